"""Safe ratios and exact rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num, den) -> Column:
    """``num / den`` as ``double``; NULL when ``den`` is 0 or NULL."""
    n = F.col(num) if isinstance(num, str) else num
    d = F.col(den) if isinstance(den, str) else den
    return F.try_divide(n.cast("double"), d.cast("double"))


def round_avg_half_up(total, count, digits: int = 1) -> Column:
    """``round(total / count, digits)`` for non-negative integer sums, exact.

    The average of integers is rounded half up on its exact rational value
    (not on a binary double), so 1.15 becomes 1.2 in every engine.
    """
    t = F.col(total) if isinstance(total, str) else total
    c = F.col(count) if isinstance(count, str) else count
    scale = 10 ** digits
    num = t.cast("long") * (2 * scale) + c
    den = c.cast("long") * 2
    # exact floor division of integers: (num - num mod den) is a multiple of den
    quotient = (num - F.pmod(num, den)) / den
    return F.when(c > 0, F.round(quotient, 0) / scale)
