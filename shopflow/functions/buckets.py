"""Time buckets and period bounds on ``timestamp_ntz`` columns.

Bounds are text dates or datetimes compared with the column as
``timestamp_ntz``: ``'2024-01-05'`` means midnight, so a closed range
``between(c, '2024-01-01', '2024-01-05')`` keeps only the first instant of
its last day, as the SQL ``BETWEEN`` on a datetime does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(value) -> Column:
    """A literal instant as ``timestamp_ntz``."""
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("timestamp_ntz")


def before(col, t) -> Column:
    return F.col(col) < at(t) if isinstance(col, str) else col < at(t)


def after(col, t) -> Column:
    return F.col(col) > at(t) if isinstance(col, str) else col > at(t)


def between(col, lo, hi) -> Column:
    """Closed range ``lo <= col <= hi``."""
    c = F.col(col) if isinstance(col, str) else col
    return c.between(at(lo), at(hi))


def sunday_week(col) -> Column:
    """Sunday that starts the week holding ``col`` (a ``date``).

    Weeks start on Sunday and a week across new year stays whole, so this
    is a grouping key equivalent to a Sunday-based year-week number.
    """
    c = F.col(col) if isinstance(col, str) else col
    return F.date_sub(F.next_day(F.to_date(c), "Sun"), 7)


def bucket_columns(col, grain: str) -> list[Column]:
    """Grouping columns for a calendar grain, each with its output name.

    ``day`` -> ``dt``; ``week`` -> ``wk_start`` (Sunday);
    ``month`` -> ``yr, mo``; ``quarter`` -> ``yr, qtr``; ``year`` -> ``yr``.
    """
    c = F.col(col) if isinstance(col, str) else col
    if grain == "day":
        return [F.to_date(c).alias("dt")]
    if grain == "week":
        return [sunday_week(c).alias("wk_start")]
    if grain == "month":
        return [F.year(c).alias("yr"), F.month(c).alias("mo")]
    if grain == "quarter":
        return [F.year(c).alias("yr"), F.quarter(c).alias("qtr")]
    if grain == "year":
        return [F.year(c).alias("yr")]
    raise ValueError(f"unknown grain {grain!r}")


def bucket_names(grain: str) -> list[str]:
    return {"day": ["dt"], "week": ["wk_start"], "month": ["yr", "mo"],
            "quarter": ["yr", "qtr"], "year": ["yr"]}[grain]


def period_label(col, cut, before_label: str, after_label: str,
                 other_label: str = "other", after_inclusive: bool = True) -> Column:
    """Label rows before or after ``cut``.

    ``after_inclusive=True`` puts the cut instant itself after; with
    ``False`` the instant gets ``other_label`` (both forms are used).
    """
    c = F.col(col) if isinstance(col, str) else col
    late = c >= at(cut) if after_inclusive else c > at(cut)
    return (F.when(c < at(cut), F.lit(before_label))
            .when(late, F.lit(after_label))
            .otherwise(F.lit(other_label)))
