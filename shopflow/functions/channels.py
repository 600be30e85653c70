"""Traffic channel conditions on session columns.

Fixed values: the referers counted as organic search in the
"referer in list" definition, and the channel group labels.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
SEARCH_REFERERS = ("https://www.gsearch.com", "https://www.bsearch.com")
CHANNEL_GROUPS = ("organic_search", "direct_type_in", "paid_brand",
                  "paid_nonbrand", "paid_social")


def src(name: str) -> Column:
    return F.col("utm_source") == F.lit(name)


def campaign(name: str) -> Column:
    return F.col("utm_campaign") == F.lit(name)


def is_direct() -> Column:
    return F.col("utm_source").isNull() & F.col("http_referer").isNull()


def is_organic(organic="any_referer") -> Column:
    """Organic search: no paid source and a referer.

    ``organic="any_referer"`` accepts any non-null referer; a list of URLs
    accepts only those referers.
    """
    if organic == "any_referer":
        return F.col("utm_source").isNull() & F.col("http_referer").isNotNull()
    return F.col("utm_source").isNull() & F.col("http_referer").isin(list(organic))


def channel_group(organic=SEARCH_REFERERS) -> Column:
    """First matching channel group of a session, NULL when none matches."""
    return (F.when(is_organic(organic), F.lit("organic_search"))
            .when(is_direct(), F.lit("direct_type_in"))
            .when(campaign("brand"), F.lit("paid_brand"))
            .when(campaign("nonbrand"), F.lit("paid_nonbrand"))
            .when(src("socialbook"), F.lit("paid_social")))
