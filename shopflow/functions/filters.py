"""Row conditions shared by the analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where(df: DataFrame, cond: Column | None) -> DataFrame:
    """``df`` filtered by ``cond``, or ``df`` itself when there is no condition."""
    return df if cond is None else df.filter(cond)


def url_is(urls) -> Column:
    """The page view's url is ``urls`` (one url) or one of ``urls`` (a list)."""
    if isinstance(urls, str):
        return F.col("pageview_url") == F.lit(urls)
    return F.col("pageview_url").isin(list(urls))
