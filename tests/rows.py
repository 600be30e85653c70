"""Hand-made rows in the shape of the five base tables."""

import datetime as dt
from decimal import Decimal

from shopflow.sources.schema import ORDERS, WEBSITE_PAGEVIEWS, WEBSITE_SESSIONS


def ts(s):
    return dt.datetime.fromisoformat(s)


def sessions(spark, rows):
    """rows: (id, created_at, user, repeat, source, campaign, device, referer)"""
    return spark.createDataFrame([(r[0], ts(r[1]), *r[2:]) for r in rows], WEBSITE_SESSIONS)


def pageviews(spark, rows):
    """rows: (pv id, created_at, session id, url)"""
    return spark.createDataFrame([(r[0], ts(r[1]), r[2], r[3]) for r in rows], WEBSITE_PAGEVIEWS)


def orders(spark, rows):
    """rows: (order id, created_at, session id, product, items, price)"""
    return spark.createDataFrame(
        [(r[0], ts(r[1]), r[2], r[3], r[4], Decimal(str(r[5])), Decimal(str(r[5])) * Decimal("0.4"))
         for r in rows], ORDERS)
