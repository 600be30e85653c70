"""The web-shop test tables as DuckDB common table expressions.

Written directly from the fixture rules (one ordered window per user), not
from the Spark code, so a mismatch shows up in the comparison.
"""

CLICK = """
ev_k AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_ts
  FROM events
), ev_start AS (
  SELECT *, (user_id IS NULL OR prev_ts IS NULL OR ts > prev_ts + INTERVAL 12 HOUR) AS is_start FROM ev_k
), ev_tagged AS (
  SELECT *, last_value(CASE WHEN is_start THEN event_id END IGNORE NULLS) OVER (
              PARTITION BY user_id ORDER BY ts, event_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS website_session_id
  FROM ev_start
), website_sessions AS (
  SELECT event_id AS website_session_id, ts AS created_at, user_id,
         CAST(CASE WHEN user_id IS NULL OR prev_ts IS NULL THEN 0 ELSE 1 END AS INTEGER) AS is_repeat_session,
         CASE WHEN k < 50 THEN 'gsearch' WHEN k < 70 THEN 'bsearch'
              WHEN k < 75 THEN 'socialbook' END AS utm_source,
         CASE WHEN k < 70 THEN (CASE WHEN k % 5 = 0 THEN 'brand' ELSE 'nonbrand' END)
              WHEN k < 75 THEN 'pilot' END AS utm_campaign,
         CASE WHEN k % 3 = 0 THEN 'mobile' ELSE 'desktop' END AS device_type,
         CASE WHEN k < 50 THEN 'https://www.gsearch.com' WHEN k < 70 THEN 'https://www.bsearch.com'
              WHEN k < 75 THEN 'https://www.socialbook.com' WHEN k < 82 THEN 'https://www.gsearch.com'
              WHEN k < 88 THEN 'https://www.bsearch.com' END AS http_referer
  FROM ev_tagged WHERE is_start
), website_pageviews AS (
  SELECT event_id AS website_pageview_id, ts AS created_at, website_session_id,
         event_type AS pageview_url
  FROM ev_tagged
), web_orders AS (
  SELECT event_id AS order_id, ts AS created_at, website_session_id,
         CAST(k % 4 + 1 AS BIGINT) AS primary_product_id,
         CAST(k % 3 + 1 AS INTEGER) AS items_purchased,
         CAST(value AS DECIMAL(18,2)) AS price_usd,
         CAST(CAST(value AS DECIMAL(18,2)) * CAST(0.40 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS cogs_usd
  FROM ev_tagged WHERE event_type = 'purchase'
)"""

COMMERCE = """
shop_items AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice,
         l.l_returnflag, o.o_orderdate AS created_at, l.l_orderkey AS order_id,
         p.p_type AS product_id,
         CAST(CASE WHEN row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber,
              l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice) = 1 THEN 1 ELSE 0 END
              AS INTEGER) AS is_primary_item,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) AS price_usd,
         CAST(l.l_quantity * p.p_retailprice AS DECIMAL(18,2)) AS cogs_usd
  FROM lineitem l
  JOIN orders o ON o.o_orderkey = l.l_orderkey
  JOIN part p ON p.p_partkey = l.l_partkey
), shop_orders AS (
  SELECT o.o_orderkey AS order_id, o.o_orderdate AS created_at,
         a.primary_product_id, CAST(coalesce(a.items_purchased, 0) AS INTEGER) AS items_purchased,
         a.price_usd, a.cogs_usd
  FROM orders o LEFT JOIN (
    SELECT order_id, max(CASE WHEN is_primary_item = 1 THEN product_id END) AS primary_product_id,
           count(*) AS items_purchased,
           CAST(sum(price_usd) AS DECIMAL(18,2)) AS price_usd,
           CAST(sum(cogs_usd) AS DECIMAL(18,2)) AS cogs_usd
    FROM shop_items GROUP BY order_id) a ON a.order_id = o.o_orderkey
), shop_refunds AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, order_id
  FROM shop_items WHERE l_returnflag = 'R'
)"""


def click(body: str) -> str:
    """A query over the clickstream tables: ``body`` may start with more CTEs
    (``name AS (...), ...`` followed by ``SELECT``) or be a plain SELECT."""
    return _with(CLICK, body)


def commerce(body: str) -> str:
    return _with(COMMERCE, body)


def _with(ctes: str, body: str) -> str:
    body = body.strip()
    if body.upper().startswith("SELECT"):
        return f"WITH {ctes.strip()}\n{body}"
    return f"WITH {ctes.strip()},\n{body}"
