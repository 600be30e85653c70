"""DuckDB SQL for each registered query, over the raw test tables.

Each query states the analysis directly in SQL, independently of the
Spark code: distinct counts over the row-level joins, staged steps as
common table expressions. Shared conventions with the Spark side: ratios
are ``double`` and NULL for a zero denominator, money sums ``double``,
year / month / quarter / hour ``integer``, integer sums ``bigint``.
"""

from oracle.fixtures import click, commerce

SQL: dict[str, str] = {}

CUT = "2024-01-27"


def bucket(col: str, grain: str) -> str:
    """Select list of a calendar grain, named as on the Spark side."""
    return {
        "day": f"cast({col} as date) as dt",
        "week": f"cast({col} as date) - cast(dayofweek({col}) as integer) as wk_start",
        "month": f"cast(year({col}) as integer) as yr, cast(month({col}) as integer) as mo",
        "quarter": f"cast(year({col}) as integer) as yr, cast(quarter({col}) as integer) as qtr",
    }[grain]


def div(a: str, b: str) -> str:
    return f"cast({a} as double) / nullif(cast({b} as double), 0)"


def ts(t: str) -> str:
    return f"timestamp '{t}'"


# sessions with their orders, one row per (session, order or none)
SO = "website_sessions s left join web_orders o on o.website_session_id = s.website_session_id"

# --- traffic and channels ---------------------------------------------------

SQL["volume_trend"] = click(f"""
select {bucket('s.created_at', 'day')},
       count(distinct s.website_session_id) as sessions,
       count(distinct o.order_id) as orders
from {SO}
where s.created_at < {ts(CUT)} and s.utm_source = 'gsearch'
group by all""")

SQL["volume_trend_sessions_with_order"] = click(f"""
select {bucket('s.created_at', 'week')},
       count(distinct s.website_session_id) as sessions_volume,
       count(distinct o.website_session_id) as order_volume
from {SO}
group by all""")


def _pair(col, values, where):
    cols = []
    for v in values:
        cols.append(f"count(distinct s.website_session_id) filter (where s.{col} = '{v}') as {v}_sessions")
        cols.append(f"count(distinct o.order_id) filter (where s.{col} = '{v}') as {v}_orders")
    return click(f"""
select {bucket('s.created_at', 'day')}, {", ".join(cols)}
from {SO}
where {where}
group by all""")


SQL["segment_trend"] = _pair("utm_campaign", ["nonbrand", "brand"],
                             f"s.created_at < {ts(CUT)} and s.utm_source = 'gsearch'")
SQL["segment_trend_device"] = _pair("device_type", ["mobile", "desktop"],
                                    f"s.created_at < {ts(CUT)} and s.utm_source = 'gsearch' "
                                    f"and s.utm_campaign = 'nonbrand'")

SQL["distinct_values"] = click("select distinct utm_source from website_sessions")
SQL["distinct_values_rows"] = click("select distinct * from website_sessions")
SQL["distinct_values_triples"] = click(f"""
select distinct utm_source, utm_campaign, http_referer
from website_sessions where created_at < {ts(CUT)}""")

SQL["channel_mix_trend"] = click(f"""
select {bucket('created_at', 'day')},
  count(*) filter (where utm_source = 'gsearch') as gsearch_paid_sessions,
  count(*) filter (where utm_source = 'bsearch') as bsearch_paid_sessions,
  count(*) filter (where utm_source is null and http_referer is not null) as organic_search_sessions,
  count(*) filter (where utm_source is null and http_referer is null) as direct_type_in_sessions
from website_sessions
where created_at < {ts(CUT)}
group by all""")

SEARCH = "('https://www.gsearch.com', 'https://www.bsearch.com')"
SQL["direct_brand_vs_nonbrand"] = click(f"""
c as (
  select {bucket('created_at', 'week')},
    count(*) filter (where utm_campaign = 'nonbrand') as nonbrand,
    count(*) filter (where utm_campaign = 'brand') as brand,
    count(*) filter (where utm_source is null and http_referer is null) as direct,
    count(*) filter (where utm_source is null and http_referer in {SEARCH}) as organic
  from website_sessions
  where created_at < {ts('2024-01-23')}
  group by all
)
select wk_start, nonbrand, brand, {div('brand', 'nonbrand')} as brand_pct_of_nonbrand,
       direct, {div('direct', 'nonbrand')} as direct_pct_of_nonbrand,
       organic, {div('organic', 'nonbrand')} as organic_pct_of_nonbrand
from c""")

SQL["conversion_trend"] = click(f"""
select {bucket('s.created_at', 'day')},
       count(distinct s.website_session_id) as sessions,
       count(distinct o.order_id) as orders,
       {div('count(distinct o.order_id)', 'count(distinct s.website_session_id)')} as conversion_rate
from {SO}
where s.created_at < {ts(CUT)}
group by all""")

SQL["efficiency_trend"] = click(f"""
c as (
  select {bucket('s.created_at', 'week')},
         count(distinct s.website_session_id) as n_s,
         count(distinct o.website_session_id) as n_o,
         cast(sum(o.price_usd) as double) as rev
  from {SO}
  group by all
)
select wk_start, {div('n_o', 'n_s')} as sessions_to_order_conv_rate,
       {div('rev', 'n_o')} as rev_per_order, {div('rev', 'n_s')} as rev_per_session
from c""")

CHANNELS = [
    ("gsearch_nonbrand", "s.utm_source = 'gsearch' and s.utm_campaign = 'nonbrand'"),
    ("bsearch_nonbrand", "s.utm_source = 'bsearch' and s.utm_campaign = 'nonbrand'"),
    ("brand", "s.utm_campaign = 'brand'"),
    ("organic_search", "s.utm_source is null and s.http_referer is not null"),
    ("direct_type_in", "s.utm_source is null and s.http_referer is null"),
]
SQL["orders_by_channel"] = click(f"""
select {bucket('s.created_at', 'week')},
  {", ".join(f"count(distinct o.order_id) filter (where {c}) as {'brandsearch_overall' if n == 'brand' else n}"
             for n, c in CHANNELS)}
from {SO}
group by all""")

SQL["conversion_by_channel"] = click(f"""
c as (
  select {bucket('s.created_at', 'week')},
    {", ".join(f"count(distinct o.order_id) filter (where {c}) as o_{n}, "
               f"count(distinct s.website_session_id) filter (where {c}) as s_{n}" for n, c in CHANNELS)}
  from {SO}
  group by all
)
select wk_start, {", ".join(f"{div('o_' + n, 's_' + n)} as {'brand_search' if n == 'brand' else n}_conv_rt"
                            for n, _ in CHANNELS)}
from c
order by wk_start""")

SQL["channel_characteristics"] = click(f"""
select utm_source, count(*) as sessions,
       count(*) filter (where device_type = 'mobile') as mobile_sessions,
       {div("count(*) filter (where device_type = 'mobile')", 'count(*)')} as pct_mobile
from website_sessions
where utm_campaign = 'nonbrand' and created_at > {ts('2024-01-05')} and created_at < {ts('2024-01-25')}
group by utm_source""")

SQL["conversion_by"] = click(f"""
select s.device_type, s.utm_source,
       count(distinct s.website_session_id) as sessions, count(distinct o.order_id) as orders,
       {div('count(distinct o.order_id)', 'count(distinct s.website_session_id)')} as conv_rate
from {SO}
where s.utm_source in ('gsearch', 'bsearch') and s.utm_campaign = 'nonbrand'
  and s.created_at > {ts('2024-01-05')} and s.created_at < {ts('2024-01-20')}
group by all""")


def _dev(source, device):
    return f"count(*) filter (where utm_source = '{source}' and device_type = '{device}')"


SQL["weekly_portfolio"] = click(f"""
c as (
  select cast(created_at as date) - cast(dayofweek(created_at) as integer) as sunday,
         min(cast(created_at as date)) as week_start,
         {_dev('gsearch', 'desktop')} as g_dtop_session, {_dev('bsearch', 'desktop')} as b_dtop_session,
         {_dev('gsearch', 'mobile')} as g_mob_session, {_dev('bsearch', 'mobile')} as b_mob_session
  from website_sessions
  where utm_campaign = 'nonbrand' and created_at > {ts('2024-01-04')} and created_at < {ts('2024-01-29')}
  group by sunday
)
select week_start, g_dtop_session, b_dtop_session, {div('b_dtop_session', 'g_dtop_session')} as b_pct_of_g_dtop,
       g_mob_session, b_mob_session, {div('b_mob_session', 'g_mob_session')} as b_pct_of_g_mob
from c""")

WEEKDAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]


def _avg_half_up(day: int) -> str:
    # the exact average of integers, rounded half up to one decimal with integer arithmetic
    t = f"sum(n) filter (where dow = {day})"
    k = f"count(*) filter (where dow = {day})"
    return f"case when {k} > 0 then cast((20 * {t} + {k}) // (2 * {k}) as double) / 10 end"


SQL["hour_by_weekday"] = click(f"""
cells as (
  select cast(created_at as date) as d, cast(hour(created_at) as integer) as hr,
         cast(isodow(created_at) - 1 as integer) as dow, count(*) as n
  from website_sessions
  where created_at between {ts('2024-01-03')} and {ts('2024-01-28')}
  group by all
)
select hr, {", ".join(f"{_avg_half_up(i)} as {d}" for i, d in enumerate(WEEKDAYS))}
from cells
group by hr""")


# --- pages, landing pages, bounce --------------------------------------------

def test_views(cond: str) -> str:
    """Page views of gsearch nonbrand sessions meeting ``cond`` (CTE ``tv``)."""
    return f"""tv as (
  select v.* from website_pageviews v
  where v.website_session_id in (
    select website_session_id from website_sessions
    where utm_source = 'gsearch' and utm_campaign = 'nonbrand' and {cond})
)"""


TV = test_views(f"created_at < {ts('2024-01-28')}")

SQL["first_seen"] = click(f"""{TV}
select min(cast(created_at as date)) as first_date, min(website_pageview_id) as first_pv_id
from tv where pageview_url = 'signup'""")

SQL["first_seen_row"] = click("""
select created_at as first_created_at, website_pageview_id as first_pv_id
from website_pageviews where pageview_url = 'signup'
order by created_at, website_pageview_id limit 1""")

LAST_VIEW = f"""
select max(s.website_session_id) as last_session_id
from website_sessions s join website_pageviews v on v.website_session_id = s.website_session_id
where s.utm_source = 'gsearch' and s.utm_campaign = 'nonbrand' and v.pageview_url = 'view'
  and s.created_at < {ts(CUT)}"""
SQL["last_seen"] = click(LAST_VIEW)

SQL["sessions_since"] = click(f"""
select count(*) as sessions_since_test
from website_sessions
where utm_source = 'gsearch' and utm_campaign = 'nonbrand' and created_at < {ts(CUT)}
  and website_session_id > ({LAST_VIEW})""")

SQL["top_pages"] = click(f"""
select pageview_url, count(distinct website_pageview_id) as sessions
from website_pageviews where created_at < {ts('2024-01-09')}
group by pageview_url order by sessions desc""")

SQL["first_pageview"] = click(f"""
select website_session_id, min(website_pageview_id) as min_pageview_id
from website_pageviews where created_at < {ts('2024-01-12')}
group by website_session_id""")


def landings(until: str) -> str:
    """``entry``: each session's first view before ``until`` and its url;
    ``single``: entries whose session has one view in all."""
    return f"""entry_id as (
  select website_session_id, min(website_pageview_id) as first_id
  from website_pageviews where created_at < {ts(until)}
  group by website_session_id
), entry as (
  select e.website_session_id, v.pageview_url as url
  from entry_id e join website_pageviews v on v.website_pageview_id = e.first_id
), single as (
  select e.website_session_id, e.url as land, count(v.website_pageview_id) as pgv
  from entry e join website_pageviews v on v.website_session_id = e.website_session_id
  group by all
  having count(v.website_pageview_id) = 1
)"""


SQL["landing_page"] = click(f"""{landings('2024-01-14')}
select website_session_id, url as landing_page from entry""")

SQL["top_entry_pages"] = click(f"""{landings('2024-01-12')}
select url as landing_page, count(distinct website_session_id) as sessions_hitting_this_landing_page
from entry group by url""")

SQL["bounced_sessions"] = click(f"""{landings('2024-01-14')}
select website_session_id, land, pgv from single""")

SQL["bounce_rate"] = click(f"""{landings('2024-01-14')}
select count(e.website_session_id) as sessions, count(b.website_session_id) as bounced_sessions,
       {div('count(b.website_session_id)', 'count(e.website_session_id)')} as bounce_rate
from entry e left join single b on b.website_session_id = e.website_session_id""")

# the first lander view at or after the first 'signup' view of the test sessions
SQL["bounce_rate_by_landing"] = click(f"""{TV},
lander_entry as (
  select website_session_id, arg_min(pageview_url, website_pageview_id) as land
  from tv
  where pageview_url in ('view', 'signup')
    and website_pageview_id >= (select min(website_pageview_id) from tv where pageview_url = 'signup')
  group by website_session_id
), views_per_session as (
  select website_session_id, count(*) as n from tv group by website_session_id
)
select l.land, count(*) as sessions, count(*) filter (where p.n = 1) as bounced_sessions,
       {div('count(*) filter (where p.n = 1)', 'count(*)')} as bounce_rate
from lander_entry l join views_per_session p on p.website_session_id = l.website_session_id
group by l.land""")

TREND = test_views(f"created_at < {ts('2024-01-31')} and created_at >= {ts('2024-01-01')}")
SUNDAY = "cast({c} as date) - cast(dayofweek({c}) as integer)"

# one landing row per session (its first lander view), totals and bounced per lander
SQL["weekly_bounce_trend"] = click(f"""{TREND},
first_lander as (
  select website_session_id, min(website_pageview_id) as id
  from tv where pageview_url in ('view', 'signup') group by website_session_id
), rows_ as (
  select f.website_session_id, v.pageview_url as land, v.created_at,
         (select count(*) from tv t where t.website_session_id = f.website_session_id) = 1 as bounced
  from first_lander f join website_pageviews v on v.website_pageview_id = f.id
)
select min(cast(created_at as date)) as week_start_date,
  count(*) as sessions, count(*) filter (where bounced) as bounced_sessions,
  {div('count(*) filter (where bounced)', 'count(*)')} as bounce_rate,
  count(*) filter (where land = 'view') as home_sessions,
  count(*) filter (where land = 'view' and bounced) as home_bounced,
  count(*) filter (where land = 'signup') as lander_sessions,
  count(*) filter (where land = 'signup' and bounced) as lander_bounced
from rows_
group by {SUNDAY.format(c='created_at')}""")

# the original form: one landing row per (session, lander view time)
SQL["weekly_bounce_trend_legacy"] = click(f"""{TREND},
land_rows as (
  select t.website_session_id, t.created_at, v.pageview_url as land
  from (select website_session_id, created_at, min(website_pageview_id) as id
        from tv where pageview_url in ('view', 'signup') group by all) t
  join website_pageviews v on v.website_pageview_id = t.id
), bounced as (
  select r.website_session_id, r.land
  from land_rows r join tv on tv.website_session_id = r.website_session_id
  group by all having count(tv.website_pageview_id) = 1
)
select min(cast(r.created_at as date)) as week_start_date,
  {div('count(b.website_session_id)', 'count(r.website_session_id)')} as bounce_rate,
  count(distinct b.website_session_id) filter (where r.land = 'view') as home_sessions,
  count(distinct b.website_session_id) filter (where r.land = 'signup') as lander_sessions
from land_rows r left join bounced b on b.website_session_id = r.website_session_id
group by {SUNDAY.format(c='r.created_at')}""")

SQL["qualifying_pageviews"] = click(f"""{TV}
select website_pageview_id, created_at, website_session_id, pageview_url from tv""")


# --- tests and funnels -------------------------------------------------------

TEST_CONV = f"""entry as (
  select v.website_session_id, arg_min(v.pageview_url, v.website_pageview_id) as landing_page
  from website_pageviews v join website_sessions s on s.website_session_id = v.website_session_id
  where s.created_at < {ts('2024-01-28')} and s.utm_source = 'gsearch' and s.utm_campaign = 'nonbrand'
    and v.website_pageview_id >= (select min(website_pageview_id) from website_pageviews
                                  where pageview_url = 'signup')
  group by v.website_session_id
), conv as (
  select e.landing_page, count(distinct e.website_session_id) as sessions,
         count(distinct o.order_id) as orders,
         {div('count(distinct o.order_id)', 'count(distinct e.website_session_id)')} as conv_rate
  from entry e left join web_orders o on o.website_session_id = e.website_session_id
  where e.landing_page in ('view', 'signup')
  group by e.landing_page
)"""

SQL["conversion_by_landing"] = click(f"""{TEST_CONV}
select landing_page, sessions, orders, conv_rate from conv""")

SQL["landing_test_lift"] = click(f"""{TEST_CONV},
rates as (
  select max(conv_rate) filter (where landing_page = 'view') as control_conv_rate,
         max(conv_rate) filter (where landing_page = 'signup') as test_conv_rate
  from conv
), last_control as ({LAST_VIEW}
), since as (
  select count(*) as n from website_sessions
  where utm_source = 'gsearch' and utm_campaign = 'nonbrand' and created_at < {ts(CUT)}
    and website_session_id > (select last_session_id from last_control)
)
select control_conv_rate, test_conv_rate, test_conv_rate - control_conv_rate as lift,
       (select last_session_id from last_control) as last_control_session_id,
       (select n from since) as sessions_since_test,
       (test_conv_rate - control_conv_rate) * (select n from since) as extra_orders
from rates""")

STEPS = ["view", "click", "signup", "purchase"]


def flags(lo: str, hi: str, segments: bool = True) -> str:
    cols = [("saw_view", "view"), ("saw_signup", "signup")] if segments else []
    cols += [(f"{p}_made_it", p) for p in STEPS]
    sel = ", ".join(f"cast(coalesce(max(case when v.pageview_url = '{u}' then 1 else 0 end), 0) as integer) as {c}"
                    for c, u in cols)
    return f"""fl as (
  select s.website_session_id, {sel}
  from website_sessions s left join website_pageviews v on v.website_session_id = s.website_session_id
  where s.utm_source = 'gsearch' and s.utm_campaign = 'nonbrand'
    and s.created_at > {ts(lo)} and s.created_at < {ts(hi)}
  group by s.website_session_id
)"""


SQL["funnel_flags"] = click(f"""{flags('2024-01-05', '2024-01-28')}
select * from fl""")

SQL["funnel_counts"] = click(f"""{flags('2024-01-05', '2024-01-25', False)}
select count(*) as sessions,
  {", ".join(f"count(*) filter (where {p}_made_it = 1) as to_{p}" for p in STEPS)}
from fl""")

SEGMENT = ("case when saw_view = 1 then 'saw_view' when saw_signup = 1 then 'saw_signup' "
           "else '{other}' end")

SQL["funnel_counts_by_segment"] = click(f"""{flags('2024-01-05', '2024-01-28')}
select {SEGMENT.format(other='other')} as segment, count(*) as sessions,
  {", ".join(f"count(*) filter (where {p}_made_it = 1) as to_{p}" for p in STEPS[1:])}
from fl group by 1""")


def _n(p):
    return f"count(*) filter (where {p}_made_it = 1)"


SQL["funnel_rates"] = click(f"""{flags('2024-01-05', '2024-01-28')}
select {SEGMENT.format(other='other')} as segment,
  {div(_n('click'), 'count(*)')} as lander_click_rt,
  {div(_n('signup'), _n('click'))} as click_click_rt,
  {div(_n('purchase'), _n('signup'))} as signup_click_rt
from fl group by 1""")

SQL["page_version_conversion"] = click(f"""
start_id as (
  select arg_min(website_pageview_id, (created_at, website_pageview_id)) as id
  from website_pageviews where pageview_url = 'signup'
)
select v.pageview_url, count(distinct v.website_session_id) as sessions,
       count(distinct o.order_id) as orders,
       {div('count(distinct o.order_id)', 'count(distinct v.website_session_id)')} as billing_to_order_rt
from website_pageviews v left join web_orders o on o.website_session_id = v.website_session_id
where v.created_at < {ts('2024-01-25')} and v.pageview_url in ('click', 'signup')
  and v.website_pageview_id >= (select id from start_id)
group by v.pageview_url""")

VERSION_REVENUE = f"""
select v.pageview_url as billing_version_seen, count(distinct v.website_session_id) as sessions,
       {div('sum(o.price_usd)', 'count(distinct v.website_session_id)')} as revenue_per_billing_page_seen
from website_pageviews v left join web_orders o on o.website_session_id = v.website_session_id
where v.created_at > {ts('2024-01-05')} and v.created_at < {ts('2024-01-25')}
  and v.pageview_url in ('click', 'signup')
group by 1"""
SQL["page_version_revenue"] = click(VERSION_REVENUE)

SQL["page_test_value"] = click(f"""rev as ({VERSION_REVENUE}
), versions as (
  select max(revenue_per_billing_page_seen) filter (where billing_version_seen = 'click') as old_rev_per_session,
         max(revenue_per_billing_page_seen) filter (where billing_version_seen = 'signup') as new_rev_per_session
  from rev
), volume as (
  select count(website_session_id) as billing_pageviews, count(distinct website_session_id) as billing_sessions
  from website_pageviews
  where pageview_url in ('click', 'signup') and created_at between {ts('2024-01-20')} and {ts('2024-01-27')}
)
select old_rev_per_session, new_rev_per_session, new_rev_per_session - old_rev_per_session as lift,
       billing_pageviews, billing_sessions,
       (new_rev_per_session - old_rev_per_session) * billing_pageviews as test_value
from versions, volume""")

SQL["sessions_detail"] = click(f"""
select * from website_pageviews where website_session_id > ({LAST_VIEW})""")


# --- products ----------------------------------------------------------------

PTYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def _sales(grain: str, where: str = "") -> str:
    return commerce(f"""
select {bucket('created_at', grain)}, count(distinct order_id) as number_of_sales,
       cast(sum(price_usd) as double) as total_revenue,
       cast(sum(price_usd - cogs_usd) as double) as total_margin
from shop_orders {where}
group by all""")


SQL["sales_trend"] = _sales("month", f"where created_at < {ts('2001-01-04')}")
SQL["sales_trend_quarterly"] = _sales("quarter")


def _launch(per_session_money: str) -> str:
    # the denominator counts rows of the session-order join, as the original does
    return click(f"""
select {bucket('s.created_at', 'week')}, count(distinct o.order_id) as orders,
       {div('count(distinct o.order_id)', 'count(s.website_session_id)')} as conv_rate,
       {div(per_session_money, 'count(s.website_session_id)')} as revenue_per_session,
       count(distinct o.order_id) filter (where o.primary_product_id = 1) as product_1_orders,
       count(distinct o.order_id) filter (where o.primary_product_id = 2) as product_2_orders
from {SO}
where s.created_at between {ts('2024-01-02')} and {ts('2024-01-29')}
group by all""")


SQL["launch_trend"] = _launch("sum(o.price_usd)")
SQL["launch_trend_legacy"] = _launch("count(o.price_usd)")

SQL["product_revenue_trend"] = commerce(f"""
select {bucket('created_at', 'month')},
  {", ".join(f"cast(sum(price_usd) filter (where product_id = '{p}') as double) as {p.lower()}_rev, "
             f"cast(sum(price_usd - cogs_usd) filter (where product_id = '{p}') as double) as {p.lower()}_marg"
             for p in PTYPES)},
  cast(sum(price_usd) as double) as total_revenue,
  cast(sum(price_usd - cogs_usd) as double) as total_margin
from shop_items
group by all
order by yr, mo""")

ANCHORS = f"""anchors as (
  select website_session_id, website_pageview_id, created_at,
         case when created_at < {ts('2024-01-16')} then 'pre_product_2'
              when created_at >= {ts('2024-01-16')} then 'post_product_2'
              else 'other' end as time_period
  from website_pageviews
  where pageview_url = 'view' and created_at between {ts('2024-01-06')} and {ts('2024-01-27')}
), nxt as (
  select a.time_period, a.website_session_id, min(v.website_pageview_id) as next_id
  from anchors a
  left join website_pageviews v
    on v.website_session_id = a.website_session_id and v.website_pageview_id > a.website_pageview_id
  group by all
), nxt_url as (
  select n.time_period, n.website_session_id, n.next_id as min_next_pageview_id, v.pageview_url
  from nxt n left join website_pageviews v on v.website_pageview_id = n.next_id
)"""

SQL["period_tag"] = click(f"""{ANCHORS}
select website_session_id, website_pageview_id, created_at, time_period from anchors""")

SQL["next_pageview"] = click(f"""{ANCHORS}
select time_period, website_session_id, min_next_pageview_id, pageview_url from nxt_url""")


def _share(cond: str) -> str:
    return div(f"count(*) filter (where {cond})", "count(*)")


SQL["pathing_summary"] = click(f"""{ANCHORS}
select time_period, count(*) as sessions,
  count(*) filter (where min_next_pageview_id is not null) as w_next_pg,
  {_share('min_next_pageview_id is not null')} as pct_w_next_pg,
  count(*) filter (where pageview_url = 'click') as to_click, {_share("pageview_url = 'click'")} as pct_to_click,
  count(*) filter (where pageview_url = 'signup') as to_signup, {_share("pageview_url = 'signup'")} as pct_to_signup
from nxt_url group by time_period""")

SQL["pages_after"] = click(f"""
product_views as (
  select website_session_id, website_pageview_id from website_pageviews
  where pageview_url in ('click', 'signup') and created_at between {ts('2024-01-06')} and {ts('2024-01-20')}
)
select distinct v.pageview_url
from product_views p
left join website_pageviews v
  on v.website_session_id = p.website_session_id and v.website_pageview_id > p.website_pageview_id""")

PFUNNEL = f"""marks as (
  select website_session_id,
         max(case when pageview_url = 'view' then 1 end) as m_view,
         max(case when pageview_url = 'purchase' then 1 end) as m_purchase
  from website_pageviews
  where created_at between {ts('2024-01-06')} and {ts('2024-01-20')}
  group by website_session_id
), product_rows as (
  select v.pageview_url as product_seen, m.website_session_id, m.m_view, m.m_purchase
  from marks m join website_pageviews v on v.website_session_id = m.website_session_id
  where v.pageview_url in ('click', 'signup')
)"""

SQL["product_funnel_counts"] = click(f"""{PFUNNEL}
select product_seen, count(distinct website_session_id) as sessions,
       count(m_view) as to_view, count(m_purchase) as to_purchase
from product_rows group by product_seen""")

SQL["product_funnel_rates"] = click(f"""{PFUNNEL}
select product_seen, count(distinct website_session_id) as sessions,
       {div('count(m_view)', 'count(distinct website_session_id)')} as product_page_click_rt,
       {div('count(m_purchase)', 'count(m_view)')} as view_click_rt
from product_rows group by product_seen""")

SQL["listing_page_trend"] = click(f"""
listing as (
  select website_pageview_id, website_session_id, created_at from website_pageviews where pageview_url = 'view'
)
select {bucket('l.created_at', 'week')},
       count(distinct l.website_session_id) as sessions_to_product,
       {div('count(distinct v.website_session_id)', 'count(distinct l.website_session_id)')} as click_thro_rate,
       {div('count(distinct o.order_id)', 'count(distinct l.website_session_id)')} as conversion_rate
from listing l
left join website_pageviews v
  on v.website_session_id = l.website_session_id and v.website_pageview_id > l.website_pageview_id
left join web_orders o on o.website_session_id = l.website_session_id
group by all""")

def cart(late: str) -> str:
    """``carts``: cart views by period (``late``: how a view compares with the cut to count as after it);
    ``after_cart``: per period and session the first view after a cart view."""
    return f"""carts as (
  select website_pageview_id, website_session_id,
         case when created_at < {ts('2024-01-16')} then 'A.pre_cross_sell'
              when created_at {late} {ts('2024-01-16')} then 'B.post_cross_sell'
              else 'other' end as time_period
  from website_pageviews
  where pageview_url = 'click' and created_at between {ts('2024-01-06')} and {ts('2024-01-26')}
), after_cart as (
  select c.time_period, c.website_session_id, min(v.website_pageview_id) as after_cart_pageview_id
  from carts c
  join website_pageviews v
    on v.website_session_id = c.website_session_id and v.website_pageview_id > c.website_pageview_id
  group by all
)"""

CART = cart(">=")
SQL["clickthrough_after"] = click(f"""{CART}
select time_period, website_session_id, after_cart_pageview_id from after_cart""")

# the original's rows: every cart view x every click-through row of the session x
# every (click-through row, order) pair of the session
SQL["cross_sell_period_summary_legacy"] = click(f"""{cart(">")},
cart_orders as (
  select a.website_session_id, o.order_id, o.items_purchased, o.price_usd
  from after_cart a left join web_orders o on o.website_session_id = a.website_session_id
), expanded as (
  select c.time_period, c.website_session_id,
         case when a.website_session_id is null then 0 else 1 end as clicked_on,
         case when co.order_id is null then 0 else 1 end as ordered,
         co.items_purchased, co.price_usd
  from carts c
  left join after_cart a on a.website_session_id = c.website_session_id
  left join cart_orders co on co.website_session_id = c.website_session_id
)
select time_period, count(distinct website_session_id) as sessions,
  cast(sum(clicked_on) as bigint) as clickthroughs,
  {div('sum(clicked_on)', 'count(distinct website_session_id)')} as cart_ctr,
  {div('sum(items_purchased)', 'sum(ordered)')} as products_per_order,
  {div('sum(price_usd)', 'sum(ordered)')} as aov,
  {div('sum(price_usd)', 'count(distinct website_session_id)')} as rev_per_cart_session
from expanded group by time_period""")

# one row per (period, cart session); orders of the sessions that clicked through
SQL["cross_sell_period_summary"] = click(f"""{CART},
per_session as (
  select c.time_period, c.website_session_id, bool_or(a.website_session_id is not null) as clicked
  from carts c
  left join after_cart a on a.website_session_id = c.website_session_id and a.time_period = c.time_period
  group by all
), order_totals as (
  select website_session_id, count(*) as n, sum(items_purchased) as items, sum(price_usd) as rev
  from web_orders group by website_session_id
)
select p.time_period, count(*) as sessions, count(*) filter (where clicked) as clickthroughs,
  {div('count(*) filter (where clicked)', 'count(*)')} as cart_ctr,
  {div('sum(t.items) filter (where clicked)', 'coalesce(sum(t.n) filter (where clicked), 0)')} as products_per_order,
  {div('sum(t.rev) filter (where clicked)', 'coalesce(sum(t.n) filter (where clicked), 0)')} as aov,
  {div('sum(t.rev) filter (where clicked)', 'count(*)')} as rev_per_cart_session
from per_session p left join order_totals t on t.website_session_id = p.website_session_id
group by p.time_period""")

SQL["portfolio_period_summary"] = click(f"""
select case when s.created_at < {ts('2024-01-16')} then 'A.Pre_Launch'
            when s.created_at >= {ts('2024-01-16')} then 'B.Post_Launch' else 'other' end as time_period,
  {div('count(distinct o.order_id)', 'count(distinct s.website_session_id)')} as conv_rate,
  {div('sum(o.price_usd)', 'count(distinct o.order_id)')} as aov,
  {div('sum(o.items_purchased)', 'count(distinct o.order_id)')} as products_per_order,
  {div('sum(o.price_usd)', 'count(distinct s.website_session_id)')} as rev_per_session
from {SO}
where s.created_at between {ts('2024-01-02')} and {ts('2024-01-29')}
group by 1""")

SQL["cross_sell_matrix"] = commerce(f"""
recent as (select order_id, primary_product_id from shop_orders where created_at > {ts('1997-06-30')})
select r.primary_product_id,
  {", ".join(f"count(distinct r.order_id) filter (where i.product_id = '{p}') as cross_sell_{p.lower()}"
             for p in PTYPES)},
  {", ".join(div(f"count(distinct r.order_id) filter (where i.product_id = '{p}')", "count(distinct r.order_id)")
             + f" as cross_sell_{p.lower()}_rt" for p in PTYPES)}
from recent r left join shop_items i on i.order_id = r.order_id and i.is_primary_item = 0
group by r.primary_product_id""")


def _refunds(legacy: bool) -> str:
    cols = []
    for n, p in enumerate(PTYPES):
        own = f"count(distinct i.order_id) filter (where i.product_id = '{p}')"
        base = PTYPES[1] if legacy and n >= 2 else p
        den = f"count(distinct i.order_id) filter (where i.product_id = '{base}')"
        num = f"count(distinct r.order_id) filter (where i.product_id = '{p}')"
        cols.append(f"{own} as {p.lower()}_orders, {div(num, den)} as {p.lower()}_refund_rt")
    key = " and ".join(f"r.{c} = i.{c}" for c in
                       ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    return commerce(f"""
select {bucket('i.created_at', 'month')}, {", ".join(cols)}
from shop_items i left join shop_refunds r on {key}
where i.created_at < {ts('2001-01-01')}
group by all""")


SQL["refund_rate_trend"] = _refunds(False)
SQL["refund_rate_trend_legacy"] = _refunds(True)


# --- users -------------------------------------------------------------------

def _visits(hi: str) -> str:
    """``firsts``: new sessions, ``repeats``: repeat sessions, both in [2024-01-01, hi)."""
    period = f"created_at >= {ts('2024-01-01')} and created_at < {ts(hi)}"
    return f"""firsts as (
  select user_id, website_session_id as first_id, created_at as first_time from website_sessions
  where is_repeat_session = 0 and {period}
), repeats as (
  select user_id, website_session_id as repeat_id, created_at as repeat_time from website_sessions
  where is_repeat_session = 1 and {period}
)"""


PAIRS = f"""{_visits('2024-01-31')},
pairs as (
  select f.user_id, f.first_id as new_id, r.repeat_id as repeated_id
  from firsts f left join repeats r on r.user_id = f.user_id and r.repeat_id > f.first_id
)"""

SQL["repeat_sessions"] = click(f"""{PAIRS}
select user_id, new_id, repeated_id from pairs""")

SQL["repeat_histogram"] = click(f"""{PAIRS}
select repeated_sessions, count(*) as users
from (select new_id, count(repeated_id) as repeated_sessions from pairs group by new_id) per_new
group by repeated_sessions""")

NEXT_VISIT = f"""{_visits('2024-01-29')},
next_visit as (
  select f.user_id, f.first_id, min(r.repeat_id) as second_id, min(r.repeat_time) as second_time,
         f.first_time
  from firsts f left join repeats r on r.user_id = f.user_id and r.repeat_id > f.first_id
  group by f.user_id, f.first_id, f.first_time
)"""

SQL["first_to_second"] = click(f"""{NEXT_VISIT}
select user_id, first_id, second_id, second_time, first_time from next_visit""")

DAYS = "date_diff('day', cast(first_time as date), cast(second_time as date))"
SQL["time_to_repeat"] = click(f"""{NEXT_VISIT}
select cast(min({DAYS}) as integer) as min_days_first_to_second,
       cast(max({DAYS}) as integer) as max_days_first_to_second,
       avg({DAYS}) as avg_days_first_to_second
from next_visit where second_id is not null""")

CHANNEL_GROUP = f"""case
    when utm_source is null and http_referer in {SEARCH} then 'organic_search'
    when utm_source is null and http_referer is null then 'direct_type_in'
    when utm_campaign = 'brand' then 'paid_brand'
    when utm_campaign = 'nonbrand' then 'paid_nonbrand'
    when utm_source = 'socialbook' then 'paid_social'
  end"""

SQL["channel_new_vs_repeat"] = click(f"""
select {CHANNEL_GROUP} as channel_group,
       count(*) filter (where is_repeat_session = 0) as new_sessions,
       count(*) filter (where is_repeat_session = 1) as repeat_sessions
from website_sessions
where created_at >= {ts('2024-01-01')} and created_at < {ts('2024-01-31')}
group by 1""")

SQL["new_vs_repeat_value"] = click(f"""
select s.is_repeat_session, count(distinct s.website_session_id) as sessions,
       {div('count(distinct o.order_id)', 'count(distinct s.website_session_id)')} as conv_rate,
       {div('sum(o.price_usd)', 'count(distinct s.website_session_id)')} as rev_per_session
from {SO}
where s.created_at >= {ts('2024-01-01')} and s.created_at < {ts('2024-01-31')}
group by 1""")

# no query of the original does this; the user value its summary asks for
PER_USER = f"""per_user as (
  select s.user_id, arg_min({CHANNEL_GROUP.replace('utm_', 's.utm_').replace('http_referer', 's.http_referer')},
                            s.website_session_id) as first_channel,
         count(distinct s.website_session_id) as sessions, count(o.order_id) as orders,
         coalesce(sum(o.price_usd), 0) as revenue
  from {SO}
  where s.user_id is not null
  group by s.user_id
)"""

SQL["customer_value"] = click(f"""{PER_USER}
select user_id, first_channel, sessions, orders, cast(revenue as double) as revenue
from per_user order by revenue desc, user_id""")

SQL["customer_value_by_channel"] = click(f"""{PER_USER}
select first_channel, count(*) as users, count(*) filter (where orders > 0) as buyers,
       cast(sum(revenue) as double) as revenue, {div('sum(revenue)', 'count(*)')} as rev_per_user
from per_user group by first_channel""")


# --- other grains and forms ---------------------------------------------------

def _at_grain(name: str, grain: str) -> str:
    sql, keys = SQL[name], {"month": "yr, mo", "quarter": "yr, qtr"}[grain]
    for col in ("s.created_at", "l.created_at", "created_at"):
        for old in ("day", "week"):
            sql = sql.replace(bucket(col, old), bucket(col, grain))
    return sql.replace("select wk_start,", f"select {keys},").replace("order by wk_start", f"order by {keys}")


for _name, _grain in (("volume_trend", "month"), ("volume_trend", "quarter"), ("segment_trend", "month"),
                      ("channel_mix_trend", "month"), ("direct_brand_vs_nonbrand", "month"),
                      ("conversion_trend", "month"), ("efficiency_trend", "quarter"),
                      ("orders_by_channel", "quarter"), ("conversion_by_channel", "quarter"),
                      ("listing_page_trend", "quarter")):
    SQL[f"{_name}_{_grain}"] = _at_grain(_name, _grain)

SQL["bounce_rate_by_landing_exclusive"] = SQL["bounce_rate_by_landing"].replace(
    "website_pageview_id >= (", "website_pageview_id > (")

# the same analyses over the five tables opened from their paths
for _name in ("conversion_trend", "top_pages", "distinct_values_rows", "product_revenue_trend", "refund_rate_trend"):
    SQL[f"tables_{_name}"] = SQL[_name]

# over session paths
for _name in ("first_pageview", "landing_page", "top_entry_pages", "bounced_sessions", "bounce_rate",
              "bounce_rate_by_landing", "weekly_bounce_trend", "qualifying_pageviews", "funnel_flags", "funnel_counts",
              "funnel_rates", "page_version_conversion", "next_pageview", "pathing_summary", "pages_after",
              "product_funnel_counts", "product_funnel_rates", "listing_page_trend", "clickthrough_after",
              "cross_sell_period_summary", "cross_sell_period_summary_legacy"):
    SQL[f"paths_{_name}"] = SQL[_name]

# over tables in the same buckets
for _name in ("cross_sell_matrix", "refund_rate_trend"):
    SQL[f"buckets_{_name}"] = SQL[_name]

# over day folders
for _name in ("conversion_trend", "conversion_by", "new_vs_repeat_value", "page_version_conversion"):
    SQL[f"daily_{_name}"] = SQL[_name]

# distinct counts from words by day, over tables with repeated rows: the counts of the clean tables
for _name in ("volume_trend", "volume_trend_month", "volume_trend_quarter", "volume_trend_sessions_with_order", "segment_trend",
              "segment_trend_month", "segment_trend_device", "channel_mix_trend", "channel_mix_trend_month",
              "conversion_trend", "conversion_trend_month", "conversion_by", "top_pages"):
    SQL[f"distinct_{_name}"] = SQL[_name]

SQL["customer_value_top"] = f"SELECT * FROM ({SQL['customer_value'].strip().rstrip(';')}) ORDER BY revenue DESC, user_id LIMIT 25"

# a careless delivery through the keyed load
for _name in ("conversion_trend", "top_pages", "distinct_values_rows"):
    SQL[f"loaded_{_name}"] = SQL[_name]

SQL["loaded_rejects"] = click("\nunion all\n".join(f"""
select '{table}' as table_name, r.reason, count(*) as n_rows, count(distinct {key}) as n_keys
from {source} join (values (7, 'repeated row'), (31, 'other row of the key'), (13, '{key} is not bigint'),
                          (21, 'created_at is missing')) r(rest, reason) on {key} % 300 = r.rest
group by r.reason""" for table, source, key in (
    ("website_sessions", "website_sessions", "website_session_id"),
    ("website_pageviews", "website_pageviews", "website_pageview_id"), ("orders", "web_orders", "order_id"))))
