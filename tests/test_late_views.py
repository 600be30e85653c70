"""Views stamped earlier than an anchor with a smaller id still come after it: order is by id."""

import datetime as dt

from shopflow.operators import products

T = dt.datetime.fromisoformat


def test_an_early_stamped_later_view_is_the_next_view(spark):
    rows = [(10, T("2024-01-10 00:00:00"), 1, "view"), (11, T("2024-01-05 00:00:00"), 1, "click"),
            (12, T("2024-01-11 00:00:00"), 2, "view")]
    views = spark.createDataFrame(rows, "website_pageview_id long, created_at timestamp_ntz, "
                                        "website_session_id long, pageview_url string")
    anchors = products.period_tag(views, "view", "2024-01-06", "2024-01-20", "2024-01-15")
    got = {(r.website_session_id, r.min_next_pageview_id, r.pageview_url)
           for r in products.next_pageview(anchors, views).collect()}
    assert got == {(1, 11, "click"), (2, None, None)}
    assert {r.pageview_url for r in products.pages_after(views, anchors.join(
        views.select("website_pageview_id", "pageview_url"), "website_pageview_id")).collect()} == {"click", None}
