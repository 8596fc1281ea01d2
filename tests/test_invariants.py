
import pytest
from pyspark.sql import functions as F

from funnelwise.functions.ranges import before, between
from funnelwise.plans.queries import STATEMENTS, SITE_FUNNEL
from funnelwise.operators import product
from tests.shopgen import random_shop, to_spark


@pytest.fixture(scope="module", params=[11, 12])
def t(request, spark):
    return to_spark(spark, random_shop(request.param, 400))


def test_funnel_steps_never_exceed_sessions(t):
    r = STATEMENTS["funnel_counts"](t).first()
    assert all(r[f"to_{s}"] <= r.sessions for s in SITE_FUNNEL)


def test_bounced_never_exceed_sessions(t):
    r = STATEMENTS["bounce_rate"](t).first()
    assert r.bounced_sessions <= r.total_sessions
    for row in STATEMENTS["ab_bounce_rate"](t).collect():
        assert row.bounced_sessions <= row.sessions


def test_entry_pages_partition_sessions_with_pageviews(t):
    window = before("2012-06-12")
    total = STATEMENTS["top_entry_pages"](t).agg(F.sum("sessions_hitting_page")).first()[0] or 0
    with_pv = t.pageviews.filter(window.on()).select("website_session_id").distinct().count()
    assert total == with_pv


def test_cross_sell_without_fan_out_equals_deduplicated(spark, t):
    # Sessions with one cart view and at most one order: all multipliers are 1.
    window = between("2012-01-01", "2016-01-01")
    views = t.pageviews.filter(F.col("pageview_url") == "/cart").groupBy("website_session_id").count().filter("count = 1")
    pages = t.pageviews.join(views, "website_session_id", "left_semi")
    one_order = t.orders.join(t.orders.groupBy("website_session_id").count().filter("count = 1"), "website_session_id", "left_semi")
    args = (pages, one_order, window, "/cart", "2013-09-25", "A", "B")
    fan_out, plain = (sorted(map(tuple, product.cross_sell(*args, dedupe=d).collect())) for d in (False, True))
    assert fan_out == plain and len(plain) == 2


def test_cross_sell_deduplicated_rates_are_rates(t):
    for r in STATEMENTS["cross_sell_pre_post_dedupe"](t).collect():
        assert 0 <= r.clickthroughs <= r.cart_sessions
