"""

A statement is built from relations defined by their meaning (a session's entry
page is its first pageview, the next page is the following pageview of the
session, a bounce is a session with a single pageview, ...) and a list of keys
and measures.  Windows, correlated counts, EXISTS and FILTER clauses say what
is wanted; none of the Spark side's rewrites (anchors, folded orders, prefix
counts) is used here, so agreement of the two is a check.

Values: counts BIGINT, date parts INTEGER, money DECIMAL(18,2), ratios DOUBLE
(NULL on a zero divisor); weeks begin on Sunday.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from funnelwise.plans.prelude import PRELUDE

# Page urls, labels, segment values and output names of the analysis.
HOME, LANDER = "/home", "/lander-1"
PRODUCTS, MRFUZZY, LOVEBEAR = "/products", "/the-original-mr-fuzzy", "/the-forever-love-bear"
CART, SHIPPING, BILLING, BILLING2, THANKYOU = "/cart", "/shipping", "/billing", "/billing-2", "/thank-you-for-your-order"
SITE_STEPS = {"products": PRODUCTS, "mrfuzzy": MRFUZZY, "cart": CART, "shipping": SHIPPING, "billing": BILLING, "thankyou": THANKYOU}
SITE_RATES = ["lander_clickthrough_rate", "products_clickthrough_rate", "mr_fuzzy_clickthrough_rate", "cart_clickthrough_rate",
              "shipping_clickthrough_rate", "billing_clickthrough_rate"]
PRODUCT_STEPS = {"cart": CART, "shipping": SHIPPING, "billing": BILLING2, "thankyou": THANKYOU}
PRODUCT_RATES = ["product_page_click_rt", "cart_click_rt", "shipping_click_rt", "billing_click_rt"]
PRODUCT_NAMES = {MRFUZZY: "mrfuzzy", LOVEBEAR: "lovebear"}
GUARD = "uh on...check logic"
PRE_PRODUCT_2 = ("A. Pre_Product_2", "B. Pre_Product_2")
CROSS_SELL = ("A. Pre_Cross_Sell", "B. Post_Cross_Sell")
BIRTHDAY_BEAR = ("A. Pre_Birthday_Bear", "B. Post_Birthday_Bear")
SEARCH_REFERERS = ("https://www.gsearch.com", "https://www.bsearch.com")
WEEKDAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]

GSEARCH_NONBRAND = "utm_source = 'gsearch' AND utm_campaign = 'nonbrand'"
NONBRAND = "utm_campaign = 'nonbrand'"


# ---- small pieces ---------------------------------------------------------------

def day(date: str) -> str:
    return f"TIMESTAMP '{date} 00:00:00'"


def before(date: str) -> str:
    return f"created_at < {day(date)}"


def within(start: str, end: str) -> str:
    """Both ends excluded."""
    return f"created_at > {day(start)} AND created_at < {day(end)}"


def since(start: str, end: str) -> str:
    """Start included."""
    return f"created_at >= {day(start)} AND created_at < {day(end)}"


def to_midnight(start: str, end: str) -> str:
    """Both midnights included."""
    return f"created_at >= {day(start)} AND created_at <= {day(end)}"


def distinct(key: str, where: str | None = None) -> str:
    return f"count(DISTINCT {key})" + (f" FILTER (WHERE {where})" if where else "")


def over(a: str, b: str) -> str:
    return f"({a})::DOUBLE / nullif({b}, 0)"


def part(name: str, ts: str = "created_at") -> str:
    return f"date_part('{name}', {ts})::INTEGER"


def sunday(ts: str = "created_at") -> str:
    return f"date_trunc('day', {ts})::DATE - date_part('dow', {ts})::INTEGER"


def year_and_week(ts: str = "created_at") -> str:
    return f"{part('year', ts)}, strftime({ts}, '%U')::INTEGER"


def one_of(column: str, values: Sequence[str]) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


def choose(options: Mapping[str, str], otherwise: str | None = None) -> str:
    """First label whose condition holds."""
    arms = " ".join(f"WHEN {cond} THEN '{label}'" for label, cond in options.items())
    return f"CASE {arms}" + (f" ELSE '{otherwise}'" if otherwise else "") + " END"


def period(cut: str, labels: tuple[str, str]) -> str:
    return choose({labels[0]: f"created_at < {day(cut)}", labels[1]: f"created_at >= {day(cut)}"}, GUARD)


def channel(social: bool) -> str:
    rules = {"organic_search": "utm_source IS NULL AND " + one_of("http_referer", SEARCH_REFERERS), "paid_nonbrand": NONBRAND,
             "paid_brand": "utm_campaign = 'brand'", "direct_type_in": "utm_source IS NULL AND http_referer IS NULL"}
    return choose(rules | ({"paid_social": "utm_source = 'socialbook'"} if social else {}))


def report(source: str, columns: Mapping[str, str], group: Sequence[str] = (), order: str = "") -> str:
    """SELECT named columns FROM a relation, grouped by expressions."""
    text = "SELECT " + ",\n       ".join(f"{e} AS {n}" for n, e in columns.items()) + f"\nFROM {source}"
    if group:
        text += "\nGROUP BY " + ", ".join(group)
    return text + (f"\nORDER BY {order}" if order else "")


def rows(name: str) -> str:
    return f"SELECT * FROM {name}"


# ---- relations (name -> text); a statement names those it needs ---------------------

def sessions_where(condition: str) -> str:
    return f"(SELECT * FROM website_sessions WHERE {condition})"


def visits(condition: str) -> str:
    """Sessions with each of their orders (one row without, if there is none)."""
    return (f"(SELECT v.*, o.order_id, o.price_usd, o.items_purchased, o.primary_product_id "
            f"FROM {sessions_where(condition)} AS v LEFT JOIN web_orders AS o USING (website_session_id))")


def entries(condition: str) -> str:
    """First pageview of each session among the pageviews that meet a condition."""
    return f"""
  SELECT website_session_id, website_pageview_id, pageview_url, created_at
  FROM website_pageviews WHERE {condition}
  QUALIFY row_number() OVER (PARTITION BY website_session_id ORDER BY website_pageview_id) = 1"""


PAGES_OF = "(SELECT count(*) FROM website_pageviews AS p WHERE p.website_session_id = e.website_session_id)"
FIRST_LANDER = f"(SELECT min(website_pageview_id) FROM website_pageviews WHERE pageview_url = '{LANDER}' AND created_at IS NOT NULL)"
FIRST_BILLING2 = f"(SELECT min(website_pageview_id) FROM website_pageviews WHERE pageview_url = '{BILLING2}')"
TEST_SESSIONS = f"(SELECT website_session_id FROM website_sessions WHERE {before('2012-07-28')} AND {GSEARCH_NONBRAND})"

RELATIONS: dict[str, str] = {}
#: The entry page of each session, in the site-wide bounce analysis and in the lander test.
RELATIONS["site_entry"] = entries(before("2012-06-14"))
RELATIONS["test_entry"] = entries(f"website_pageview_id > {FIRST_LANDER} AND website_session_id IN {TEST_SESSIONS}")
RELATIONS["test_landing"] = "SELECT * FROM test_entry WHERE " + one_of("pageview_url", [HOME, LANDER])
for _landing in ("site_entry", "test_landing"):
    RELATIONS[f"{_landing}_pages"] = (f"SELECT website_session_id, pageview_url AS landing_page, {PAGES_OF} AS count_of_pages_viewed FROM {_landing} AS e")

_SEGMENT = sessions_where(f"{within('2012-06-01', '2012-08-31')} AND {GSEARCH_NONBRAND}")
RELATIONS["any_entry"] = entries("true")
RELATIONS["trend"] = f"""
  SELECT s.website_session_id, e.website_pageview_id AS first_pageview_id, {PAGES_OF.replace('e.website', 's.website')} AS count_pageviews,
         e.pageview_url AS landing_page, e.created_at AS session_created_at
  FROM {_SEGMENT} AS s LEFT JOIN any_entry AS e USING (website_session_id)"""

_FUNNEL = sessions_where(f"{within('2012-08-05', '2012-09-05')} AND {GSEARCH_NONBRAND}")
RELATIONS["site_funnel"] = "\n  SELECT s.website_session_id, " + ", ".join(
    f"(EXISTS (SELECT 1 FROM website_pageviews AS p WHERE p.website_session_id = s.website_session_id AND p.pageview_url = '{url}'))::INTEGER AS {step}_made_it"
    for step, url in SITE_STEPS.items()) + f"\n  FROM {_FUNNEL} AS s"

RELATIONS["billing_views"] = (f"SELECT website_session_id, pageview_url AS billing_version_seen FROM website_pageviews "
                              f"WHERE website_pageview_id >= {FIRST_BILLING2} AND {before('2012-11-10')} AND " + one_of("pageview_url", [BILLING, BILLING2]))
RELATIONS["billing_orders"] = "SELECT b.*, o.order_id FROM billing_views AS b LEFT JOIN web_orders AS o USING (website_session_id)"

#: Every pageview with the one that follows it in its session.
RELATIONS["steps_on"] = """
  SELECT *, lead(website_pageview_id) OVER s AS following_id, lead(pageview_url) OVER s AS following_url
  FROM website_pageviews WINDOW s AS (PARTITION BY website_session_id ORDER BY website_pageview_id)"""
RELATIONS["products_views"] = (f"SELECT *, {period('2013-01-06', PRE_PRODUCT_2)} AS time_period FROM steps_on "
                               f"WHERE {within('2012-10-06', '2013-04-06')} AND pageview_url = '{PRODUCTS}'")
RELATIONS["after_products"] = """
  SELECT DISTINCT ON (time_period, website_session_id) time_period, website_session_id, following_id, following_url
  FROM products_views ORDER BY time_period, website_session_id, website_pageview_id"""

RELATIONS["product_views"] = (f"SELECT website_session_id, website_pageview_id, pageview_url AS product_page_seen FROM website_pageviews "
                              f"WHERE {within('2013-01-06', '2013-04-10')} AND " + one_of("pageview_url", list(PRODUCT_NAMES)))
RELATIONS["later_pages"] = """
  SELECT v.*, p.pageview_url AS later_url FROM product_views AS v
  LEFT JOIN website_pageviews AS p ON p.website_session_id = v.website_session_id AND v.website_pageview_id < p.website_pageview_id"""
RELATIONS["product_funnel"] = "\n  SELECT website_session_id, " + choose({n: f"product_page_seen = '{u}'" for u, n in PRODUCT_NAMES.items()}, GUARD) + \
    " AS product_seen,\n    " + ", ".join(f"coalesce(bool_or(later_url = '{u}'), false)::INTEGER AS {s}_made_it" for s, u in PRODUCT_STEPS.items()) + \
    "\n  FROM later_pages GROUP BY 1, 2"

RELATIONS["carts"] = (f"SELECT {period('2013-09-25', CROSS_SELL)} AS time_period, website_session_id AS cart_session_id, website_pageview_id AS cart_pageview_id, following_id "
                      f"FROM steps_on WHERE {to_midnight('2013-08-25', '2013-10-25')} AND pageview_url = '{CART}'")
RELATIONS["cart_clicks"] = "SELECT time_period, cart_session_id, min(following_id) AS pv_id_after_cart FROM carts GROUP BY ALL HAVING count(following_id) > 0"
RELATIONS["cart_purchases"] = "SELECT c.time_period, c.cart_session_id, o.order_id, o.items_purchased, o.price_usd FROM carts AS c JOIN web_orders AS o ON o.website_session_id = c.cart_session_id"
RELATIONS["cart_sessions"] = "SELECT time_period, cart_session_id, bool_or(following_id IS NOT NULL) AS clicked FROM carts GROUP BY ALL"

for _name, _end in (("year", "2014-11-01"), ("longer", "2014-11-03")):
    RELATIONS[f"{_name}_visits"] = f"SELECT * FROM website_sessions WHERE {since('2014-01-01', _end)}"
    RELATIONS[f"{_name}_repeats"] = f"""
  SELECT a.user_id, a.website_session_id AS new_session_id, a.created_at AS new_session_created_at,
         b.website_session_id AS repeat_session_id, b.created_at AS repeat_session_created_at
  FROM {_name}_visits AS a LEFT JOIN (FROM {_name}_visits WHERE is_repeat_session = 1) AS b USING (user_id)
  WHERE a.is_repeat_session = 0"""
RELATIONS["second_visits"] = """
  SELECT user_id, date_diff('day', new_session_created_at::DATE, min(repeat_session_created_at)::DATE)::INTEGER AS days_first_to_second_session
  FROM longer_repeats WHERE repeat_session_id IS NOT NULL GROUP BY user_id, new_session_id, new_session_created_at"""


# ---- statements ------------------------------------------------------------------

SESSION = "website_session_id"
N = distinct(SESSION)
ORDERS = distinct("order_id")


def conversion(condition: str, by: Sequence[str] = (), rate: str = "conv_rate") -> str:
    return report(visits(condition), {b: b for b in by} | {"sessions": N, "orders": ORDERS, rate: over(ORDERS, N)}, by)


def weekly(condition: str, measures: Mapping[str, str], week: str, label: str = "week_start_date") -> str:
    return report(sessions_where(condition), {label: "min(created_at::DATE)"} | dict(measures), [week])


def bounces(landing: str, total: str, by: Sequence[str] = ()) -> str:
    n = distinct(SESSION, "count_of_pages_viewed = 1")
    return report(f"{landing}_pages", {b: b for b in by} | {total: N, "bounced_sessions": n, "bounce_rate": over(n, N)}, by)


def bounce_listing(landing: str, keep: Sequence[str] = ()) -> str:
    return report(f"{landing}_pages", {k: k for k in keep} | {SESSION: SESSION, "bounced_website_session_id":
                                                              f"CASE WHEN count_of_pages_viewed = 1 THEN {SESSION} END"}, order=SESSION)


def reached(steps: Mapping[str, str]) -> dict[str, str]:
    return {f"to_{s}": distinct(SESSION, f"{s}_made_it = 1") for s in steps}


def step_rates(steps: Mapping[str, str], names: Sequence[str]) -> dict[str, str]:
    counts = [N, *reached(steps).values()]
    return {name: over(b, a) for name, a, b in zip(names, counts, counts[1:])}


def page_flags(steps: Mapping[str, str], url: str) -> dict[str, str]:
    return {f"{s}_page": f"coalesce({url} = '{u}', false)::INTEGER" for s, u in steps.items()}


def heat_map() -> str:
    hours = report(sessions_where(to_midnight("2012-09-15", "2012-11-15")),
                   {"on_day": "created_at::DATE", "weekday": part("isodow"), "hr": part("hour"), "n": N}, ["1", "2", "3"])
    return report(f"({hours})", {"hr": "hr"} | {d: f"round(avg(n) FILTER (WHERE weekday = {i}), 1)" for i, d in enumerate(WEEKDAYS, 1)}, ["hr"], "hr")


def new_and_repeat(keys: Mapping[str, str]) -> str:
    counts = {f"{name}_sessions": f"count({SESSION}) FILTER (WHERE is_repeat_session = {flag})" for name, flag in (("new", 0), ("repeat", 1))}
    return report(sessions_where(since("2014-01-01", "2014-11-05")), dict(keys) | counts, [str(i + 1) for i in range(len(keys))], "repeat_sessions DESC")


def refund_rates(products: Sequence[int] = (1, 2, 3, 4)) -> str:
    columns = {"yr": part("year"), "mo": part("month")}
    for p in products:
        sold = distinct("order_item_id", f"product_id = {p}")
        columns |= {f"p{p}_orders": sold, f"p{p}_refund_rt": over(distinct("order_item_id", f"product_id = {p} AND refunded"), sold)}
    items = (f"(SELECT *, order_item_id IN (SELECT order_item_id FROM order_item_refunds) AS refunded FROM order_items WHERE {before('2014-10-15')})")
    return report(items, columns, ["1", "2"])


def quarterly(measures: Mapping[str, str]) -> str:
    return report(visits("true"), {"yr": part("year"), "qtr": part("quarter")} | dict(measures), ["1", "2"], "1, 2")


def cross_sell(source: str, sessions: str, clicks: str, orders: str) -> str:
    items, revenue = "sum(items_purchased)", "sum(price_usd)"
    return report(source, {
        "time_period": "time_period", "cart_sessions": sessions, "clickthroughs": f"({clicks})::BIGINT", "cart_ctr": over(clicks, sessions),
        "orders_placed": f"({orders})::BIGINT", "products_purchased": f"{items}::BIGINT", "products_per_order": over(items, orders),
        "aov": over(revenue, orders), "rev_per_cart_session": over(revenue, sessions)}, ["time_period"])


_SESSIONS_BY = ", ".join(("utm_source", "utm_campaign", "http_referer"))
_DEVICE = {d: f"device_type = '{d}'" for d in ("desktop", "mobile")}
_G, _B = "utm_source = 'gsearch'", "utm_source = 'bsearch'"
_MOBILE = distinct(SESSION, _DEVICE["mobile"])


def _source_device() -> dict[str, str]:
    out = {}
    for short, device in (("dtop", "desktop"), ("mob", "mobile")):
        g, b = (distinct(SESSION, f"{s} AND {_DEVICE[device]}") for s in (_G, _B))
        out |= {f"g_{short}_sessions": g, f"b_{short}_sessions": b, f"b_pct_of_g_{short}": over(b, g)}
    return out


def _channel_mix() -> str:
    n = {c: distinct(SESSION, f"channel_group = '{c}'") for c in ("paid_nonbrand", "paid_brand", "direct_type_in", "organic_search")}
    columns = {"yr": part("year"), "mo": part("month"), "nonbrand": n["paid_nonbrand"]}
    for name, c in (("brand", "paid_brand"), ("direct", "direct_type_in"), ("organic", "organic_search")):
        columns |= {name: n[c], f"{name}_pct_of_nonbrand": over(n[c], n["paid_nonbrand"])}
    return report(f"(SELECT *, {channel(False)} AS channel_group FROM website_sessions WHERE {before('2012-12-23')})", columns, ["1", "2"])


def _pathing() -> str:
    counts = {"w_next_pg": distinct(SESSION, "following_url IS NOT NULL"), "to_mrfuzzy": distinct(SESSION, f"following_url = '{MRFUZZY}'"),
              "to_lovebear": distinct(SESSION, f"following_url = '{LOVEBEAR}'")}
    columns = {"time_period": "time_period", "sessions": N}
    for name, count in counts.items():
        columns |= {name: count, f"pct_{name}": over(count, N)}
    return report("after_products", columns, ["time_period"])


STATEMENTS: dict[str, str] = {
    "traffic_top_sources": f"SELECT {_SESSIONS_BY}, {N} AS sessions FROM {sessions_where(before('2012-04-12'))} GROUP BY {_SESSIONS_BY} ORDER BY sessions DESC",
    "source_conversion_rate": conversion(f"{before('2012-04-14')} AND {GSEARCH_NONBRAND}", rate="session_to_order_conv_rate"),
    "weekly_sessions": weekly(f"{before('2012-05-10')} AND {GSEARCH_NONBRAND}", {"sessions": N}, year_and_week(), "week_started_at"),
    "conversion_by_device": conversion(f"{before('2012-05-11')} AND {GSEARCH_NONBRAND}", ["device_type"], "conv_rt"),
    "weekly_sessions_by_device": weekly(f"{within('2012-04-15', '2012-06-09')} AND {GSEARCH_NONBRAND}",
                                        {f"{d}_sessions": distinct(SESSION, c) for d, c in _DEVICE.items()}, year_and_week()),
    "top_pages": report(f"website_pageviews WHERE {before('2012-06-09')}", {"pageview_url": "pageview_url", "pvs": distinct("website_pageview_id")}, ["pageview_url"], "pvs DESC"),
    "first_pv_per_session": f"SELECT website_session_id, website_pageview_id AS first_pv FROM ({entries(before('2012-06-12'))})",
    "top_entry_pages": report(f"({entries(before('2012-06-12'))})", {"Landing_page": "pageview_url", "sessions_hitting_page": N}, ["pageview_url"]),
    "first_pageviews": "SELECT website_session_id, website_pageview_id AS min_pageview_id FROM site_entry",
    "sessions_w_landing_page": "SELECT website_session_id, pageview_url AS landing_page FROM site_entry",
    "bounced_sessions": "SELECT * FROM site_entry_pages WHERE count_of_pages_viewed = 1",
    "session_bounce_detail": bounce_listing("site_entry"),
    "bounce_rate": bounces("site_entry", "total_sessions"),
    "page_first_seen": report(f"website_pageviews WHERE pageview_url = '{LANDER}' AND created_at IS NOT NULL",
                              {"first_created_at": "min(created_at)", "first_pageview_id": "min(website_pageview_id)"}),
    "ab_first_test_pageview": "SELECT website_session_id, website_pageview_id AS min_pageview_id FROM test_entry",
    "ab_sessions_w_landing_page": "SELECT website_session_id, pageview_url AS landing_page FROM test_landing",
    "ab_bounced_sessions": "SELECT * FROM test_landing_pages WHERE count_of_pages_viewed = 1",
    "ab_session_detail": bounce_listing("test_landing", ["landing_page"]),
    "ab_bounce_rate": bounces("test_landing", "sessions", ["landing_page"]),
    "session_first_pv_and_count": "SELECT website_session_id, first_pageview_id, count_pageviews FROM trend",
    "session_lander_and_time": rows("trend"),
    "weekly_bounce_and_lander": report("trend", {
        "week_start_date": "min(session_created_at::DATE)", "bounce_rate": over(distinct(SESSION, "count_pageviews = 1"), N),
        "home_sessions": distinct(SESSION, f"landing_page = '{HOME}'"), "lander_sessions": distinct(SESSION, f"landing_page = '{LANDER}'")}, [sunday("session_created_at")]),
    "funnel_page_flags": report(f"{_FUNNEL} AS s LEFT JOIN website_pageviews AS p USING (website_session_id)",
                                {SESSION: SESSION, "pageview_url": "p.pageview_url"} | page_flags(SITE_STEPS, "p.pageview_url"), order=f"{SESSION}, p.created_at"),
    "funnel_session_flags": rows("site_funnel"),
    "funnel_counts": report("site_funnel", {"sessions": N} | reached(SITE_STEPS)),
    "funnel_click_rates": report("site_funnel", {"sessions": N} | step_rates(SITE_STEPS, SITE_RATES)),
    "billing_first_pv": f"SELECT {FIRST_BILLING2} AS first_pv_id",
    "billing_sessions_detail": "SELECT website_session_id, billing_version_seen, order_id, count(*) AS n_rows FROM billing_orders GROUP BY ALL",
    "billing_ab_conversion": report("billing_orders", {"billing_version_seen": "billing_version_seen", "sessions": N, "orders": ORDERS, "billing_to_order_rt": over(ORDERS, N)},
                                    ["billing_version_seen"]),
    "weekly_channel_sessions": weekly(f"{within('2012-08-22', '2012-11-29')} AND {NONBRAND}",
                                      {"gsearch_sessions": distinct(SESSION, _G), "bsearch_sessions": distinct(SESSION, _B)}, sunday()),
    "channel_mobile_share": report(sessions_where(f"{within('2012-08-22', '2012-11-30')} AND {NONBRAND}"),
                                   {"utm_source": "utm_source", "sessions": N, "mobile_sessions": _MOBILE, "pct_mobile": over(_MOBILE, N)}, ["utm_source"]),
    "conversion_by_device_source": conversion(f"{within('2012-08-22', '2012-09-19')} AND {NONBRAND}", ["device_type", "utm_source"]),
    "weekly_source_device_mix": weekly(f"{within('2012-11-04', '2012-12-22')} AND {NONBRAND}", _source_device(), sunday()),
    "monthly_channel_mix": _channel_mix(),
    "weekly_seasonality": report(visits(before("2013-01-01")), {"yr": part("year"), "wk": "strftime(created_at, '%U')::INTEGER", "week_start": "min(created_at::DATE)",
                                                               "sessions": N, "orders": ORDERS}, ["1", "2"]),
    "hour_weekday_heatmap": heat_map(),
    "monthly_sales": report(f"web_orders WHERE {before('2013-01-04')}", {
        "yr": part("year"), "mo": part("month"), "number_of_sales": ORDERS, "total_revenue": "sum(price_usd)::DECIMAL(18,2)",
        "total_margin": "sum(price_usd - cogs_usd)::DECIMAL(18,2)"}, ["1", "2"]),
    "product_launch": report(visits(within("2012-04-01", "2013-04-05")), {
        "yr": part("year"), "mo": part("month"), "sessions": N, "orders": ORDERS, "conv_rate": over(ORDERS, N), "revenue_per_session": over("sum(price_usd)", N),
        "product_one_orders": distinct("order_id", "primary_product_id = 1"), "product_two_orders": distinct("order_id", "primary_product_id = 2")}, ["1", "2"]),
    "products_pageviews": "SELECT website_session_id, website_pageview_id, created_at, time_period FROM products_views",
    "next_pageview_id": "SELECT time_period, website_session_id, following_id AS min_next_pageview_id FROM after_products",
    "next_pageview_url": "SELECT time_period, website_session_id, following_url AS next_pageview_url FROM after_products",
    "product_pathing_pre_post": _pathing(),
    "sessions_seeing_product_pages": rows("product_views"),
    "urls_after_product_page": "SELECT DISTINCT later_url AS pageview_url FROM later_pages",
    "product_funnel_page_flags": report("later_pages", {SESSION: SESSION, "product_page_seen": "product_page_seen"} | page_flags(PRODUCT_STEPS, "later_url") | {"n_rows": "count(*)"},
                                        [str(i + 1) for i in range(2 + len(PRODUCT_STEPS))]),
    "product_funnel_session_flags": rows("product_funnel"),
    "product_funnel_counts": report("product_funnel", {"product_seen": "product_seen", "sessions": N} | reached(PRODUCT_STEPS), ["product_seen"]),
    "product_funnel_rates": report("product_funnel", {"product_seen": "product_seen"} | step_rates(PRODUCT_STEPS, PRODUCT_RATES), ["product_seen"]),
    "sessions_seeing_cart": "SELECT time_period, cart_session_id, cart_pageview_id FROM carts",
    "cart_sessions_seeing_another_page": rows("cart_clicks"),
    "cart_session_orders": "SELECT *, count(*) AS n_rows FROM cart_purchases GROUP BY ALL",
    "cross_sell_pre_post": cross_sell("carts AS c LEFT JOIN (SELECT cart_session_id, true AS clicked FROM cart_clicks) USING (cart_session_id) "
                                      "LEFT JOIN (SELECT cart_session_id, order_id, items_purchased, price_usd FROM cart_purchases) USING (cart_session_id)",
                                      distinct("cart_session_id"), "count(clicked)", "count(order_id)"),
    "cross_sell_pre_post_dedupe": cross_sell("cart_sessions LEFT JOIN web_orders ON website_session_id = cart_session_id", distinct("cart_session_id"),
                                             distinct("cart_session_id", "clicked"), "count(order_id)"),
    "portfolio_pre_post": report(visits(to_midnight("2013-11-22", "2014-01-22")), {
        "time_period": period("2013-12-22", BIRTHDAY_BEAR), "conv_rate": over(ORDERS, N), "average_order_value": over("sum(price_usd)", ORDERS),
        "products_per_order": over("sum(items_purchased)", ORDERS), "revenue_per_session": over("sum(price_usd)", N)}, ["1"]),
    "monthly_refund_rate": refund_rates(),
    "sessions_w_repeats": "SELECT user_id, new_session_id, repeat_session_id FROM year_repeats",
    "repeat_session_distribution": report("(SELECT user_id, count(DISTINCT repeat_session_id) AS repeat_sessions FROM year_repeats GROUP BY user_id)",
                                          {"repeat_sessions": "repeat_sessions", "users": "count(*)"}, ["repeat_sessions"]),
    "repeats_for_time_diff": "SELECT user_id, new_session_id, new_session_created_at, repeat_session_id, repeat_session_created_at FROM longer_repeats",
    "users_first_to_second": rows("second_visits"),
    "time_to_repeat": report("second_visits", {f"{f}_days_first_to_second": f"{f}(days_first_to_second_session)" for f in ("avg", "min", "max")}),
    "repeat_by_source": new_and_repeat({c: c for c in ("utm_source", "utm_campaign", "http_referer")}),
    "repeat_by_channel": new_and_repeat({"channel_group": channel(True)}),
    "new_vs_repeat_conversion": report(visits(since("2014-01-01", "2014-11-08")), {
        "is_repeat_session": "is_repeat_session", "sessions": N, "conv_rate": over(ORDERS, N), "rev_per_session": over("sum(price_usd)", N)}, ["1"]),
    "quarterly_volume": quarterly({"sessions": N, "orders": ORDERS}),
    "quarterly_efficiency": quarterly({"session_to_order_conv_rate": over(ORDERS, N), "revenue_per_order": over("sum(price_usd)", ORDERS),
                                       "revenue_per_session": over("sum(price_usd)", N)}),
    "quarterly_channel_orders": quarterly({f"{name}_orders": distinct("order_id", cond) for name, cond in {
        "gsearch_nonbrand": f"{_G} AND {NONBRAND}", "bsearch_nonbrand": f"{_B} AND {NONBRAND}", "brand_search": "utm_campaign = 'brand'",
        "organic_search": "utm_source IS NULL AND http_referer IS NOT NULL", "direct_type_in": "utm_source IS NULL AND http_referer IS NULL"}.items()}),
}


def walk(codes: str) -> str:
    """Steps reached by looking at pages in order: each page may only add the next step."""
    return f"list_reduce(list_prepend(0, coalesce({codes}, [])), lambda n, c: CASE WHEN c = n + 1 THEN c ELSE n END)"


def step_code(steps: Mapping[str, str]) -> str:
    return "CASE pageview_url " + " ".join(f"WHEN '{u}' THEN {i + 1}" for i, u in enumerate(steps.values())) + " END"


def reached_in_order(steps: Mapping[str, str]) -> dict[str, str]:
    return {"sessions": "count(*)"} | {f"to_{n}": f"count(*) FILTER (WHERE n >= {i + 1})" for i, n in enumerate(steps)}


_PAGE_ORDER = "list(code ORDER BY website_pageview_id) FILTER (WHERE code IS NOT NULL)"
_VISITS = {"sessions": distinct(SESSION), "product_sessions": distinct(SESSION, one_of("pageview_url", (MRFUZZY, LOVEBEAR))),
           "cart_sessions": distinct(SESSION, f"pageview_url = '{CART}'"), "thankyou_sessions": distinct(SESSION, f"pageview_url = '{THANKYOU}'")}
_USERS = {"users": distinct("user_id"), "desktop_users": distinct("user_id", "device_type = 'desktop'"), "mobile_users": distinct("user_id", "device_type = 'mobile'"),
          "nonbrand_users": distinct("user_id", NONBRAND)}

STATEMENTS |= {
    "weekly_unique_visits": report("website_pageviews", {"week_start_date": sunday()} | _VISITS, ["1"]),
    "monthly_unique_visits": report("website_pageviews", {"yr": part("year"), "mo": part("month")} | _VISITS, ["1", "2"]),
    "quarterly_unique_users": report("website_sessions", {"yr": part("year"), "qtr": part("quarter")} | _USERS, ["1", "2"]),
    "unique_users_by_device_source": report("website_sessions", {
        "device_type": "device_type", "utm_source": "utm_source", "users": distinct("user_id"), "repeat_users": distinct("user_id", "is_repeat_session = 1")}, ["1", "2"]),
    "ordered_funnel_counts": report(
        f"(SELECT {walk(_PAGE_ORDER)} AS n FROM (SELECT s.website_session_id, website_pageview_id, {step_code(SITE_STEPS)} AS code "
        f"FROM {_FUNNEL} AS s LEFT JOIN website_pageviews AS p USING (website_session_id)) GROUP BY website_session_id)", reached_in_order(SITE_STEPS)),
    "ordered_product_funnel_counts": report(
        f"(SELECT product_seen, {walk(_PAGE_ORDER)} AS n FROM (SELECT e.*, website_pageview_id, {step_code(PRODUCT_STEPS)} AS code FROM "
        f"(SELECT website_session_id, {choose({n: f"product_page_seen = '{u}'" for u, n in PRODUCT_NAMES.items()}, GUARD)} AS product_seen, min(website_pageview_id) AS entry "
        "FROM product_views GROUP BY ALL) AS e LEFT JOIN website_pageviews AS p ON p.website_session_id = e.website_session_id AND p.website_pageview_id > e.entry) "
        "GROUP BY website_session_id, product_seen)", {"product_seen": "product_seen"} | reached_in_order(PRODUCT_STEPS), ["product_seen"]),
    "weekly_sessions_checked_feed": report("website_sessions", {"week_start_date": "min(created_at::DATE)", "sessions": N,
                                                                "broken_lines": "(SELECT count(*) FROM website_pageviews)"}, [sunday()]),
    "conversion_by_source_any_case": conversion(f"{before('2012-09-01')} AND {one_of('utm_source', ('gsearch', 'bsearch'))}", ["utm_source"]),
    "monthly_sales_by_period": STATEMENTS["monthly_sales"],
    "bounce_rate_from_snapshot": STATEMENTS["bounce_rate"],
}


def assemble(body: str, prelude: bool = True) -> str:
    """A statement with the relations it needs as CTEs, after the prelude or alone."""
    needed: list[str] = []

    def add(text: str) -> None:
        words = set(text.replace("(", " ").replace(")", " ").replace(",", " ").split())
        for name in RELATIONS:
            if name in words and name not in needed:
                add(RELATIONS[name])
                needed.append(name)

    add(body)
    parts = [f"{name} AS ({RELATIONS[name]})" for name in needed]
    if prelude:
        return PRELUDE.rstrip() + "".join(f",\n{p}" for p in parts) + f"\n{body}\n"
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + f"{body}\n"


# Texts run by the driver: derive the shop tables from ``events`` first.
ORACLE: dict[str, str] = {name: assemble(body) for name, body in STATEMENTS.items()}

# The same statements over existing tables named website_sessions,
# website_pageviews, web_orders, order_items, order_item_refunds.
STANDALONE: dict[str, str] = {name: assemble(body, prelude=False) for name, body in STATEMENTS.items()}
