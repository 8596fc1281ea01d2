"""DuckDB text of the events-to-shop derivation (the oracle's CTE prelude).

Written independently of the Spark code in ``sources.events_fixture``,
straight from the rules: plain window functions, no chunking.  Every oracle
statement starts with this ``WITH`` list, so the DuckDB side reads only the
driver's ``events`` view.
"""

PRELUDE = """
WITH fx_ev AS (
  SELECT event_id, ts, user_id, event_type,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 2 AS b
  FROM events
), fx_num AS (
  SELECT fx_ev.*,
         row_number() OVER (PARTITION BY user_id, b ORDER BY event_id) AS n,
         min(event_id) OVER (PARTITION BY user_id, b) + 1 AS sid,
         min(ts) OVER (PARTITION BY user_id, b) AS first_ts,
         first_value(k) OVER (PARTITION BY user_id, b ORDER BY event_id) AS k1
  FROM fx_ev
), fx_rows AS (
  SELECT fx_num.*,
         TIMESTAMP '2012-03-19 00:00:00'
           + to_microseconds(36 * date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', first_ts)) AS s_at,
         CASE WHEN sid % 4 = 0 AND n >= 5 THEN n - 1 ELSE n END AS stage
  FROM fx_num
), website_sessions AS (
  SELECT
    sid AS website_session_id,
    s_at AS created_at,
    user_id * 5 + b // 3 AS user_id,
    CAST(CASE WHEN sid = min(sid) OVER (PARTITION BY user_id * 5 + b // 3) THEN 0 ELSE 1 END AS INTEGER)
      AS is_repeat_session,
    CASE WHEN k < 55 THEN 'gsearch' WHEN k < 74 THEN 'bsearch' WHEN k < 79 THEN 'socialbook' END AS utm_source,
    CASE WHEN k < 45 THEN 'nonbrand' WHEN k < 55 THEN 'brand' WHEN k < 70 THEN 'nonbrand'
         WHEN k < 74 THEN 'brand' WHEN k < 79 THEN 'pilot' END AS utm_campaign,
    CASE WHEN sid % 10 < 7 THEN 'desktop' ELSE 'mobile' END AS device_type,
    CASE WHEN k < 55 THEN 'https://www.gsearch.com' WHEN k < 74 THEN 'https://www.bsearch.com'
         WHEN k < 79 THEN 'https://www.socialbook.com' WHEN k < 89 THEN 'https://www.gsearch.com'
         WHEN k < 92 THEN 'https://www.bsearch.com' WHEN k < 98 THEN NULL
         ELSE 'https://www.other.example' END AS http_referer
  FROM fx_rows
  WHERE n = 1
), fx_pv AS (
  SELECT
    event_id + 1 AS website_pageview_id,
    s_at + to_microseconds(date_diff('microsecond', first_ts, ts)) AS created_at,
    sid AS website_session_id,
    CASE stage
      WHEN 1 THEN CASE WHEN s_at >= TIMESTAMP '2012-06-19 00:00:00' AND sid % 2 = 1 THEN '/lander-1' ELSE '/home' END
      WHEN 2 THEN '/products'
      WHEN 3 THEN CASE WHEN s_at >= TIMESTAMP '2013-01-06 00:00:00' AND sid % 3 = 0
                       THEN '/the-forever-love-bear' ELSE '/the-original-mr-fuzzy' END
      WHEN 4 THEN '/cart'
      WHEN 5 THEN '/shipping'
      WHEN 6 THEN CASE WHEN s_at >= TIMESTAMP '2012-09-10 00:00:00' AND (sid // 2) % 2 = 0
                       THEN '/billing-2' ELSE '/billing' END
      WHEN 7 THEN '/thank-you-for-your-order'
      ELSE '/products' END AS pageview_url,
    stage, s_at, k1
  FROM fx_rows
  WHERE event_type <> 'error'
), website_pageviews AS (
  SELECT website_pageview_id, created_at, website_session_id, pageview_url FROM fx_pv
), fx_ord AS (
  SELECT
    website_session_id AS order_id,
    created_at,
    website_session_id,
    CAST(CASE WHEN s_at >= TIMESTAMP '2013-12-12 00:00:00' AND website_session_id % 5 = 0 THEN 3
              WHEN s_at >= TIMESTAMP '2013-01-06 00:00:00' AND website_session_id % 3 = 0 THEN 2
              ELSE 1 END AS INTEGER) AS primary_product_id,
    CAST(CASE WHEN created_at >= TIMESTAMP '2013-09-25 00:00:00' AND website_session_id % 3 = 1 THEN 2 ELSE 1 END
         AS INTEGER) AS items_purchased,
    k1
  FROM fx_pv
  WHERE stage = 7
), web_orders AS (
  SELECT order_id, created_at, website_session_id, primary_product_id, items_purchased,
         CAST(items_purchased * (29.99 + k1) AS DECIMAL(8,2)) AS price_usd,
         CAST(items_purchased * 19.49 AS DECIMAL(8,2)) AS cogs_usd
  FROM fx_ord
), order_items AS (
  SELECT order_id * 10 + 1 AS order_item_id, created_at, primary_product_id AS product_id FROM web_orders
  UNION ALL
  SELECT order_id * 10 + 2 AS order_item_id, created_at, CAST(4 AS INTEGER) AS product_id
  FROM web_orders WHERE items_purchased = 2
), order_item_refunds AS (
  SELECT order_item_id FROM order_items WHERE order_item_id % 11 = 0
)
"""


def with_prelude(body: str) -> str:
    """An oracle statement: the prelude followed by one SELECT."""
    return PRELUDE + body.strip() + "\n"
