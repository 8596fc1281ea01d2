"""Conversion funnels: page flags per pageview, "made it" flags per session,
step counts and step-to-step click rates.

The reference's funnel is unordered: a session "made it" to a step when it
has any pageview of that step's url (MAX of 0/1 flags).  The product funnel
only looks at pages after the session's product page; there "has a later
page of url u" is decided from two per-session aggregates (the earliest
product view, and the latest view of each step url) instead of pairing
product views with later pageviews, so no step multiplies rows.  The page
listing of that funnel, whose literal rows are those pairs, is returned as a
multiset (distinct rows with ``n_rows``) from chunked prefix counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from funnelwise.functions.columns import first_match, flag, safe_ratio
from funnelwise.functions.joins import join_keyed, key_range, per_key, rekeyed
from funnelwise.functions.sequence import (DEFAULT_CHUNK, CHUNK, before_in_chunk, chunk_offsets,
                                          group_window, prior_chunks, with_chunk)
from funnelwise.functions.ranges import TimeRange

SESSION_ID = "website_session_id"
PAGEVIEW_ID = "website_pageview_id"


def page_flags(sessions: DataFrame, pageviews: DataFrame, window: TimeRange, where: Column,
               steps: Mapping[str, str]) -> DataFrame:
    """One row per pageview of the segment's sessions with a 0/1 flag per step.

    Sessions without pageviews keep one row with NULL url and all flags 0.
    ``steps`` maps flag column name to url, in funnel order.
    """
    s = sessions.filter(window.on("created_at") & where).select(SESSION_ID)
    pv = pageviews.select(SESSION_ID, "pageview_url", F.col("created_at").alias("_pv_at"))
    # LEFT JOIN as inner join plus the sessions without pageviews: adaptive
    # execution can split a hot session on either side of an inner join, and the
    # anti join probes one row per session with pageviews.
    matched = join_keyed(pv, s, SESSION_ID)
    with_pages = per_key(pv, s, SESSION_ID, F.count(F.lit(1)).alias("_n")).select(SESSION_ID)
    empty = (s.join(with_pages, SESSION_ID, "left_anti")
             .select(SESSION_ID, F.lit(None).cast("string").alias("pageview_url"),
                     F.lit(None).cast("timestamp_ntz").alias("_pv_at")))
    joined = matched.unionByName(empty)
    url = F.col("pageview_url")
    return (joined.select(SESSION_ID, "pageview_url", "_pv_at",
                          *[flag(url == u).alias(name) for name, u in steps.items()])
            .orderBy(SESSION_ID, "_pv_at").drop("_pv_at"))


def funnel(entries: DataFrame, pageviews: DataFrame, steps: Mapping[str, str], by: Sequence[str] = (),
           after: str | None = None) -> DataFrame:
    """One row per entry (session, ``by``): ``<step>_made_it`` = a pageview of the step's url.

    With ``after``, a pageview id of the entry, only later pageviews count: a
    step follows the entry exactly when its latest view in the session has a
    greater id, so one aggregate per session decides all entries.
    """
    url = F.col("pageview_url")
    latest = per_key(pageviews.filter(url.isin(*steps.values())), entries, SESSION_ID,
                     *[F.max(F.when(url == u, F.col(PAGEVIEW_ID))).alias(f"_last_{n}") for n, u in steps.items()])
    reached = {n: F.col(f"_last_{n}").isNotNull() if after is None else F.col(f"_last_{n}") > F.col(after) for n in steps}
    return entries.join(latest, SESSION_ID, "left").select(
        SESSION_ID, *by, *[flag(F.coalesce(c, F.lit(False))).alias(f"{n}_made_it") for n, c in reached.items()])


#: Pageview ids of a chunk: at most that many pages of a session are walked in one row.
WALK = 4_096


def ordered_funnel(entries: DataFrame, pageviews: DataFrame, steps: Mapping[str, str], by: Sequence[str] = (),
                   after: str | None = None, chunk: int = WALK) -> DataFrame:
    """One row per entry (session, ``by``): ``<step>_made_it`` = the steps up to this one were
    seen one after another, in order of pageview ids (other pages may lie between).

    Walking a session's pages moves it from "so many steps reached" to a larger number.
    What a chunk of pages does to every such number is a small array, and arrays of
    consecutive chunks compose, so a session is walked chunk by chunk in any task, and
    its arrays (one per ``chunk`` ids) are put together at the end.  No window or list
    holds more than a chunk of a session's pages.  ``after``: see ``funnel``.
    """
    urls = list(dict.fromkeys(steps.values()))
    wanted = F.array(*[F.lit(urls.index(u) + 1) for u in steps.values()])  # the page that takes a session on from each number
    page = F.array_position(F.array(*map(F.lit, urls)), F.col("pageview_url")).cast("int").alias("_page")
    views = pageviews.filter(F.col("pageview_url").isin(*urls)).select(SESSION_ID, PAGEVIEW_ID, page)
    if by or after:
        keep = [SESSION_ID, *by] + ([after] if after else [])
        views = join_keyed(views, entries.select(*keep), SESSION_ID)
        views = rekeyed(views if after is None else views.filter(F.col(PAGEVIEW_ID) > F.col(after)), SESSION_ID)
    else:
        views = key_range(views, entries, SESSION_ID)
    in_order = F.sort_array(F.collect_list(F.struct(PAGEVIEW_ID, "_page")))
    chunks = with_chunk(views, PAGEVIEW_ID, chunk).groupBy(SESSION_ID, *by, CHUNK).agg(in_order.alias("_pages"))
    start = F.array(*[F.lit(i) for i in range(len(steps) + 1)])
    moved = F.aggregate("_pages", start, lambda f, p: F.transform(f, lambda n: F.when(F.get(wanted, n) == p["_page"], n + 1).otherwise(n)))
    arrays = F.sort_array(F.collect_list(F.struct(CHUNK, "_moved")))
    walked = chunks.select(SESSION_ID, *by, CHUNK, moved.alias("_moved")).groupBy(SESSION_ID, *by).agg(arrays.alias("_arrays"))
    reached = F.aggregate("_arrays", F.lit(0), lambda n, a: F.get(a["_moved"], n))
    walked = walked.select(F.col(SESSION_ID).alias("_session"), *[F.col(b).alias(f"_by_{b}") for b in by], reached.alias("_reached"))
    same = F.col(SESSION_ID) == F.col("_session")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    return entries.join(walked, same, "left").select(
        SESSION_ID, *by, *[flag(F.coalesce(F.col("_reached"), F.lit(0)) > i).alias(f"{n}_made_it") for i, n in enumerate(steps)])


def session_flags(sessions: DataFrame, pageviews: DataFrame, window: TimeRange, where: Column,
                  steps: Mapping[str, str]) -> DataFrame:
    """One row per session of the segment: ``<step>_made_it`` = any pageview of the step."""
    return funnel(sessions.filter(window.on("created_at") & where).select(SESSION_ID), pageviews, steps)


def step_counts(flags: DataFrame, steps: list[str], by: list[str] = (), prefix: str = "to_") -> DataFrame:
    """Sessions and sessions reaching each step (flags hold one row per counted session)."""
    aggs = [F.count(SESSION_ID).alias("sessions")]
    aggs += [F.count(F.when(F.col(f"{s}_made_it") == 1, F.lit(1))).alias(f"{prefix}{s}") for s in steps]
    return flags.groupBy(*by).agg(*aggs) if by else flags.agg(*aggs)


def step_rates(counts: DataFrame, steps: list[str], names: list[str], keep: list[str]) -> DataFrame:
    """Each step's sessions over the previous step's (the first over all sessions)."""
    previous = ["sessions"] + [f"to_{s}" for s in steps[:-1]]
    rates = [safe_ratio(f"to_{s}", p).alias(n) for s, p, n in zip(steps, previous, names)]
    return counts.select(*keep, *rates)


def product_page_views(pageviews: DataFrame, window: TimeRange, products: Mapping[str, str]) -> DataFrame:
    """Views of the product pages in the window: session, pageview id, url seen."""
    return (pageviews.filter(window.on("created_at") & F.col("pageview_url").isin(*products.values()))
            .select(SESSION_ID, PAGEVIEW_ID, F.col("pageview_url").alias("product_page_seen")))


def urls_after(pageviews: DataFrame, window: TimeRange, urls: Sequence[str]) -> DataFrame:
    """Distinct urls seen after any view of ``urls`` in the window in the same session, plus
    NULL when some such view is the last pageview of its session (an unmatched outer row).

    A url follows some view of the session exactly when its latest view in the
    session is after the session's earliest view; a view is unmatched exactly
    when the session's latest pageview is a view.  One aggregate per
    (session, url) and one per session over its rows decide both.
    """
    viewed = window.on("created_at") & F.col("pageview_url").isin(*urls)
    per_url = per_key(pageviews, pageviews.filter(viewed).select(SESSION_ID), SESSION_ID,
                      F.max(PAGEVIEW_ID).alias("_last"), F.min(F.when(viewed, F.col(PAGEVIEW_ID))).alias("_first_view"),
                      F.max(F.when(viewed, F.col(PAGEVIEW_ID))).alias("_last_view"), by=["pageview_url"])
    per_session = per_url.groupBy(SESSION_ID).agg(
        F.min("_first_view").alias("_anchor"), F.max("_last").alias("_end"), F.max("_last_view").alias("_last_view")).filter(F.col("_anchor").isNotNull())
    later = (per_url.select(SESSION_ID, "pageview_url", "_last").join(rekeyed(per_session.select(SESSION_ID, "_anchor"), SESSION_ID), SESSION_ID)
             .filter(F.col("_last") > F.col("_anchor")).select("pageview_url"))
    unmatched = per_session.filter(F.col("_last_view") >= F.col("_end")).select(F.lit(None).cast("string").alias("pageview_url"))
    return later.unionByName(unmatched).distinct()


def product_session_flags(pageviews: DataFrame, views: DataFrame, labels: Mapping[str, str],
                          steps: Mapping[str, str], guard: str) -> DataFrame:
    """Per (session, product seen): did a later pageview of each step url follow?

    ``labels`` maps product url to label (CASE with ``guard`` as ELSE); the
    entry of a product is its earliest view in the session.
    """
    return funnel(product_entries(views, labels, guard), pageviews, steps, by=["product_seen"], after="entry_pageview_id")


def product_entries(views: DataFrame, labels: Mapping[str, str], guard: str) -> DataFrame:
    """website_session_id, product_seen, entry_pageview_id: a session's earliest view of each product."""
    label = first_match([(F.col("product_page_seen") == url, name) for url, name in labels.items()])
    return (views.withColumn("product_seen", F.coalesce(label, F.lit(guard)))
            .groupBy(SESSION_ID, "product_seen").agg(F.min(PAGEVIEW_ID).alias("entry_pageview_id")))


def product_page_flag_counts(pageviews: DataFrame, window: TimeRange, products: list[str],
                             steps: Mapping[str, str], chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """The product-funnel page listing as a multiset: distinct rows and their count.

    The listing pairs every product view in ``window`` (url in ``products``)
    with every later pageview of its session (one all-zero row when none
    follows) and flags the later page's step.  Its rows only vary by
    (session, product seen, step flags), so the same multiset is returned as
    those distinct rows with ``n_rows``, without forming the pairs:

    * for each pageview v, ``before_u(v)`` = product views of url u in the
      window earlier in the session (a prefix count: per-chunk counts with
      offsets, then a running count inside the chunk, so no window holds
      more than ``chunk`` rows of a session);
    * pairs (u, flags) of a session = sum of ``before_u(v)`` over its pages
      v with those flags;
    * a product view that is the session's last pageview adds one all-zero
      row (the outer join's unmatched row).
    """
    marks = {i: flag((F.col("pageview_url") == u) & window.on("created_at")) for i, u in enumerate(products)}
    pv = pageviews.select(SESSION_ID, PAGEVIEW_ID, "pageview_url", "created_at").withColumns(
        {f"_p{i}": m for i, m in marks.items()})
    # Only pages of sessions with a product view in the window (a plain filter
    # that reaches the scan) are cut into chunks.
    viewed = pageviews.filter(window.on("created_at") & F.col("pageview_url").isin(*products)).select(SESSION_ID)
    pv = key_range(pv, viewed, SESSION_ID).join(rekeyed(viewed.distinct(), SESSION_ID), SESSION_ID, "left_semi")
    pv = rekeyed(pv, SESSION_ID)

    keys = [SESSION_ID]
    chunked = with_chunk(pv, PAGEVIEW_ID, chunk)
    whole, prior = group_window(keys), prior_chunks(keys)
    chunk_aggs = {f"_c{i}": F.sum(f"_p{i}") for i in marks}
    chunk_aggs["_cmax"] = F.max(PAGEVIEW_ID)
    group_values = {f"_o{i}": F.coalesce(F.sum(f"_c{i}").over(prior), F.lit(0).cast("long")) for i in marks}
    group_values["_last"] = F.max("_cmax").over(whole)
    group_values["_views"] = sum(F.sum(f"_c{i}").over(whole) for i in marks)
    offsets = chunk_offsets(chunked, keys, chunk_aggs, group_values).filter(F.col("_views") > 0)

    inner = before_in_chunk(keys, PAGEVIEW_ID)
    rows = chunked.join(offsets.select(*keys, CHUNK, "_last", *[f"_o{i}" for i in marks]), [*keys, CHUNK], "inner")
    rows = rows.withColumns({
        f"_b{i}": F.col(f"_o{i}") + F.coalesce(F.sum(f"_p{i}").over(inner), F.lit(0).cast("long"))
        for i in marks})
    url = F.col("pageview_url")
    flags = [flag(url == u).alias(f"{name}_page") for name, u in steps.items()]
    flag_cols = [f"{name}_page" for name in steps]
    is_last = F.col(PAGEVIEW_ID) == F.col("_last")
    per_flags = rows.groupBy(SESSION_ID, *flags).agg(
        *[F.sum(f"_b{i}").alias(f"_n{i}") for i in marks],
        *[F.sum(F.when(is_last, F.col(f"_p{i}")).otherwise(0)).alias(f"_u{i}") for i in marks])
    # Unpivot in one pass: per product, the pairs with these flags and the
    # unmatched (all-zero) rows of its views that end the session.
    zero = [F.lit(0).alias(c) for c in flag_cols]
    entries = []
    for i, u in enumerate(products):
        entries.append(F.struct(F.lit(u).alias("product_page_seen"), *[F.col(c) for c in flag_cols],
                                F.col(f"_n{i}").cast("long").alias("n_rows")))
        entries.append(F.struct(F.lit(u).alias("product_page_seen"), *zero,
                                F.col(f"_u{i}").cast("long").alias("n_rows")))
    listing = per_flags.select(SESSION_ID, F.explode(F.array(*entries)).alias("_e")).select(SESSION_ID, "_e.*")
    return (listing.filter(F.col("n_rows") > 0)
            .groupBy(SESSION_ID, "product_page_seen", *flag_cols)
            .agg(F.sum("n_rows").alias("n_rows")))
