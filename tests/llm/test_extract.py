import html
import re
import time

from funnelwise.llm import extract as X

SF = "/root/testdata/sf0.001"


def test_article_of_every_page(spark):
    """On pages with one article element its whole text is wanted: strip the markup plainly."""
    rows = X.extract(spark.read.parquet(f"{SF}/pages.parquet")).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect()
    assert rows
    for r in rows:
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        plain = html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|br|h1)[^>]*>", " ", article)))
        assert r.text == " ".join(plain.split())
        assert r.n_chars == len(r.text)


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>if (a < b) document.write("<p>no</p>")</script></head>
<body><header><h1>Site name</h1></header>
<div id="cookie-notice"><p>We use cookies, and this notice is long enough to be a surge in the distribution of text over the lines of the page.</p></div>
<div class="wrap"><div class="menu"><a href="/x">One</a> <a href="/y">Two</a></div>
<div class="col"><h2>Title  here</h2><p>The first paragraph has enough text to be part of an article, and a bit more of it so that it's surely a surge.</p>
<p>Short.</p><!-- <p>hidden</p> --><p>A second one &amp; with <b>bo</b>ld, caf&eacute;&#33; and&nbsp;enough text to be an article's paragraph, and more of it.<br>New line</div>
<div class="sidebar"><ul><li>a<li>b</ul></div></div>
<section id=comments><p>I like it a lot, and this reader's comment is really very long: on and on and on and on and on and on and on and on and on it goes.</p></section>
<form><p>Subscribe to our letter and never miss a thing, whatever it may be that we will write about in the coming years.</p></form><footer>foot</footer></body></html>"""


def test_without_article_element():
    assert X.main_text(PAGE) == (
        "Title here The first paragraph has enough text to be part of an article, and a bit more of it so that it's surely a surge. Short. "
        "A second one & with bold, café! and enough text to be an article's paragraph, and more of it. New line")


def test_names_of_boilerplate():
    long = "This paragraph is long enough to be a surge of text in the middle of the page, whatever else stands around it."
    page = f"""<body class="has-sidebar"><div class="layout-with-menu wrapper"><div id="header"><p>Name of the site and its motto, which is long enough to count as text</p></div>
<div class="topnav">x y z</div><div class="entry-header"><h1>Title</h1></div><div class="entry-content"><p>{long}</p><div class="advert-box">{long}</div>
<p>Second. {long}</p></div><ol class="commentlist"><li>{long}</li></ol><div role="complementary">{long}</div></div></body>"""
    assert X.main_text(page) in (f"{long} Second. {long}", f"Title {long} Second. {long}")
    assert X.main_text(f"<main><h1>T</h1><p>{long}</p><section class='related'><p>{long}</p></section></main><p>{long} {long}</p>") == f"T {long}"
    assert X.main_text(f"<table><tr><td class=menu>{long}</td><td><p>{long}</p><p>end.</p></td></tr></table>") == f"{long} end."


LONG = "This paragraph is long enough to be a surge of text in the middle of the page, whatever else stands around it."


def test_stretches_between_surge_and_dive():
    open_ = [False] * 12
    assert X.stretches([5, 0, 0, 0, 100, 3, 80, 0, 0, 0, 70, 0], open_) == [(4, 6), (10, 10)]
    assert X.stretches([1, 2, 9], open_[:3]) == []
    assert X.stretches([100, 90, 100], [False, True, False]) == [(0, 0), (2, 2)]
    assert X.stretches([40, 90, 40], [False, True, False]) == [] == X.stretches([], [])


def test_stretches_decide_without_article_elements(spark):
    """The same pages with plain div elements: the lengths alone find every article, and other lines than theirs don't."""
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    plain = [re.sub(r"<(/?)article>", r"<\1div>", p) for p in pages]
    assert pages != plain and [X.main_text(p) for p in plain] == [X.main_text(p) for p in pages]
    lines = [X.parse(p) for p in plain]
    everything = [" ".join(l.texts) for l in lines]
    assert all(X.main_text(p) != t for p, t in zip(plain, everything))


def test_no_text_of_the_article_is_lost():
    two = f"<body><div class=ad>{LONG}</div><article><p>{LONG} one</p></article><article><p>{LONG} two</p></article><footer>{LONG}</footer></body>"
    assert X.main_text(two) == f"{LONG} one {LONG} two"
    assert X.main_text(f"<main>{two}</main>") == f"{LONG} one {LONG} two"
    links = "<p><a href=x>a link</a></p>" * 4
    for gap, text in (("", ""), (links, " a link a link a link a link")):
        content = f"<div class=content><div class=text><p>{LONG}</p><p>{LONG} more</p></div>{gap}<div class=text><p>{LONG} end</p></div></div>"
        assert X.main_text(f"<nav>x</nav>{content}<footer>y</footer>") == f"{LONG} {LONG} more{text} {LONG} end"
        body = f"<body><nav>x</nav><h1>Title</h1><p>{LONG}</p>{gap}<p>{LONG} end</p><footer>{LONG}</footer></body>"
        assert X.main_text(body) == f"Title {LONG}{text} {LONG} end"
    for name in ("social-history", "alert-systems", "related-work", "search-engines-compared", "has-sidebar"):
        assert X.main_text(f"<article><p>{LONG}</p><section id={name}><p>{LONG} more</p></section></article>") == f"{LONG} {LONG} more"
    for name in ("social-share", "related-posts", "cookie-notice", "comments", "newsletter_signup-box", "reader-comments"):
        assert X.main_text(f"<article><p>{LONG}</p><section id={name}><p>{LONG} more</p></section><p>end</p></article>") == f"{LONG} end"


def test_articles_in_barriers():
    teaser = f"<aside><article>{LONG} teaser</article></aside>"
    assert X.main_text(f"<article>{LONG}</article>{teaser}") == LONG
    assert X.main_text(f"<div class='modal'><article>{LONG}</article></div><div>other {LONG}</div>") == LONG
    assert X.main_text(f"<div class=ad>x<article>{LONG}</article><footer>y</footer>") == LONG
    assert X.main_text(f"<article>{LONG}<article class=comment>{LONG} I think</article></article>") == LONG


def test_deep_markup_takes_linear_time():
    for page in ("<div>x" * 20_000, "<b>y " * 20_000, "<article><p>a" * 10_000, "<div class=ad>x" * 10_000, "<a href=x>z" * 10_000, "<div class=ad><article>x" * 5_000):
        start = time.process_time()
        X.main_text(page)
        assert time.process_time() - start < 3


def test_edge_pages(spark):
    pages = [(1, "u", None), (2, None, ""), (3, "u", "plain"), (4, "u", "<article></article>"), (4, "u", "<article>twice"), (None, "u", "<p>a<b>b"),
             (6, "u", "<article><p>x</p><nav>menu</nav><p>y &lt; z</article> tail"), (7, "u", "<div class='ad'>advert<article>told</article>"),
             (8, "u", "<article>" + "<p>word</p>" * 5000 + "</article>"), (9, "u", "a < b <"), (10, "u", "<script>only"), (11, "u", '<p title="a>b">t</p>')]
    df = spark.createDataFrame([(*p, 5, "z") for p in pages], "page_id bigint, url string, html string, n_chars int, text string")
    got = sorted([(r.page_id, r.text, r.n_chars) for r in X.extract(df).collect()], key=repr)
    want = [(1, ""), (2, ""), (3, "plain"), (4, ""), (4, "twice"), (None, "ab"), (6, "x y < z"), (7, "told"), (8, " ".join(["word"] * 5000)), (9, "a < b <"), (10, ""), (11, "t")]
    assert got == sorted([(i, t, len(t)) for i, t in want], key=repr)
    assert X.extract(df.limit(0)).count() == 0
