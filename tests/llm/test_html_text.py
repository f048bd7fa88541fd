import html as h
import re

from ledgerline.llm import html_text as x
from ledgerline.llm.common import documents
from tests.llm.util import SF


def pages_df(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, host int")


def test_whole_table_against_the_article_element(spark):
    """The tables' pages have one article element; its text is cut out by hand."""
    pages = documents(spark, SF, "pages")
    source = {r.page_id: r for r in pages.collect()}
    got = x.query(pages).collect()
    assert len(got) == len(source)
    for r in got:
        inner = re.search(r"<article>(.*)</article>", source[r.page_id].html, re.S).group(1)
        want = " ".join(h.unescape(re.sub(r"</?(?:p|h1|br)>", " ", re.sub(r"</?b>", "", inner))).split())
        assert r.text == want and r.n_chars == len(want) and r.url == source[r.page_id].url


PAGE = """<!doctype html><html><head><title>T</title><style>p{{}}</style></head><body>
<header class="top"><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies</div>
<div id="wrap"><div class="post post-{k}"><h1>Head &amp; line {k}</h1><div class="meta">By me</div><p>First <b>bold</b>ed
 para&nbsp;graph &lt;x&gt; with many words in it, number {k}.<p>Second one<br>with a break and more words to read.
<form><input name=q>Search here</form><script>var a = "</p><p>no";</script><!-- <p>gone</p> -->
<ul><li>one item<li>two items</ul><span class="adsbox ad-slot">Buy now</span>
<div class="comments"><p>Great article, I love it very much indeed and agree.</p></div></div>
<aside>Related links</aside></div><footer>&copy; me</footer></body></html>"""


def wanted(k):
    return (f"Head & line {k} By me First bolded para graph <x> with many words in it, number {k}. "
            "Second one with a break and more words to read. one item two items")


def test_article_without_everything_else(spark):
    rows = [(k, f"http://h{k % 2}.example/x?{k}", PAGE.format(k=k)) for k in range(6)]
    assert {r.page_id: r.text for r in x.query(pages_df(spark, rows)).collect()} == {k: wanted(k) for k in range(6)}


def test_the_hosts_path_beats_a_misleading_page(spark):
    plain = "<body><div class=a><p>{}</p></div><div class=b><p>{}</p></div></body>"
    rows = [(k, "http://one.example/", plain.format("long text " * 20, "short")) for k in range(5)]
    rows.append((9, "HTTP://user@ONE.example:80/z", plain.format("long text here " * 8, "unusually long other box " * 4)))
    got = {r.page_id: r for r in x.extract(pages_df(spark, rows)).collect()}
    assert got[9].host_path == got[1].host_path == ">body>div.a"
    assert got[9].text == ("long text here " * 8).strip()


CASES = [(1, None, None), (None, "u", ""), (3, "http://a/", "just text &amp; more"), (4, "http://a/", "<p>a<p>b<div>c"), (4, "http://a/", "<p>a<p>b<div>c"),
         (5, "http://b/", "<script>x"), (6, "http://b/", "<<<>>><"), (7, "http://c/", "<p>" + "word " * 30_000), (8, "http://c/", "<table><tr><td>x<td>y<tr><td>z</table>"),
         (9, "http://d/", "a < b and <b>c</b>d"), (10, "http://e/", "<div><p>x</div></div></p>y")]


def test_cases(spark):
    got = sorted(((r.page_id, r.text) for r in x.query(pages_df(spark, CASES)).collect()), key=str)
    want = {1: "", None: "", 3: "just text & more", 4: "a b c", 5: "", 6: "<<<>>><", 7: ("word " * 30_000).strip(), 8: "x y z", 9: "a < b and cd", 10: "x y"}
    assert got == sorted(((i, want[i]) for i, _, _ in CASES), key=str)
    assert x.query(pages_df(spark, [])).count() == 0


def test_large_host_tables_are_joined_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(x, "BROADCAST_BYTES", -1)
    rows = [(k, f"http://h{k}.example/", PAGE.format(k=k)) for k in range(3)]
    assert {r.page_id: r.text for r in x.query(pages_df(spark, rows)).collect()} == {k: wanted(k) for k in range(3)}


def one(source):
    page = x.parse(source)
    return x.text_at(page, x.widened(page, x.best_path(x.container_scores(page))))


BODY = "Body text with a good many words in it, more than all the rest of the page has. " * 3
KEPT = [
    # names that only hold a doubtful word
    ('<article><div class="article-header"><h1>T</h1><p>Lead para.</p></div><p>Body.</p></article>', "T Lead para. Body."),
    ('<article><div class="header"><h1>T</h1><p>Lead para.</p></div><p>Body.</p></article>', "T Lead para. Body."),
    (f'<body><h1>T</h1><div class="share-price-report"><p>{BODY}</p></div></body>', f"T {BODY}".strip()),
    (f'<article><h1>T</h1><p>{BODY}</p><div class="share-price">It rose.</div></article>', f"T {BODY}It rose."),
    (f'<body><div id="content-sidebar-wrap"><h1>T</h1><p>{BODY}</p><div class="sidebar"><p>Other</p></div></div></body>', f"T {BODY}".strip()),
    (f'<body><div class="alert"><p>{BODY}</p></div><p><a href=/>x</a></p></body>', BODY.strip()),
    # an introduction above the body
    (f"<body><div class=post><p>Intro words here.</p><div class=text><p>{BODY}</p></div></div></body>", f"Intro words here. {BODY}".strip()),
    (f"<body><div class=post><p>Intro.</p><div class=a><div class=text><p>{BODY}</p></div></div></div></body>", f"Intro. {BODY}".strip()),
]
DROPPED = [
    '<div class="site-header"><p>Site name</p></div>', '<div class="share-bar"><p>Share this</p></div>', '<div class="cookie-notice">We use them</div>',
    '<div class="post-share"><a href=/>one</a> <a href=/>two</a></div>', '<div class="related-articles"><p>Else</p></div>',
    f'<div class="comments-area"><p>{BODY * 2}</p></div>', '<div class="notice">Closed today</div>', '<div class="newsletter-teaser"><p>Sign up</p></div>',
    '<div hidden>unseen</div>', '<div role="navigation">menu</div>']


def test_article_text_in_containers_with_doubtful_names():
    for source, want in KEPT:
        assert one(source) == want, source


def test_furniture_stays_out():
    for junk in DROPPED:
        for page in (f"<body><article><h1>T</h1><p>{BODY}</p>{junk}</article></body>", f"<body>{junk}<div class=post><h1>T</h1><p>{BODY}</p></div></body>"):
            assert one(page) == f"T {BODY}".strip(), page


def test_pages_without_article_keep_their_introduction(spark):
    source = "<body><div class=top>Site</div><div class=post>{}<div class=text><p>" + BODY + "</p></div></div></body>"
    rows = [(k, "http://i.example/", source.format("<p>Intro.</p>" if k == 3 else "")) for k in range(6)]
    got = {r.page_id: r.text for r in x.query(pages_df(spark, rows)).collect()}
    assert got == {k: ("Intro. " + BODY if k == 3 else BODY).strip() for k in range(6)}
