"""Main text of web pages by consensus paths of a host.

Each page's containers are scored: how much of the page's clean text (outside
menus, headers, footers, forms, adverts, notices, comments) a container holds,
how little else, and whether it has the headline.  A container is known by its
generalised path, the tags and classes from the root with digits folded; a
narrower container is preferred to one that holds little more, but never to one
that has clean text of its own outside it (an introduction above the body).
Every page votes for its best path, Spark counts the votes of a host's pages,
and the host's winning path is then used to extract its pages again.  A page on
which that path holds less than half of the clean text falls back to its own
best container, and the path is widened where the page has such text around it.

Names mark furniture by degrees.  A class name or id with a plain word for it
(``STRONG``: comments, sidebar, cookie ...) does, and so does one made of
doubtful words (``WEAK``: header, share, notice ...) and layout words alone:
``share-bar`` is furniture, ``share-price-report`` and ``article-header`` are
not.  A doubtful word beside others counts where half of the text is links.
A container so named is kept all the same if it has most of the page's text
and, for a plain word, the headline or a main element; one with a doubtful
name, if it has the headline inside an article or main element.

Defined cases: NULL or empty html gives the empty text; a page without a url
votes with all others that have none; text outside any tag counts as a page of
one container; malformed markup is read as far as it goes.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import pieces, stash

# HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp "
                   "small span strike strong sub sup time tt u var".split())
SKIPPED = frozenset("nav header footer aside form script style noscript template iframe svg button select option menu dialog "
                    "head title textarea object canvas audio video noembed noframes xmp math".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
                   "h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "option": {"option"}, "thead": {"tr", "td", "th", "thead", "tbody", "tfoot"}, "tbody": {"tr", "td", "th", "thead", "tbody", "tfoot"},
            "tfoot": {"tr", "td", "th", "thead", "tbody", "tfoot"}}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"},
          "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
CONTAINERS = frozenset("html body main article section div td center".split())
NARROWING = frozenset("main article div td center".split())
# Words of a class, id or role that mark what is not the article: plainly, or only if nothing else is said.
STRONG = frozenset("ad ads advert adverts advertisement advertising adsbox sponsored nav navbar navigation menu breadcrumb breadcrumbs "
                   "masthead footer sidebar aside cookie cookies gdpr consent comment comments commentlist disqus respond replies "
                   "newsletter pagination pager complementary contentinfo".split())
WEAK = frozenset("sponsor promo promotion banner header widget related recommended share sharing social notice notices alert disclaimer "
                 "subscribe subscription signup login popup modal overlay toolbar search skip hidden".split())
LAYOUT = frozenset("site page global top bottom left right main inner outer box bar block area section container wrapper wrap list item "
                   "items link links button buttons icon icons text message msg info warning slot unit panel strip form posts articles "
                   "stories module group row col column small large".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/][^>]*>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)|(?=[\s/>]|\Z))""", re.I)
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
PARTS = re.compile(r"[^A-Za-z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


MIXED, DOUBTFUL, PLAIN = 1, 2, 3


@dataclass
class Page:
    """Flat tree: parallel lists of nodes, and text runs in page order."""

    parent: list[int] = field(default_factory=lambda: [-1])
    path: list[str] = field(default_factory=lambda: [""])
    tag: list[str] = field(default_factory=lambda: [""])
    named: list[int] = field(default_factory=lambda: [0])
    junk: list[bool] = field(default_factory=lambda: [False])
    block: list[bool] = field(default_factory=lambda: [True])
    container: list[bool] = field(default_factory=lambda: [True])
    runs: list[tuple[int, str, bool]] = field(default_factory=list)   # node (-1: a break), text, in a link
    headline: int = -1                                                 # node of the first clean h1


def _label(tag: str, attrs: dict[str, str]) -> str:
    classes = sorted({re.sub(r"\d+", "0", c.lower()) for c in attrs.get("class", "").split()})
    return ".".join([tag, *classes])


def _is_skipped(tag: str, attrs: dict[str, str]) -> bool:
    """Furniture or unseen by its tag or attributes, whatever its name."""
    if tag in SKIPPED:
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    return "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or bool(HIDDEN.search(attrs.get("style", "")))


def _named(tag: str, attrs: dict[str, str]) -> int:
    """What the names say: PLAIN, DOUBTFUL, only MIXED with other words, or nothing (0)."""
    if not attrs or tag in ("html", "body", "article", "main"):
        return 0
    found = 0
    for name in " ".join(attrs.get(a, "") for a in ("class", "id", "role")).split():
        words = {w.lower() for w in PARTS.split(CAMEL.sub(" ", name)) if w}
        if words & STRONG:
            return PLAIN
        if words & WEAK:
            found = max(found, DOUBTFUL if words <= WEAK | LAYOUT else MIXED)
    return found


def _settle(page: Page) -> None:
    """Mark the named containers that are furniture, and find the headline."""
    n = len(page.parent)
    size, linked = np.zeros(n), np.zeros(n)
    for node, text, link in page.runs:
        if node >= 0 and not page.junk[node]:
            chars = len("".join(text.split()))
            size[node] += chars
            linked[node] += chars if link else 0
    head, main = np.zeros(n, bool), np.zeros(n, bool)
    for k in range(n):
        head[k] = page.tag[k] == "h1" and not page.junk[k]
        main[k] = page.tag[k] == "main"
    for k in range(n - 1, 0, -1):
        up = page.parent[k]
        size[up] += size[k]
        linked[up] += linked[k]
        head[up] |= head[k]
        main[up] |= main[k]
    in_article = [False] * n
    for k in range(1, n):
        up = page.parent[k]
        in_article[k] = in_article[up] or page.tag[up] in ("article", "main")
        if page.junk[up]:
            page.junk[k] = True
        if page.junk[k]:
            continue
        most = 2 * size[k] > size[0]
        if page.named[k] == PLAIN:
            page.junk[k] = not (most and (head[k] or main[k]))
        elif page.named[k]:
            kept = most or (head[k] and in_article[k])
            page.junk[k] = not kept and (page.named[k] == DOUBTFUL or 2 * linked[k] >= size[k] > 0)
    page.headline = next((k for k in range(n) if page.tag[k] == "h1" and not page.junk[k]), -1)


def parse(source: str) -> Page:
    page = Page()
    stack: list[tuple[str, int]] = [("", 0)]
    links = 0

    def pop_to(depth: int) -> None:
        nonlocal links
        while len(stack) > depth:
            tag, node = stack.pop()
            links -= tag == "a"
            if page.block[node]:
                page.runs.append((-1, " ", False))

    def close_open(tags: set[str], stop: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                pop_to(k)
                return close_open(tags, stop)
            if stack[k][0] in stop:
                return None
        return None

    at, n = 0, len(source)
    while at < n:
        m = TOKEN.match(source, at)
        at = m.end()
        tag = m.group(2)
        if tag is None:
            text = m.group()
            if text[0] != "<" or text == "<":
                page.runs.append((stack[-1][1], text, links > 0))
            continue
        tag = tag.lower()
        if m.group(1):
            if tag == "br":
                page.runs.append((-1, " ", False))
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
                if tag in INLINE and page.block[stack[k][1]]:
                    break
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                page.runs.append((-1, " ", False))
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
            if end is None:
                break
            close = source.find(">", end.start())
            at = n if close < 0 else close + 1
            continue
        if tag == "body":
            close_open({"head"}, set())
        if tag in ENDS_P:
            close_open({"p"}, {"table", "td", "th", "div", "article", "section", "li", "blockquote"})
        if tag in SIBLINGS:
            close_open(SIBLINGS[tag], SCOPES[tag])
        if tag == "a":
            close_open({"a"}, {t for t, _ in stack if t not in INLINE})
        raw = m.group(3)
        attrs = {a.lower(): html.unescape(v.strip("\"'")) for a, v in ATTRIBUTE.findall(raw)} if "=" in raw or "hidden" in raw.lower() else {}
        up, node = stack[-1][1], len(page.parent)
        block = tag not in INLINE and "-" not in tag
        page.parent.append(up)
        page.path.append(f"{page.path[up]}>{_label(tag, attrs)}" if block else page.path[up])
        page.tag.append(tag)
        page.named.append(_named(tag, attrs))
        page.junk.append(page.junk[up] or _is_skipped(tag, attrs))
        page.block.append(block)
        page.container.append(tag in CONTAINERS)
        if block:
            page.runs.append((-1, " ", False))
        if not (raw.rstrip().endswith("/") and tag == "svg"):
            stack.append((tag, node))
            links += tag == "a"
    _settle(page)
    return page


def container_scores(page: Page) -> dict[str, tuple[float, float]]:
    """(score, share of the clean text) of each container path."""
    n = len(page.parent)
    clean, other = np.zeros(n), np.zeros(n)
    for node, text, link in page.runs:
        if node >= 0 and (size := len("".join(text.split()))):
            if page.junk[node]:
                other[node] += size
            else:
                clean[node] += 0.5 * size if link else size
                other[node] += 0.5 * size if link else 0
    head = np.zeros(n, bool)
    if page.headline >= 0:
        head[page.headline] = True
    for k in range(n - 1, 0, -1):
        up = page.parent[k]
        clean[up] += clean[k]
        other[up] += other[k]
        head[up] |= head[k]
    total = clean[0]
    if not total:
        return {}
    by_path: dict[str, list[float]] = {}
    for k in range(n):
        if not page.junk[k] and page.container[k] and clean[k]:
            s = by_path.setdefault(page.path[k], [0.0, 0.0, 0.0])
            up = page.parent[k]
            if not (k and page.path[up] == page.path[k]):
                s[0] += clean[k]
                s[1] += other[k]
                s[2] = max(s[2], float(head[k]))
    out = {}
    for path, (c, o, h) in by_path.items():
        share = c / total
        headline = 1.0 if h or page.headline < 0 else 0.5
        tags = [step.split(".")[0] for step in path.split(">")]
        depth = sum(t in NARROWING for t in tags)
        named = 1.2 if tags[-1] in ("article", "main") else 1.0
        out[path] = (share * headline * named * c / (c + o) * (1 + 0.05 * depth), share)
    return out


def best_path(scores: dict[str, tuple[float, float]]) -> str:
    return max(scores, key=lambda p: (scores[p][0], p))


def widened(page: Page, path: str) -> str:
    """The path, or that of the widest container around it with clean text of its own.

    A container's own text stands in it but in no container within it; links
    don't count, nor do html, body and the page as a whole, which hold what
    the rest of a site puts around its articles."""
    near = [0] * len(page.parent)
    for k in range(1, len(page.parent)):
        near[k] = k if page.container[k] else near[page.parent[k]]
    own = {near[node] for node, text, link in page.runs if node >= 0 and not link and not page.junk[node] and text.strip()}
    wide, depth = path, path.count(">")
    for k in range(1, len(page.parent)):
        if page.container[k] and page.path[k] == path:
            up = near[page.parent[k]]
            while up and page.tag[up] not in ("html", "body"):
                if up in own and page.path[up].count(">") < depth:
                    wide, depth = page.path[up], page.path[up].count(">")
                up = near[page.parent[up]]
    return wide


def text_at(page: Page, path: str) -> str:
    """Clean text of all containers with that path, blocks in page order."""
    inside = [False] * len(page.parent)
    for k in range(len(page.parent)):
        up = page.parent[k]
        inside[k] = (page.path[k] == path and page.container[k]) or (up >= 0 and inside[up])
    parts = [text if node < 0 else html.unescape(text) for node, text, _ in page.runs
             if node < 0 or (inside[node] and not page.junk[node])]
    return " ".join("".join(parts).split())


def host(url: Column) -> Column:
    """Lower-case host of a url without user and port ('' if there is none)."""
    name = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(name)


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path): every page (columns host, html) votes for its best path;
    most votes win, then the larger sum of scores, then the smaller path."""

    def vote(batches):
        for rb in pieces(batches, "html"):
            hosts, paths, scores = [], [], []
            for h, source in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                page = parse(source)
                found = container_scores(page)
                if found:
                    path = widened(page, best_path(found))
                    hosts.append(h)
                    paths.append(path)
                    scores.append(round(found[path][0] * 1e6))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.int64())],
                                             ["host", "path", "score"])

    votes = pages.select("host", "html").mapInArrow(vote, "host string, path string, score long")
    sums = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("score").alias("score"))
    return sums.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), -F.col("score"), F.col("path"))).alias("path"))


BROADCAST_BYTES = 16 << 20


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, the path used and the host's path."""
    named = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host(F.col(url_col)).alias("host"),
                         F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    winners = stash(winning_paths(named).select(F.col("host").alias("w_host"), F.col("path").alias("w_path")), "html-paths")
    size = winners.agg(F.sum(F.octet_length("w_host") + F.octet_length("w_path") + 64)).first()[0] or 0
    # measured size: a small table of hosts is broadcast, a larger one is joined by host (AQE splits hot hosts)
    joined = named.join(F.broadcast(winners) if size <= BROADCAST_BYTES else winners, F.col("host") == F.col("w_host"), "left")
    url_type = dict(named.dtypes)["url"]

    def run(batches):
        for rb in pieces(batches, "html"):
            out, used = [], []
            for source, path in zip(rb.column(2).to_pylist(), rb.column(3).to_pylist(), strict=True):
                page = parse(source)
                scores = container_scores(page)
                if path not in scores or scores[path][1] < 0.5:
                    path = best_path(scores) if scores else None
                if path is not None:
                    path = widened(page, path)
                out.append(text_at(page, path) if path is not None else "")
                used.append(path)
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(out, pa.string()), pa.array(used, pa.string()), rb.column(3)],
                                             ["page_id", "url", "text", "path", "host_path"])

    schema = f"page_id {dict(named.dtypes)['page_id']}, url {url_type}, text string, path string, host_path string"
    return joined.select("page_id", "url", "html", "w_path").mapInArrow(run, schema)


def query(pages: DataFrame) -> DataFrame:
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
