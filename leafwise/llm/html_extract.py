"""Main text of web pages by a tree-structured graphical model.

The elements of a page form a tree.  Every element has a hidden label,
content or not; its observed features (tag, words of class and id, density
of links, amount of text) depend on the label, and the label depends on that
of the parent.  Sum-product messages run upward from the leaves and downward
from the root and give each element's marginal; a block of text belongs to
the article when the marginal of the element that holds it says content.

The potentials are counts from labelled pages.  A labelled page is HTML in
which ``data-main="1"`` or ``"0"`` labels an element and what it holds, down
to the next label; elements above any label are unlabelled for training.
``TRAINING`` holds small labelled pages; ``semantic_labels`` labels pages
that mark their article themselves.

Edge cases: NULL html is empty and has empty text; unclosed, stray and
deeply nested tags are accepted; very long pages are read whole, in time
linear in their length; an empty table gives no rows; repeated rows and extra
columns change nothing.  White space includes the no-break space.  ``<br>`` is white space.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwise.llm.common import bound_batches

#: Hashed feature names.
WIDTH = 4096
#: Pages from the table that are labelled by their own markup for training, about (chosen by a hash of the id).
SAMPLE = 2000
#: Pseudo-count of every potential.
PRIOR = 0.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as page text.
RAW = frozenset("script style noscript template iframe textarea title svg math select button".split())
LITERAL = frozenset("script style textarea title iframe noscript".split())
#: Elements that flow inside a block; all others begin a block of their own.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that may hold an article or a frame around it; the others mostly go with their parent.
CONTAINER = frozenset("#root html body div section article main center td header footer aside nav form".split())
#: Opening one of these closes an open element of the set, up to the nearest of the barrier.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
SIGN = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""(class|id|role|data-main)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z]+")


@dataclass
class Tree:
    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    words: list[str] = field(default_factory=list)
    #: data-main of the element: "1", "0" or "".
    mark: list[str] = field(default_factory=list)
    #: (element that holds it, text) in page order; the text is one block.
    blocks: list[tuple[int, str]] = field(default_factory=list)
    text_len: list[int] = field(default_factory=list)
    link_len: list[int] = field(default_factory=list)


class Scanner:
    """The comments, declarations and tags of a page one after the other, in time linear in the page.

    A tag ends at the first ">" outside quotes; where quotes never end so, at
    the first ">" of all.  Quotes from which no such end is reached are
    remembered: no later tag follows them again.
    """

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.astray: set[int] = set()

    def tag_end(self, pos: int) -> int:
        """The ">" that ends the tag whose attributes start at ``pos``."""
        page, way, at = self.page, [], pos
        while (m := SIGN.search(page, at)) is not None:
            i = m.start()
            if page[i] == ">":
                return i
            if i in self.astray:
                break
            way.append(i)
            at = page.find(page[i], i + 1) + 1
            if not at:
                break
        self.astray.update(way)
        return page.find(">", pos)

    def next(self, pos: int) -> tuple[int, int, str, bool, str] | None:
        """The next one from ``pos``: start, end, name ("" if no tag), whether it closes, attributes."""
        page = self.page
        while (lt := page.find("<", pos)) >= 0:
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                return lt, len(page) if end < 0 else end + 3, "", False, ""
            if lt > self.last:                # no tag ends any more; a comment may still begin
                lt = page.find("<!--", lt)
                if lt < 0:
                    return None
                pos = lt
                continue
            if page[lt + 1 : lt + 2] in ("!", "?"):
                return lt, page.find(">", lt) + 1, "", False, ""
            closes = page.startswith("/", lt + 1)
            if (m := NAME.match(page, lt + 1 + closes)) is not None:
                end = self.tag_end(m.end())
                return lt, end + 1, m[0].lower(), closes, page[m.end() : end]
            pos = lt + 1
        return None


def parse(page: str) -> Tree:
    """The tree of block elements of a page, with its blocks of text."""
    t = Tree()

    def node(parent: int, tag: str, attrs: str) -> int:
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attrs)} if attrs else {}
        t.parent.append(parent)
        t.tag.append(tag)
        t.words.append(" ".join(found.get(k, "") for k in ("class", "id", "role")).lower())
        t.mark.append(found.get("data-main", ""))
        t.text_len.append(0)
        t.link_len.append(0)
        return len(t.parent) - 1

    root = node(-1, "#root", "")
    # open elements: (tag, node that holds their text, inside hidden, inside a link)
    stack = [("#root", root, False, False)]
    # depths of the open elements by tag, and of those that are blocks
    depths: dict[str, list[int]] = {}
    blocks = [0]
    scanner = Scanner(page)
    run: list[str] = []
    pos = 0

    def deepest(tags) -> int:
        return max((depths[x][-1] for x in tags if depths.get(x)), default=0)

    def flush() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if text:
            t.blocks.append((stack[-1][1], text))

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            tag = stack[-1][0]
            if tag not in INLINE:
                flush()
                blocks.pop()
            depths[tag].pop()
            stack.pop()

    def add_text(raw: str) -> None:
        _, holder, hidden, link = stack[-1]
        if not hidden:
            run.append(raw)
            n = len(raw)
            t.text_len[holder] += n
            if link:
                t.link_len[holder] += n

    while pos < len(page):
        found = scanner.next(pos)
        if found is None:
            add_text(page[pos:])
            break
        start, end, name, closes, attrs = found
        if start > pos:
            add_text(page[pos:start])
        pos = end
        if not name:
            continue
        if closes:
            if depths.get(name):
                close_to(depths[name][-1])
            elif name not in INLINE:
                flush()
            continue
        if name == "br":
            run.append(" ")
            continue
        if name in VOID:
            if name not in INLINE:
                flush()
            continue
        if name not in INLINE:
            flush()
            if stack[blocks[-1]][0] == "p":
                close_to(blocks[-1])
            if name in CLOSES:
                shut, barrier = map(deepest, CLOSES[name])
                if shut > barrier:
                    close_to(shut)
        holder = stack[-1][1] if name in INLINE else node(stack[-1][1], name, attrs)
        hidden = stack[-1][2] or name in RAW
        if name not in INLINE:
            blocks.append(len(stack))
        depths.setdefault(name, []).append(len(stack))
        stack.append((name, holder, hidden, stack[-1][3] or name == "a"))
        if name in LITERAL:
            end = re.compile(f"</{name}", re.I).search(page, pos)
            pos = end.start() if end else len(page)
        elif attrs.endswith("/") and name in ("svg", "math"):
            close_to(len(stack) - 1)
    close_to(1)
    flush()
    return t


def _feature(name: str) -> int:
    return zlib.crc32(name.encode()) % WIDTH


def features(t: Tree) -> list[list[int]]:
    """Hashed features of every element."""
    n = len(t.parent)
    text, link = list(t.text_len), list(t.link_len)
    for i in range(n - 1, 0, -1):  # children come after their parents
        text[t.parent[i]] += text[i]
        link[t.parent[i]] += link[i]
    out = []
    for i in range(n):
        own = [f"tag:{t.tag[i]}", f"len:{min(text[i].bit_length(), 12)}", f"link:{min(4, 5 * link[i] // max(text[i], 1))}"]
        own += {f"word:{w}" for w in WORD.findall(t.words[i])}
        out.append([_feature(x) for x in own])
    return out


@dataclass
class Model:
    #: log P(feature | label), shape (2, WIDTH)
    emit: np.ndarray
    #: log P(label of child | label of parent), shape (2, 2, 2): first for elements that flow, then for containers
    pair: np.ndarray
    #: log P(label) at the root
    root: np.ndarray


def marginals(t: Tree, feats: list[list[int]], model: Model) -> np.ndarray:
    """P(content) of every element: messages upward, then downward."""
    n = len(t.parent)
    e0, e1 = model.emit
    flow, hold = np.exp(model.pair).tolist()
    pair = [hold if x in CONTAINER else flow for x in t.tag]
    up0, up1 = [0.0] * n, [0.0] * n  # log of own features and all below, per own label
    to0, to1 = [0.0] * n, [0.0] * n  # message to the parent, per the parent's label
    for i in range(n):
        f = feats[i]
        up0[i], up1[i] = float(e0[f].sum()), float(e1[f].sum())
    for i in range(n - 1, 0, -1):
        (a00, a01), (a10, a11) = pair[i]
        top = max(up0[i], up1[i])
        x0, x1 = math.exp(up0[i] - top), math.exp(up1[i] - top)
        to0[i] = top + math.log(a00 * x0 + a01 * x1)
        to1[i] = top + math.log(a10 * x0 + a11 * x1)
        p = t.parent[i]
        up0[p] += to0[i]
        up1[p] += to1[i]
    b0, b1 = [0.0] * n, [0.0] * n  # beliefs
    b0[0], b1[0] = up0[0] + model.root[0], up1[0] + model.root[1]
    for i in range(1, n):
        p = t.parent[i]
        (a00, a01), (a10, a11) = pair[i]
        c0, c1 = b0[p] - to0[i], b1[p] - to1[i]  # the parent without this child
        top = max(c0, c1)
        x0, x1 = math.exp(c0 - top), math.exp(c1 - top)
        b0[i] = up0[i] + top + math.log(a00 * x0 + a10 * x1)
        b1[i] = up1[i] + top + math.log(a01 * x0 + a11 * x1)
    d = np.clip(np.array(b0) - np.array(b1), -700, 700)
    return 1 / (1 + np.exp(d))


def extract(page: str, model: Model) -> str:
    t = parse(page)
    if not t.blocks:
        return ""
    content = marginals(t, features(t), model) > 0.5
    return "\n\n".join(text for holder, text in t.blocks if content[holder])


def labels_of(t: Tree) -> list[int]:
    """Label of every element from its own or the nearest mark above; -1 without one, and for an element that holds both."""
    out = []
    for i in range(len(t.parent)):
        own = t.mark[i]
        out.append(int(own) if own in ("0", "1") else out[t.parent[i]] if i else -1)
    return out


#: Elements that say themselves what they hold.
SAYS_MAIN = {"article": 1, "main": 1, "nav": 0, "footer": 0, "aside": 0, "form": 0, "menu": 0, "dialog": 0}


def semantic_labels(t: Tree) -> None:
    """Mark the elements of a page that has an article by what their tags say; pages without one stay unmarked."""
    if "article" in t.tag or "main" in t.tag:
        for i, tag in enumerate(t.tag):
            if not t.mark[i] and tag in SAYS_MAIN:
                t.mark[i] = str(SAYS_MAIN[tag])
        for i, tag in enumerate(t.tag):
            if tag == "body" or (t.parent[i] >= 0 and t.tag[t.parent[i]] == "body" and not t.mark[i] and tag != "div"):
                t.mark[i] = t.mark[i] or "0"


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (kind, a, b, n): kind 0 feature a under label b, kind 1 (3 for containers) parent label a and child label b, kind 2 label b."""
    total: dict[tuple[int, int, int], int] = {}

    def add(*key: int, n: int = 1) -> None:
        total[key] = total.get(key, 0) + n

    for pdf in batches:
        for page, given, times in zip(pdf["html"], pdf["given"], pdf["times"]):
            t = parse(page.decode("utf-8", "replace"))
            if not given:
                semantic_labels(t)
            label, feats = labels_of(t), features(t)
            for i, y in enumerate(label):
                if y < 0:
                    continue
                add(2, 0, y, n=times)
                for f in feats[i]:
                    add(0, f, y, n=times)
                # above the marks nothing is content
                above = max(label[t.parent[i]], 0) if i else 0
                add(3 if t.tag[i] in CONTAINER else 1, above, y, n=times)
    if total:
        yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["kind", "a", "b", "n"])


def fit(labelled: DataFrame) -> Model:
    """Potentials from rows (html binary, given boolean, times int); ``given``: the page carries data-main marks."""
    got = (
        labelled.mapInPandas(_count, "kind int, a int, b int, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    )  # 2 * WIDTH + 10 rows at most
    seen, pair, label = np.zeros((2, WIDTH)), np.zeros((2, 2, 2)), np.zeros(2)
    for r in got:
        if r["kind"] == 0:
            seen[r["b"], r["a"]] = r["n"]
        elif r["kind"] == 2:
            label[r["b"]] = r["n"]
        else:
            pair[r["kind"] // 2, r["a"], r["b"]] = r["n"]
    emit = np.log((seen + PRIOR) / (label[:, None] + 2 * PRIOR))
    pair = np.log((pair + PRIOR) / (pair.sum(axis=2, keepdims=True) + 2 * PRIOR))
    return Model(emit, pair, np.log(np.array([0.95, 0.05])))


def training_rows(spark: SparkSession, pages: DataFrame, page_count: int) -> DataFrame:
    """The labelled pages of ``TRAINING`` (each counted as often as keeps them audible) and a sample of ``pages`` with an article."""
    times = max(20, min(page_count, SAMPLE) // (4 * len(TRAINING)))
    own = spark.createDataFrame([(bytearray(p.encode()), True, times) for p in TRAINING], "html binary, given boolean, times int")
    rate = min(1.0, SAMPLE / max(page_count, 1))
    draw = F.pmod(F.xxhash64("page_id", F.lit("pages")), F.lit(1_000_000)) / 1_000_000
    drawn = pages.where(F.col("html").isNotNull() & (draw < rate))
    return own.unionByName(drawn.select(F.col("html").cast("binary").alias("html"), F.lit(False).alias("given"), F.lit(1).alias("times")))


def extract_column(model: Model, column: str = "html") -> Column:
    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([extract(p.decode("utf-8", "replace"), model) for p in pages], dtype=object)

    return main_text(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page."""
    bound_batches(pages.sparkSession, 200)
    model = fit(training_rows(pages.sparkSession, pages, pages.count()))
    return pages.select("page_id", "url", extract_column(model).alias("text"))


_BODY = """<h1>How rivers shape their valleys</h1><p>A river carries stones, sand and clay from the hills to the plain, and
each flood moves the banks a little.</p><h2>Slow work</h2><p>Where the water is slow the load settles, and a
<a href="/delta">delta</a> grows year after year into the sea. The land behind it sinks under the weight.</p>
<blockquote><p>No one sees the same river twice, as the saying goes, and geology agrees with it.</p></blockquote>
<ul><li>Steep rivers cut narrow valleys into hard rock.</li><li>Slow rivers wander over wide plains of their own making.</li></ul>
<table><tr><th>River</th><th>Length</th></tr><tr><td>Long one</td><td>6,000 km</td></tr></table>
<pre>depth = flow / width</pre><figure><figcaption>The delta from above, seen in late summer</figcaption></figure>"""
_MENU = '<ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/shop">Shop</a></li><li><a href="/about">About us</a></li></ul>'

#: Labelled pages: the same article in different frames.
TRAINING = [
    f'<html><head><title>Rivers</title></head><body data-main="0"><header><p>The Valley Paper</p>{_MENU}</header><nav>{_MENU}</nav>'
    f'<main data-main="1">{_BODY}</main><aside><h3>Most read</h3>{_MENU}</aside><footer><p>&copy; The Valley Paper. All rights reserved.</p></footer></body></html>',
    f'<html><body data-main="0"><div id="header" class="site-header top banner"><h2>Valley blog</h2></div><div class="menu navigation navbar">{_MENU}</div>'
    f'<div id="content" class="post entry article body text story" data-main="1">{_BODY}</div><div class="sidebar widget"><p>Read also</p>{_MENU}</div>'
    f'<div id="comments" class="comments discussion replies"><h3>2 comments</h3><div class="comment reply"><p>Great text, thank you for writing about our river so well!</p></div>'
    f'<div class="comment"><p>I do not agree with the part on deltas at all, they sink much faster.</p></div></div>'
    f'<div id="footer" class="footer copyright"><p>Imprint, privacy, terms of use</p></div></body></html>',
    f'<html><body data-main="0"><div class="cookie notice consent banner alert"><p>We use cookies to make this site better. Accept all?</p></div>'
    f'<div class="ad ads advert advertisement sponsored promo"><p>Buy the best boots of the year now, half price this week only!</p></div><article data-main="1">{_BODY}'
    f'<div class="ad" data-main="0"><p>Buy the best boots of the year.</p></div><p>In the end the sea takes what the river brought.</p></article>'
    f'<form class="newsletter signup subscribe"><p>Sign up for our letter</p><label>Mail</label><input><button>Send</button></form>'
    f'<section class="comments"><h2>Comments</h2><ol><li><p>First! And what a good read on a rainy day it was for me.</p></li></ol></section></body></html>',
    f'<html><body data-main="0"><div class="page wrapper container"><div class="breadcrumb"><a href="/">Home</a> <a href="/n">Nature</a></div>'
    f'<section class="content main" data-main="1">{_BODY}</section><div class="related recommended"><h3>Related</h3>{_MENU}</div>'
    f'<div class="share social"><a href="#">Share</a> <a href="#">Post</a></div><div class="author bio"><p>The author lives by a river.</p></div></div></body></html>',
    f'<html><body data-main="0"><div class="popup modal dialog overlay"><p>Subscribe now for full access to all of our texts.</p></div>'
    f'<nav class="nav">{_MENU}</nav><article class="post" data-main="1"><header><h1>Rivers</h1></header>{_BODY}</article>'
    f'<aside class="sidebar"><div class="promo"><p>Our partner offers boots.</p></div></aside><div class="disclaimer legal notice"><p>Opinions are those of the author.</p></div></body></html>',
    '<html><body data-main="0"><nav><ul><li><a href="/a">one</a></li><li><a href="/b">two</a></li></ul></nav><article data-main="1"><h1>Short</h1><p>Yes.</p><p>It is so.</p></article><footer>&copy; site</footer></body></html>',
]
