"""Main text of web pages from flat text blocks.

A page is cut into blocks of text. A block is described by its own words and
link density, those of its neighbours, and the kind of element it stands in. A
decision tree, trained on the small labelled table below, tells main text from
the rest.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A tag ends at the next < at the latest, so that unclosed ones are not read to the end of the page again and again.
#: Quotes enclose a value behind an equals sign only; anywhere else they are signs as others are. An svg may close itself.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<svg\b[^<>]*+(?<=/)>|<(script|style|noscript|template|textarea|select|svg|iframe|title|object)\b[^<>]*+>.*?(?:</\1\s*>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>", re.S | re.I
)
_LOOSE = re.compile(r"</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
_HINT = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[a-z]+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements and words in class, id or role that say what a part of a page is.
MAIN_TAGS = frozenset(["article", "main"])
SIDE_TAGS = frozenset("nav footer aside form menu button dialog label fieldset legend option".split())
MAIN_WORDS = frozenset("article articlebody main post entry story content".split())
SIDE_WORDS = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent copyright disclaimer footer login menu nav navbar navigation newsletter notice pagination pager popup promo promoted recommended related reply replies share sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget".split()
)
#: What comes behind one of these parts of a class is had or lacked by the element, which is something else.
HAVING_PARTS = frozenset("with without has no".split())
#: A class of which this is the first part tells something about the page or its subject, not what the element is.
ASIDE_PARTS = frozenset("no not has have with without is hide category tag type status format lang js".split())
FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "in_main", "side_within", "side_around", "heading", "page_header", "mark", "has_main", "mixed"]


@dataclass
class Block:
    text: str
    words: int
    linked: int
    in_main: int
    side_within: int
    side_around: int
    heading: int
    page_header: int
    mixed: int


def _role(tag: str, attributes: str) -> str:
    """m for a main part, s for a side part, x for marks of both, h for a header, else nothing.

    Each class is judged as a whole: a side word in it makes it a side class
    (main-nav), whatever else it says.
    """
    if tag in SIDE_TAGS:
        return "s"
    main, side = tag in MAIN_TAGS, False
    if "=" in attributes:
        for hit in _HINT.finditer(attributes):
            for name in (hit[1] or hit[2] or hit[3] or "").lower().split():
                parts = _NAME.findall(name)
                if not parts or len(parts) > 1 and parts[0] in ASIDE_PARTS:
                    continue
                parts = parts[: next((i for i, x in enumerate(parts) if x in HAVING_PARTS), len(parts))]
                if not SIDE_WORDS.isdisjoint(parts):
                    side = side or tag not in ("body", "html")
                elif not MAIN_WORDS.isdisjoint(parts):
                    main = main or tag != "header"
    return "x" if main and side else "m" if main else "s" if side else "h" if tag == "header" else ""


#: What the open elements say together: in a main part, a side part within it, one around it, in a header, in a part marked both ways.
_NOWHERE = (0, 0, 0, 0, 0)


def _inside(at: tuple[int, int, int, int, int], role: str) -> tuple[int, int, int, int, int]:
    main, within, around, header, mixed = at
    if role in ("m", "x"):
        return 1, 0, around | within, header, mixed | (role == "x")
    if role == "s":
        return (1, 1, around, header, mixed) if main else (0, 0, 1, header, mixed)
    return (main, within, around, 1, mixed) if role == "h" else at


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in order, with character references decoded and white space collapsed. Takes time in proportion to the page, however broken it is."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[int, int, int, int, int]]] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    link = heading = linked = 0
    head = False

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split()) if parts else ""
        if text and not head:
            main, within, around, header, mixed = stack[-1][1] if stack else _NOWHERE
            words = len(text.split())
            out.append(Block(text, words, min(linked, words), main, within, around, int(heading > 0), int(not main and header), mixed))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        parts.append(raw)
        if link:
            linked += len(raw.split())

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            if m[1] and m[1].lower() in ("textarea", "select", "iframe", "object"):
                flush()
            continue
        if tag in INLINE:
            if tag == "a":
                link = 0 if m[2] else 1
            continue
        flush()
        if tag == "head":
            head = not m[2]
        elif tag == "body":
            head = False
        if tag in VOID:
            continue
        link = 0
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            heading = 0 if m[2] else 1
        if stack and stack[-1][0] in ("p", "li", "td", "dd", "dt") and not m[2] and tag in ("p", stack[-1][0], "div", "ul", "article", "section", "footer", "nav", "aside", "header", "main"):
            if stack[-1][0] == "p" or tag == stack[-1][0]:
                opened[stack.pop()[0]] -= 1
        if m[2]:
            while opened[tag] > 0:
                last = stack.pop()[0]
                opened[last] -= 1
                if last == tag:
                    break
        elif not m[4].rstrip().endswith("/"):
            stack.append((tag, _inside(stack[-1][1] if stack else _NOWHERE, _role(tag, m[4]))))
            opened[tag] += 1
    if at < len(page):
        add(_LOOSE.sub(" ", page[at:]))
    flush()
    return out


def describe(found: list[Block]) -> np.ndarray:
    """One row of FEATURES for each block; outside the page there are empty blocks."""
    own = np.array([(b.words, b.linked / max(b.words, 1)) for b in found], float).reshape(-1, 2)
    gap = np.zeros((1, 2))
    before, after = np.concatenate([gap, own[:-1]]) if len(found) else own, np.concatenate([own[1:], gap]) if len(found) else own
    rest = np.array([(b.in_main, b.side_within, b.side_around, b.heading, b.page_header, int(b.text[:1] in "©®" or b.text[:9].lower() == "copyright")) for b in found], float).reshape(-1, 6)
    has = np.full((len(found), 1), float(any(b.in_main for b in found)))
    mixed = np.array([b.mixed for b in found], float).reshape(-1, 1)
    return np.concatenate([own, before, after, rest, has, mixed], 1)


#: The labelled table: pages by lines, + before a line whose text is main text, - before one whose text is not. w40 stands for 40 words.
LABELLED_PAGES = [
    "-<nav><ul><li><a href=x>w1</a></li><li><a href=x>w2</a></li></ul></nav> -<div class=ad>w5</div> +<article><h1>w6</h1> +<p>w60</p> +<p>w4</p> +<p>w30</p></article> -<footer>&copy; w12</footer>",
    "-<nav><a href=x>w1</a> <a href=x>w1</a></nav> +<article><h1>w8</h1> +<p>w3</p></article> -<footer>w20</footer>",
    "-<header><a href=x>w2</a> -<p>w6</p></header> +<main><h1>w5</h1> +<p>w45</p> -<aside><p>w30</p></aside> +<p>w25</p> +<ul><li>w4</li></ul></main> -<footer><p>w40</p></footer>",
    "-<div id=menu><a href=x>w2</a> -<a href=x>w2</a></div> +<div class=content><h2>w7</h2> +<p>w70</p> -<div class=share><a href=x>w1</a></div> +<p>w35 <a href=x>w3</a></p> -<div class=comments><p>w28</p> -<p>w50</p></div></div> -<div class=footer>w15</div>",
    "-<div><a href=x>w2</a></div> -<div><a href=x>w3</a></div> -<h1>w3</h1> +<p>w40</p> +<p>w55</p> +<p>w12</p> +<p>w33</p> -<p><a href=x>w4</a></p> -<p>&copy; w6</p>",
    "+<article><header><h1>w7</h1> +<p>w5</p></header> +<p>w50</p> -<form><label>w2</label> -<p>w6</p></form> -<section class=related><h3>w2</h3> -<a href=x>w6</a></section> +<blockquote>w14</blockquote></article> -<aside><h3>w2</h3> -<p>w35</p></aside>",
    "-<div class=cookie><p>w32</p></div> -<div class=banner>w9</div> +<article><p>w2</p> +<h2>w3</h2> +<p>w90</p> -<p class=advert>w8</p> +<table><tr><td>w1</td></tr></table></article> -<div id=comments><p>w44</p></div> -<section class=newsletter>w18</section>",
    "-<ul><li><a href=x>w1</a></li> -<li><a href=x>w1</a></li></ul> +<p>w80</p> +<h2>w4</h2> +<p>w65</p> +<p>w22</p> -<ul><li><a href=x>w5</a></li> -<li><a href=x>w4</a></li></ul> -<div class=footer>w30</div>",
    "-<div class=sidebar><p>w42</p> -<p>w20</p></div> +<div id=main><p>w38</p> +<p>w18</p> -<div class=notice>w15</div> +<h3>w2</h3> +<p>w28</p></div> -<div class=disclaimer>w60</div>",
    "-<p><a href=x>w3</a></p> -<p>w2</p> -<p><a href=x>w2</a></p>",
    "+<p>w48</p>",
    "-<nav><a href=x>w1</a></nav> +<article><h1>w9</h1> +<p>w40</p> +<p>w95</p></article> -<footer>&copy; w14</footer>",
    "-<div class=ad>w45</div> +<article><h1>w9</h1> +<p>w120</p></article> -<footer>w70</footer> -<div>w55</div>",
    "-<nav>w60</nav> -<aside>w50</aside> +<article><p>w33</p> -<aside>w66</aside> -<nav>w48</nav> +<p>w88</p></article> -<form>w52</form> -<footer>w36</footer>",
    "-<header>w50</header> +<article><p>w10</p> -<div class=comments>w75</div> -<form>w34</form></article> -<div class=related>w90</div> -<footer>w49</footer>",
    "-<header>w70 -<p>w47</p></header> +<main><p>w8</p> +<p>w64</p></main> -<p>w61</p> -<div>w40</div>",
    "-<nav>w62</nav> -<div class=banner>w58</div> +<p>w57</p> +<p>w140</p> -<footer>w80</footer> -<div class=cookie>w66</div>",
    "-<div class=sidebar>w90</div> +<p>w75</p> -<aside>w85</aside> +<p>w50</p> -<form>w47</form> +<p>w61</p> -<div class=comment>w64</div>",
    "+<article>w1</article> -<footer>&copy; w3</footer> -<p>w25</p>",
    "-<nav><a href=x>w1</a></nav> +<div class='content no-sidebar'><h1>w6</h1> +<p>w50</p> +<p>w7</p></div> -<div class=site-footer>w30</div>",
    "+<article class='post has-comments category-ads'><h2>w4</h2> +<p>w44</p> +<p>w3</p> -<div class=comment-list><p>w40</p></div></article> -<div class='widget widget-tags'><a href=x>w3</a></div>",
    "-<header><a href=x>w2</a></header> +<article class='story sponsored'><h1>w5</h1> +<p>w60</p> +<p>w9</p></article> -<footer>w20</footer>",
    "+<article class=post><p>w70</p></article> -<div id=comments><article class='comment post'><p>w52</p> -<p>w12</p></article> -<article class='comment post'><p>w31</p></article></div>",
    "+<div class='entry share'><p>w40</p> +<p>w66</p></div> -<div id=comments><article class=comment-body><p>w70</p></article></div> -<footer>w11</footer>",
]


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """(features, label) of the blocks of LABELLED_PAGES."""
    xs, ys = [], []
    fill = re.compile(r"\bw(\d+)\b")
    for page in LABELLED_PAGES:
        marks = re.findall(r"(?:^| )([+-])(?=<)", page)
        plain = re.sub(r"(^| )[+-](?=<)", lambda m: m[1], page)
        number = iter(range(10_000))
        text = fill.sub(lambda m: " ".join(f"t{next(number)}" for _ in range(int(m[1]))), plain)
        found = blocks(text)
        # a line may hold several blocks; which line a block came from follows from its first word
        lines, seen = re.split(r"(?:^| )[+-](?=<)", page)[1:], 0
        owner = []
        for i, line in enumerate(lines):
            n = sum(int(k) for k in fill.findall(line))
            owner += [i] * n
            seen += n
        for b, row in zip(found, describe(found)):
            first = re.search(r"\bt(\d+)\b", b.text)
            xs.append(row)
            ys.append(1 if marks[owner[int(first[1])]] == "+" else 0)
    return np.array(xs), np.array(ys)


@dataclass
class Tree:
    """Binary tree in arrays; a leaf has feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    label: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while (inner := self.feature[at] >= 0).any():
            go = x[np.arange(len(x)), np.maximum(self.feature[at], 0)] <= self.cut[at]
            at = np.where(inner, np.where(go, self.left[at], self.right[at]), at)
        return self.label[at]


def train_tree(x: np.ndarray, y: np.ndarray, depth: int = 8) -> Tree:
    """CART by Gini impurity on all features; the first of equal cuts is taken."""
    nodes: list[list] = []

    def grow(rows: np.ndarray, level: int) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, 0, 0, int(y[rows].mean() >= 0.5)])
        if level == depth or y[rows].min() == y[rows].max():
            return at
        best = (1e-12, None, None)
        total = y[rows].mean()
        for f in range(x.shape[1]):
            values = np.unique(x[rows, f])
            for cut in (values[1:] + values[:-1]) / 2:
                side = x[rows, f] <= cut
                p, q = y[rows][side].mean(), y[rows][~side].mean()
                gain = total * (1 - total) - side.mean() * p * (1 - p) - (1 - side.mean()) * q * (1 - q)
                if gain > best[0] + 1e-12:
                    best = (gain, f, cut)
        if best[1] is None:
            return at
        side = x[rows, best[1]] <= best[2]
        left, right = grow(rows[side], level + 1), grow(rows[~side], level + 1)
        nodes[at][:4] = [best[1], best[2], left, right]
        return at

    grow(np.arange(len(y)), 0)
    f, c, left, right, label = zip(*nodes)
    return Tree(np.array(f), np.array(c), np.array(left), np.array(right), np.array(label))


def extract_blocks(pages: DataFrame, key: str = "page_id", tree: Tree | None = None) -> DataFrame:
    """One row for each row of pages: key, url, blocks (text and whether it is main text, in page order). A null html has none."""
    tree = tree or train_tree(*labelled_table())
    kind = pages.schema[key].dataType.simpleString()
    item = pa.list_(pa.struct([("text", pa.string()), ("main", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                found = [blocks(h or "") for h in part.column("html").to_pylist()]
                flags = tree.predict(np.concatenate([describe(f) for f in found])).astype(bool)
                it = iter(flags.tolist())
                rows = [[{"text": b.text, "main": next(it)} for b in f] for f in found]
                yield pa.RecordBatch.from_arrays([part.column(key), part.column("url"), pa.array(rows, item)], [key, "url", "blocks"])

    return pages.select(key, F.col("url").cast("string").alias("url"), "html").mapInArrow(run, f"`{key}` {kind}, url string, blocks array<struct<text: string, main: boolean>>")


def main_text(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """One row for each row of pages: key, url, text (main blocks joined by a space; empty if there are none), n_chars.

    Null and empty html give an empty text. Every page is handled alone, so
    repeated rows give repeated rows and an empty table none. Other columns of
    pages, whatever their names, are ignored.
    """
    out = extract_blocks(pages, key).withColumn("text", F.array_join(F.transform(F.filter("blocks", lambda b: b["main"]), lambda b: b["text"]), " "))
    return out.select(key, "url", "text", F.length("text").cast("long").alias("n_chars"))
