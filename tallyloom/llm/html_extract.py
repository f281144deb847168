"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into flat blocks of text at block-level tags. Each block is described by its words and link density,
those of the blocks before and after it, and by where it stands (article, beside one, page furniture, named or hidden
containers, heading). A decision tree, trained here on a small labelled table of blocks, tells main text from the
rest. The table is made by a rule: pages of many layouts are composed of labelled parts (`labelled_pages`), half of whose
furniture has names that say nothing.

Tags are read as browsers read them where it matters here: end tags may be left out (li, p, td and others end at the next of
their kind or with what holds them), script and style end at their own end tag only, `html` and `body` say nothing by their
names. An element without an end tag says nothing of what follows, and one that holds the page's first article or its
`main` is no furniture, whatever its name, unless it is an aside, a footer, or named for comments or teasers.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm import _bytes as B
from tallyloom.llm._store import Workspace

# Element and attribute names of HTML, by role.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe "
    "legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
RAW_TAGS = frozenset("script style noscript template svg math iframe object textarea title select button canvas audio video".split())
#: What is skipped ends at its own end tag. Where that is missing, script and style reach to the page's end; the start tags of the others are passed over.
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW_TAGS}
TO_THE_END = frozenset(["script", "style"])
CONTAINERS = frozenset("article aside blockquote dd details dialog div dl dt fieldset figure footer form header li main menu nav ol p section span table td th tr ul".split())
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
FURNITURE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright disclaimer disqus footer form gdpr header "
    "legal login masthead menu meta modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion reactions recommended related replies reply respond "
    "rail search share sharing sidebar signup skip social sponsor sponsored subscribe tags teaser toolbar topbar widget widgets".split()
)
#: Parts of names that tell a state or a layout ("has-sidebar", "share-enabled"): such a name does not say what the element is.
STATES = frozenset("has have with without no not is are enabled disabled on off show shown hide open closed active layout style styled full wide left-aligned supports uses".split())
#: Names under which pages put comments, or teasers of other articles, which may be articles themselves.
OF_OTHERS = frozenset("comment comments commentlist disqus reactions recommended related rail replies reply respond sidebar teaser widget widgets promo ad ads".split())
#: Start tags that end open elements (those that are innermost).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
MAY_LACK_END = frozenset("li p dt dd tr td th option span".split())
MAIN_TAGS = frozenset(["article", "main"])
MAIN_NAMES = frozenset("article articlebody content entry main post story".split())
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_main", "in_furniture", "named_furniture", "hidden", "heading", "in_header", "in_list", "depth_of_main", "main_elsewhere")

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][^\s/>]*)([^\"'>]*(?:(?:\"[^\"<]*\"|'[^'<]*')[^\"'>]*)*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([A-Za-z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile("[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


class Block:
    __slots__ = ("text", "words", "linked", "main", "furniture", "named", "hidden", "heading", "header", "list")

    def __init__(self, text, words, linked, heading):
        self.text, self.words, self.linked, self.heading = text, words, linked, heading

    def place(self, traits):
        self.main, self.furniture, self.named, self.hidden, self.header, self.list = traits


MAIN, FURNITURE, NAMED, HIDDEN, HEADER, LIST = range(6)


def _named(value: str) -> tuple[bool, bool, bool]:
    """What the names in a class or id say: main text, furniture, of others (comments or teasers)."""
    main = furniture = others = False
    for token in value.split():
        parts = {w.lower() for w in _NAME.findall(token)}
        if parts & STATES:
            continue
        bad, good = parts & FURNITURE_NAMES, parts & MAIN_NAMES
        if good and bad <= {"header"}:  # an article's own header holds its title
            main = True
        elif bad:
            furniture = True
            others |= bool(bad & OF_OTHERS)
    return main, furniture, others


def _traits(tag: str, attributes: str) -> tuple[list[int], bool]:
    """What a container says of its content: main, furniture, named furniture, hidden, header, list; and whether it is named for others' texts."""
    named = main = hidden = furniture = others = False
    if attributes.strip():
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values)
            if name in ("class", "id"):
                good, bad, of_others = _named(value)
                main, named, others = main or good, named or bad, others or of_others
            elif name == "role":
                furniture |= value.lower() in FURNITURE_ROLES
                main |= value.lower() in MAIN_TAGS
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                hidden = True
    return [int((tag in MAIN_TAGS or main) and not named), int(tag in FURNITURE_TAGS or furniture), int(named), int(hidden), int(tag == "header"), int(tag in ("ul", "ol", "menu"))], others


class _Nodes:
    """The containers of a page in the order of their start tags, and the stack of open ones."""

    def __init__(self):
        self.traits, self.parent, self.tag, self.others = [[0] * 6], [-1], [""], [False]
        self.stack = [0]
        self.open: dict[str, int] = {}
        self.first = {"article": True, "main": True}

    def push(self, tag: str, traits: list[int], others: bool) -> None:
        self.parent.append(self.stack[-1])
        self.stack.append(len(self.traits))
        self.traits.append(traits)
        self.tag.append(tag)
        self.others.append(others)
        self.open[tag] = self.open.get(tag, 0) + 1
        if self.first.get(tag) and not traits[NAMED]:
            self._clear_above(tag)

    def _clear_above(self, tag: str) -> None:
        above = self.stack[:-1]
        if tag == "article" and any(self.tag[i] in ("aside", "footer") or self.others[i] for i in above):
            return
        self.first[tag] = self.first["article"] = False
        for i in above:
            self.traits[i][FURNITURE] = self.traits[i][NAMED] = 0

    def pop(self, whole: bool = True) -> None:
        """whole: by its own end tag, or as its end tag may be left out. An element that lacks it says nothing of its content."""
        i = self.stack.pop()
        tag = self.tag[i]
        self.open[tag] -= 1
        if not whole and tag not in MAY_LACK_END:
            self.traits[i][FURNITURE] = self.traits[i][NAMED] = 0

    def close(self, tag: str) -> None:
        if self.open.get(tag):
            while self.tag[self.stack[-1]] != tag:
                self.pop(False)
            self.pop()

    def sums(self) -> list[tuple]:
        """Of each container, its traits and those of all that hold it, added up."""
        out: list[tuple] = [tuple(self.traits[0])]
        for own, up in zip(self.traits[1:], self.parent[1:], strict=True):
            out.append(tuple(map(sum, zip(own, out[up], strict=True))))
        return out


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in order."""
    out: list[Block] = []
    at_node: list[int] = []
    text: list[str] = []
    linked: list[str] = []
    nodes = _Nodes()
    endless: set[str] = set()
    heading, anchor, at, scan, complete = 0, 0, 0, 0, False

    def flush():
        if text:
            body = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if body:
                n = body.count(" ") + 1
                out.append(Block(body, n, min(len("".join(linked).split()), n), heading))
                at_node.append(nodes.stack[-1])
        text.clear()
        linked.clear()

    def add(piece):
        text.append(piece)
        if anchor:
            linked.append(piece)

    while m := _TAG.search(page, scan):
        scan = m.end()
        if m.start() > at:
            add(page[at : m.start()])
        at = scan
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        empty = attributes.rstrip().endswith("/")
        if tag in RAW_TAGS:
            if closing or empty or tag in endless:
                continue
            end = _ENDS[tag].search(page, scan)
            if end:
                flush() if tag in BLOCK_TAGS else None
                scan = at = end.end()
            elif tag in TO_THE_END:
                at = len(page)
                break
            else:
                endless.add(tag)
            continue
        if tag == "a":
            anchor = 0 if closing else len(nodes.stack)
            continue
        if tag in BLOCK_TAGS:
            flush()
            if tag in HEADINGS:
                heading = 0 if closing else 1
            if not closing and nodes.tag[nodes.stack[-1]] == "p":
                nodes.pop()
        if tag in ("body", "html"):
            complete |= bool(closing)
        elif tag in CONTAINERS:
            if closing:
                if nodes.open.get(tag):
                    flush()
                    nodes.close(tag)
            elif not empty:
                while nodes.tag[nodes.stack[-1]] in CLOSES.get(tag, ()):
                    nodes.pop()
                traits, others = _traits(tag, attributes)
                if tag == "span":
                    traits[MAIN] = 0  # a phrase of a block is no block
                if tag not in ("p", "span") or any(traits):
                    flush()
                    nodes.push(tag, traits, others)
            if len(nodes.stack) < anchor:
                anchor = 0
    if at < len(page):
        add(page[at:])
    flush()
    while len(nodes.stack) > 1:
        nodes.pop(not complete)  # in a page that is cut off, what is open at its end may have had an end tag
    sums = nodes.sums()
    for block, node in zip(out, at_node, strict=True):
        block.place(sums[node])
    return out


def features(found: list[Block]) -> np.ndarray:
    x = np.zeros((len(found), len(FEATURES)))
    has_main = any(b.main > 0 and not b.furniture and not b.named for b in found)
    for i, b in enumerate(found):
        before = found[i - 1] if i else None
        after = found[i + 1] if i + 1 < len(found) else None
        x[i] = (
            min(b.words, 500), b.linked / b.words, min(before.words, 500) if before else 0, before.linked / before.words if before else 0, min(after.words, 500) if after else 0, after.linked / after.words if after else 0,
            b.main > 0, b.furniture > 0, b.named > 0, b.hidden > 0, b.heading, b.header > 0, b.list > 0, min(b.main, 3), has_main and not b.main,
        )
    return x


class Tree:
    """A binary decision tree (Gini impurity), as arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 9, least: int = 4):
        self.feature, self.limit, self.left, self.right, self.value = [], [], [], [], []
        self._grow(x, y.astype(float), depth, least)
        self.arrays = tuple(np.array(a) for a in (self.feature, self.limit, self.left, self.right, self.value))

    def _grow(self, x, y, depth, least) -> int:
        node = len(self.feature)
        for column, value in ((self.feature, -1), (self.limit, 0.0), (self.left, node), (self.right, node), (self.value, float(y.mean()) if len(y) else 0.0)):
            column.append(value)
        best = None
        if depth and 0 < y.mean() < 1 and len(y) >= 2 * least:
            for f in range(x.shape[1]):
                order = np.argsort(x[:, f], kind="stable")
                v, ones = x[order, f], np.cumsum(y[order])
                n = np.arange(1, len(y) + 1)
                cut = np.flatnonzero(v[1:] > v[:-1])
                cut = cut[(cut + 1 >= least) & (len(y) - cut - 1 >= least)]
                if not len(cut):
                    continue
                a, p = n[cut], ones[cut]
                b, q = len(y) - a, ones[-1] - p
                gini = (a - (p * p + (a - p) ** 2) / a) + (b - (q * q + (b - q) ** 2) / b)
                k = int(np.argmin(gini))
                if best is None or gini[k] < best[0] - 1e-9:
                    best = (gini[k], f, (v[cut[k]] + v[cut[k] + 1]) / 2)
        if best is not None:
            _, f, limit = best
            low = x[:, f] <= limit
            self.feature[node], self.limit[node] = f, limit
            self.left[node] = self._grow(x[low], y[low], depth - 1, least)
            self.right[node] = self._grow(x[~low], y[~low], depth - 1, least)
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, limit, left, right, value = self.arrays
        at = np.zeros(len(x), int)
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                return value[at]
            go = np.where(x[np.arange(len(x)), np.maximum(feature[at], 0)] <= limit[at], left[at], right[at])
            at = np.where(inner, go, at)


def labelled_pages(n: int = 1200, seed: int = 7) -> Iterator[tuple[str, list[str]]]:
    """(page, its main blocks): pages composed by rule of labelled parts. The main blocks' texts begin with 'M'."""
    r = random.Random(seed)

    def said(low, high, mark="x"):
        return mark + " ".join("".join(r.choice("abcdefghi") for _ in range(r.randint(2, 9))) for _ in range(r.randint(low, high))) + r.choice([".", "", "!"])

    def links(k):
        return "".join(f"<li><a href='/{i}'>{said(1, 3)}</a></li>" for i in range(k))

    def name(of):
        """A name from the list, alone or as a part of a longer one; as often, one that says nothing."""
        if r.random() < 0.5:
            return "".join(r.choice("bcdfgklmnprstvz") + r.choice("aeiou") for _ in range(r.randint(2, 4))) + r.choice(["", "-1", "7", "_x"])
        return r.choice(["", "", "site-", "page-", "js-", "u_"]) + r.choice(of) + r.choice(["", "", "-area", "-box", "1", "_wrap", "List"])

    def furniture(of, tag="div", low=3, high=30):
        how = r.choice(["class", "id"])
        body = "".join(f"<p>{said(low, high)}</p>" for _ in range(r.randint(1, 3))) if r.random() < 0.6 else said(low, high)
        if r.random() < 0.3:
            body += "".join(f"<p><a href='/x'>{said(2, 9)}</a></p>" for _ in range(r.randint(1, 4)))
        return f'<{tag} {how}="{name(of)}">{body}</{tag}>'

    def known(of, tag="div"):
        return f'<{tag} class="{r.choice(["", "x-"])}{r.choice(of)}">{said(3, 30)}</{tag}>'

    def comments():
        k = r.randint(1, 4)
        how = r.random()
        one = (lambda: f"<div class=comment><p>{said(3, 60)}</p></div>") if how < 0.5 else (lambda: f"<li><article class='comment'><div class='comment-content'><p>{said(3, 60)}</p></div></article>") if how < 0.8 else (lambda: f"<article><div class='content'><p>{said(3, 60)}</p></div></article>")
        return f"<section id='comments'>{''.join(one() for _ in range(k))}</section>"

    def paragraph():
        body = said(1, 120 if r.random() < 0.6 else 12, "M")
        if r.random() < 0.2:
            body += f" <a href='#'>{said(1, 3)}</a> {said(1, 20)}"
        style = r.random()
        if style < 0.15:
            return f"<p><b>{body}<br>"
        return f"<h2>{said(1, 8, 'M')}</h2><p>{body}</p>" if style < 0.3 else f"<ul><li>{body}</li></ul>" if style < 0.36 else f"<blockquote>{body}</blockquote>" if style < 0.4 else f"<p>{body}</p>"

    names = sorted(FURNITURE_NAMES - {"header", "meta", "byline"})
    wraps = ["", "", "", "<div class='page has-sidebar'>", "<div id='page' class='site tags-on'>", "<form id='aspnet'>"]
    for _ in range(n):
        parts = []
        for _ in range(r.randint(1, 9)):
            parts.append(paragraph())
            if r.random() < 0.15:
                parts.append(known(names))
        if r.random() < 0.3:
            parts.insert(r.randint(0, len(parts)), r.choice([f"<p hidden>{said(1, 20)}</p>", f"<div style='display: none'>{said(1, 30)}</div>", f"<p aria-hidden='true'>{said(1, 20)}</p>"]))
        if r.random() < 0.2:
            parts.append(f"<aside>{said(3, 40)}</aside>")
        if r.random() < 0.1:
            parts.append(f"<form><label>{said(1, 4)}</label><p>{said(2, 20)}</p><input></form>")
        title = f"<h1>{said(2, 10, 'M')}</h1>" if r.random() < 0.8 else ""
        if title and r.random() < 0.3:
            title = f"<header>{title}</header>"
        body = title + "".join(parts)
        if r.random() < 0.15:
            body += f"<footer>{said(2, 15)}</footer>"
        layout = r.random()
        body = f"<article>{body}</article>" if layout < 0.5 else f"<main>{body}</main>" if layout < 0.65 else f'<div class="{r.choice(sorted(MAIN_NAMES))}">{body}</div>' if layout < 0.85 else f"<div>{body}</div>"
        top = []
        if r.random() < 0.8:
            top.append(f"<nav><ul>{links(r.randint(2, 8))}</ul></nav>" if r.random() < 0.7 else f"<div class='menu'><ul>{links(r.randint(2, 8))}</ul></div>")
        if r.random() < 0.4:
            top.append(f"<header><h1>{said(1, 4)}</h1><p>{said(1, 10)}</p></header>")
        if r.random() < 0.5:
            top.append(furniture(names))
        r.shuffle(top)
        end = []
        if r.random() < 0.4:
            end.append(comments())
        if r.random() < 0.4:
            end.append(f"<aside>{''.join(f'<p>{said(2, 40)}</p>' for _ in range(r.randint(1, 3)))}<ul>{links(3)}</ul></aside>")
        if r.random() < 0.4:
            end.append(furniture(names, r.choice(["div", "section"]), 2, 60) if layout < 0.85 else known(names))
        if r.random() < 0.15:
            end.append(f"<ul>{links(4)}</ul>")
        if r.random() < 0.15:
            end.append(f"<div style='display:none'>{said(2, 40)}</div>")
        end.append(f"<footer>&copy; {said(1, 4)} &middot; {said(1, 12)}</footer>" if r.random() < 0.8 else furniture(["footer"], low=2, high=14))
        if r.random() < 0.15:
            end.append(f"<aside class='related'>{''.join(f'<article><h3><a href=/r>{said(2, 8)}</a></h3><p>{said(3, 25)}</p></article>' for _ in range(r.randint(1, 3)))}</aside>")
        if r.random() < 0.2:
            end = []
        wrap = r.choice(wraps) if layout < 0.65 else ""
        yield f"<html><head><title>{said(2, 8)}</title></head><body>{wrap}{''.join(top)}{body}{''.join(end)}{wrap and '</' + wrap[1:].split()[0] + '>'}</body></html>"


def train(n: int = 1200) -> Tree:
    found = [b for page in labelled_pages(n) for b in [blocks(page)]]
    x = np.concatenate([features(b) for b in found])
    y = np.array([b.text.startswith("M") for own in found for b in own])
    return Tree(x, y)


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page) if page else []
    if not found:
        return ""
    good = tree.predict(features(found)) >= 0.5
    return "\n".join(b.text for b, g in zip(found, good, strict=True) if g)


def extract(pages: DataFrame, keys: list[str], markup: str = "html", tree: Tree | None = None) -> DataFrame:
    """The key columns with text and n_chars (code points).

    Null and empty pages, and pages without main text, give the empty text. Pages that end within a tag or an
    element are read as far as they go. Repeated rows are answered one by one. An empty table gives no rows.
    """
    spark = pages.sparkSession
    Workspace(spark, "html")
    shared = spark.sparkContext.broadcast(tree or train())
    schema = pages.select(*keys).schema.add("text", "string").add("n_chars", "long")

    def scan(batches, n=len(keys)):
        tree = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                found = [blocks(page) if page else [] for page in part.column(n).to_pylist()]
                some = [features(b) for b in found if b]
                good = tree.predict(np.concatenate(some)) >= 0.5 if some else np.zeros(0, bool)
                texts, at = [], 0
                for own in found:
                    texts.append("\n".join(b.text for b, g in zip(own, good[at : at + len(own)], strict=True) if g))
                    at += len(own)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names[:n], "text", "n_chars"])

    return pages.select(*keys, F.col(markup).cast("string").alias("__html")).mapInArrow(B.lean(scan), schema)
