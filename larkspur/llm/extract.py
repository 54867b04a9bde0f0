"""Main text of web pages: flat text blocks, classified by a decision tree over words and link density of neighbours.

A page is cut into flat blocks at every start and end of an element that isn't inline. A
block has its number of words, the share of them in links, and the roles that the elements around it
have by their tag, ARIA role, class or id (menu, header, footer, side matter, notice, advert,
form, comments, not shown, article). A decision tree, fitted in ``fitted_tree`` on the blocks of the small labelled
pages of ``larkspur.llm.labelled``, sees these features of a block together with words and link
density of the blocks before and behind it. Blocks it takes for main text are joined.

Pages are independent: there is no shuffle, and a lost task is run again on its own rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from larkspur.llm.common import rest_worker

#: Most levels of the tree and fewest labelled blocks in a leaf.
DEPTH, LEAF = 8, 4

#: Elements that don't end a block, that have no end tag, whose content is no text of the page, and that an element of the same kind ends.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
ENDS_ITSELF = frozenset("li dt dd tr td th option".split())
HOLDS_ITEMS = frozenset("ul ol dl table select menu".split())

#: Roles, and the tags, ARIA roles and words in class and id that give them.
ROLES = ("menu", "header", "footer", "side", "notice", "advert", "form", "comments", "unseen", "article")
BY_TAG = {
    "nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "side", "dialog": "notice", "form": "form", "button": "form", "select": "form", "fieldset": "form", "label": "form", "article": "article", "main": "article",
    "noscript": "unseen", "template": "unseen", "svg": "unseen", "canvas": "unseen", "object": "unseen", "audio": "unseen", "video": "unseen", "head": "unseen", "datalist": "unseen",
}
BY_ARIA = {"navigation": "menu", "menu": "menu", "menubar": "menu", "banner": "header", "contentinfo": "footer", "complementary": "side", "alert": "notice", "alertdialog": "notice", "dialog": "notice", "search": "form", "form": "form", "article": "article", "main": "article"}
BY_WORD = {
    word: role
    for role, words in {
        "menu": "nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager toc topnav sitenav",
        "header": "header masthead topbar branding sitehead",
        "footer": "footer colophon copyright legal bottom",
        "side": "sidebar side aside related recommended recommendations widget widgets share sharing social trending popular teaser teasers byline meta tags rail sidecol",
        "notice": "notice cookie cookies consent gdpr alert popup modal overlay paywall banner announcement disclaimer toast",
        "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion adsense adbox adslot",
        "form": "form search searchbox login signup subscribe subscription newsletter contact",
        "comments": "comment comments commentlist reply replies respond disqus discussion reviews",
        "unseen": "hidden invisible",
        "article": "article content post entry story main body articlebody maintext prose text",
    }.items()
    for word in words.split()
}
#: Words beside which class words say what an element has, not what it is.
SPOILERS = frozenset("with has no without wrapper wrap container layout page".split())

TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^<>])*+)>?|<[!?/][^>]*>?""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+)))?""")
CLASS_WORD = re.compile(r"[a-z]+")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

BIT = {role: 1 << i for i, role in enumerate(ROLES)}


@dataclass
class Block:
    """A run of text between two ends of blocks; ``mark`` says whether it stands within an element marked as main text (in labelled pages)."""

    text: str
    words: int
    linked: int
    roles: int
    heading: bool
    item: bool
    mark: bool = False

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def size_in_words(text: str) -> int:
    """Words between blanks; in scripts without blanks eight characters count as one."""
    return max(len(text.split()), len(text) // 8)


@lru_cache(4096)
def roles_of(tag: str, attributes: str) -> int:
    """The roles that an element has by itself; unlike an article, any other role outweighs class words that speak of text."""
    found = {BY_TAG[tag]} if tag in BY_TAG else set()
    if not attributes.strip(" \t\r\n/"):
        return sum(BIT[r] for r in found)
    named = {m[0].lower(): next((x for x in m[1:] if x), "") for m in ATTRIBUTE.findall(attributes)}
    if named.get("role", "").lower() in BY_ARIA:
        found.add(BY_ARIA[named["role"].lower()])
    if "hidden" in named or named.get("aria-hidden", "").lower() == "true" or UNSEEN.search(named.get("style", "")):
        found.add("unseen")
    if tag not in ("html", "body"):
        for value in f"{named.get('class', '')} {named.get('id', '')}".split():
            words = {*CLASS_WORD.findall(value.lower()), *CLASS_WORD.findall(re.sub("([A-Z])", r" \1", value).lower())}
            own = {BY_WORD[w] for w in words if w in BY_WORD}
            if not words & SPOILERS:
                found |= own - {"article"} or own
    return sum(BIT[r] for r in found)


@dataclass
class Cutter:
    """Reads a page once and gathers its blocks; holds the open elements with the roles inside each."""

    blocks: list[Block] = field(default_factory=list)
    open: list[tuple[str, int, bool]] = field(default_factory=list)
    count: Counter = field(default_factory=Counter)
    parts: list[str] = field(default_factory=list)
    links: list[str] = field(default_factory=list)

    def text(self, run: str) -> None:
        if "&" in run:
            run = entities.unescape(run)
        self.parts.append(run)
        if self.count["a"]:
            self.links.append(run)

    def end_block(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                roles, mark = self.open[-1][1:] if self.open else (0, False)
                heading = any(self.count[f"h{i}"] for i in range(1, 7))
                self.blocks.append(Block(text, size_in_words(text), sum(map(size_in_words, self.links)), roles, heading, self.count["li"] > 0, mark))
            self.parts, self.links = [], []

    def close(self, tag: str, until: frozenset = frozenset()) -> None:
        """End the innermost open element of the kind, with those inside it, if it isn't beyond one of ``until``."""
        if self.count[tag]:
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at][0] == tag:
                    for gone, _, _ in self.open[at:]:
                        self.count[gone] -= 1
                    del self.open[at:]
                    return
                if self.open[at][0] in until:
                    return

    def start(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self.end_block()
            self.close("p", HOLDS_ITEMS | {"td", "th", "button", "object"})
        if tag in ENDS_ITSELF:
            self.close(tag, HOLDS_ITEMS)
        if tag == "a":
            self.close("a")
        if tag not in VOID:
            roles, mark = self.open[-1][1:] if self.open else (0, False)
            self.open.append((tag, roles | roles_of(tag, attributes), mark or "data-main" in attributes))
            self.count[tag] += 1
        elif tag == "br":
            self.parts.append(" ")

    def end(self, tag: str) -> None:
        if tag not in INLINE:
            self.end_block()
        self.close(tag)

    def read(self, page: str) -> list[Block]:
        at = 0
        while m := TOKEN.search(page, at):
            if m.start() > at:
                self.text(page[at : m.start()])
            at, tag = m.end(), (m[2] or "").lower()
            if tag and m[1]:
                self.end(tag)
            elif tag in RAW:
                if tag not in INLINE:
                    self.end_block()
                close = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
                at = close.start() if close else len(page)
            elif tag:
                self.start(tag, m[3])
        self.text(page[at:])
        self.end_block()
        return self.blocks


def blocks_of(page: str | None) -> list[Block]:
    return Cutter().read(page or "")


FEATURES = ("words", "density", "words before", "density before", "words behind", "density behind", "heading", "item", "article", "header", "other role")


def features(blocks: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block of a page; beyond the page's ends there are no words."""
    own = np.array([(b.words, b.density) for b in blocks], float).reshape(-1, 2)
    none = np.zeros((1, 2))
    flags = np.array([(b.heading, b.item, bool(b.roles & BIT["article"]), bool(b.roles & BIT["header"]), bool(b.roles & ~(BIT["article"] | BIT["header"]))) for b in blocks], float).reshape(-1, 5)
    return np.hstack([own, np.vstack([none, own])[:-1], np.vstack([own, none])[1:], flags])


def grown(rows: np.ndarray, main: np.ndarray, depth: int = DEPTH, leaf: int = LEAF):
    """A decision tree by Gini impurity: (feature, threshold, at most, above) or the share of main text in a leaf. Of equal splits the first feature and threshold wins."""
    share = float(main.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for f in range(rows.shape[1]):
        order = np.argsort(rows[:, f], kind="stable")
        values, hits = rows[order, f], np.cumsum(main[order])
        n = np.arange(1, len(values))
        cuts = np.flatnonzero((values[1:] > values[:-1]) & (n >= leaf) & (len(values) - n >= leaf))
        if len(cuts):
            left, right = cuts + 1, len(values) - cuts - 1
            a, b = hits[cuts] / left, (hits[-1] - hits[cuts]) / right
            impurity = left * a * (1 - a) + right * b * (1 - b)
            k = int(impurity.argmin())
            if best is None or impurity[k] < best[0] - 1e-12:
                best = (impurity[k], f, float(values[cuts[k]] + values[cuts[k] + 1]) / 2)
    if best is None:
        return share
    _, f, cut = best
    low = rows[:, f] <= cut
    return f, cut, grown(rows[low], main[low], depth - 1, leaf), grown(rows[~low], main[~low], depth - 1, leaf)


def is_main(tree, rows: np.ndarray) -> np.ndarray:
    """The tree's decision for each row."""
    if not isinstance(tree, tuple):
        return np.full(len(rows), tree >= 0.5)
    f, cut, low, high = tree
    out, under = np.zeros(len(rows), bool), rows[:, f] <= cut
    out[under], out[~under] = is_main(low, rows[under]), is_main(high, rows[~under])
    return out


@lru_cache(1)
def fitted_tree():
    """The tree of the labelled pages; it depends on nothing else."""
    from larkspur.llm.labelled import pages

    cut = [blocks_of(p) for p in pages()]
    return grown(np.vstack([features(b) for b in cut]), np.array([b.mark for page in cut for b in page]))


def judged(page: str | None, tree) -> list[tuple[Block, bool]]:
    blocks = blocks_of(page)
    return list(zip(blocks, is_main(tree, features(blocks)).tolist(), strict=True)) if blocks else []


def main_text(page: str | None, tree=None) -> str:
    """The main text of one page: its main blocks in page order, joined by a space."""
    return " ".join(b.text for b, kept in judged(page, tree or fitted_tree()) if kept)


def extract(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text (main text, empty if there is none), n_chars (its code points).

    A null or empty page has no text; pages cut off in the middle of an element are read up to their
    end; very long pages are read whole. Repeated rows give equal rows; an empty table none. Null ids and
    urls stay; further columns, whatever their names, are not read.
    """
    tree = fitted_tree()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = [main_text(p.as_py(), tree) for p in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
        rest_worker()

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def text_blocks(pages: DataFrame) -> DataFrame:
    """Every block of every page with what the tree has seen and decided: page_id, position, text, words, link_density, roles, main. Edge cases as in ``extract``; a page without text has no rows."""
    tree = fitted_tree()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                rows = [(page, i, b.text, b.words, b.density, [r for r in ROLES if b.roles & BIT[r]], kept) for page, text in zip(part.column(0).to_pylist(), part.column(1), strict=True) for i, (b, kept) in enumerate(judged(text.as_py(), tree))]
                if rows:
                    columns = list(zip(*rows, strict=True))
                    kinds = [part.schema.field(0).type, pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.list_(pa.string()), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "position", "text", "words", "link_density", "roles", "main"])
        rest_worker()

    return pages.select("page_id", "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, position int, text string, words int, link_density double, roles array<string>, main boolean")
