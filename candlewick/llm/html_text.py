"""Operator 4, HTML extraction: flat text blocks, classified by a decision tree.

A page becomes a flat list of blocks: text between block-level tags or line breaks. Each block has its words,
the share of them inside links, the same of its neighbours, and where it stands: in an article, in a heading, in a
list, or in a part whose tag or class speaks of a menu, a footer and the like. Such a mark is no verdict: the tree
also sees which share of the page's words the marked part holds, and a part without a rival is the page's text. A
decision tree, grown on the driver from the small labelled table below, says which blocks are main text. Extraction
is a map over rows: no shuffle, and memory for one batch of pages. Its time is linear in a page's length.

Tags need not be closed or nested well: a closing tag without an open one is ignored, a paragraph ends where
the next block begins, and a page may stop anywhere; a tag or comment cut off at the end is dropped. Drawings and
formulas may close themselves (``<svg/>``).

Defined cases: null and empty html give an empty text; a page whose blocks are all rejected gives an empty text;
repeated rows are extracted alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.common import table

# Tags by what they mean here.
UNSEEN = "script style noscript template title svg math iframe object select option button textarea canvas audio video".split()
INLINE = "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img input link meta".split()
EMPTY = "area base br col embed hr img input link meta param source track wbr".split()
APART = "nav header footer aside form menu dialog".split()
BODY = "article main".split()
#: Words of a class, id or role that mark a part as no article.
NOISE = """ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer
discussion footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo
promoted promotion related replies reply search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget""".split()

_TAG = r"\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"  # comments
    r"|<(?:svg|math)" + _TAG + r"(?<=/)>"  # foreign elements that close themselves
    r"|<(" + "|".join(UNSEEN) + ")" + _TAG + r">.*?(?:</\1\s*>|\Z)"  # what is not shown, with its contents
    r"|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z][^>]*>|<[!?][^>]*>|<[/!?a-zA-Z][^>]*\Z",
    re.S | re.I,
)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")
_MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_UNSEEN, _INLINE, _EMPTY, _APART, _BODY, _NOISE = map(frozenset, (UNSEEN, INLINE, EMPTY, APART, BODY, NOISE))
_HEADINGS = frozenset(f"h{k}" for k in range(1, 7))
_OWN_HEAD, _OWN = frozenset(("header", "masthead")), frozenset(("article", "content", "entry", "post", "story"))
NONE, WEAK, CLASS, TAG = range(4)  # marks of a part: none, the header of an article, by a class, by a tag


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    article: int
    mark: int
    part: int  # the innermost marked part, 0 for none
    heading: int
    item: int


class Open(NamedTuple):
    """An open block-level tag."""

    tag: str
    article: int
    mark: int
    part: int


def _mark(tag: str, source: str, article: int) -> int:
    if tag in _APART:
        return WEAK if article and tag == "header" else TAG
    if "=" not in source or tag in _BODY or tag in ("html", "body"):
        return NONE
    words = {w for x in _MARKS.findall(source) for w in re.split(r"[^a-z]+", x.lower())}
    noise = words & _NOISE
    if not noise:
        return NONE
    return WEAK if noise <= _OWN_HEAD and (article or words & _OWN) else CLASS


def blocks(page: str) -> tuple[list[Block], list[int]]:
    """The page's text blocks in order, and the part that each marked part lies in (the first stands for the page)."""
    out: list[Block] = []
    inside = [0]
    stack: list[Open] = [Open("", 0, NONE, 0)]
    places: dict[str, list[int]] = defaultdict(list)  # of the open tags by name, places in the stack
    bodies: list[int] = []
    pieces: list[tuple[str, bool]] = []
    link = False

    def end() -> None:
        text = " ".join(html.unescape("".join(p for p, _ in pieces)).split())
        if text:
            linked = sum(len(html.unescape(p).split()) for p, in_link in pieces if in_link)
            words = text.count(" ") + 1
            _, article, mark, part = stack[-1]
            names = [s.tag for s in stack[-3:]]
            out.append(Block(text, words, min(linked, words), article, mark, part, int(any(n in _HEADINGS for n in names)), int("li" in names or "dd" in names)))
        pieces.clear()

    def close(k: int) -> None:
        while len(stack) > k:
            places[stack.pop().tag].pop()
        while bodies and bodies[-1] >= k:
            bodies.pop()

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            pieces.append((page[at : m.start()], link))
        at = m.end()
        name = _NAME.match(m[0])
        if m[1] or not name:
            continue
        tag = name[1].lower()
        closing = m[0][1] == "/"
        if tag == "a":
            link = not closing
        if tag in _INLINE or tag in _UNSEEN:
            continue
        end()
        if tag in _EMPTY:
            continue
        if closing:
            # a paragraph doesn't end from inside an article that it holds
            if places[tag] and not (tag == "p" and bodies and bodies[-1] > places[tag][-1]):
                close(places[tag][-1])
                link = False
            continue
        if stack[-1].tag == "p" or stack[-1].tag == tag == "li":
            close(len(stack) - 1)  # the next block ends a paragraph or list item
            link = False
        _, article, mark, part = stack[-1]
        own = _mark(tag, m[0], article)
        if own:
            inside.append(part)
            mark, part = max(mark, own), len(inside) - 1
        places[tag].append(len(stack))
        if tag in _BODY:
            bodies.append(len(stack))
            article = 1
        stack.append(Open(tag, article, mark, part))
    if at < len(page):
        pieces.append((page[at:], link))
    end()
    return out, inside


RIVAL, BARE, MOST, LINE = 20, 3, 200, 10
FEATURES = "words density before_words before_density after_words after_density article mark share heading item beside".split()


def features(found: list, inside: list[int]) -> list[list[float]]:
    """Numbers of each block and its neighbours; beyond the page's ends there are blocks without words.

    share: of the page's words outside of links those in the block's marked part; 0 without one. Words that no mark
    speaks against count more the likelier they are the page's text: RIVAL times in an article, BARE times in long
    blocks elsewhere. So a part is large only where it has no rival, however many comments it holds.

    beside: for a block outside of all articles the words outside of links that the page has in articles, MOST at most: what
    stands beside an article is not the page's text, whatever its class is called.
    """
    held, rival = [0] * len(inside), 0
    for b in found:
        held[b.part] += b.words - b.linked
        if b.mark < CLASS:
            rival += (RIVAL if b.article else BARE if b.words >= LINE else 0) * (b.words - b.linked)
    for k in range(len(inside) - 1, 0, -1):
        held[inside[k]] += held[k]
    size = [(float(b.words), b.linked / b.words) for b in found]
    around = [(0.0, 0.0), *size, (0.0, 0.0)]
    text = [b.words - b.linked for b in found]
    article = min(MOST, sum(n for n, b in zip(text, found, strict=True) if b.article and b.mark < CLASS))
    share = [held[b.part] / max(held[0], held[b.part] + rival, 1) if b.part else 0.0 for b in found]
    return [[*around[k + 1], *around[k], *around[k + 2], float(b.article), float(b.mark), share[k], float(b.heading), float(b.item), 0.0 if b.article else float(article)] for k, b in enumerate(found)]


# Labelled pages. A block is kind, words, words in links. Kinds: A in an article, B in the bare body;
# w in the own header of an article or post, c in a part that a class marks, t in one that a tag marks; h heading, l list item.
# Marked blocks in a row are one part. An upper-case X behind a block marks main text.
LABELLED = """
Btl 1 1, Btl 1 1, Btl 2 2, Bc 7 0, Ah 8 0 X, A 60 0 X, A 3 0 X, A 120 4 X, A 1 0 X, A 45 0 X, Bt 14 0
Btl 1 1, Btl 1 1, Btl 1 1, Bc 6 0, Ah 2 0 X, A 2 0 X, Bt 9 0
Btl 1 1, Btl 1 1, Btl 1 1, Bc 12 0, Ah 5 0 X, A 4 0 X, A 6 0 X, Bt 13 0
Btl 1 1, Btl 2 2, Bc 30 0, Ah 5 0 X, A 25 0 X, A 9 0 X, Ac 40 0, A 80 10 X, Bc 60 0, Bc 70 2, Bt 8 0
Bt 6 6, Awh 4 0 X, A 2 0 X, A 1 0 X, A 7 7 X, A 200 3 X, Bc 50 0, Bt 16 4
Bc 3 3, Bc 3 3, Bc 4 4, Bh 6 0 X, B 55 2 X, B 70 0 X, B 30 1 X, B 2 2, B 2 2, B 3 3, Bc 11 0
Bc 20 1, B 1 1, B 2 2, B 1 1, Bh 5 0 X, B 90 0 X, B 12 0 X, B 64 0 X, B 4 3, B 3 3, Bt 9 2
Ah 7 0 X, A 33 0 X, Al 12 0 X, Al 15 1 X, Al 9 0 X, A 41 2 X, Al 3 3, Al 4 4, Al 4 4, Bt 25 5
Bl 2 2, Bl 1 1, Bl 3 3, Bh 9 0 X, B 48 0 X, Bl 14 1 X, Bl 18 0 X, B 66 3 X, Bl 5 5, Bl 6 6
Bth 2 0, A 300 0 X, A 1 0 X, At 1 1, Bt 100 0, Bc 80 0, Bt 35 1
Btl 5 5, Bc 18 0, Ah 14 0 X, A 6 0 X, A 22 0 X, A 4 0 X, Ac 45 0, A 11 0 X, Bt 13 1
B 3 3, B 2 2, B 80 1 X, B 110 0 X, B 7 0, B 3 3
Btl 1 1, Btl 1 1, Ah 3 0 X, Ah 2 0 X, A 5 5 X, A 14 6 X, Ah 3 0 X, A 17 0 X, Bt 6 0
B 1 1, B 2 2, B 1 1, B 2 2, B 7 0 X, B 40 0 X, B 75 3 X, B 52 0 X, B 28 1 X, B 9 0, B 1 1, B 1 1
B 4 0, B 1 1, B 1 1, B 3 3, Bh 8 0 X, B 34 2 X, B 95 0 X, B 5 0 X, B 61 4 X, B 6 5, B 5 5, B 8 0
B 16 1, B 2 2, B 1 1, B 2 2, B 26 0 X, B 88 2 X, B 47 0 X, B 3 3, B 2 2, B 4 4, B 12 1
Btl 2 2, Btl 2 2, Btl 30 0 X, Btl 90 2 X, Btl 4 0 X, Btl 64 0 X, Btl 120 1 X, Btl 44 0 X
Bt 3 3, Bt 2 2, Bt 9 0 X, Bt 75 0 X, Bt 160 4 X, Bt 22 0 X, Bt 85 0 X, Bt 3 3, Bt 2 2
Bc 2 2, Bc 1 1, Bch 8 0 X, Bc 66 0 X, Bc 101 3 X, Bc 18 0 X, Bc 140 0 X, Bc 4 4
Bc 70 1 X, Bc 85 0 X, Bc 6 0 X, Bc 110 2 X, Bc 2 2, Bc 3 3, Bc 5 5
Bch 2 0, B 1 1, B 1 1, Bwh 7 0 X, Bw 4 1, B 39 0 X, B 55 1 X, B 71 0 X, Bc 24 0, Bc 31 0, Bt 10 2
Bch 1 0, B 2 2, B 2 2, Bwh 9 0 X, B 81 1 X, B 15 0 X, B 62 0 X, Bc 45 1, Bc 9 0, Bc 8 1
Bth 3 0, Bt 1 1, Bt 1 1, Awh 9 0 X, Aw 4 0, Aw 3 1, A 52 0 X, A 130 2 X, At 12 12, At 20 8, Bt 30 6
Bth 2 2, Btl 1 1, Awh 6 0 X, Aw 24 0 X, Aw 5 2, A 77 0 X, A 48 0 X, Ath 2 0, Atl 6 6, Atl 7 7, A 33 0 X, Bt 11 3
Bth 1 0, Awh 11 0 X, Aw 19 0 X, Aw 2 0, A 90 0 X, A 66 0 X, A 29 3 X, Ac 2 0, Ac 3 3, Ac 55 0, Ac 28 0, Bt 12 0
Bt 4 4, Ath 4 0, At 40 0, At 25 0, Ah 10 0 X, A 210 3 X, A 35 0 X, A 8 0 X, At 15 3, Bt 6 1
Btl 1 1, Btl 1 1, Bc 25 2, Ah 6 0 X, A 14 0 X, A 80 0 X, A 56 0 X, Bth 2 0, Bt 30 1, Bt 45 0, Bt 60 0, Bt 4 4
Bc 10 0, B 3 3, Bh 7 0 X, B 58 1 X, B 73 0 X, B 10 0 X, B 41 2 X, Bch 2 0, Bc 90 0, Bc 35 0, Bc 52 0, Bt 5 0
B 2 2, B 3 3, B 2 2, B 1 1, B 4 4, B 3 2, Bh 4 0 X, B 120 0 X, B 8 0 X, B 96 5 X, B 13 11, B 9 8, B 7 7, B 10 1
B 1 1, B 14 0, B 2 2, B 3 3, B 6 0 X, B 44 0 X, B 17 0 X, B 85 1 X, B 38 0 X, B 11 0, B 2 2
Bt 8 0, Bt 6 0, Bt 12 1, A 5 0 X, A 9 0 X, A 7 1 X, Bt 10 0
B 1 1, B 2 2, B 1 1, Bh 3 0 X, B 60 8 X, B 92 14 X, B 45 12 X, B 31 7 X, B 120 22 X, B 5 4, B 6 6, B 8 5
Bt 2 2, Bt 5 5, Bh 2 0 X, B 75 16 X, B 28 6 X, B 54 17 X, B 40 5 X, B 3 3, B 9 8, Bt 14 6
Bl 1 1, Bl 2 2, B 6 0 X, B 38 10 X, B 110 25 X, Bl 16 5 X, Bl 22 4 X, B 64 9 X, Bl 3 3, Bl 5 4, B 10 6
Bt 1 1, Bt 2 2, Bt 55 7 X, Bt 83 15 X, Bt 140 21 X, Bt 36 9 X, Bt 4 4
Bc 3 3, Bc 90 12 X, Bc 70 16 X, Bc 11 0 X, Bc 130 20 X, Bc 5 5, Bc 7 6
Btl 2 2, Ah 4 0 X, A 66 15 X, A 40 14 X, A 25 8 X, A 90 3 X, A 4 4, A 9 8, Bt 12 3
Btl 1 1, Btl 2 2, Ah 5 0 X, A 40 0 X, A 30 0 X, A 3 0 X
Bt 2 2, Ah 6 0 X, A 60 0 X, A 45 0 X, Bch 2 0, Bc 90 0, Bc 130 0, Bc 210 0, Bc 160 0, Bc 300 1
B 2 2, B 1 1, Bh 5 0 X, B 70 0 X, B 62 1 X, Bc 80 0, Bc 140 0, Bc 95 0, Bc 180 0, Bt 5 1
Bt 2 2, Bt 1 1, Awh 5 0 X, A 60 0 X, A 44 0 X
Awh 3 0 X, A 20 0 X, A 18 0 X, A 12 0 X, Bt 9 1
Bt 3 3, Bwh 5 0 X, B 70 0 X, B 45 0 X, Bt 6 0
Bt 1 1, Bwh 4 0 X, B 52 3 X, B 37 0 X, B 85 0 X
B 2 2, Bh 5 0 X, B 60 0 X, B 80 2 X
B 5 0 X, B 44 0 X, B 7 0 X, B 70 6 X, B 36 1 X
Btl 1 1, Ah 6 0 X, A 60 0 X, A 45 0 X, B 90 0, B 30 0, B 12 0, B 140 0, Bt 9 0
B 60 0, B 25 1, Ah 5 0 X, A 80 2 X, A 14 0 X, A 66 0 X, Bh 2 0, B 3 0, B 40 0, B 2 0, B 75 0, B 3 0, B 110 0, Bt 5 0
B 14 0, Ah 9 0 X, A 120 3 X, A 33 0 X, B 22 0, B 8 4, B 51 0, Bt 12 1
B 2 2, B 35 0, Ah 7 0 X, A 48 0 X, A 52 1 X, A 7 0 X, B 18 0, B 66 0, B 24 0, B 5 0, B 95 0
Bh 5 0 X, B 60 0 X, B 1 0 X, B 2 0 X, B 75 0 X, B 3 0 X, B 1 0 X, B 44 0 X, Bt 8 0
B 1 1, B 2 2, Bh 4 0 X, B 52 0 X, B 2 0 X, B 1 0 X, B 3 0 X, B 61 1 X, B 4 0 X, B 38 0 X, B 2 2, B 3 3
A 2 0 X
B 9 0 X
B 4 0 X
Bt 1 1, Ah 6 0 X, A 18 0 X, A 3 3, A 2 2, Bt 9 0
Btl 2 2, Ah 3 0 X, A 8 0 X, A 5 5, A 15 0 X, At 4 4
Bt 2 2, A 10 0 X, A 4 4, A 3 3
B 1 1, B 2 2, Bh 4 0 X, B 30 0 X, B 12 0 X, B 4 4, B 3 3
Al 3 3, Al 4 4, A 20 0 X
A 6 6, A 9 0 X, A 12 1 X
Btl 2 2, Btl 1 1, A 12 0 X, A 6 0 X
A 16 0 X, A 5 1 X, A 2 0 X, A 30 2 X, A 9 0 X
Bc 15 0, Bt 2 2, Bt 3 3, A 12 0 X, A 7 0 X, A 10 2 X, A 3 0 X, Bc 22 0, Bt 18 2
"""


class _Labelled(NamedTuple):
    words: int
    linked: int
    article: int
    mark: int
    part: int
    heading: int
    item: int
    main: bool


def labelled() -> tuple[list[list[float]], list[bool]]:
    """Features and labels of all blocks of the table."""
    rows, main = [], []
    for line in LABELLED.strip().splitlines():
        page, inside, before = [], [0], NONE
        for block in line.split(","):
            kind, words, linked, *label = block.split()
            mark = next((k for k, c in ((WEAK, "w"), (CLASS, "c"), (TAG, "t")) if c in kind), NONE)
            if mark and mark != before:
                inside.append(0)
            before = mark
            page.append(_Labelled(int(words), int(linked), int(kind[0] == "A"), mark, len(inside) - 1 if mark else 0, int("h" in kind), int("l" in kind), bool(label)))
        rows += features(page, inside)
        main += [b.main for b in page]
    return rows, main


def grow(rows: list[list[float]], main: list[bool], depth: int = 8, least: int = 4):
    """A decision tree by Gini impurity: True or False, or (feature, threshold, at or below, above)."""
    yes = sum(main)
    if depth == 0 or yes in (0, len(main)) or len(main) < 2 * least:
        return 2 * yes >= len(main)
    best = None
    for f in range(len(rows[0])):
        order = sorted(range(len(rows)), key=lambda k: rows[k][f])
        left = 0
        for n, k in enumerate(order[:-1], 1):
            left += main[k]
            here, there = rows[k][f], rows[order[n]][f]
            if here == there or n < least or len(order) - n < least:
                continue
            right = yes - left
            impurity = left * (n - left) / n + right * (len(order) - n - right) / (len(order) - n)
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, f, (here + there) / 2
    if best is None:
        return 2 * yes >= len(main)
    _, f, cut = best
    below = [k for k in range(len(rows)) if rows[k][f] <= cut]
    above = [k for k in range(len(rows)) if rows[k][f] > cut]
    sides = [grow([rows[k] for k in part], [main[k] for k in part], depth - 1, least) for part in (below, above)]
    return sides[0] if isinstance(sides[0], bool) and sides[0] is sides[1] else (f, cut, *sides)


def decide(tree, row: list[float]) -> bool:
    while not isinstance(tree, bool):
        f, cut, below, above = tree
        tree = below if row[f] <= cut else above
    return tree


def kept(found: list[Block], inside: list[int], tree) -> list[bool]:
    """What the tree decides of each block; and short lines without links between two kept long blocks of their part (in an
    article also behind one), which say less than what stands around them, are kept with those."""
    keep = [decide(tree, row) for row in features(found, inside)]
    last = None  # the long block that was kept last, with nothing behind it but such lines
    for k, b in enumerate(found):
        if b.words >= LINE:
            if keep[k] and last is not None and (found[last].part, found[last].article) == (b.part, b.article):
                keep[last:k] = [True] * (k - last)
            last = k if keep[k] else None
        elif b.linked or last is None or (found[last].part, found[last].article) != (b.part, b.article):
            last = None
        elif b.article:
            keep[k] = True
    return keep


def main_text(page: str, tree) -> str:
    found, inside = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, kept(found, inside, tree), strict=True) if keep)


def extract(pages: DataFrame, rows: list[list[float]] | None = None, main: list[bool] | None = None) -> DataFrame:
    """pages as struct ``page`` and its main text as ``text``; rows and main: another labelled table."""
    tree = grow(*(labelled() if rows is None else (rows, main)))

    @F.arrow_udf("string")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(x, tree) if x else "" for x in batch.to_pylist()], type=pa.string())

    return pages.select(F.struct("*").alias("page")).withColumn("text", of("page.html"))


def op4_html_text(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page.page_id", "page.url", "text", F.length("text").cast("long").alias("n_chars"))
