"""Problem 3: cut oversized segments at natural boundaries.

Structure-tree packing.  A long text is parsed into a tree: a heading owns the
section below it, sections hold blocks (paragraphs between blank lines or
rows of void placeholders), a list holds its items and an item what is
indented below it, a block holds lines, a line sentences, a sentence clauses,
a clause words, a word characters; a placeholder pair is a node with its own
sentences inside.  Sibling subtrees are merged, bottom-up, as far as the limit
allows, and only a node that is too large by itself is opened; what comes out
of it is never merged with the nodes beside it.  A heading is never the end of
a piece, and a placeholder pair that fits a piece is never cut.  Children are
parsed when a node is opened.  Every piece but the first starts with the last
``context_chars`` characters of the text before it, inside the limit.

Defined cases: null and empty texts and texts within the limit give no piece;
an overlap of half the limit or more is taken as half the limit; a text
without any boundary is cut between characters, never inside a placeholder
that fits a piece nor between a letter and its combining accent; pairs nested
deeper than ``DEPTH`` count as text; a heading longer than a piece is cut like
any text; a null or missing limit takes the default; repeated rows give pieces
each; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.plans.runtime import materialize, small

#: Limit and overlap where a book has no settings.
DEFAULT_LIMIT, DEFAULT_OVERLAP = 6000, 0
#: Placeholder pairs inside each other that are nodes.
DEPTH = 100

_TOKEN = r"</?x\d+\s*/?>"
_PAIR = re.compile(r"<(/?)x(\d+)>")
_HEADING = re.compile(r"^(?:[ \t]*)(#{1,6})[ \t]+\S.*$", re.M)
_ITEM = re.compile(r"^([ \t]*)(?:[-*•]|\d+[.)])[ \t]+(?=\S)", re.M)
# Boundaries inside a block, from coarse to fine: a cut is at the end of a match.  A full stop before a small letter or a
# digit ends no sentence.
_LEVELS = {
    "block": re.compile(r"\n[ \t]*\n\s*|(?:<x\d+\s*/>\s*){2,}"),
    "line": re.compile(r"\n+|<x\d+\s*/>\s*"),
    "sentence": re.compile(rf"(?<![.!?…])[.!?…]++[\"'”’»)\]]*+(?:{_TOKEN})*+\s+(?![a-zß-öø-ÿа-яё0-9])"),
    "clause": re.compile(r"[,;:—–][\"'”’»)\]]*\s+"),
    "word": re.compile(rf"\s+|{_TOKEN}"),
}


@dataclass(frozen=True)
class Node:
    """A stretch of the text; ``kind`` says what it is, and so what its children are."""

    start: int
    end: int
    kind: str

    @property
    def size(self) -> int:
        return self.end - self.start


#: What a node of each kind is parsed into, the first that gives more than one child.
_CHILDREN = {
    "text": ("section", "block", "list", "item", "line", "sentence", "clause", "word", "inside", "char"),
    "section": ("section", "block", "list", "item", "line", "sentence", "clause", "word", "inside", "char"),
    "block": ("list", "item", "line", "sentence", "clause", "word", "inside", "char"),
    "list": ("item", "line", "sentence", "clause", "word", "inside", "char"),
    "item": ("item", "line", "sentence", "clause", "word", "inside", "char"),
    "line": ("sentence", "clause", "word", "inside", "char"),
    "sentence": ("clause", "word", "inside", "char"),
    "clause": ("word", "inside", "char"),
    "word": ("inside", "char"),
    "inside": ("sentence", "clause", "word", "inside", "char"),
}


class Tree:
    """The structure of one text."""

    def __init__(self, text: str, most: int):
        self.text, self.most = text, most
        self.headings = [(m.start(), len(m[1]), m.end()) for m in _HEADING.finditer(text)]
        self.items = [(m.start(), len(m[1].expandtabs())) for m in _ITEM.finditer(text)]
        self.item_starts = [a for a, _ in self.items]
        self.pairs = self._pairs()
        self.pair_starts = [a for a, _ in self.pairs]
        self.holder = self._holders()
        self.heading_starts = [a for a, _, _ in self.headings]
        # where no cut may be: (after, before), sorted, for headings with what follows them
        follows = [(a, self._after(b)) for a, _, b in self.headings]
        self.glued = [(a, b) for a, b in follows if b - a < most]
        self.glued_starts = [a for a, _ in self.glued]

    def _after(self, at: int) -> int:
        """The first place behind the blank lines after a heading, and behind headings that follow it at once."""
        while at < len(self.text) and self.text[at].isspace():
            at += 1
        return at

    def _pairs(self) -> list[tuple[int, int]]:
        """(start, end) of the placeholder pairs, by start."""
        open_: list[tuple[str, int]] = []
        at: dict[str, int] = {}
        out = []
        for m in _PAIR.finditer(self.text):
            if not m[1]:
                at[m[2]] = len(open_)
                open_.append((m[2], m.start()))
            elif m[2] in at and at[m[2]] < len(open_) and open_[at[m[2]]][0] == m[2]:
                k = at.pop(m[2])
                if k < DEPTH:
                    out.append((open_[k][1], m.end()))
                del open_[k:]
        return sorted(out)

    def free(self, cut: int, node: Node) -> bool:
        """Whether the node may be cut here: not after a heading, not in a pair that fits a piece or that holds less than the node."""
        i = bisect_left(self.glued_starts, cut) - 1
        if i >= 0 and self.glued[i][0] >= node.start and cut <= self.glued[i][1] and self.glued[i][1] < node.end:
            return False
        i = bisect_left(self.pair_starts, cut)
        for a, b in self._around(i, cut):
            if a >= node.start and b <= node.end and (b - a <= self.most or b - a < node.size):
                return False
        return True

    def _around(self, i: int, cut: int) -> Iterator[tuple[int, int]]:
        """The pairs that hold a place, innermost first; pairs are nested, so each one's holder starts before it."""
        k = i - 1
        while k >= 0:
            if self.pairs[k][1] > cut:
                yield self.pairs[k]
            k = self.holder[k]

    def _holders(self) -> list[int]:
        """The pair around each pair, -1 where there is none."""
        out, stack = [], []
        for k, (_, b) in enumerate(self.pairs):
            while stack and self.pairs[stack[-1]][1] < b:
                stack.pop()
            out.append(stack[-1] if stack else -1)
            stack.append(k)
        return out

    def children(self, node: Node) -> list[Node]:
        for kind in _CHILDREN[node.kind]:
            found = getattr(self, f"_{kind}s", None)
            cuts = found(node) if found else self._matches(node, kind)
            if kind in ("block", "line", "list", "item", "section", "sentence", "clause", "word"):
                cuts = [c for c in cuts if node.start < c < node.end and self.free(c, node)]
            edges = [node.start, *cuts, node.end]
            if len(edges) > 2:
                return [Node(a, b, kind) for a, b in zip(edges, edges[1:])]
        return []

    def _matches(self, node: Node, kind: str) -> list[int]:
        return [m.end() for m in _LEVELS[kind].finditer(self.text, node.start, node.end)]

    def _sections(self, node: Node) -> list[int]:
        """Headings of the highest level among those of the node, but for one at its very start."""
        inner = [(a, level) for a, level, _ in self.headings[bisect_right(self.heading_starts, node.start) : bisect_left(self.heading_starts, node.end)]]
        top = min((level for _, level in inner), default=0)
        return [a for a, level in inner if level == top]

    def _lists(self, node: Node) -> list[int]:
        """Where the node's list begins, if text stands before it."""
        i = bisect_right(self.item_starts, node.start)
        return self.item_starts[i : i + 1] if not (i and self.item_starts[i - 1] == node.start) else []

    def _items(self, node: Node) -> list[int]:
        """Items of the least indent; deeper ones belong to the item above them."""
        inner = self.items[bisect_left(self.item_starts, node.start) : bisect_left(self.item_starts, node.end)]
        if node.kind == "item":
            inner = inner[1:]
        least = min((n for _, n in inner), default=0)
        return [a for a, n in inner if n == least]

    def _insides(self, node: Node) -> list[int]:
        """Sentences, clauses or words inside a pair that is too large for a piece; its ends stay with what is beside them."""
        own = self.pairs[bisect_left(self.pair_starts, node.start) : bisect_left(self.pair_starts, node.end)]
        pair = next(((a, b) for a, b in own if b <= node.end and b - a > self.most), None)
        if pair is None:
            return []
        a, b = self.text.index(">", pair[0]) + 1, self.text.rindex("<", pair[0], pair[1])
        within = Node(a, b, "inside")
        for kind in ("line", "sentence", "clause", "word"):
            cuts = [c for c in self._matches(within, kind) if a < c < b and self.free(c, within)]
            if cuts:
                return cuts + ([pair[1]] if pair[1] < node.end else [])
        return []

    def _chars(self, node: Node) -> list[int]:
        """Characters; placeholders that fit a piece, and letters with their combining accents, stay whole."""
        out, at, token = [], node.start, re.compile(_TOKEN)
        while at < node.end:
            m = token.match(self.text, at, node.end)
            at = m.end() if m and m.end() - at <= self.most else at + 1
            while at < node.end and unicodedata.combining(self.text[at]) and at - (out[-1] if out else node.start) < self.most:
                at += 1
            out.append(at)
        return out[:-1]


def bodies(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """Ranges that cover the text, each with the kind of node whose end it is.

    The first range has at most ``limit`` characters, later ones leave room for
    the overlap.
    """
    tree = Tree(text, limit - overlap)
    out: list[tuple[int, int, str]] = []
    waiting = [iter([Node(0, len(text), "text")])]  # siblings that are still to be placed, innermost last
    ahead: list[Node | None] = [None]  # the next sibling of each, if it was looked at already
    while waiting:
        room = limit - (overlap if out else 0)
        node = ahead[-1] or next(waiting[-1], None)
        ahead[-1] = None
        if node is None:
            waiting.pop()
            ahead.pop()
        elif node.size <= room:  # a whole number of subtrees
            end, kind = node.end, node.kind
            for other in waiting[-1]:
                if other.end - node.start > room:
                    ahead[-1] = other
                    break
                end, kind = other.end, other.kind
            out.append((node.start, end, kind))
        else:
            inner = tree.children(node)
            if not inner:  # a single character or placeholder longer than a piece
                step = limit - overlap
                inner = [Node(a, min(node.end, a + step), "char") for a in range(node.start, node.end, step)]
            waiting.append(iter(inner))
            ahead.append(None)
    return [(a, b, "end" if b == len(text) else kind) for a, b, kind in out]


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """(start, body start, end, boundary) of each piece; pieces are at most ``limit`` long."""
    limit = max(limit, 2)
    overlap = min(max(overlap, 0), limit // 2)
    return [(max(0, a - overlap) if i else a, a, b, kind) for i, (a, b, kind) in enumerate(bodies(text, limit, overlap))]


_OUT = "seg_id long, piece_no int, start int, body_start int, stop int, boundary string, piece string"
_ARROW = pa.schema([("seg_id", pa.int64()), ("piece_no", pa.int32()), ("start", pa.int32()), ("body_start", pa.int32()), ("stop", pa.int32()), ("boundary", pa.string()), ("piece", pa.string())])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [
            (seg, i + 1, start, body, stop, kind, text[start:stop])
            for seg, text, limit, overlap in zip(*(c.to_pylist() for c in batch.columns))
            for i, (start, body, stop, kind) in enumerate(pieces(text, limit, overlap))
        ]
        cols = list(zip(*rows)) or [()] * len(_ARROW)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _ARROW.types)], schema=_ARROW)


def split_segments(segments: DataFrame, books: DataFrame, run_config: DataFrame) -> DataFrame:
    """(seg_id, piece_no, start, body_start, stop, boundary, piece) of every segment over its limit.

    Only oversized texts leave the JVM.  Positions count characters of the
    text; ``body_start`` is where the overlap ends.
    """
    limits = books.select("book_id", "profile").join(run_config.select("profile", "segment_chars", "context_chars"), "profile", "left")
    limits = limits.groupBy("book_id").agg(F.max("segment_chars").alias("row_limit"), F.max("context_chars").alias("row_overlap"))
    limits = small(materialize(limits, "limits"))  # a row per book: the texts needn't be shuffled to meet it
    rows = segments.select(F.col("book_id"), F.col("seg_id").cast("long").alias("row_id"), F.col("text").alias("row_text")).join(limits, "book_id", "left")
    rows = rows.select("row_id", "row_text", F.coalesce("row_limit", F.lit(DEFAULT_LIMIT)).alias("row_limit"), F.coalesce("row_overlap", F.lit(DEFAULT_OVERLAP)).alias("row_overlap"))
    return rows.filter(F.length("row_text") > F.col("row_limit")).mapInArrow(_split, _OUT)
