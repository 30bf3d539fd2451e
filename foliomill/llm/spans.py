"""Problem 9: long spans that stand verbatim in more than one document.

An FM-index answers where a string occurs in a shard of text.  Testing every
document against every shard would grow with the square of the corpus, so a
document meets only the shards that can hold a match: winnowing over
``GRAM``-character hashes keeps one hash in each window of every span of
``SPAN`` characters, so two documents that share a span share a kept hash.

1. Equal texts form one class; classes stand for their documents from here on.
2. Kept hashes that two or more classes have make edges.  A class is indexed
   in one shard (shards have about ``SHARD_CHARS`` characters, whatever the
   corpus' size) and streamed to the shards of the classes it has an edge to.
   Shards that many classes are streamed to are repeated, each copy serving a
   part of the stream.
3. Per shard, a suffix array gives the Burrows-Wheeler transform, kept in a
   wavelet tree of packed bits; of the suffix array itself only every
   ``SAMPLE``-th text position is kept.  Backward search, for all streamed
   documents at once, tests the matching statistics at every ``SPAN / 2``-th
   character against that length: each block of so many characters is read
   from its end to its start, and every span holds at least one whole block.
   Blocks that occur in another class are located, by walking back to a kept
   position, and extended to maximal matches.
4. Matches become pairs of classes with spans; membership gives the documents.

Defined cases: null texts and texts shorter than ``SPAN`` share nothing;
repeated rows with one id are one document; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm._codes import SEP, chunks, code_points, gram_hash, joined, prefix, winnow
from foliomill.plans.runtime import materialize, small

#: Characters a shared span has at least; characters of a hashed gram; characters of an index shard.
SPAN, GRAM, SHARD_CHARS = 320, 240, 1_500_000
#: Text positions of which one is kept in a sampled suffix array.
SAMPLE = 32
#: Characters of a piece of a very long text.
PIECE = 1 << 20
#: Streamed characters one copy of a shard serves.
STREAM_CHARS = 8_000_000


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; only suffixes that still tie are sorted again."""
    n = len(codes)
    if n == 0:
        return np.zeros(0, np.int64)
    bits = int(codes.max() + 1).bit_length()
    width = min(n, max(1, 62 // bits))
    key = np.zeros(n, np.uint64)
    for k in range(width):
        part = np.zeros(n, np.uint64)
        part[: n - k] = codes[k:].astype(np.uint64) + np.uint64(1)
        key = key << np.uint64(bits) | part
    sa = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[sa[1:]] != key[sa[:-1]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = width
    tied = ~(new & np.append(new[1:], True))
    where = np.flatnonzero(tied)
    while len(where) and h < n:
        suffix = sa[where]
        group = rank[suffix]
        after = suffix + h
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        order = np.lexsort((second, group))
        suffix, group, second = suffix[order], group[order], second[order]
        sa[where] = suffix
        first = np.ones(len(where), bool)
        first[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        rank[suffix] = np.maximum.accumulate(np.where(first, where, 0))
        single = first & np.append(first[1:], True)
        where = where[~single]
        h *= 2
    return sa


class WaveletTree:
    """Ranks of symbols in a sequence: one packed bit row and its counts per level."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        seq = symbols.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level & 1).astype(np.uint8)
            packed = np.packbits(np.append(bit, np.zeros(64 - len(bit) % 64, np.uint8)), bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64))))
            self.zeros.append(int(len(bit) - bit.sum()))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def ones(self, k: int, i: np.ndarray) -> np.ndarray:
        """How many bits of a row are set before position i."""
        word = i >> 6
        below = self.bits[k][word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.counts[k][word] + np.bitwise_count(below)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position i, less the symbol's start in the last level."""
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self.ones(k, i)
            i = np.where(symbol >> level & 1, self.zeros[k] + ones, i - ones)
        return i


    def access(self, i: np.ndarray) -> np.ndarray:
        """The symbols at the positions i."""
        symbol = np.zeros(len(i), np.int64)
        for k in range(self.levels):
            bit = (self.bits[k][i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            ones = self.ones(k, i)
            symbol = symbol << 1 | bit
            i = np.where(bit == 1, self.zeros[k] + ones, i - ones)
        return symbol


class FMIndex:
    """Occurrences of patterns in a text by backward search."""

    def __init__(self, codes: np.ndarray):
        self.alphabet = np.unique(codes)
        symbols = np.searchsorted(self.alphabet, codes) + 1
        text = np.append(symbols, 0)
        self.rows = len(text)
        sa = suffix_array(text)
        bwt = text[sa - 1]
        kept = sa % SAMPLE == 0
        self.kept, self.samples = WaveletTree(kept.astype(np.int64), 2), sa[kept].astype(np.int32 if self.rows < 1 << 31 else np.int64)
        self.tree = WaveletTree(bwt, len(self.alphabet) + 1)
        count = np.bincount(bwt, minlength=len(self.alphabet) + 1)
        self.first = np.concatenate(([0], np.cumsum(count)))[:-1]
        # ranks come out shifted by where a symbol starts in the tree's last level: symbols stand there in the same order
        s = np.arange(len(self.alphabet) + 1)
        self.shift = self.tree.rank(s, np.zeros(len(s), np.int64))

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        """Symbols of the index; 0 where a character doesn't occur."""
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes, at + 1, 0)

    def search(self, symbols: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, lo, hi) of the patterns symbols[start : start + length] that occur, as rows of the suffix array."""
        alive = np.arange(len(start))
        lo, hi = np.zeros(len(start), np.int64), np.full(len(start), self.rows, np.int64)
        for k in range(length - 1, -1, -1):
            c = symbols[start[alive] + k]
            lo = self.first[c] + self.tree.rank(c, lo) - self.shift[c]
            hi = self.first[c] + self.tree.rank(c, hi) - self.shift[c]
            keep = (hi > lo) & (c > 0)
            if not keep.all():
                alive, lo, hi = alive[keep], lo[keep], hi[keep]
            if not len(alive):
                break
        return alive, lo, hi


    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix array: back by one character at a time, to a kept one."""
        out = np.zeros(len(row), np.int64)
        todo, steps = np.arange(len(row)), 0
        while len(todo):
            here = self.kept.access(row) == 1
            done = todo[here]
            out[done] = self.samples[self.kept.ones(0, row[here])] + steps
            todo, row = todo[~here], row[~here]
            c = self.tree.access(row)
            row = self.first[c] + self.tree.rank(c, row) - self.shift[c]
            steps += 1
        return out


class Shard:
    """The indexed texts of a shard."""

    def __init__(self, keys: list[int], texts: list[str]):
        self.keys = np.array(keys, np.int64)
        self.codes = code_points(joined(texts) + SEP)
        self.starts = np.concatenate(([0], np.flatnonzero(self.codes == ord(SEP)) + 1))
        self.index = FMIndex(self.codes)

    def matches(self, keys: list[int], texts: list[str], span: int = SPAN) -> Iterator[tuple[int, int, int, int, int]]:
        """(streamed key, indexed key, start, start, length) of maximal matches of at least ``span`` characters."""
        block = span // 2
        codes = code_points(joined(texts) + SEP)
        ends = np.flatnonzero(codes == ord(SEP))
        begins = np.concatenate(([0], ends[:-1] + 1))
        at = [np.arange(a, b - block + 1, block) for a, b in zip(begins.tolist(), ends.tolist()) if b - a >= span]
        if not at:
            return
        start = np.concatenate(at)
        found, lo, hi = self.index.search(self.index.symbols(codes), start, block)
        if not len(found):
            return
        n = hi - lo
        row = np.repeat(np.arange(len(found)), n)
        here = self.index.locate(np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()))
        mine = start[found[row]]
        doc = np.searchsorted(ends, mine)
        other = np.searchsorted(self.starts, here, "right") - 1
        key_a, key_b = np.array(keys, np.int64)[doc], self.keys[other]
        keep = key_a != key_b
        mine, here, doc, other = mine[keep], here[keep], doc[keep], other[keep]
        # blocks of one match lie on one diagonal, a block apart: the first of each chain is extended
        order = np.lexsort((mine, mine - here, other, doc))
        mine, here, doc, other = mine[order], here[order], doc[order], other[order]
        chain = np.ones(len(mine), bool)
        chain[1:] = (doc[1:] != doc[:-1]) | (other[1:] != other[:-1]) | (mine[1:] - here[1:] != mine[:-1] - here[:-1]) | (mine[1:] - mine[:-1] != block)
        heads = np.flatnonzero(chain)
        for h, last in zip(heads.tolist(), np.append(heads[1:], len(mine)).tolist()):
            a, b, stop = int(mine[h]), int(here[h]), int(mine[last - 1]) + block
            d, o = int(doc[h]), int(other[h])
            left = min(block, a - int(begins[d]), b - int(self.starts[o]))
            same = codes[a - left : a][::-1] != self.codes[b - left : b][::-1]
            left = int(same.argmax()) if same.any() else left
            far = b + stop - a
            right = min(block, int(ends[d]) - stop, int(self.starts[o + 1]) - 1 - far)
            same = codes[stop : stop + right] != self.codes[far : far + right]
            right = int(same.argmax()) if same.any() else right
            length = stop + right - a + left
            if length >= span:
                yield int(keys[d]), int(self.keys[o]), a - left - int(begins[d]), b - left - int(self.starts[o]), length


def _print_rows(span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            # a very long text goes in overlapping pieces: each window of a span lies in one of them
            cuts = [(i, c) for i, t in enumerate(texts) for c in range(0, max(1, len(t) - span + 1), PIECE)]
            keys, texts = keys[[i for i, _ in cuts]], [texts[i][c : c + PIECE + span - 1] for i, c in cuts]
            for a, b in chunks([len(t) for t in texts]):
                codes = code_points(joined(texts[a:b]))
                row = np.cumsum(codes == ord(SEP))
                n = max(0, len(codes) - span + 1)
                # windows inside one text only
                at = winnow(gram_hash(prefix(codes), gram), span - gram + 1, row[:n] == row[span - 1 : span - 1 + n]) if n else np.zeros(0, np.int64)
                h = gram_hash(prefix(codes), gram)[at].astype(np.int64)
                pairs = np.unique(np.stack((keys[a:b][row[at]], h), 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["cls", "h"])

    return run


_OUT = "cls_a long, cls_b long, start_a int, start_b int, length int"
_ARROW = pa.schema([("cls_a", pa.int64()), ("cls_b", pa.int64()), ("start_a", pa.int32()), ("start_b", pa.int32()), ("length", pa.int32())])


def _search_shards(span: int):
    """Rows (shard, part, role, cls, text), indexed texts of a shard before the streamed ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard, held = None, None, ([], [])
        out: list[tuple[int, int, int, int, int]] = []
        wait: tuple[list[int], list[str]] = ([], [])

        def flush() -> None:
            nonlocal shard
            if wait[0] and held[0]:
                if shard is None:
                    shard = Shard(*held)
                out.extend((x if x[0] < x[1] else (x[1], x[0], x[3], x[2], x[4])) for x in shard.matches(*wait, span))
            wait[0].clear()
            wait[1].clear()

        size = 0
        for batch in batches:
            for s, part, role, cls, text in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (s, part):
                    flush()
                    key, shard, held, size = (s, part), None, ([], []), 0
                if role == 0:
                    held[0].append(cls)
                    held[1].append(text)
                else:
                    wait[0].append(cls)
                    wait[1].append(text)
                    size += len(text)
                    if size > 1 << 19:
                        flush()
                        size = 0
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ARROW.types)], schema=_ARROW)
                out.clear()
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 5, _ARROW.types)], schema=_ARROW)

    return run


def text_classes(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, cls): documents with equal texts have one class, the smallest of their ids."""
    rows = documents.filter((F.length("text") >= span) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2("text", 256)).alias("d"))
    first = rows.groupBy("d").agg(F.min("doc_id").alias("cls"))
    return rows.join(first, "d").select("doc_id", "cls").distinct()


def class_matches(documents: DataFrame, classes: DataFrame, span: int = SPAN, gram: int = GRAM, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(cls_a, cls_b, start_a, start_b, length), cls_a < cls_b: maximal spans two classes share."""
    own = documents.select(F.col("doc_id").cast("long").alias("cls"), F.col("text").alias("row_text")).filter(F.length("row_text") >= span)
    heads = materialize(classes.select("cls").distinct(), "span-heads")
    texts = own.join(small(heads), "cls", "left_semi").dropDuplicates(["cls"]) if _has_repeats(documents) else own.join(small(heads), "cls", "left_semi")
    prints = materialize(texts.mapInArrow(_print_rows(span, gram), "cls long, h long"), "span-prints")
    shared = prints.groupBy("h").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).filter("lo < hi").select("h")
    edges = materialize(prints.join(small(materialize(shared, "span-shared")), "h", "left_semi"), "span-edges")
    members = materialize(edges.select("cls").distinct(), "span-members")
    members = small(members)
    text_of = materialize(texts.join(members, "cls", "left_semi"), "span-texts")
    total = text_of.agg(F.sum(F.length("row_text"))).first()[0] or 0
    shards = max(1, -(-total // shard_chars))
    shard_of = F.pmod(F.xxhash64("cls"), F.lit(shards))
    routes = edges.select("h", F.col("cls").alias("other"), shard_of.alias("shard")).groupBy("h", "shard").agg(F.min("other").alias("lo"), F.max("other").alias("hi"))
    # a class alone in a shard for this hash needn't be streamed to it
    routes = edges.join(routes, "h").filter("lo <> cls or hi <> cls").select("cls", "shard").distinct()
    routes = materialize(routes, "span-routes")
    sizes = text_of.select("cls", F.length("row_text").alias("n"))
    load = materialize(routes.join(small(materialize(sizes, "span-sizes")), "cls").groupBy("shard").agg(F.ceil(F.sum("n") / STREAM_CHARS).cast("int").alias("copies")), "span-load")
    parts = routes.join(small(load), "shard").withColumn("part", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("copies")))
    streamed = parts.join(text_of, "cls").select("shard", "part", F.lit(1).alias("role"), "cls", "row_text")
    indexed = text_of.withColumn("shard", shard_of).join(small(load), "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select("shard", F.col("part").cast("long").alias("part"), F.lit(0).alias("role"), "cls", "row_text")
    rows = indexed.union(streamed).repartition(F.col("shard"), F.col("part")).sortWithinPartitions("shard", "part", "role", "cls")
    return rows.mapInArrow(_search_shards(span), _OUT).distinct()


def _has_repeats(documents: DataFrame) -> bool:
    """Whether an id stands in several rows."""
    return documents.groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0


def shared_spans(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """(cls, doc_class, start, length): per class of equal texts, its spans that other classes hold too."""
    classes = materialize(text_classes(documents, span), "span-classes")
    found = materialize(class_matches(documents, classes, span), "span-matches")
    a = found.select(F.col("cls_a").alias("cls"), F.col("cls_b").alias("other"), F.col("start_a").alias("start"), "length")
    b = found.select(F.col("cls_b").alias("cls"), F.col("cls_a").alias("other"), F.col("start_b").alias("start"), "length")
    return a.union(b)


def shared_amounts(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, class_id, class_docs, spans, shared_chars, shared_share) of every document that shares a span.

    ``shared_chars`` counts characters once, however many documents hold them;
    a document whose whole text stands elsewhere shares all of it.
    """
    classes = materialize(text_classes(documents, span), "span-classes")
    size = classes.groupBy("cls").agg(F.count("*").alias("class_docs"))
    found = materialize(class_matches(documents, classes, span), "span-matches")
    sides = found.select(F.col("cls_a").alias("cls"), F.col("start_a").alias("s"), (F.col("start_a") + F.col("length")).alias("e")).union(found.select("cls_b", "start_b", F.col("start_b") + F.col("length"))).distinct()
    merged = _union_length(sides)
    lengths = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.length("text").alias("n")).groupBy("doc_id").agg(F.max("n").alias("n"))
    rows = classes.join(size, "cls").join(merged, "cls", "left").filter("class_docs > 1 or spans is not null").join(lengths, "doc_id")
    chars = F.when(F.col("class_docs") > 1, F.col("n")).otherwise(F.col("chars"))
    return rows.select("doc_id", F.col("cls").alias("class_id"), "class_docs", F.coalesce("spans", F.lit(0)).alias("spans"), chars.cast("long").alias("shared_chars"), F.round(chars / F.col("n"), 6).alias("shared_share"))


def _union_length(sides: DataFrame) -> DataFrame:
    """(cls, spans, chars): number and joint length of the intervals of each class."""
    from pyspark.sql import Window

    order = Window.partitionBy("cls").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = sides.withColumn("reach", reach)
    fresh = F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), F.coalesce("reach", F.lit(0))))
    return rows.withColumn("fresh", fresh).groupBy("cls").agg(F.count("*").alias("spans"), F.sum("fresh").alias("chars"))


def document_pairs(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: documents that share a span, equal texts included."""
    classes = materialize(text_classes(documents, span), "span-classes")
    pairs = materialize(class_matches(documents, classes, span).select("cls_a", "cls_b").distinct(), "span-pairs")
    repeated = classes.groupBy("cls").agg(F.count("*").alias("k")).filter("k > 1").select("cls")
    a = classes.select(F.col("cls").alias("cls_a"), F.col("doc_id").alias("x"))
    b = classes.select(F.col("cls").alias("cls_b"), F.col("doc_id").alias("y"))
    across = pairs.join(a, "cls_a").join(b, "cls_b").select("x", "y")
    copies = classes.join(repeated, "cls", "left_semi")
    equal = copies.select("cls", F.col("doc_id").alias("x")).join(copies.select("cls", F.col("doc_id").alias("y")), "cls").filter("x < y").select("x", "y")
    return across.union(equal).select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()
