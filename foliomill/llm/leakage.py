"""Problem 7: passages of test items inside training documents.

Winnowing over words: a text keeps the smallest hash of ``WORDS_PER_GRAM``
consecutive words in every window of ``WINDOW`` of them.  Any run of at least
``RUN`` = WINDOW + WORDS_PER_GRAM - 1 equal words holds one whole window, in
which both sides keep the same gram, so the join of the two fingerprint sets
misses none.  The test hashes travel to the corpus as a bitmap of bounded size,
so that hashes no test item has are dropped where they are made, whatever the
number of test items, and only the others are joined.  Hits are then extended word by word, which also sorts out
hash collisions.

Words are maximal runs of letters and digits after NFKC, lower-casing and
dropping invisible characters.  Defined cases: null and empty texts and texts
of fewer than RUN words match nothing; repeated items and documents are
reported each; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm._codes import SEP, chunks, code_points, gram_hash, joined, prefix, span_hash, winnow, word_chars
from foliomill.llm._lookalike import INVISIBLE
from foliomill.plans.runtime import materialize, small

#: Words a leak has at least; words of a gram; grams of a window.
RUN, WORDS_PER_GRAM = 13, 6
WINDOW = RUN - WORDS_PER_GRAM + 1
#: Bits of the bitmap for each test hash, and the most it has in all (16 MB); beyond, more hashes pass, and the join is as exact.
BITS_EACH, MOST_BITS = 32, 1 << 27

_DROP = np.zeros(0x110000, bool)
_DROP[INVISIBLE] = True


def _normal(text: str) -> np.ndarray:
    """Code points after NFKC, lower-casing and dropping invisible characters."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    codes = code_points(text.lower())
    gone = _DROP[codes]
    return codes[~gone] if gone.any() else codes


def _word_spans(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = word_chars()[codes]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def words(text: str) -> list[str]:
    """The words of one text."""
    codes = _normal(text)
    return [codes[a:b].tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(*_word_spans(codes))]


def fingerprints(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word position, hash) of the kept grams of many texts."""
    codes = _normal(joined(texts))
    start, end = _word_spans(codes)
    row = np.searchsorted(np.flatnonzero(codes == ord(SEP)), start)
    grams = gram_hash(prefix(span_hash(prefix(codes), start, end)), WORDS_PER_GRAM)
    first = np.searchsorted(row, np.arange(len(texts) + 1))
    # a window of RUN words is used if its last word is in the same text
    n = max(0, len(row) - RUN + 1)
    at = winnow(grams, WINDOW, row[:n] == row[RUN - 1 : RUN - 1 + n]) if n else np.zeros(0, np.int64)
    return row[at], at - first[row[at]], grams[at].astype(np.int64) if len(at) else np.zeros(0, np.int64)


def hash_bitmap(prints: DataFrame) -> np.ndarray:
    """A bitmap of the hashes ``h``: its size follows their number up to MOST_BITS."""
    bits = min(MOST_BITS, 1 << max(16, (prints.count() * BITS_EACH).bit_length()))
    place = prints.select(F.pmod("h", F.lit(bits)).alias("place"))
    words = place.selectExpr("shiftright(place, 6) as w", "shiftleft(1L, cast(place & 63 as int)) as b").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out.view(np.uint64)


def in_bitmap(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h.astype(np.uint64) & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def word_fingerprints(texts: DataFrame, key: str, text: str = "text", among: np.ndarray | None = None) -> DataFrame:
    """(row_id, pos, h) by winnowing; with a bitmap only the hashes that are in it."""
    bitmap = None if among is None else texts.sparkSession.sparkContext.broadcast(among)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, some = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for a, b in chunks([len(t) for t in some]):
                row, pos, h = fingerprints(some[a:b])
                if bitmap is not None:
                    keep = in_bitmap(bitmap.value, h)
                    row, pos, h = row[keep], pos[keep], h[keep]
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][row]), pa.array(pos.astype(np.int32)), pa.array(h)], names=["row_id", "pos", "h"])

    rows = texts.select(F.col(key).cast("long").alias("row_id"), F.col(text).alias("row_text")).filter("row_id is not null and row_text is not null")
    return rows.mapInArrow(run, "row_id long, pos int, h long")


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, [(item_id, item text, [(doc pos, item pos)])]) -> shared runs."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("doc_word", pa.int32()), ("item_word", pa.int32()), ("n_words", pa.int32())])
    for batch in batches:
        out = set()
        known: dict[str, list[str]] = {}
        last, doc = None, []
        for doc_id, text, item_id, item_text, hits in zip(*(c.to_pylist() for c in batch.columns)):
            if last != (doc_id, text):
                last, doc = (doc_id, text), words(text)
            item = known.setdefault(item_text, None) or words(item_text)
            known[item_text] = item
            for hit in hits:
                a, b = hit["dpos"], hit["ipos"]
                if doc[a : a + WORDS_PER_GRAM] != item[b : b + WORDS_PER_GRAM]:
                    continue
                i, j = a, b
                while i and j and doc[i - 1] == item[j - 1]:
                    i, j = i - 1, j - 1
                n = a - i
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n]:
                    n += 1
                out.add((doc_id, item_id, i, j, n))
        cols = list(zip(*sorted(out))) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)


def leaked_runs(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_words): maximal shared runs of at least RUN words."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text")).filter("item_id is not null and item_text is not null").distinct()
    test = materialize(word_fingerprints(items, "item_id", "item_text").select(F.col("row_id").alias("item_id"), F.col("pos").alias("ipos"), "h"), "test-prints")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("doc_text")).filter("doc_id is not null and doc_text is not null")
    hits = word_fingerprints(docs, "doc_id", "doc_text", hash_bitmap(test)).withColumnsRenamed({"row_id": "doc_id", "pos": "dpos"}).join(small(test), "h")
    hits = materialize(hits.select("doc_id", "dpos", "item_id", "ipos").distinct(), "hits")
    # one row a pair; positions of one pair are bounded by the two texts
    pairs = hits.groupBy("doc_id", "item_id").agg(F.collect_list(F.struct("dpos", "ipos")).alias("hits"))
    some = docs.join(small(materialize(hits.select("doc_id").distinct(), "hit-docs")), "doc_id", "left_semi")
    rows = some.join(pairs, "doc_id").join(small(materialize(items, "items")), "item_id").select("doc_id", "doc_text", "item_id", "item_text", "hits")
    return rows.mapInArrow(_extend, "doc_id long, item_id long, doc_word int, item_word int, n_words int").filter(F.col("n_words") >= RUN).distinct()
