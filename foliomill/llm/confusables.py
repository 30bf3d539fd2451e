"""Problem 6: one consistent form for texts that look the same.

The skeleton of a text: decompose it canonically, replace every character by
the prototype of the look-alike table (full-width forms, kinds of blank,
letters of other alphabets), drop what is invisible, decompose again.  Texts
with one skeleton look the same.  Case, accents, digits, superscripts and
punctuation keep their own prototypes, so they stay differences.

Defined cases: a null text has a null skeleton and is in no group; an empty
text and a text of invisible characters only have the empty skeleton; equal
texts are no pair; extra columns are ignored; duplicate rows stay rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm._codes import SEP, chunks, code_points, joined
from foliomill.llm._lookalike import prototypes
from foliomill.plans.runtime import materialize, small


def skeletons(texts: list[str]) -> list[str]:
    """Skeletons of many texts, by whole-array replacement."""
    if not texts:
        return []
    codes = prototypes()[code_points(unicodedata.normalize("NFD", joined(texts)))]
    plain = codes[codes != 0].tobytes().decode("utf-32-le", "surrogatepass")
    return unicodedata.normalize("NFD", plain).split(SEP)


def consistent(text: str) -> str:
    """The form all texts of one skeleton share, for readers: the composed skeleton."""
    return unicodedata.normalize("NFC", skeletons([text])[0])


def _halves(digest: int) -> tuple[int, int]:
    high, low = digest >> 64, digest & (1 << 64) - 1
    return high - (1 << 64) * (high >> 63), low - (1 << 64) * (low >> 63)


def with_skeleton(segments: DataFrame, key: str = "seg_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """(key, s1, s2, t1, t2[, skeleton, form]): 128-bit digests of skeleton and text."""
    fields = [pa.field("row_key", pa.int64()), *(pa.field(c, pa.int64()) for c in ("s1", "s2", "t1", "t2"))]
    if keep_text:
        fields += [pa.field("form", pa.string())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_intdigest
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for a, b in chunks([len(t) for t in texts]):
                own = texts[a:b]
                forms = skeletons(own)
                s = np.array([_halves(digest(f.encode("utf-8", "surrogatepass"))) for f in forms], np.int64)
                t = np.array([_halves(digest(x.encode("utf-8", "surrogatepass"))) for x in own], np.int64)
                cols = [pa.array(ids[a:b]), *(pa.array(np.ascontiguousarray(m[:, j])) for m in (s, t) for j in (0, 1))]
                if keep_text:
                    cols.append(pa.array([unicodedata.normalize("NFC", f) for f in forms]))
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    rows = segments.select(F.col(key).cast("long").alias("row_key"), F.col(text).alias("row_text")).filter("row_key is not null and row_text is not null")
    return rows.mapInArrow(run, "row_key long, s1 long, s2 long, t1 long, t2 long" + ", form string" * keep_text).withColumnRenamed("row_key", key)


def look_alike_members(digests: DataFrame) -> DataFrame:
    """Rows of ``digests`` whose skeleton has at least two different texts.

    The aggregate combines before the shuffle, so one text held by a third of
    all rows sends one row per task.
    """
    text = F.struct("t1", "t2")
    groups = digests.groupBy("s1", "s2").agg(F.min(text).alias("lo"), F.max(text).alias("hi")).filter("lo <> hi").select("s1", "s2")
    return digests.join(small(materialize(groups, "lookalike-groups")), ["s1", "s2"], "left_semi")


def look_alike_pairs(segments: DataFrame) -> DataFrame:
    """(seg_a, seg_b): texts that look the same and are not equal.

    Different texts of one skeleton are paired first, each text once however
    many rows hold it; then the pairs are given their rows on either side.  So
    rows of one text never meet each other, and no more rows are made than the
    result has.
    """
    members = materialize(look_alike_members(materialize(with_skeleton(segments), "skeletons")), "lookalike-members")
    texts = materialize(members.select("s1", "s2", "t1", "t2").distinct(), "lookalike-texts")
    one = texts.select("s1", "s2", F.col("t1").alias("a1"), F.col("t2").alias("a2"))
    other = texts.select("s1", "s2", F.col("t1").alias("b1"), F.col("t2").alias("b2"))
    twos = one.join(other, ["s1", "s2"]).filter(F.struct("a1", "a2") < F.struct("b1", "b2")).select("a1", "a2", "b1", "b2")
    twos = small(materialize(twos, "lookalike-twos"))
    rows = members.select("seg_id", "t1", "t2").distinct()
    left = rows.select(F.col("seg_id").alias("x"), F.col("t1").alias("a1"), F.col("t2").alias("a2")).join(twos, ["a1", "a2"]).select("x", "b1", "b2")
    both = left.join(rows.select(F.col("seg_id").alias("y"), F.col("t1").alias("b1"), F.col("t2").alias("b2")), ["b1", "b2"]).filter("x <> y")
    return both.select(F.least("x", "y").alias("seg_a"), F.greatest("x", "y").alias("seg_b")).distinct()


def look_alike_groups(segments: DataFrame) -> DataFrame:
    """(seg_id, group_id, form): one consistent form, and the first segment of those that agree."""
    rows = materialize(with_skeleton(segments, keep_text=True), "forms")
    first = rows.groupBy("s1", "s2").agg(F.min("seg_id").alias("group_id"), F.count("*").alias("group_rows"))
    return rows.join(first, ["s1", "s2"]).select("seg_id", "group_id", "group_rows", "form")
