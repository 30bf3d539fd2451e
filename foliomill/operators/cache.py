"""The keyed translation cache: probe, pending work, last write, no-regression rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.functions import text as T
from foliomill.operators.segments import latest_segments, superseded


def latest_entries(cache: DataFrame) -> DataFrame:
    """The last write of every (book_id, doc_no, src_sha1)."""
    return cache.join(superseded(cache, ("book_id", "doc_no", "src_sha1"), F.struct("written_at", "cache_id"), "cache_id"), "cache_id", "left_anti")


def merged_cache(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new entries, the last write per key."""
    return latest_entries(old.unionByName(new, allowMissingColumns=True))


def _keyed(segments: DataFrame) -> DataFrame:
    rows = latest_segments(segments).filter(T.is_translatable(F.col("text")))
    return rows.select("seg_id", "book_id", "doc_no", "seg_no", "text", T.text_key(F.col("text")).alias("src_sha1"))


def cache_hits(segments: DataFrame, cache: DataFrame) -> DataFrame:
    """(seg_id, cache_id): segments whose text is in their document's cache."""
    return _keyed(segments).join(latest_entries(cache).select("book_id", "doc_no", "src_sha1", "cache_id"), ["book_id", "doc_no", "src_sha1"]).select("seg_id", "cache_id")


def pending_segments(segments: DataFrame, cache: DataFrame) -> DataFrame:
    """Segments still to be translated."""
    return _keyed(segments).join(cache.select("book_id", "doc_no", "src_sha1"), ["book_id", "doc_no", "src_sha1"], "left_anti")


def kept_answers(pairs: DataFrame) -> DataFrame:
    """pairs (source, old, new, old_breaks, new_breaks, damaged) with ``answer``: the new one only if it is no worse.

    The old answer stays where the new one repeats the source, has damaged
    placeholders or breaks as many rules as before.
    """
    worse = (T.trimmed(F.col("new")) == T.trimmed(F.col("source"))) | F.col("damaged") | (F.col("new_breaks") >= F.col("old_breaks"))
    return pairs.withColumn("answer", F.when(F.coalesce(worse, F.lit(True)), F.col("old")).otherwise(F.col("new")))


def answer_status(cache: DataFrame) -> DataFrame:
    """(status, entries): what a response's finish reason and text say about it."""
    status = (
        F.when(F.col("finish_reason").isNull(), "blocked: no candidate").when(F.col("finish_reason") == "MAX_TOKENS", "truncated")
        .when(F.coalesce(T.trimmed(F.col("translation")), F.lit("")) == "", "empty").when(F.col("finish_reason") != "STOP", F.concat(F.lit("blocked: "), F.col("finish_reason"))).otherwise("ok")
    )
    return cache.select(status.alias("status")).groupBy("status").agg(F.count("*").alias("entries"))
