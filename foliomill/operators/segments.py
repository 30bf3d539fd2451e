"""Segments, their lines and their text forms."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.functions import text as T

KEY = ("book_id", "doc_no", "seg_no")


def latest_segments(segments: DataFrame) -> DataFrame:
    """One row per place in a book: the one ingested last (then the largest id)."""
    return segments.filter("book_id is not null").join(superseded(segments, KEY, F.struct("ingested_at", "seg_id"), "seg_id"), "seg_id", "left_anti")


def superseded(rows: DataFrame, key: tuple[str, ...], order: Column, ident: str) -> DataFrame:
    """(ident): the rows of a key but its last one.

    Few keys are repeated, so it is their rows that are joined against, not the
    last row of every key: the rows themselves needn't be shuffled.
    """
    best = rows.groupBy(*(F.col(c).alias(f"{c}_") for c in key)).agg(F.max(order).alias("best"), F.count("*").alias("n")).filter("n > 1")
    same = F.lit(True)
    for c in key:
        same &= F.col(c).eqNullSafe(F.col(f"{c}_"))
    return rows.select(*key, order.alias("own"), ident).join(best, same).filter("own < best").select(ident)


def first_seen(segments: DataFrame) -> DataFrame:
    """(book_id, doc_no, seg_no, seg_id, copies): the first row of each place in extraction order."""
    order = F.struct("extracted_at", "seg_id")
    return segments.groupBy(*KEY).agg(F.min(order).alias("b"), F.count("*").alias("copies")).select(*KEY, F.col("b.seg_id").alias("seg_id"), "copies")


def text_lines(text: Column) -> Column:
    """array<(line_no, line)>: the lines of a text that aren't blank."""
    made = F.transform(F.split(text, T.BREAK, -1), lambda raw, i: F.struct((i + 1).alias("line_no"), T.plain(raw).alias("line")))
    return F.filter(made, lambda x: x["line"] != "")


def lines(segments: DataFrame) -> DataFrame:
    """(seg_id, book_id, doc_no, tag, n_lines, line_no, line): the lines of each text that aren't blank.

    A line ends at a line break or a void placeholder; ``n_lines`` counts blank ones too.
    """
    rows = segments.filter("text is not null").select("seg_id", "book_id", "doc_no", "tag", F.size(F.split("text", T.BREAK, -1)).alias("n_lines"), F.explode(text_lines(F.col("text"))).alias("x"))
    return rows.select("seg_id", "book_id", "doc_no", "tag", "n_lines", "x.line_no", "x.line")


def translatable(segments: DataFrame) -> DataFrame:
    return segments.filter(T.is_translatable(F.col("text")))


def numbered_text(segments: DataFrame) -> DataFrame:
    """(book_id, doc_no, body): ``[[n]] text`` lines of a document in order."""
    rows = latest_segments(segments).filter("text is not null")
    item = F.struct("seg_no", F.concat(F.lit("[["), F.col("seg_no").cast("string"), F.lit("]] "), F.col("text")).alias("t"))
    return rows.groupBy("book_id", "doc_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), "\n").alias("body"))


def plain_document(segments: DataFrame) -> DataFrame:
    """(book_id, doc_no, body): readable segments of a document, a blank line between."""
    rows = latest_segments(segments).select("book_id", "doc_no", "seg_no", T.plain_tight(F.col("text")).alias("t")).filter("t <> ''")
    return rows.groupBy("book_id", "doc_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_no", "t"))), lambda x: x["t"]), "\n\n").alias("body"))


def parsed_markers(replies: DataFrame) -> DataFrame:
    """(book_id, doc_no, item, reply): parts of a reply that start with ``[[n]]`` on a new line.

    The last part of a number counts; text before the first marker is dropped.
    """
    body = F.regexp_replace(T.trimmed(F.col("body")), r"^```[a-zA-Z]*[ \t\n\r\f]*|```[ \t\n\r\f]*$", "")
    marked = F.regexp_replace(F.concat(F.lit("\n"), body), r"\n[ \t]*\[\[([0-9]+)\]\][ ]?", "\x01$1\x02")
    parts = replies.select("book_id", "doc_no", F.posexplode(F.split(marked, "\x01")).alias("pos", "part")).filter("pos > 0")
    parts = parts.select("book_id", "doc_no", "pos", F.substring_index("part", "\x02", 1).cast("int").alias("item"), T.collapsed(F.regexp_replace("part", "^[^\x02]*\x02", "")).alias("reply"))
    return parts.groupBy("book_id", "doc_no", "item").agg(F.max_by("reply", "pos").alias("reply"))


def bilingual_rows(segments: DataFrame, cache: DataFrame) -> DataFrame:
    """(book_id, doc_no, seg_no, rank, body): source and translation in turns, in reading order."""
    from foliomill.operators.cache import latest_entries

    rows = latest_segments(segments).filter("text is not null").select("book_id", "doc_no", "seg_no", "text", T.text_key(F.col("text")).alias("src_sha1"))
    hits = latest_entries(cache).filter("translation is not null").select("book_id", "doc_no", "src_sha1", "translation")
    both = rows.join(hits, ["book_id", "doc_no", "src_sha1"])
    source = both.select("book_id", "doc_no", "seg_no", F.lit(0).alias("rank"), F.col("text").alias("body"))
    return source.unionByName(both.select("book_id", "doc_no", "seg_no", F.lit(1).alias("rank"), F.col("translation").alias("body")))


def placeholder_census(segments: DataFrame) -> DataFrame:
    """(book_id, tag, segments, placeholders): segments and placeholders per tag."""
    rows = segments.select("book_id", F.coalesce("tag", F.lit("?")).alias("tag"), F.coalesce(F.regexp_count("text", F.lit(T.TOKEN)), F.lit(0)).alias("k"))
    return rows.groupBy("book_id", "tag").agg(F.count("*").alias("segments"), F.sum("k").alias("placeholders"))


def _free_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (book, root): each id's number of underscores, the least that no id of its root has yet."""
    schema = pa.schema([("book_id", pa.int64()), ("doc_no", pa.int32()), ("seg_no", pa.int32()), ("ident", pa.string()), ("made", pa.string())])
    key, taken, least = None, set(), {}
    for batch in batches:
        made = []
        for book, root, kept, tails in zip(*(batch.column(c).to_pylist() for c in ("book_id", "root", "kept", "tails"))):
            if key != (book, root):
                key, taken, least = (book, root), set(), {}
            k = tails
            if not kept:
                k = least.get(tails, tails)
                while k in taken:
                    k += 1
                least[tails] = k + 1
            taken.add(k)
            made.append(root + "_" * k)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("book_id", "doc_no", "seg_no")), batch.column("ident").cast(pa.string()), pa.array(made, pa.string())], schema=schema)


def chapter_ids(segments: DataFrame) -> DataFrame:
    """(book_id, doc_no, seg_no, ident, made): valid, distinct navigation ids from heading texts.

    The first valid use of an id is kept; invalid or repeated ones become
    ``np_`` and the id with other characters as ``_``, and as many more ``_``
    as it takes to differ from all others.  Only ids that differ in their last
    underscores can clash: these are put in order together.
    """
    heads = latest_segments(segments).filter("tag = 'h1' and text is not null").select("book_id", "doc_no", "seg_no", F.col("text").alias("ident"))
    place = F.struct("doc_no", "seg_no")
    first = heads.groupBy("book_id", "ident").agg(F.min(place).alias("first"))
    rows = heads.join(first, ["book_id", "ident"])
    rows = rows.withColumn("kept", F.col("ident").rlike(r"^[A-Za-z_][A-Za-z0-9_.-]*$") & (place == F.col("first")))
    base = F.when(F.col("kept"), F.col("ident")).otherwise(F.concat(F.lit("np_"), F.regexp_replace("ident", r"[^A-Za-z0-9_.-]", "_")))
    rows = rows.withColumn("base", base).withColumn("root", F.regexp_replace("base", "_+$", "")).withColumn("tails", (F.length("base") - F.length("root")).cast("int"))
    rows = rows.repartition("book_id", "root").sortWithinPartitions("book_id", "root", F.desc("kept"), "doc_no", "seg_no")
    return rows.select("book_id", "doc_no", "seg_no", "ident", "root", "kept", "tails").mapInArrow(_free_ids, "book_id long, doc_no int, seg_no int, ident string, made string")
