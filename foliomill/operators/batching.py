"""Work units and requests: sentence splits, greedy chunks, context windows, dry-run totals."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill.functions import text as T
from foliomill.operators.segments import latest_segments

#: Characters a request pays for each unit besides its text.
UNIT_COST = 8
#: Source characters of context, and the least that is still worth adding.
CONTEXT, LEAST_ROOM = 1500, 200
#: Characters of a part where a book has no settings; pairs of the document before that a document's context may hold;
#: terms asked for at a time.
PART_CHARS, CARRIED, TERM_BATCH = 6000, 3, 150

_TAG = re.compile(r"<(/?)x\d+(/?)>")
_STOP = re.compile(r"[.!?…][\"”’»)]*\s+")


def sentence_parts(text: str, limit: int) -> list[str]:
    """Pieces cut after sentences outside any open placeholder: the last cut that fits, else the next one."""
    if len(text) <= limit:
        return [text]
    cuts, depth, last = [], 0, 0
    for stop in _STOP.finditer(text):
        for tag in _TAG.finditer(text, last, stop.end()):
            depth += 0 if tag[2] else -1 if tag[1] else 1
        last = stop.end()
        if depth == 0 and stop.end() < len(text):
            cuts.append(stop.end())
    out, start, i = [], 0, 0
    while len(text) - start > limit:
        while i < len(cuts) and cuts[i] <= start:
            i += 1
        if i == len(cuts):
            break
        j = i
        while j + 1 < len(cuts) and cuts[j + 1] <= start + limit:
            j += 1
        out.append(text[start : cuts[j]].strip())
        start = cuts[j]
    return [p for p in [*out, text[start:].strip()] if p]


def split_units(segments: DataFrame, limits: DataFrame) -> DataFrame:
    """(seg_id, book_id, doc_no, seg_no, part_no, n_parts, unit): translatable texts in parts of about their book's limit.

    ``limits`` has (book_id, part_chars); a book without takes PART_CHARS.
    Only texts over the limit leave the JVM.
    """
    schema = pa.schema([("seg_id", pa.int64()), ("parts", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [sentence_parts(t, n) for t, n in zip(*(batch.column(i).to_pylist() for i in (1, 2)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.list_(pa.string()))], schema=schema)

    rows = latest_segments(segments).filter(T.is_translatable(F.col("text"))).select("seg_id", "book_id", "doc_no", "seg_no", "text")
    rows = rows.join(limits.select("book_id", "part_chars"), "book_id", "left").withColumn("limit", F.coalesce("part_chars", F.lit(PART_CHARS)).cast("int")).drop("part_chars")
    short = rows.filter(F.length("text") <= F.col("limit")).withColumn("parts", F.array("text")).drop("text", "limit")
    place = rows.filter(F.length("text") > F.col("limit"))
    long = place.select("seg_id", "text", "limit").mapInArrow(run, "seg_id long, parts array<string>").join(place.drop("text", "limit"), "seg_id")
    both = short.unionByName(long)
    return both.select("seg_id", "book_id", "doc_no", "seg_no", F.size("parts").alias("n_parts"), F.posexplode("parts").alias("part", "unit")).select("seg_id", "book_id", "doc_no", "seg_no", (F.col("part") + 1).alias("part_no"), "n_parts", "unit")


def rejoined(units: DataFrame) -> DataFrame:
    """(seg_id, body): parts put together in order."""
    return units.groupBy("seg_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_no", "unit"))), lambda x: x["unit"]), " ").alias("body"))


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rows sorted by document; the state is one running size."""
    schema = pa.schema([("seg_id", pa.int64()), ("chunk", pa.int32())])
    doc, size, chunk = None, 0, 0
    for batch in batches:
        out = []
        for book, no, n, cap in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4))):
            if doc != (book, no):
                doc, size, chunk = (book, no), 0, 1
            elif size + n > cap:
                size, chunk = 0, chunk + 1
            size += n
            out.append(chunk)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int32())], schema=schema)


def chunk_plan(pending: DataFrame, books: DataFrame, run_config: DataFrame) -> DataFrame:
    """(seg_id, chunk): requests of consecutive texts, a new one where the next text doesn't fit.

    Where a request starts depends on the one before, so a document is read in
    order by one task; it is streamed, never held.
    """
    caps = books.join(run_config, "profile").select("book_id", F.col("max_chars").alias("cap"))
    rows = pending.join(caps, "book_id").select("seg_id", "book_id", "doc_no", (F.length("text") + UNIT_COST).alias("n"), "cap", "seg_no")
    rows = rows.repartition("book_id", "doc_no").sortWithinPartitions("book_id", "doc_no", "seg_no", "seg_id")
    return rows.select("seg_id", "book_id", "doc_no", "n", "cap").mapInArrow(_greedy, "seg_id long, chunk int")


def dry_run(pending: DataFrame, plan: DataFrame, books: DataFrame, run_config: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """(book_id, pending, pending_chars, requests, tokens, days): what a run would ask for.

    With ``candidates`` (book_id, term) the requests for a glossary count too.
    """
    rows = pending.join(plan, "seg_id").groupBy("book_id", "doc_no").agg(F.count("*").alias("k"), F.sum(F.length("text")).alias("c"), F.max("chunk").alias("r"))
    rows = rows.groupBy("book_id").agg(F.sum("k").alias("pending"), F.sum("c").alias("pending_chars"), F.sum("r").alias("requests"))
    if candidates is not None:
        asked = candidates.groupBy("book_id").agg(F.ceil(F.count("*") / TERM_BATCH).alias("t"))
        rows = rows.join(asked, "book_id", "left").withColumn("requests", F.col("requests") + F.coalesce("t", F.lit(0))).drop("t")
    daily = books.join(run_config, "profile").select("book_id", "rpd")
    days = F.when(F.col("rpd") > 0, F.ceil(F.col("requests") / F.col("rpd")))
    return rows.join(daily, "book_id").select("book_id", "pending", "pending_chars", "requests", F.floor(F.col("pending_chars") / 4).alias("tokens"), days.cast("long").alias("days"))


def context_windows(segments: DataFrame, context: int = CONTEXT) -> DataFrame:
    """(seg_id, before, chars): texts before each one that fit its context, whole or as a tail.

    Going back from a text, texts are added while LEAST_ROOM characters are
    free; by prefix sums that is a range frame, no loop.
    """
    rows = latest_segments(segments).filter(T.is_translatable(F.col("text"))).select("seg_id", "book_id", "doc_no", "seg_no", F.length(T.plain_tight(F.col("text"))).cast("long").alias("n"))
    doc = Window.partitionBy("book_id", "doc_no")
    rows = rows.withColumn("upto", F.sum("n").over(doc.orderBy("seg_no").rowsBetween(Window.unboundedPreceding, 0)))
    reach = doc.orderBy("upto").rangeBetween(LEAST_ROOM - context, 0)
    rows = rows.withColumn("k", F.count("*").over(reach)).withColumn("s", F.sum("n").over(reach))
    order = doc.orderBy("seg_no")
    return rows.select("seg_id", F.coalesce(F.lag("k").over(order), F.lit(0)).alias("before"), F.least(F.coalesce(F.lag("s").over(order), F.lit(0)), F.lit(context)).alias("chars"))


def request_contexts(pairs: DataFrame, documents: DataFrame, starts: DataFrame, limits: DataFrame) -> DataFrame:
    """(book_id, doc_no, chunk, context): the passage before each request, source and translation in turns.

    ``pairs`` (book_id, doc_no, seg_no, source, translation) are the readable
    texts translated so far, ``documents`` (book_id, doc_no) all documents,
    ``starts`` (book_id, doc_no, chunk, seg_no) where requests begin, ``limits``
    (book_id, context_chars) the source characters of a context.

    Going back from a request, pairs are taken while LEAST_ROOM characters are
    free; the last one may be a tail, of both texts in one proportion.  Before
    a document stand the last CARRIED pairs of the nearest one before it that
    has any.  By prefix sums all that is a range frame; the frame is the widest
    any book asks for, and each book's own limit is applied inside it.
    """
    doc = Window.partitionBy("book_id", "doc_no")
    own = pairs.filter(T.trimmed(F.col("source")) != "").withColumn("n", F.length("source").cast("long"))
    nth = F.row_number().over(doc.orderBy(F.desc("seg_no")))
    last = own.withColumn("back", nth).filter(F.col("back") <= CARRIED)
    has = own.select("book_id", "doc_no").distinct().withColumn("has", F.col("doc_no"))
    book = Window.partitionBy("book_id").orderBy("doc_no").rowsBetween(Window.unboundedPreceding, -1)
    before = documents.select("book_id", "doc_no").distinct().join(has, ["book_id", "doc_no"], "left").withColumn("from", F.last("has", ignorenulls=True).over(book)).select("book_id", F.col("doc_no").alias("to"), F.col("from").alias("doc_no")).filter("doc_no is not null")
    carried = last.join(before, ["book_id", "doc_no"]).select("book_id", F.col("to").alias("doc_no"), (-F.col("back")).cast("long").alias("at"), F.lit(1).alias("rank"), "source", "translation", "n")
    inside = own.select("book_id", "doc_no", F.col("seg_no").cast("long").alias("at"), F.lit(1).alias("rank"), "source", "translation", "n")
    marks = starts.select("book_id", "doc_no", F.col("seg_no").cast("long").alias("at"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("n"), "chunk")
    rows = inside.unionByName(carried).unionByName(marks, allowMissingColumns=True)
    rows = rows.withColumn("upto", F.sum("n").over(doc.orderBy("at", "rank").rowsBetween(Window.unboundedPreceding, 0)))
    widest = limits.agg(F.max("context_chars")).first()[0] or 0
    reach = doc.orderBy("upto").rangeBetween(-max(0, widest - LEAST_ROOM), 0)
    seen = F.collect_list(F.when(F.col("rank") == 1, F.struct("upto", "source", "translation"))).over(reach)
    rows = rows.withColumn("seen", F.when(F.col("rank") == 0, seen)).filter("rank = 0").join(limits.select("book_id", "context_chars"), "book_id")
    room = lambda x: F.col("context_chars") - (F.col("upto") - x["upto"])

    def shown(x: Column) -> Column:
        source, translation, free = x["source"], x["translation"], room(x)
        share = F.greatest(F.lit(1), F.floor(F.length(translation) * free / F.length(source))).cast("int")
        cut = F.length(source) > free
        return F.concat(F.lit("SOURCE: "), F.when(cut, T.tail_of(source, free.cast("int"))).otherwise(source), F.lit("\nTRANSLATION: "), F.when(cut, T.tail_of(translation, share)).otherwise(translation))

    near = F.filter("seen", lambda x: (room(x) >= LEAST_ROOM) & (F.col("context_chars") > 0))
    context = F.array_join(F.transform(F.array_sort(near), shown), "\n")
    return rows.select("book_id", "doc_no", "chunk", F.nullif(context, F.lit("")).alias("context"))
