"""Page artefacts: learned running heads, line classes, broken lines, split paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill.functions import text as T
from foliomill.operators.segments import latest_segments, lines, text_lines
from foliomill.plans.runtime import materialize

#: Uses from which a numbered line is a running head, and a line in capitals an artefact.
HEAD_USES, CAPS_USES = 3, 5

HEADINGS = "^h[1-6]$"


def name_keys(books: DataFrame) -> DataFrame:
    """(book_id, key): folded title, title before a colon, author and the author's last word."""
    parts = F.array("title", F.substring_index("title", ":", 1), "author", F.element_at(F.split(T.trimmed(F.col("author")), " "), -1))
    rows = books.select("book_id", F.explode(F.array_compact(parts)).alias("name")).select("book_id", T.norm_key(F.col("name")).alias("key"))
    return rows.filter(F.length("key") >= 3).distinct()


def running_heads(rows: DataFrame) -> DataFrame:
    """(book_id, key, uses): short numbered lines that recur in a book, without their numbers."""
    heads = rows.filter(F.length("line").between(1, 60) & F.col("line").rlike(T.NUMBER) & ~T.is_page_number(F.col("line")))
    heads = heads.select("book_id", T.header_key(F.col("line")).alias("key")).filter(F.length("key") >= 3)
    return heads.groupBy("book_id", "key").agg(F.count("*").alias("uses")).filter(F.col("uses") >= HEAD_USES)


def _capitals(line: Column) -> Column:
    return F.length(line).between(6, 40) & ~line.rlike(r"\p{Ll}") & (F.regexp_count(line, F.lit(r"\p{Lu}")) >= 5)


def repeated_caps(rows: DataFrame) -> DataFrame:
    """(book_id, line, uses): lines in capitals that recur inside texts of several lines, heads aside."""
    numbered = F.col("line").rlike(T.NUMBER) & ~T.is_page_number(F.col("line")) & (F.length(T.header_key(F.col("line"))) >= 3)
    caps = rows.filter((F.col("n_lines") > 1) & _capitals(F.col("line")) & ~numbered)
    return caps.groupBy("book_id", "line").agg(F.count("*").alias("uses")).filter(F.col("uses") >= CAPS_USES)


def classified_lines(segments: DataFrame, books: DataFrame) -> DataFrame:
    """lines with ``kind``: header, page number, watermark, caps or null, the first that fits.

    The learned keys are joined, not collected; headings keep their lines.
    """
    rows = materialize(lines(segments), "lines")
    heads = running_heads(rows).select("book_id", "key").union(name_keys(books)).distinct().withColumn("is_key", F.lit(True))
    caps = repeated_caps(rows).select("book_id", "line").withColumn("is_caps", F.lit(True))
    short = (F.length("line") <= 60) & F.col("line").rlike(T.NUMBER)
    rows = rows.withColumn("key", F.when(short, T.header_key(F.col("line"))))
    rows = rows.join(heads, ["book_id", "key"], "left").join(caps, ["book_id", "line"], "left")
    several = F.col("n_lines") > 1
    kind = (
        F.when(F.col("tag").rlike(HEADINGS), None)
        .when(F.col("is_key"), "header")
        .when(several & T.is_page_number(F.col("line")), "page number")
        .when((F.length("line") <= 90) & F.col("line").rlike(T.NOTES), "watermark")
        .when(several & F.col("is_caps"), "caps")
    )
    return rows.select("seg_id", "book_id", "doc_no", "tag", "n_lines", "line_no", "line", kind.alias("kind"))


def footnote_suspects(classified: DataFrame) -> DataFrame:
    """Later lines that begin like a footnote: reported, never removed."""
    keep = F.col("kind").isNull() & (F.col("line_no") > 1) & F.col("line").rlike(T.FOOTNOTE) & (F.length("line") < 300)
    return classified.filter(keep & ~F.coalesce(F.col("tag").rlike(HEADINGS), F.lit(False))).select("seg_id", "line_no", F.substring("line", 1, 90).alias("line"))


def stripped_text(segments: DataFrame, classified: DataFrame) -> DataFrame:
    """(seg_id, removed, body): texts that lost lines, the others joined by a blank.

    Lines to be removed are few: their numbers go to the texts that hold them,
    and the lines of a text stay in its row.
    """
    gone = classified.filter("kind is not null").groupBy("seg_id").agg(F.collect_set("line_no").alias("gone"))
    rows = segments.filter("text is not null").select("seg_id", text_lines(F.col("text")).alias("all")).join(gone, "seg_id")
    kept = F.filter("all", lambda x: ~F.array_contains("gone", x["line_no"]))
    return rows.select("seg_id", F.size("gone").alias("removed"), F.array_join(F.transform(kept, lambda x: x["line"]), " ").alias("body"))


def issue_counts(cleanup_log: DataFrame) -> DataFrame:
    """(book_id, headers, page_numbers, watermarks, line_joins, paragraph_merges, char_fixes, footnotes)."""
    what = F.regexp_extract("entry", r"^[^:]*: (.*)$", 1)
    count = lambda start, name: F.count_if(what.startswith(start)).alias(name)
    return cleanup_log.groupBy("book_id").agg(
        count("removed header", "headers"), count("removed page number", "page_numbers"), count("removed watermark", "watermarks"), count("joined broken line", "line_joins"),
        count("merged split paragraph", "paragraph_merges"), count("character fixes", "char_fixes"), count("POSSIBLE FOOTNOTE", "footnotes"),
    )


def issues_by_kind(cleanup_log: DataFrame) -> DataFrame:
    """(kind, n): kinds of log entry, most frequent first."""
    kind = F.regexp_extract("entry", r"^[^:]*: ([A-Za-z]+ [A-Za-z]+)", 1)
    return cleanup_log.select(kind.alias("kind")).filter("kind <> ''").groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


LOWER, UPPER = r"\p{Ll}", r"\p{Lu}"
# What a line or paragraph ends with that stops inside a sentence.
STOPS_INSIDE = r"[a-záéíóúñüàèìòùâêîôûç0-9,;:-]$"
LONG_STOPS_INSIDE = r"[a-záéíóúñü,;]$"
#: Characters of a line from which a capital may follow a break inside a sentence.
LONG_LINE = 25


def broken_lines_joined(segments: DataFrame) -> DataFrame:
    """(seg_id, joins, body): texts whose lines were cut inside a sentence, put together.

    A line is joined to the next where the next starts lower-case, or where it
    is long, stops inside a sentence and the next starts upper-case.  A
    hyphen after a letter goes; other breaks stay as line breaks.  All lines of
    a text are in its row, so nothing is shuffled.
    """
    # most texts have one line: they are told apart before any is taken to pieces
    rows = segments.filter(F.col("text").rlike(T.BREAK)).select("seg_id", F.transform(text_lines(F.col("text")), lambda x: x["line"]).alias("lines"))

    def judged(line: Column, i: Column) -> Column:
        after = F.get("lines", i + 1)
        low = after.rlike(f"^{LOWER}") & (line.rlike(STOPS_INSIDE) | line.rlike(r"\p{L}$"))
        up = after.rlike(f"^{UPPER}") & (F.length(line) >= LONG_LINE) & line.rlike(LONG_STOPS_INSIDE)
        return F.struct(line.alias("line"), F.coalesce(low | up, F.lit(False)).alias("joined"), after.isNull().alias("last"))

    def piece(x: Column) -> Column:
        line = x["line"]
        return F.when(x["last"], line).when(x["joined"] & line.rlike(r"\p{L}-$"), F.regexp_replace(line, "-$", "")).when(x["joined"], F.concat(line, F.lit(" "))).otherwise(F.concat(line, F.lit("\n")))

    rows = rows.withColumn("judged", F.transform("lines", judged)).withColumn("joins", F.size(F.filter("judged", lambda x: x["joined"]))).filter("joins > 0")
    return rows.select("seg_id", "joins", F.array_join(F.transform("judged", piece), "").alias("body"))


def paragraphs_merged(segments: DataFrame) -> DataFrame:
    """(book_id, doc_no, seg_no, merged, body): runs of neighbours cut inside a sentence.

    Neighbours are p or div texts that follow each other; a run's number is a
    running sum of its breaks (gaps and islands).
    """
    rows = latest_segments(segments).select("book_id", "doc_no", "seg_no", "tag", T.plain(F.col("text")).alias("line"))
    order = Window.partitionBy("book_id", "doc_no").orderBy("seg_no")
    before, tag, number = (F.lag(c).over(order) for c in ("line", "tag", "seg_no"))
    fits = F.col("tag").isin("p", "div") & tag.isin("p", "div") & (number == F.col("seg_no") - 1) & before.rlike(STOPS_INSIDE) & F.col("line").rlike(f"^{LOWER}")
    rows = rows.withColumn("fresh", F.when(F.coalesce(fits, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("book_id", "doc_no", "run").agg(F.min("seg_no").alias("seg_no"), F.count("*").cast("int").alias("merged"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_no", "line"))), lambda x: x["line"]), " ").alias("body"))
    return runs.filter("merged > 1").select("book_id", "doc_no", "seg_no", "merged", "body")


def cleaned_segments(segments: DataFrame, books: DataFrame) -> DataFrame:
    """segments with their texts cleaned: page artefacts out, characters repaired; texts that only were an artefact become empty."""
    stripped = stripped_text(segments, classified_lines(segments, books)).select("seg_id", "body")
    return segments.join(stripped, "seg_id", "left").withColumn("text", T.characters_fixed(F.coalesce("body", "text"))).drop("body")


def fixed_characters(segments: DataFrame) -> DataFrame:
    """(seg_id, body): texts that character repairs change."""
    rows = segments.select("seg_id", "text", T.characters_fixed(F.col("text")).alias("body"))
    return rows.filter("body <> text").select("seg_id", "body")
