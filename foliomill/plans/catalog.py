"""Registered queries of the core operators over one data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliomill.functions import languages
from foliomill.functions import text as T
from foliomill.operators import batching, cache, checker, cleanup, glossary, limits, markup, quality, search, segments, translate
from foliomill.plans.runtime import materialize
from foliomill.sources import epub
from foliomill.sources.tables import table

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _seg(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "segments")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return quality.pairs(_seg(spark, d), table(spark, d, "segment_cache"))


# --- segments and text forms


@query
def segment_lines(spark: SparkSession, d: str) -> DataFrame:
    return segments.lines(_seg(spark, d)).select("seg_id", "line_no", "n_lines", "line")


@query
def translatable(spark: SparkSession, d: str) -> DataFrame:
    return segments.translatable(_seg(spark, d)).select("seg_id")


@query
def plain_texts(spark: SparkSession, d: str) -> DataFrame:
    return _seg(spark, d).filter("text is not null").select("seg_id", T.plain(F.col("text")).alias("body"), T.plain_tight(F.col("text")).alias("tight"))


@query
def numbered_text(spark: SparkSession, d: str) -> DataFrame:
    return segments.numbered_text(_seg(spark, d))


@query
def plain_document(spark: SparkSession, d: str) -> DataFrame:
    return segments.plain_document(_seg(spark, d))


@query
def parse_markers(spark: SparkSession, d: str) -> DataFrame:
    return segments.parsed_markers(segments.numbered_text(_seg(spark, d).withColumn("text", T.collapsed(F.col("text")))))


@query
def bilingual_rows(spark: SparkSession, d: str) -> DataFrame:
    return segments.bilingual_rows(_seg(spark, d), table(spark, d, "segment_cache"))


@query
def tag_census(spark: SparkSession, d: str) -> DataFrame:
    return segments.placeholder_census(_seg(spark, d))


@query
def ordered_dedup(spark: SparkSession, d: str) -> DataFrame:
    return segments.first_seen(_seg(spark, d))


@query
def ncx_ids(spark: SparkSession, d: str) -> DataFrame:
    return segments.chapter_ids(_seg(spark, d))


# --- cleanup


@query
def running_heads(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.running_heads(segments.lines(_seg(spark, d)))


@query
def repeated_caps(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.repeated_caps(segments.lines(_seg(spark, d)))


def _page_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines as a scanned page has them: the book's title and a number over every document, and its author in capitals."""
    rows = table(spark, d, "documents").select("doc_id", "book_id", "chapter").join(table(spark, d, "books").select("book_id", "title", "author"), "book_id")
    line = F.explode(F.array_compact(F.array(F.concat_ws(" ", F.col("chapter").cast("string"), "title"), F.upper("author"), F.concat_ws(" ", F.lit("p."), "chapter"))))
    return rows.select(F.col("doc_id").alias("seg_id"), "book_id", F.lit(3).alias("n_lines"), line.alias("line"))


@query
def page_heads(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.running_heads(_page_lines(spark, d))


@query
def page_caps(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.repeated_caps(_page_lines(spark, d))


@query
def name_keys(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.name_keys(table(spark, d, "books"))


@query
def page_numbers(spark: SparkSession, d: str) -> DataFrame:
    return segments.lines(_seg(spark, d)).filter(T.is_page_number(F.col("line"))).select("seg_id", "line_no", "line")


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.classified_lines(_seg(spark, d), table(spark, d, "books"))


@query
def line_class(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).select("seg_id", "line_no", F.coalesce("kind", F.lit("text")).alias("kind"))


@query
def footnote_suspects(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.footnote_suspects(_classified(spark, d))


@query
def strip_lines(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.stripped_text(_seg(spark, d), _classified(spark, d))


@query
def join_broken(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.broken_lines_joined(_seg(spark, d))


@query
def merge_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.paragraphs_merged(_seg(spark, d))


@query
def char_fix(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.fixed_characters(_seg(spark, d))


@query
def cleanup_summary(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.issue_counts(table(spark, d, "cleanup_log"))


@query
def repairs_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.issues_by_kind(table(spark, d, "cleanup_log"))


# --- cache and batching


@query
def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    return cache.cache_hits(_seg(spark, d), table(spark, d, "segment_cache"))


def _pending(spark: SparkSession, d: str) -> DataFrame:
    return cache.pending_segments(_seg(spark, d), table(spark, d, "segment_cache"))


@query
def pending(spark: SparkSession, d: str) -> DataFrame:
    return _pending(spark, d).select("seg_id", "src_sha1")


@query
def cache_latest(spark: SparkSession, d: str) -> DataFrame:
    return cache.latest_entries(table(spark, d, "segment_cache")).select("cache_id", "book_id", "doc_no", "src_sha1")


@query
def answer_status(spark: SparkSession, d: str) -> DataFrame:
    return cache.answer_status(table(spark, d, "segment_cache"))


@query
def chunk_plan(spark: SparkSession, d: str) -> DataFrame:
    return batching.chunk_plan(_pending(spark, d), table(spark, d, "books"), table(spark, d, "run_config"))


@query
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = materialize(_pending(spark, d), "pending")
    books, config = table(spark, d, "books"), table(spark, d, "run_config")
    return batching.dry_run(rows, batching.chunk_plan(rows, books, config), books, config, glossary.name_words(_seg(spark, d)))


def _settings(spark: SparkSession, d: str) -> DataFrame:
    """(book_id, context_chars, part_chars) of each book."""
    return table(spark, d, "books").join(table(spark, d, "run_config"), "profile").select("book_id", "context_chars", F.col("segment_chars").alias("part_chars"))


def _units(spark: SparkSession, d: str) -> DataFrame:
    return batching.split_units(_seg(spark, d), _settings(spark, d))


@query
def split_units(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d)


@query
def rejoined_units(spark: SparkSession, d: str) -> DataFrame:
    return batching.rejoined(_units(spark, d)).select("seg_id", F.length(F.regexp_replace("body", r"[ \t\n\r\f]+", "")).alias("chars"))


@query
def context_pairs(spark: SparkSession, d: str) -> DataFrame:
    return batching.context_windows(_seg(spark, d))


def _starts(rows: DataFrame, plan: DataFrame) -> DataFrame:
    return rows.join(plan, "seg_id").groupBy("book_id", "doc_no", "chunk").agg(F.min("seg_no").alias("seg_no"))


def _contexts(spark: SparkSession, d: str, rows: DataFrame, plan: DataFrame) -> DataFrame:
    done = _pairs(spark, d).select("book_id", "doc_no", "seg_no", T.plain_tight(F.col("source")).alias("source"), T.plain_tight(F.col("translation")).alias("translation"))
    return batching.request_contexts(done, _seg(spark, d).filter("book_id is not null"), _starts(rows, plan), _settings(spark, d))


def _planned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = materialize(_pending(spark, d), "pending")
    return rows, materialize(batching.chunk_plan(rows, table(spark, d, "books"), table(spark, d, "run_config")), "plan")


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """Pending texts as requests: parts of long texts, the rules that stand in them, the passage before."""
    rows, plan = _planned(spark, d)
    units = _units(spark, d).join(rows.select("seg_id"), "seg_id", "left_semi")
    bodies = rows.select("seg_id", "book_id", T.plain_tight(F.col("text")).alias("body"))
    return translate.requests_of(units, plan, glossary.relevant_rules(bodies, _name_rules(spark, d)), _contexts(spark, d, rows, plan))


@query
def request_context(spark: SparkSession, d: str) -> DataFrame:
    """The passage before each planned request."""
    return _contexts(spark, d, *_planned(spark, d))


@query
def prompt_texts(spark: SparkSession, d: str) -> DataFrame:
    """What would be sent: glossary, passage before, numbered texts."""
    return translate.prompt_of(_requests(spark, d))


@query
def prompt_parts(spark: SparkSession, d: str) -> DataFrame:
    """How many texts, rules and pairs of context each prompt holds."""
    n = lambda pattern: F.regexp_count("prompt", F.lit(pattern))
    rules = F.when(F.col("prompt").startswith(translate.TERMS), F.size(F.split(F.substring_index("prompt", "\n\n", 1), "\n")) - 1).otherwise(0)
    return prompt_texts(spark, d).select("book_id", "doc_no", "chunk", rules.alias("rules"), n(r"(?m)^SOURCE: ").alias("pairs"))


@query
def echo_translation(spark: SparkSession, d: str) -> DataFrame:
    """Pending texts through the whole request path: split, planned, asked for in batches, put together."""
    made = translate.translated_units(_requests(spark, d), translate.echo)
    whole = batching.rejoined(made.withColumnRenamed("translation", "unit"))
    return whole.select("seg_id", F.regexp_replace("body", r"[ \t\n\r\f]+", "").alias("body"))


@query
def checker_diff(spark: SparkSession, d: str) -> DataFrame:
    """Log entries as a checker's reports: the messages of the first and the second half of the year, compared."""
    log = table(spark, d, "cleanup_log").select("book_id", "logged_at", F.regexp_extract("entry", r"^([^#:]*)", 1).alias("p"), F.regexp_extract("entry", r"^[^:]*: ([A-Za-z]+ [A-Za-z]+)", 1).alias("m"), (F.col("doc_no") % 3).alias("k"))
    severity = F.when(F.col("k") == 0, "ERROR").when(F.col("k") == 1, "WARNING").otherwise("INFO")
    item = F.struct(F.col("m").alias("ID"), severity.alias("severity"), F.concat("m", F.lit("; expected "), "p").alias("message"), F.array(F.struct(F.col("p").alias("path"), F.lit(1).alias("line"))).alias("locations"))
    part = lambda late: checker.messages(log.filter((F.month("logged_at") > 6) == late).groupBy("book_id").agg(F.to_json(F.struct(F.collect_list(item).alias("messages"))).alias("json")))
    return checker.new_problems(part(False), part(True))


# --- terms


@query
def term_candidates(spark: SparkSession, d: str) -> DataFrame:
    return glossary.term_batches(glossary.term_candidates(_seg(spark, d)))


@query
def name_words(spark: SparkSession, d: str) -> DataFrame:
    return glossary.name_words(_seg(spark, d))


def _name_rules(spark: SparkSession, d: str) -> DataFrame:
    """A rule per recurring name of a book: names stay as they are."""
    words = glossary.name_words(_seg(spark, d)).filter("uses >= 3")
    order = F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc("uses"), "word"))
    return words.select("book_id", F.col("word").alias("source"), F.array("word").alias("renderings"), F.concat_ws(" = ", "word", "word").alias("line"), order.alias("ord"))


def _long_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules of several words and with a rendering in small letters: each name and the word after it."""
    after = F.regexp_extract_all(T.plain_tight(F.col("text")), F.lit(r"[a-z],? ([A-Z][a-z]+ [a-z]+)"), F.lit(1))
    words = _seg(spark, d).filter("text is not null").select("book_id", F.explode(after).alias("source")).groupBy("book_id", "source").agg(F.count("*").alias("uses")).filter("uses >= 2")
    return words.select("book_id", "source", F.array(F.lower("source"), F.col("source")).alias("renderings"), F.concat_ws(" = ", "source", F.lower("source")).alias("line"), F.lit(0).alias("ord"))


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    return segments.latest_segments(_seg(spark, d)).filter(T.is_translatable(F.col("text"))).select("seg_id", "book_id", T.plain_tight(F.col("text")).alias("body"))


@query
def relevant_terms(spark: SparkSession, d: str) -> DataFrame:
    return glossary.relevant_rules(_bodies(spark, d), _name_rules(spark, d)).select("seg_id", "source").distinct()


@query
def relevant_phrases(spark: SparkSession, d: str) -> DataFrame:
    return glossary.relevant_rules(_bodies(spark, d), _long_rules(spark, d)).select("seg_id", "source").distinct()


@query
def phrase_cases(spark: SparkSession, d: str) -> DataFrame:
    """Rules with a rendering in small letters, against texts that hold them as they are."""
    rows = _bodies(spark, d).withColumn("translation", F.col("body"))
    return glossary.violations(rows, _long_rules(spark, d))


@query
def prompt_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The rules of each text, in the order of their lines, not of their uses."""
    rules = _name_rules(spark, d).withColumn("ord", F.lit(0))
    return glossary.rule_blocks(glossary.relevant_rules(_bodies(spark, d), rules))


def _answered(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("seg_id", "book_id", T.plain_tight(F.col("source")).alias("body"), T.plain_tight(F.col("translation")).alias("translation"))


@query
def missing_names(spark: SparkSession, d: str) -> DataFrame:
    return glossary.missing_names(_answered(spark, d), _name_rules(spark, d))


@query
def violations(spark: SparkSession, d: str) -> DataFrame:
    return glossary.violations(_answered(spark, d), _name_rules(spark, d))


@query
def names_report(spark: SparkSession, d: str) -> DataFrame:
    return quality.names_report(glossary.missing_names(_answered(spark, d), _name_rules(spark, d)))


def _rule(source: str | Column, *targets: Column) -> Column:
    return F.when(F.col(source).isNotNull(), F.concat(F.col(source), F.lit(" = "), F.concat_ws(" | ", *targets)))


def _base_texts(spark: SparkSession, d: str) -> DataFrame:
    note = F.when(F.col("author").isNotNull(), F.concat(F.col("author"), F.lit("="), F.col("author"), F.lit("  # who wrote it")))
    return table(spark, d, "books").select("book_id", F.concat_ws("\n", F.lit("# terms"), F.lit(""), _rule("title", F.col("title"), F.col("series")), note, F.lit("no rule here"), _rule("author", F.upper(F.substring("author", 1, 1)), F.col("author"))).alias("body"))


def _new_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "books").select("book_id", F.concat_ws("\n", _rule("title", F.col("title")), _rule("path", F.col("profile"), F.col("lang"))).alias("body"))


@query
def parse_glossary(spark: SparkSession, d: str) -> DataFrame:
    return glossary.parsed_rules(_base_texts(spark, d)).select("book_id", "source", F.concat_ws("|", "renderings").alias("targets"), "line", "ord")


@query
def glossary_merge(spark: SparkSession, d: str) -> DataFrame:
    both = glossary.merged_rules(glossary.parsed_rules(_base_texts(spark, d)), glossary.parsed_rules(_new_texts(spark, d)))
    return both.select("book_id", "source", F.concat_ws("|", "renderings").alias("targets"), "change", "ord")


@query
def series_terms(spark: SparkSession, d: str) -> DataFrame:
    """Names of all books of a series, as its rules, that stand in each of them."""
    books = table(spark, d, "books")
    rules = _name_rules(spark, d).join(books.filter("series is not null").select("book_id", "series"), "book_id").groupBy("series", "source")
    return glossary.inherited_rules(_bodies(spark, d), books, rules.agg(F.min("renderings").alias("renderings"), F.min("line").alias("line"), F.min("ord").alias("ord")))


@query
def new_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Names of a book that its series has no rule for."""
    words = glossary.name_words(_seg(spark, d)).withColumnRenamed("word", "term")
    return glossary.unknown_terms(words, series_terms(spark, d))


@query
def glossary_replies(spark: SparkSession, d: str) -> DataFrame:
    """The rule lines of a model's replies, fenced and commented."""
    log = table(spark, d, "cleanup_log")
    reply = F.concat(F.lit("```text\n# terms\n  "), F.replace("entry", F.lit(": "), F.lit(" = ")), F.lit("\nno rule\n#x = y\n"), F.col("entry"), F.lit("\n``` "))
    return log.select("log_id", T.reply_rules(reply).alias("rules"))


@query
def metadata_keys(spark: SparkSession, d: str) -> DataFrame:
    """Cache keys of titles, and whether a text may be translated as a description."""
    books = table(spark, d, "books").filter("title is not null")
    return books.select("book_id", T.text_key(F.concat(F.lit("title\n"), "title")).alias("key"), T.is_description(F.col("title")).alias("plain"), T.is_description(F.concat(F.lit("<b>"), "title")).alias("marked"))


@query
def label_translations(spark: SparkSession, d: str) -> DataFrame:
    """Navigation labels with the translation their document's cache has, else as they are."""
    labels = segments.latest_segments(_seg(spark, d)).filter(F.col("tag").rlike("^h[1-3]$") & (T.collapsed(F.col("text")) != "")).select("book_id", "doc_no", "seg_no", F.col("text").alias("label"), T.text_key(F.col("text")).alias("src_sha1"))
    known = cache.latest_entries(table(spark, d, "segment_cache")).select("book_id", "doc_no", "src_sha1", "translation")
    return labels.join(known, ["book_id", "doc_no", "src_sha1"], "left").select("book_id", "doc_no", "seg_no", F.coalesce("translation", "label").alias("label"))

@query
def glossary_override(spark: SparkSession, d: str) -> DataFrame:
    both = glossary.overriding(glossary.parsed_rules(_base_texts(spark, d)), glossary.parsed_rules(_new_texts(spark, d)))
    return both.select("book_id", "source", F.concat_ws("|", "renderings").alias("targets"), "layer")


@query
def known_terms_removed(spark: SparkSession, d: str) -> DataFrame:
    words = glossary.name_words(_seg(spark, d)).withColumnRenamed("word", "term")
    last = table(spark, d, "books").select("book_id", F.element_at(F.split("author", " "), 1).alias("source"))
    return glossary.unknown_terms(words, last)


# --- quality


@query
def completeness(spark: SparkSession, d: str) -> DataFrame:
    return quality.incomplete(_pairs(spark, d))


@query
def unchanged(spark: SparkSession, d: str) -> DataFrame:
    return quality.unchanged(_pairs(spark, d))


@query
def placeholder_check(spark: SparkSession, d: str) -> DataFrame:
    return quality.placeholder_problems(_pairs(spark, d))


@query
def repaired_answers(spark: SparkSession, d: str) -> DataFrame:
    return quality.repaired_answers(_pairs(spark, d))


@query
def tag_count_diff(spark: SparkSession, d: str) -> DataFrame:
    return quality.tag_count_changes(_pairs(spark, d))


@query
def kept_answers(spark: SparkSession, d: str) -> DataFrame:
    """Rewritten entries: the later answer if it is no worse than the first."""
    rows = table(spark, d, "segment_cache").filter("translation is not null")
    order = F.struct("written_at", "cache_id", "translation")
    two = rows.groupBy("book_id", "doc_no", "src_sha1").agg(F.min(order).alias("a"), F.max(order).alias("b")).filter("a.cache_id <> b.cache_id")
    source = _seg(spark, d).filter("text is not null").select("book_id", "doc_no", T.text_key(F.col("text")).alias("src_sha1"), F.col("text").alias("source")).distinct()
    both = two.join(source, ["book_id", "doc_no", "src_sha1"]).select("source", F.col("a.cache_id").alias("first_id"), F.col("b.cache_id").alias("last_id"), F.col("a.translation").alias("old"), F.col("b.translation").alias("new"))
    n = lambda c: F.regexp_count(c, F.lit(T.TOKEN))
    miss = lambda c: F.abs(n(F.col(c)) - n(F.col("source")))
    both = both.withColumn("old_breaks", miss("old") + 1).withColumn("new_breaks", miss("new")).withColumn("damaged", n(F.col("new")) < n(F.col("source")))
    return cache.kept_answers(both).select("first_id", "last_id", "answer")


@query
def report_diff(spark: SparkSession, d: str) -> DataFrame:
    return quality.report_difference(table(spark, d, "run_stats"))


@query
def report_diff_books(spark: SparkSession, d: str) -> DataFrame:
    """The first and the last run of each book, whatever document they were over."""
    return quality.report_difference(table(spark, d, "run_stats").withColumn("doc_no", F.lit(0)))


@query
def run_totals(spark: SparkSession, d: str) -> DataFrame:
    return quality.run_totals(table(spark, d, "run_stats"))


def _name_issues(spark: SparkSession, d: str) -> DataFrame:
    return quality.placed_issues(glossary.violations(_answered(spark, d), _name_rules(spark, d)), _seg(spark, d))


@query
def names_files(spark: SparkSession, d: str) -> DataFrame:
    return quality.names_files(_name_issues(spark, d))


def _reports(spark: SparkSession, d: str) -> DataFrame:
    seg, documents = _seg(spark, d), markup.documents_of(_seg(spark, d))
    warnings = quality.placed_issues(quality.repaired_answers(_pairs(spark, d)).withColumnRenamed("problems", "problem"), seg)
    repairs = markup.repaired_documents(documents).groupBy("book_id", "kind").agg(F.sum("fixes").alias("fixes"))
    malformed = markup.document_segments(documents).filter("recovered").select("book_id", F.concat(F.lit("ch"), "doc_no").alias("item")).distinct()
    validation = epub_problems(spark, d).join(table(spark, d, "books").select("book_id", "path"), "path")
    return quality.book_reports(table(spark, d, "run_stats"), table(spark, d, "books"), table(spark, d, "run_config"), warnings, _name_rules(spark, d), _name_issues(spark, d), repairs, malformed, validation, checker_diff(spark, d))


@query
def run_reports(spark: SparkSession, d: str) -> DataFrame:
    """The report of each book as JSON."""
    return quality.report_json(_reports(spark, d))


@query
def report_counts(spark: SparkSession, d: str) -> DataFrame:
    """The report of each book, its lists as their lengths."""
    sizes = [F.size(c).alias(c) for c in ("possibly_untranslated", "possibly_incomplete", "inline_tag_warnings", "name_consistency_issues", "validation_problems")]
    return _reports(spark, d).select("book_id", "output", "model", "target_language", "series", "documents", "segments", "translated_segments", "api_requests_this_run", "glossary_terms", *sizes, F.col("epubcheck.new_errors").alias("new_errors"))


@query
def issue_list(spark: SparkSession, d: str) -> DataFrame:
    return quality.run_issues(table(spark, d, "run_stats")).select("run_id", "kind", "path", "seg_no", "message")


@query
def documents_without_runs(spark: SparkSession, d: str) -> DataFrame:
    return quality.documents_without_runs(_seg(spark, d), table(spark, d, "run_stats"))


@query
def documents_without_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents none of whose runs reports how many requests it made."""
    return quality.documents_without_runs(_seg(spark, d), table(spark, d, "run_stats").filter("requests is not null"))


@query
def resource_hash(spark: SparkSession, d: str) -> DataFrame:
    return quality.changed_resources(_seg(spark, d))


# --- scalar functions over books and configuration


@query
def slugs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "books")
    stem = F.regexp_replace(F.regexp_replace("path", "^.*/", ""), "[.][^.]*$", "")
    series = F.when(F.col("series").isNotNull(), F.concat(F.lit("series/"), T.slug(F.lower("series")), F.lit("/"), F.col("lang")))
    return rows.select("book_id", T.slug(F.col("title")).alias("slug"), series.alias("series_path"), F.concat(stem, F.lit("_"), F.upper("lang"), F.lit("_bilingual.epub")).alias("output"))


@query
def derived_uid(spark: SparkSession, d: str) -> DataFrame:
    old = F.when(F.col("book_id") % 2 == 0, F.concat(F.lit("urn:uuid:"), F.col("path"))).otherwise(F.col("path"))
    return table(spark, d, "books").select("book_id", T.derived_uid(old, F.col("lang")).alias("uid"))


@query
def language_resolve(spark: SparkSession, d: str) -> DataFrame:
    lang = table(spark, d, "books").select(F.col("lang").alias("v")).union(table(spark, d, "segment_cache").select("target_lang")).distinct()
    made = lang.select(F.explode(F.array("v", F.concat("v", F.lit("_XX")), F.upper("v"), F.concat(F.lit("  "), "v"), F.lit("Castellano"), F.lit("klingon"), F.lit("PT_br"))).alias("value")).distinct()
    code, name = languages.resolved(F.col("value"))
    return made.filter("value is not null").select("value", code.alias("code"), name.alias("name"))


@query
def name_search(spark: SparkSession, d: str) -> DataFrame:
    """Books found by path, by file name and by words of the title, asked for once for every book.

    An exact path wins, then an exact name, else all the words must stand in the stem.
    """
    books = table(spark, d, "books")
    name = F.regexp_replace("path", "^.*/", "")
    words = F.split("title", " ")
    texts = F.array("path", F.upper(name), F.concat_ws(" ", F.element_at(words, 1), F.element_at(words, -1)), F.substring(F.element_at(words, -1), 1, 4))
    asked = books.filter("title is not null").select(F.col("book_id").alias("asked"), F.posexplode(texts).alias("nth", "q"))
    return search.found_books(books.select("book_id", "path"), asked)


@query
def scalar_texts(spark: SparkSession, d: str) -> DataFrame:
    """Text functions over log entries and cache answers."""
    log = table(spark, d, "cleanup_log").select(F.col("log_id").alias("id"), F.col("entry").alias("t"))
    return log.select("id", T.tail_of(F.col("t"), 40).alias("tail"), T.redacted(F.col("t"), ["OEBPS", "xhtml"]).alias("redacted"), T.without_thoughts(F.concat(F.lit("<think>a\nb</think> "), F.col("t"))).alias("answer"), T.title_reply(F.concat(F.lit("\n  Title: “"), F.substring("t", 1, 30), F.lit("”\nmore"))).alias("title"), T.message_key(F.concat(F.col("t"), F.lit("; expected x\ny"))).alias("key"), T.retry_delay(F.concat(F.lit("retryDelay: "), F.regexp_extract("t", "#([0-9]+)", 1), F.lit("s"))).alias("delay"))


# --- limits


@query
def sliding_rate(spark: SparkSession, d: str) -> DataFrame:
    return limits.rate_breaches(table(spark, d, "events"), 2, 21_600)


@query
def daily_quota(spark: SparkSession, d: str) -> DataFrame:
    return limits.daily_use(table(spark, d, "events"), 1)


@query
def admitted_calls(spark: SparkSession, d: str) -> DataFrame:
    rows = limits.admitted(table(spark, d, "events"), 2, 21_600)
    return rows.select("event_id", "user_id", F.unix_micros("start").alias("start_us"), (F.unix_micros("start") - F.unix_micros("ts")).alias("waited_us"))


def _streamed(spark: SparkSession, d: str, build, name: str, mode: str) -> DataFrame:
    """Runs a stream over the events file to its end and returns its table."""
    import uuid

    from foliomill.plans.runtime import shared_dir
    from foliomill.streaming.limits import request_stream

    base, out = f"{shared_dir(spark)}/foliomill/{name}-{uuid.uuid4().hex}", build(request_stream(spark, f"{d}/events.parquet*", table(spark, d, "events").schema))
    sink = out.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint").outputMode(mode)
    if mode == "append":
        sink.format("parquet").option("path", f"{base}/rows").start().awaitTermination()
        return spark.read.schema(out.schema).parquet(f"{base}/rows")
    # a batch writes its updates under its own number, so that one that is run again replaces them
    sink.foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{base}/rows/batch={n}")).start().awaitTermination()
    return spark.read.schema(out.schema.add("batch", "long")).parquet(f"{base}/rows")


@query
def stream_daily_quota(spark: SparkSession, d: str) -> DataFrame:
    from foliomill.streaming import limits as stream_limits

    return stream_limits.merged_updates(_streamed(spark, d, stream_limits.daily_use, "daily", "update"), "user_id", "day")


@query
def stream_sliding_rate(spark: SparkSession, d: str) -> DataFrame:
    from foliomill.streaming import limits as stream_limits

    return _streamed(spark, d, lambda s: stream_limits.rate_breaches(s, 2, 21_600), "rate", "append")


# --- documents and packages


@query
def document_segments(spark: SparkSession, d: str) -> DataFrame:
    return markup.document_segments(markup.documents_of(_seg(spark, d))).select("book_id", "doc_no", "seg_no", "tag", "text", "recovered")


@query
def document_repairs(spark: SparkSession, d: str) -> DataFrame:
    return markup.repaired_documents(markup.documents_of(_seg(spark, d)))


@query
def translated_documents(spark: SparkSession, d: str) -> DataFrame:
    answers = _pairs(spark, d).select("book_id", "doc_no", "seg_no", "translation")
    return markup.translated_documents(markup.documents_of(_seg(spark, d)), answers, "es", bilingual=True)


def _packages(spark: SparkSession, d: str) -> DataFrame:
    return epub.built_packages(markup.documents_of(_seg(spark, d)), table(spark, d, "books"))


def _at(documents: DataFrame, books: DataFrame) -> DataFrame:
    """(path, item_path, html): where documents stand in the packages of ``_packages``."""
    name = F.concat(F.lit("OEBPS/ch"), F.lpad(F.col("doc_no").cast("string"), 5, "0"), F.lit(".xhtml"))
    return documents.join(books.select("book_id", "path"), "book_id").select("path", name.alias("item_path"), "html")


@query
def epub_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Books written as packages and read again: their documents in reading order."""
    return epub.content_documents(materialize(epub.packages(_packages(spark, d)), "opened"))


@query
def epub_metadata(spark: SparkSession, d: str) -> DataFrame:
    return epub.packages(_packages(spark, d)).select("path", "title", "author", "lang", "series", "version", "identifier", F.size("spine").alias("documents"))


@query
def epub_translated(spark: SparkSession, d: str) -> DataFrame:
    """Packages from book to book: cached answers written into the documents, metadata rewritten, read again."""
    books = table(spark, d, "books")
    answers = _pairs(spark, d).select("book_id", "doc_no", "seg_no", "translation")
    documents = markup.translated_documents(markup.documents_of(_seg(spark, d)), answers, "es")
    files = materialize(_packages(spark, d), "packages")
    meta = books.select("path", F.lit("es").alias("lang"), T.derived_uid(F.concat(F.lit("book-"), "book_id"), F.lit("es")).alias("uid"), T.capitals(F.col("title")).alias("title"), F.lit(None).cast("map<string,string>").alias("labels"))
    made = epub.rewritten_packages(files, _at(documents, books), meta)
    return epub.packages(made).select("path", "title", "lang", "identifier", F.size("spine").alias("documents"))


@query
def epub_problems(spark: SparkSession, d: str) -> DataFrame:
    """Packages without their first document and with a picture more in the others, against the whole ones.

    Texts whose placeholders don't match make documents that are no XML in both; these are left out here.
    """
    documents = markup.documents_of(_seg(spark, d))
    first = documents.groupBy("book_id").agg(F.min("doc_no").alias("doc_no"))
    less = documents.join(first, ["book_id", "doc_no"], "left_anti").withColumn("html", F.replace("html", F.lit("</body>"), F.lit('<p><img src="x.png" alt=""/></p></body>')))
    books = table(spark, d, "books")
    whole = materialize(_packages(spark, d), "packages").join(books.join(less.select("book_id"), "book_id", "left_semi").select("path"), "path", "left_semi")
    return epub.package_problems(epub.built_packages(less, books), whole).filter(~F.col("problem").endswith("is not well-formed"))


@query
def epub_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Packages of cleaned texts, without translation: their documents."""
    books = table(spark, d, "books")
    documents = markup.documents_of(cleanup.cleaned_segments(_seg(spark, d), books))
    made = epub.built_packages(documents, books.withColumn("path", F.regexp_replace("path", "[.]epub$", "_CLEAN.epub")))
    opened = epub.content_documents(materialize(epub.packages(made), "opened"))
    return epub.document_bytes(made, opened).select("path", "item_path", F.length("data").alias("bytes"))
