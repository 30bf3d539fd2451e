"""Terms: candidates, glossary rules, relevance, violations, merging."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill.functions import text as T

# Words that are no terms by themselves, capitalised or not.
STOPWORDS = frozenset(
    """I A An The He She It They We You Me Him Her Us Them His Hers Its Our Their Your My Mine This That These Those
    There Here What When Where Why How Who Whom Which Whose Then Now Yes No Not Oh Ah Um Uh Hey Well So But And Or
    Nor For Yet If As At In On Of To By Up With From Into Onto Over Under After Before Once Only Just Even Still
    All Any Some Each Every Both Either Neither One Two Three Maybe Perhaps Please Sorry Okay OK Good Very Really
    Indeed Is Are Was Were Be Been Do Does Did Don't Can't Won't Let Let's Get Got Come Go Look Tell See Say Said
    Chapter Part Book Prologue Epilogue Contents Mr Mrs Ms Dr Sir Madam""".split()
)
# Characters after which a capital proves nothing.
INITIAL = "(?:^|[.!?¿¡…:;«»“”\"‘’'()\\[\\]•—–-])[ \t\n\r\f]*$"
#: Terms of a book's list, and terms asked for at a time.
TERMS, BATCH = 300, 150

# What a name's words look like, the small words that may join two of them, endings that are no name's.
NAME_WORD = r"[A-Z][A-Za-z'’\-]*[A-Za-z]"
JOINERS = "of|from|the|de|del|la"
POSSESSIVE, SHORT_FORM = r"['’]s$", r"(?i)['’](?:m|d|ll|ve|re|t|s)$"
#: Joiners between two words of a name, at most; characters shown around an example.
MOST_JOINERS, AROUND = 2, 70

_NAME_WORD = re.compile(NAME_WORD)
_JOINED = re.compile(rf"(?:\s+(?:{JOINERS})){{0,{MOST_JOINERS}}}\s+")
_INITIAL = re.compile(INITIAL)


def sentence_initial(text: str, at: int) -> bool:
    """Whether the four characters before a place are blank or end a sentence."""
    return bool(_INITIAL.search(text[max(0, at - 4) : at]))


def _is_weak(word: str) -> bool:
    return word in STOPWORDS or word[0].islower()


def term_uses(text: str) -> list[tuple[str, bool, str, int]]:
    """(term, inside a sentence, example, position) of the names of a text.

    Capitalised words are found one by one; where only joiners stand between
    two of them, they are linked; each chain, without weak words at its ends,
    is a name.
    """
    spans = [m.span() for m in _NAME_WORD.finditer(text)]
    linked = [_JOINED.fullmatch(text, a[1], b[0]) is not None for a, b in zip(spans, spans[1:])]
    out = []
    for first, last in _chains(linked, len(spans)):
        whole = text[spans[first][0] : spans[last][1]]
        words = re.sub(POSSESSIVE, "", whole).split()
        strong = [i for i, w in enumerate(words) if not _is_weak(w)]
        if not strong or re.search(SHORT_FORM, words[-1]):
            continue
        term = " ".join(words[strong[0] : strong[-1] + 1])
        if len(term) > 1:
            at = spans[first][0] + whole.find(words[strong[0]])
            out.append((term, not sentence_initial(text, at), " ".join(text[max(0, at - AROUND) : at + len(term) + AROUND].split()), at))
    return out


def _chains(linked: list[bool], n: int) -> Iterator[tuple[int, int]]:
    """(first, last) of the maximal stretches of 0..n-1 whose neighbours are linked."""
    breaks = [i for i, x in enumerate(linked) if not x]
    yield from zip([0, *(i + 1 for i in breaks)], [*breaks, n - 1]) if n else ()


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("book_id", pa.int64()), ("doc_no", pa.int32()), ("seg_no", pa.int32()), ("at", pa.int32()), ("term", pa.string()), ("mid", pa.bool_()), ("example", pa.string())])
    for batch in batches:
        rows = [(b, d, s, at, t, mid, ex) for b, d, s, text in zip(*(c.to_pylist() for c in batch.columns)) for t, mid, ex, at in term_uses(text)]
        cols = list(zip(*rows)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)


def term_candidates(segments: DataFrame, limit: int = TERMS) -> DataFrame:
    """(book_id, term, uses, example, rank): terms used twice, once inside a sentence; the first wins a tie."""
    rows = segments.filter(T.is_translatable(F.col("text"))).select("book_id", "doc_no", "seg_no", T.plain_tight(F.col("text")).alias("t"))
    uses = rows.mapInArrow(_emit, "book_id long, doc_no int, seg_no int, at int, term string, mid boolean, example string")
    place = F.struct("doc_no", "seg_no", "at")
    terms = uses.groupBy("book_id", "term").agg(F.count("*").alias("uses"), F.count_if("mid").alias("inside"), F.min(place).alias("first"), F.min(F.when(F.col("mid"), F.struct("doc_no", "seg_no", "at", "example"))).alias("ex"))
    terms = terms.filter("uses >= 2 and inside >= 1")
    rank = F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc("uses"), "first", "term"))
    return terms.withColumn("rank", rank).filter(F.col("rank") <= limit).select("book_id", "term", "uses", F.col("ex.example").alias("example"), "rank")


def name_words(segments: DataFrame) -> DataFrame:
    """(book_id, word, uses): capitalised words that follow a lower-case word: the SQL form of candidates."""
    words = F.regexp_extract_all(T.plain_tight(F.col("text")), F.lit(r"[a-z],? ([A-Z][a-z]+)"), F.lit(1))
    rows = segments.filter("text is not null").select("book_id", F.explode(words).alias("word")).filter(~F.col("word").isin(*sorted(STOPWORDS)))
    return rows.groupBy("book_id", "word").agg(F.count("*").alias("uses")).filter("uses >= 2")


def term_batches(candidates: DataFrame) -> DataFrame:
    """candidates with ``batch``: which request of BATCH terms asks for each."""
    return candidates.withColumn("batch", F.floor((F.col("rank") - 1) / BATCH))


def parsed_rules(texts: DataFrame) -> DataFrame:
    """(book_id, source, renderings, line, ord) of glossary texts (book_id, body), a rule a line.

    ``source = rendering | rendering  # note``; blank lines, notes and lines
    without ``=`` are skipped; the last rule of a source counts, at the place
    of its first.
    """
    rows = texts.select("book_id", F.posexplode(F.split("body", "\r?\n")).alias("pos", "raw")).withColumn("line", T.trimmed(F.col("raw")))
    rows = rows.filter((F.col("line") != "") & ~F.col("line").startswith("#") & F.contains("line", F.lit("=")))
    rule = F.regexp_replace("line", "#.*$", "")
    rows = rows.select("book_id", "pos", "line", T.trimmed(F.regexp_replace(rule, "=.*$", "")).alias("source"), F.regexp_replace(rule, "^[^=]*=?", "").alias("target"))
    options = F.filter(F.transform(F.split("target", r"\|"), T.trimmed), lambda x: x != "")
    rows = rows.withColumn("renderings", options).filter((F.col("source") != "") & (F.size("renderings") > 0))
    last = F.max_by(F.struct("renderings", "line"), "pos").alias("r")
    return rows.groupBy("book_id", "source").agg(last, F.min("pos").cast("int").alias("ord")).select("book_id", "source", F.col("r.renderings").alias("renderings"), F.col("r.line").alias("line"), "ord")


def overriding(*rules: DataFrame) -> DataFrame:
    """Rules of several glossaries, the later one where both have a source."""
    tagged = [r.withColumn("layer", F.lit(i)) for i, r in enumerate(rules)]
    rows = tagged[0]
    for r in tagged[1:]:
        rows = rows.unionByName(r)
    best = F.max_by(F.struct("renderings", "line", "layer"), "layer").alias("r")
    return rows.groupBy("book_id", "source").agg(best, F.min(F.struct("layer", "ord")).alias("o")).select("book_id", "source", F.col("r.renderings").alias("renderings"), F.col("r.line").alias("line"), F.col("r.layer").alias("layer"))


def merged_rules(base: DataFrame, new: DataFrame) -> DataFrame:
    """(book_id, source, renderings, line, change, ord): full outer join, the new rule wins; added, changed or kept.

    ``ord`` is the place in the merged list, by the source in small letters.
    """
    b = base.select("book_id", "source", F.col("renderings").alias("b_r"), F.col("line").alias("b_l"))
    n = new.select("book_id", "source", F.col("renderings").alias("n_r"), F.col("line").alias("n_l"))
    change = F.when(F.col("b_r").isNull(), "added").when(F.col("n_r").isNotNull() & (F.col("b_r") != F.col("n_r")), "changed").otherwise("kept")
    return b.join(n, ["book_id", "source"], "full").select("book_id", "source", F.coalesce("n_r", "b_r").alias("renderings"), F.coalesce("n_l", "b_l").alias("line"), change.alias("change")).withColumn("ord", F.row_number().over(Window.partitionBy("book_id").orderBy(F.lower("source"), "source")))


def inherited_rules(bodies: DataFrame, books: DataFrame, series_rules: DataFrame) -> DataFrame:
    """(book_id, source, line): the rules of a book's series whose terms stand in the book.

    bodies (seg_id, book_id, body), series_rules (series, source, renderings, line, ord).
    """
    rules = books.select("book_id", "series").filter("series is not null").join(series_rules, "series").drop("series")
    return relevant_rules(bodies, rules).select("book_id", "source", "line").distinct()


def unknown_terms(candidates: DataFrame, rules: DataFrame) -> DataFrame:
    """Candidates the series' rules don't cover yet."""
    return candidates.join(rules.select("book_id", F.col("source").alias("term")), ["book_id", "term"], "left_anti")


def bounded(term: Column) -> Column:
    """Pattern of a term as whole words; straight and curly apostrophes are the same."""
    body = F.regexp_replace(F.replace(term, F.lit("’"), F.lit("'")), r"([.\\+*?\[^\]$(){}=!<>|:\-#/])", r"\\$1")
    return F.concat(F.lit(r"(?<![\p{L}\p{N}_'’])"), F.replace(body, F.lit("'"), F.lit("['’]")), F.lit(r"(?![\p{L}\p{N}_])"))


_PLAIN_WORD = r"[\p{L}\p{N}_]+"


def _rule_words(text: Column) -> Column:
    """The words of a text, each as a rule's first word: with an apostrophe where one stands before it."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"(?<![\p{{L}}\p{{N}}_])['’]?{_PLAIN_WORD}|(?<=[\p{{L}}\p{{N}}_])['’]{_PLAIN_WORD}"), F.lit(0)), lambda w: F.replace(w, F.lit("’"), F.lit("'"))))


def relevant_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(rows' columns, source, renderings, line, ord): the rules whose term stands in ``body``.

    The theta join is an equi-join on the term's first word, without the texts:
    only ``seg_id`` and words are exploded.  A term of one word is met by that;
    longer ones are tested in the text, which is fetched for the hits alone.
    ``seg_id`` is unique in ``rows``; a rule without letter or digit meets nothing.
    """
    first = rules.withColumn("w", F.replace(F.regexp_extract("source", rf"['’]?{_PLAIN_WORD}", 0), F.lit("’"), F.lit("'"))).filter("w <> ''")
    words = rows.select("seg_id", "book_id", F.explode(_rule_words(F.col("body"))).alias("w"))
    hits = words.join(first, ["book_id", "w"]).drop("book_id", "w")
    own = F.replace(F.col("source"), F.lit("’"), F.lit("'"))
    holds = F.contains(F.replace(F.col("body"), F.lit("’"), F.lit("'")), own) & F.regexp_like(F.col("body"), bounded(F.col("source")))
    return rows.join(hits, "seg_id").filter(F.when(F.col("source").rlike(rf"^{_PLAIN_WORD}$"), True).otherwise(holds)).select(*rows.columns, "source", "renderings", "line", "ord")


def rule_blocks(relevant: DataFrame) -> DataFrame:
    """(seg_id, block): the lines of a text's rules, in the glossary's order."""
    return relevant.groupBy("seg_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("block"))


# A place after a sentence's end or at the start, by the four characters before it; no longer than a lookbehind may be.
_AFTER_END = "(?<=(?:^|[.!?¿¡…:;«»“”\"‘’'()\\[\\]•—–-])[ \t\n\r\f]{0,3}|[ \t\n\r\f]{4})"


def _uses(text: Column, word: Column, initial: bool = False) -> Column:
    """How often a word stands in a text; the costly pattern only where the word occurs at all."""
    pattern = F.concat(F.lit(_AFTER_END), bounded(word)) if initial else bounded(word)
    same = lambda c: F.replace(c, F.lit("’"), F.lit("'"))
    return F.when(F.contains(same(text), same(word)), F.regexp_count(text, pattern)).otherwise(0)


def rule_problems(body: Column, translation: Column, term: Column, renderings: Column) -> Column:
    """How a translation breaks one rule: an array of messages, from counts in both texts.

    A rendering in small letters may be capitalised only where a sentence
    starts; one with a capital is expected with it, unless small forms can be
    ordinary words (there are more of both than uses in the source).
    """

    def counted(r: Column) -> Column:
        head = F.left(r, F.lit(1))
        small = (head == F.lower(head)) & (head != F.upper(head))
        other = F.concat(F.when(small, F.upper(head)).otherwise(F.lower(head)), F.substring(r, 2, 1 << 30))
        cased = (F.length(r) > 1) & (F.lower(r) != F.upper(r))
        return F.struct(r.alias("r"), other.alias("other"), _uses(translation, r).alias("right"), (cased & small).alias("small"), (cased & ~small).alias("capital"), F.when(cased, _uses(translation, other)).otherwise(0).alias("swapped"), F.when(cased & small, _uses(translation, other, True)).otherwise(0).alias("initial"))

    def judged(cases: Column) -> Column:
        wrong = lambda c: (c["small"] & (c["swapped"] > c["initial"])) | (c["capital"] & (c["swapped"] > 0) & (c["swapped"] + c["right"] <= _uses(body, term)))
        bad = F.transform(F.filter(cases, wrong), lambda c: F.concat(term, F.lit(": '"), c["other"], F.lit("' should be '"), c["r"], F.lit("'")))
        met = F.exists(cases, lambda c: (c["right"] > 0) | (c["initial"] > 0))
        return F.when(F.size(bad) > 0, bad).when(met, F.array().cast("array<string>")).otherwise(F.array(F.concat(term, F.lit(": expected "), F.array_join(renderings, " | "))))

    return T.let(F.transform(renderings, counted), judged)


def violations(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """(seg_id, source, problem) of (seg_id, book_id, body, translation) pairs and their relevant rules."""
    problems = rule_problems(F.col("body"), F.col("translation"), F.col("source"), F.col("renderings"))
    return relevant_rules(pairs, rules).select("seg_id", "source", F.explode(problems).alias("problem"))


def missing_names(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """(seg_id, source): rules none of whose renderings stands in the translation, JVM-side."""
    rows = relevant_rules(pairs, rules)
    hit = F.exists("renderings", lambda r: F.regexp_like(F.col("translation"), bounded(r)))
    return rows.filter(~hit).select("seg_id", "source").distinct()
