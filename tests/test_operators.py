import datetime as dt

import pytest
from pyspark.sql import functions as F

from foliomill.operators import batching, cache, cleanup, glossary, limits, quality, segments

SEG = "seg_id long, book_id long, doc_no int, seg_no int, path string, tag string, text string, extracted_at timestamp, ingested_at timestamp"
T0 = dt.datetime(2025, 1, 1)


def seg(spark, texts, tags=None, book=1, doc=1):
    rows = [(i, book, doc, i, "a.xhtml", (tags or ["p"] * len(texts))[i - 1], t, T0, T0) for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, SEG)


def books(spark, title="Firstborn: Part One", author="Jane Doe"):
    return spark.createDataFrame([(1, "in/Firstborn.epub", "2.0", title, author, "en", None, "p")], "book_id long, path string, version string, title string, author string, lang string, series string, profile string")


def test_lines_and_latest(spark):
    s = seg(spark, ["one<x1/>  <x2/>two &amp;", None, ""])
    assert [(r["line_no"], r["n_lines"], r["line"]) for r in segments.lines(s).orderBy("line_no").collect()] == [(1, 3, "one"), (3, 3, "two &")]
    twice = s.unionByName(s.withColumn("seg_id", F.col("seg_id") + 100).withColumn("ingested_at", F.expr("ingested_at + interval 1 day")))
    assert sorted(r["seg_id"] for r in segments.latest_segments(twice).collect()) == [101, 102, 103]
    assert {r["copies"] for r in segments.first_seen(twice).collect()} == {2}


def test_line_classes(spark):
    texts = ["2 JANE DOE<x1/>Story goes on", "FIRSTBORN 3<x1/>and on", "Text here<x1/>- 14 -", "Scanned by someone<x1/>x", "12", "<x1/>", "He said<x1/>* A note below"]
    s = seg(spark, texts, ["p", "p", "p", "p", "h1", "p", "p"])
    got = {(r["seg_id"], r["line_no"]): r["kind"] for r in cleanup.classified_lines(s, books(spark)).collect()}
    assert got == {(1, 1): "header", (1, 2): None, (2, 1): "header", (2, 2): None, (3, 1): None, (3, 2): "page number", (4, 1): "watermark", (4, 2): None, (5, 1): None, (7, 1): None, (7, 2): None}
    stripped = {r["seg_id"]: r["body"] for r in cleanup.stripped_text(s, cleanup.classified_lines(s, books(spark))).collect()}
    assert stripped == {1: "Story goes on", 2: "and on", 3: "Text here", 4: "x"}
    assert [r["seg_id"] for r in cleanup.footnote_suspects(cleanup.classified_lines(s, books(spark))).collect()] == [7]


def test_learned_heads_and_caps(spark):
    s = seg(spark, [f"{n} The Deep Well<x1/>text" for n in (3, 5, 7)] + ["SOME LOUD LINE<x1/>x"] * 5)
    rows = segments.lines(s)
    assert [(r["key"], r["uses"]) for r in cleanup.running_heads(rows).collect()] == [("the deep well", 3)]
    assert [(r["line"], r["uses"]) for r in cleanup.repeated_caps(rows).collect()] == [("SOME LOUD LINE", 5)]


def test_broken_lines(spark):
    s = seg(spark, ["had done<x1/>to get inside", "some-<x1/>thing", "Title Line<x1/>Next Title", "a rather long line about the<x1/>Marines went", "one<x1/><x2/>two", "whole"])
    got = {r["seg_id"]: r["body"] for r in cleanup.broken_lines_joined(s).collect()}
    assert got == {1: "had done to get inside", 2: "something", 4: "a rather long line about the Marines went", 5: "one two"}


def test_split_paragraphs(spark):
    s = seg(spark, ["It was a dark,", "stormy and", "wet night.", "The end", "of it"], ["p", "div", "p", "p", "h1"])
    got = [(r["seg_no"], r["merged"], r["body"]) for r in cleanup.paragraphs_merged(s).collect()]
    assert got == [(1, 3, "It was a dark, stormy and wet night.")]


CACHE = "cache_id long, book_id long, doc_no int, src_sha1 string, target_lang string, translation string, finish_reason string, model string, written_at timestamp"


def cached(spark, pairs):
    import hashlib

    rows = [(i, 1, 1, hashlib.sha1(s.encode()).hexdigest(), "es", t, "STOP", "m", T0 + dt.timedelta(hours=i)) for i, (s, t) in enumerate(pairs, 1)]
    return spark.createDataFrame(rows, CACHE)


def test_cache(spark):
    s, c = seg(spark, ["alpha", "beta", "<x1/> 1", None]), cached(spark, [("alpha", "A"), ("alpha", "B"), ("gone", "C")])
    assert [(r["seg_id"], r["cache_id"]) for r in cache.cache_hits(s, c).collect()] == [(1, 2)]
    assert [r["seg_id"] for r in cache.pending_segments(s, c).collect()] == [2]
    assert sorted(r["cache_id"] for r in cache.merged_cache(c, cached(spark, [("beta", "D")]).withColumn("cache_id", F.lit(9))).collect()) == [2, 3, 9]
    kept = spark.createDataFrame([("s", "old", "s ", 1, 0, False), ("s", "old", "new", 2, 1, False), ("s", "old", "new", 2, 1, True), ("s", "old", "new", 1, 1, False)], "source string, old string, new string, old_breaks int, new_breaks int, damaged boolean")
    assert [r["answer"] for r in cache.kept_answers(kept).collect()] == ["old", "new", "old", "old"]


def test_sentence_parts():
    text = "One two three. <x1>Four five. Six</x1> seven. Eight nine."
    parts = batching.sentence_parts(text, 30)
    assert parts == ["One two three.", "<x1>Four five. Six</x1> seven.", "Eight nine."]
    assert " ".join(parts) == text
    assert batching.sentence_parts("abc", 10) == ["abc"]
    assert batching.sentence_parts("no sentence end here at all", 5) == ["no sentence end here at all"]


def test_chunks_and_context(spark):
    s = seg(spark, ["a" * 30, "b" * 30, "c" * 200, "d"])
    config = spark.createDataFrame([("p", 100, 2)], "profile string, max_chars int, rpd int")
    pending = cache.pending_segments(s, cached(spark, [("x", "y")]))
    plan = batching.chunk_plan(pending, books(spark), config)
    assert [r["chunk"] for r in plan.orderBy("seg_id").collect()] == [1, 1, 2, 3]
    total = batching.dry_run(pending, plan, books(spark), config).first()
    assert (total["pending"], total["pending_chars"], total["requests"], total["tokens"], total["days"]) == (4, 261, 3, 65, 2)
    before = {r["seg_id"]: (r["before"], r["chars"]) for r in batching.context_windows(s, 260).collect()}
    assert before == {1: (0, 0), 2: (1, 30), 3: (2, 60), 4: (1, 200)}


def test_markers(spark):
    reply = spark.createDataFrame([(1, 1, "```\n[[1]] Uno\nwrapped\n[[3]] Tres\n[[1]] Otro\n```"), (1, 2, "nothing")], "book_id long, doc_no int, body string")
    assert {(r["doc_no"], r["item"]): r["reply"] for r in segments.parsed_markers(reply).collect()} == {(1, 1): "Otro", (1, 3): "Tres"}


def test_navigation_ids(spark):
    s = seg(spark, ["1", "ok_2", "a b", "ok_2", "np_1"], ["h1"] * 5)
    assert [r["made"] for r in segments.chapter_ids(s).orderBy("seg_no").collect()] == ["np_1_", "ok_2", "np_a_b", "np_ok_2", "np_1"]


def test_term_uses():
    found = {t for text in ["He met Jake and Rosemary. Suddenly Jake ran.", "Well, I'm Jake's friend, said Gray Tiger.", "The Gray Tiger of the North"] for t, *_ in glossary.term_uses(text)}
    assert {"Jake", "Rosemary", "Gray Tiger", "Gray Tiger of the North"} <= found
    assert not {"Well", "I'm"} & found


def test_term_candidates(spark):
    s = seg(spark, ["He met Jake and Rosemary. Then Jake ran.", "then Rosemary saw Jake. Suddenly it ended.", "so Tom left"])
    got = [(r["term"], r["uses"], r["rank"]) for r in glossary.term_candidates(s).orderBy("rank").collect()]
    assert got == [("Jake", 3, 1), ("Rosemary", 2, 2)]


@pytest.mark.parametrize(
    ("source", "translation", "term", "renderings", "want"),
    [
        ("Gray Tiger came.", "El Tigre Gris vino.", "Gray Tiger", ["Tigre Gris"], []),
        ("Gray Tiger came.", "El tigre gris vino.", "Gray Tiger", ["Tigre Gris"], ["Gray Tiger: expected Tigre Gris"]),
        ("the Shelak fell", "el Shelak cayó", "Shelak", ["shelak"], ["Shelak: 'Shelak' should be 'shelak'"]),
        ("Shelak fell", "Shelak cayó", "Shelak", ["shelak"], []),
        ("Les saw les", "les vio", "Les", ["Les"], ["Les: 'les' should be 'Les'"]),
        ("the Preserver", "la Preservadora", "Preserver", ["Preservador", "Preservadora"], []),
        ("X Y", "nada", "X", ["a", "b"], ["X: expected a | b"]),
    ],
)
def test_rule_breaks(spark, source, translation, term, renderings, want):
    pairs = spark.createDataFrame([(1, 1, source, translation)], "seg_id long, book_id long, body string, translation string")
    rules = spark.createDataFrame([(1, term, renderings, "x", 0)], "book_id long, source string, renderings array<string>, line string, ord int")
    assert [r["problem"] for r in glossary.violations(pairs, rules).collect()] == want


def test_apostrophes_before_terms(spark):
    rows = spark.createDataFrame([(1, 1, "he saw 'Tis and O’Brien"), (2, 1, "l'Tis, Tis"), (3, 1, "OBrien Brien")], "seg_id long, book_id long, body string")
    rules = spark.createDataFrame([(1, t, ["x"], t, i) for i, t in enumerate(["Tis", "'Tis", "Brien", "O'Brien", "&"])], "book_id long, source string, renderings array<string>, line string, ord int")
    assert sorted((r["seg_id"], r["source"]) for r in glossary.relevant_rules(rows, rules).collect()) == [(1, "'Tis"), (1, "O'Brien"), (2, "Tis"), (3, "Brien")]


def test_relevant_rules_explode_no_texts(spark):
    rows = spark.createDataFrame([(1, 1, "the Gray Tiger's den")], "seg_id long, book_id long, body string")
    rules = spark.createDataFrame([(1, "Gray Tiger", ["Tigre"], "l", 0)], "book_id long, source string, renderings array<string>, line string, ord int")
    plan = glossary.relevant_rules(rows, rules)._jdf.queryExecution().optimizedPlan().toString()
    generate = next(line for line in plan.split("\n") if "Generate explode" in line)
    assert generate.split("], ")[-2 if generate.count("], ") > 1 else -1].count("body") == 0


def test_rules(spark):
    body = "# note\n\nGray Tiger = Tigre Gris\nno rule\nA = x | y # why\nA= z\n = q\nB ="
    rules = glossary.parsed_rules(spark.createDataFrame([(1, body)], "book_id long, body string"))
    assert [(r["source"], list(r["renderings"])) for r in rules.orderBy("ord").collect()] == [("Gray Tiger", ["Tigre Gris"]), ("A", ["z"])]
    base = glossary.parsed_rules(spark.createDataFrame([(1, "A=a\nB=b")], "book_id long, body string"))
    new = glossary.parsed_rules(spark.createDataFrame([(1, "B=bb\nC=c")], "book_id long, body string"))
    assert {r["source"]: r["change"] for r in glossary.merged_rules(base, new).collect()} == {"A": "kept", "B": "changed", "C": "added"}
    assert {r["source"]: list(r["renderings"]) for r in glossary.overriding(base, new).collect()} == {"A": ["a"], "B": ["bb"], "C": ["c"]}


def test_relevant_rules_plan_has_no_nested_loop(spark):
    rows = spark.createDataFrame([(1, 1, "the Gray Tiger's den"), (2, 1, "Gray Tigers"), (3, 2, "Gray Tiger")], "seg_id long, book_id long, body string")
    rules = spark.createDataFrame([(1, "Gray Tiger", ["Tigre"], "Gray Tiger = Tigre", 0), (1, "a.b", ["c"], "a.b = c", 1)], "book_id long, source string, renderings array<string>, line string, ord int")
    got = glossary.relevant_rules(rows, rules)
    assert [r["seg_id"] for r in got.collect()] == [1]
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert [r["block"] for r in glossary.rule_blocks(got).collect()] == ["Gray Tiger = Tigre"]


def test_completeness_and_unchanged(spark):
    long = "the quick brown fox jumps over lazy dogs while seven other animals watch from their quiet place near the river bank today " * 4
    s = seg(spark, [long, "short one", long + "x", "This sentence is unchanged by anyone."])
    c = cached(spark, [(long, long[:200]), ("short one", "s"), (long + "x", long), ("This sentence is unchanged by anyone.", " This sentence is unchanged by anyone. ")])
    both = quality.pairs(s, c)
    assert {r["seg_id"]: r["problem"] for r in quality.incomplete(both).collect()} == {1: "dropped", 3: "partly untranslated"}
    assert [r["seg_id"] for r in quality.unchanged(both).collect()] == [4]


def test_placeholders():
    known, voids = {1, 2, 3}, {3}
    assert quality.check_placeholders("<x1>a</x1><x2>b</x2><x3/>", known) == []
    assert quality.check_placeholders("<x1>a<x2>b</x1></x2><x9/>", known) == ["misnested </x1>", "unknown tag x9", "unclosed tags x1", "missing tags x3"]
    assert quality.sanitized("<x1>a<x2>b</x1>c</x2><x9>d<x3/>", known, voids) == "<x1>ab</x1>cd<x3/>"
    assert quality.closed("<x1>a <x2>b <x3/>c", known, voids, {2: {1}, 3: set()}) == "<x1>a <x2>b </x2></x1><x3/>c"


def test_placeholder_problems(spark):
    s = seg(spark, ["<x1>a</x1> b<x2/>", "plain text"])
    c = cached(spark, [("<x1>a</x1> b<x2/>", "<x1>a b<x7/>"), ("plain text", "ok")])
    both = quality.pairs(s, c)
    r = quality.placeholder_problems(both).collect()
    assert [(x["seg_id"], x["unknown"], x["missing"], x["unbalanced"]) for x in r] == [(1, 1, 1, 1)]
    assert quality.repaired_answers(both).first()["repaired"] == "<x1>a b</x1>"


def test_report_difference(spark):
    item = "a#1: m1; expected x"
    rows = [(1, 1, "es", 1, 1, 1, 1, [item], [], T0), (2, 1, "es", 1, 1, 1, 1, ["a#1: m1; expected y", "a#2: m2"], [], T0 + dt.timedelta(days=1)), (3, 2, "es", 1, 1, 1, None, None, [], T0)]
    stats = spark.createDataFrame(rows, "run_id long, book_id long, target_lang string, doc_no int, segments int, translated int, requests int, unchanged array<string>, incomplete array<string>, reported_at timestamp")
    assert [(r["change"], r["items"]) for r in quality.report_difference(stats).collect()] == [("new", 1)]
    assert quality.run_totals(stats).first()["documents"] == 2


def test_limits(spark):
    rows = [(i, T0 + dt.timedelta(seconds=s), 1) for i, s in enumerate((0, 10, 20, 59, 60, 130))]
    ev = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long")
    assert sorted((r["event_id"], r["calls"]) for r in limits.rate_breaches(ev, 2, 60).collect()) == [(2, 3), (3, 4), (4, 4)]
    assert [r["waited"] for r in limits.admitted(ev, 2, 60).orderBy("event_id").collect()] == [0.0, 0.0, 40.0, 11.0, 60.0, 0.0]
    assert sorted(r["calls"] for r in limits.daily_use(ev, 5).collect()) == [6]
