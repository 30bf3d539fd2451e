import datetime as dt

from foliomill.operators import batching, quality, search, segments
from foliomill.operators import translate as R
from foliomill.streaming import limits as stream_limits


def test_context_goes_back_over_texts_and_documents(spark):
    pairs = [(1, 1, i, f"source {i} " + "a" * 90, f"target {i} " + "b" * 190) for i in range(1, 6)] + [(1, 3, 1, "first " + "c " * 150, "erster " + "d " * 150), (1, 3, 2, "second", "zweiter"), (1, 3, 3, " ", "blank")]
    pairs = spark.createDataFrame(pairs, "book_id long, doc_no int, seg_no int, source string, translation string")
    docs = spark.createDataFrame([(1, n) for n in (1, 2, 3)], "book_id long, doc_no int")
    starts = spark.createDataFrame([(1, 1, 1, 1), (1, 2, 1, 1), (1, 3, 1, 1), (1, 3, 2, 3), (2, 1, 1, 1)], "book_id long, doc_no int, chunk int, seg_no int")
    got = lambda n: {(r["book_id"], r["doc_no"], r["chunk"]): r["context"] for r in batching.request_contexts(pairs, docs, starts, spark.createDataFrame([(1, n), (2, n)], "book_id long, context_chars int")).collect()}
    wide = got(1500)
    assert wide[(1, 1, 1)] is None and wide[(2, 1, 1)] is None
    # document 2 has no pairs: both it and document 3 begin after the last three of document 1
    assert wide[(1, 2, 1)] == wide[(1, 3, 1)] and [x.split()[2] for x in wide[(1, 2, 1)].split("\n")[::2]] == ["3", "4", "5"]
    assert wide[(1, 3, 2)].split("\n")[-2:] == ["SOURCE: second", "TRANSLATION: zweiter"] and wide[(1, 3, 2)].count("SOURCE: ") == 5
    small = got(250)[(1, 3, 2)].split("\n")
    assert len(small) == 4 and small[0].startswith("SOURCE: …c ") and len(small[0]) <= 8 + 1 + 244 and small[1].startswith("TRANSLATION: …d ")
    assert set(got(199).values()) == {None} and set(got(0).values()) == {None}


def test_prompts_and_requests(spark):
    units = spark.createDataFrame([(1, 1, 1, 1, 1, "Tom came"), (2, 1, 1, 2, 1, "he left")], "seg_id long, book_id long, doc_no int, seg_no int, part_no int, unit string")
    plan = spark.createDataFrame([(1, 1), (2, 2)], "seg_id long, chunk int")
    rules = spark.createDataFrame([(1, 0, "Tom", "Tom = Tomás")], "seg_id long, ord int, source string, line string")
    contexts = spark.createDataFrame([(1, 1, 2, "SOURCE: a\nTRANSLATION: b")], "book_id long, doc_no int, chunk int, context string")
    requests = R.requests_of(units, plan, rules, contexts)
    assert {r["chunk"]: r["prompt"] for r in R.prompt_of(requests).collect()} == {
        1: "GLOSSARY:\nTom = Tomás\n\nSEGMENTS:\n[[1]] Tom came", 2: "PREVIOUS PASSAGE (context only, do not output):\nSOURCE: a\nTRANSLATION: b\n\nSEGMENTS:\n[[1]] he left"}
    assert [r["prompt"] for r in R.prompt_of(R.requests_of(units.filter("seg_id = 1"), plan)).collect()] == ["[[1]] Tom came"]
    # what a call is sent is what the prompt says
    call = lambda prompt: "[[1]] " + str(len(prompt))
    sent = {r["seg_id"]: r["translation"] for r in R.translated_units(requests, call).collect()}
    assert sent == {1: str(len("GLOSSARY:\nTom = Tomás\n\nSEGMENTS:\n[[1]] Tom came")), 2: str(len("PREVIOUS PASSAGE (context only, do not output):\nSOURCE: a\nTRANSLATION: b\n\nSEGMENTS:\n[[1]] he left"))}


def test_search_tiers(spark):
    books = spark.createDataFrame([(1, "d/Arthas_-_Golden.Rise.epub"), (2, "d/golden.epub"), (3, "e/golden.epub"), (4, "d/notes.txt")], "book_id long, path string")
    asked = spark.createDataFrame([(1, 0, "d/golden.epub"), (2, 0, "GOLDEN"), (3, 0, "gold"), (4, 0, "rise ARTH"), (5, 0, "zzz"), (6, 0, "notes.txt"), (7, 0, None), (8, 0, "")], "asked long, nth int, q string")
    got = {}
    for r in search.found_books(books, asked).collect():
        got.setdefault(r["asked"], set()).add(r["book_id"])
    assert got == {1: {2}, 2: {2, 3}, 3: {1, 2, 3}, 4: {1}}


def test_ids_are_distinct(spark):
    texts = ["a b", "a b", "np_a_b_", "ok", "ok", "np_a_b"]
    rows = [(i, 1, 1, i, "h1", t, dt.datetime(2024, 1, 1)) for i, t in enumerate(texts)]
    seg = spark.createDataFrame(rows, "seg_id long, book_id long, doc_no int, seg_no int, tag string, text string, ingested_at timestamp")
    made = [r["made"] for r in segments.chapter_ids(seg).orderBy("seg_no").collect()]
    assert made == ["np_a_b__", "np_a_b___", "np_a_b_", "ok", "np_ok", "np_a_b"] and len(set(made)) == 6


def test_last_rows_of_keys(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    rows = [(1, 1, 1, None, t(1)), (2, 1, 1, None, t(2)), (3, 1, 1, 2, t(1)), (4, 1, 1, 3, None), (5, 1, 1, 3, t(1)), (6, None, 1, 3, t(1))]
    seg = spark.createDataFrame(rows, "seg_id long, book_id long, doc_no int, seg_no int, ingested_at timestamp")
    assert sorted(r["seg_id"] for r in segments.latest_segments(seg).collect()) == [2, 3, 5]


def test_late_calls_count_only_those_before_them(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    schema = "event_id long, ts timestamp, user_id long"
    for n, seconds in enumerate([[(1, 100), (2, 110)], [(3, 50)], [(4, 120), (5, 4 * 86_400)], [(6, 4 * 86_400 + 1)]]):
        spark.createDataFrame([(i, t0 + dt.timedelta(seconds=s), 1) for i, s in seconds], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = stream_limits.rate_breaches(stream, 2, 60)
    out.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).format("parquet").option("path", str(tmp_path / "out")).start().awaitTermination()
    assert {(r["event_id"], r["calls"]) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()} <= {(4, 3)}


def test_marks_against_a_plain_stack():
    import random
    import re

    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(["<x1>", "</x1>", "<x2>", "</x2>", "<x3/>", "</x3/>", "<x9>", "a"]) for _ in range(rng.randint(0, 9)))
        kept, stack, used = [], [], set()
        tags = list(re.finditer(r"<(/?)x(\d)(/?)>", text))
        for i, m in enumerate(tags):
            k = int(m[2])
            if k == 9 or (m[1] and m[3]):
                continue
            if m[3]:
                kept.append(i)
            elif not m[1] and k not in used:
                used.add(k)
                stack.append((k, i))
            elif m[1] and any(k == j for j, _ in stack):
                while stack[-1][0] != k:
                    stack.pop()
                kept += [stack.pop()[1], i]
        want = re.sub(r"<[^>]*>", lambda m, it=iter(range(99)): m[0] if next(it) in kept else "", text)
        assert quality.sanitized(text, {1, 2, 3}, {3}) == want, text
