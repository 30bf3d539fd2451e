"""Cases that earlier rules cut off."""

import random

import pyarrow as pa

from foliomill.llm import confusables, encoding, mixing, pairs, scannoise

PLAIN = "señor mañana café corazón jardín también después canción élève première garçon français über für schön müde casa perro maison haus tree".split()


def sentences(n, seed=1, more=()):
    rng = random.Random(seed)
    return [" ".join(rng.choice([*PLAIN, *more]) for _ in range(10)) + "." for _ in range(n)]


def repairer(texts):
    counts = next(encoding.count_pairs(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])])))
    return encoding.Repairer(encoding.PairModel(counts.column(0).to_numpy(), counts.column(1).to_numpy()))


# --- 4


def test_frequent_garble_does_not_vouch_for_itself():
    clean = sentences(2000)
    garbled = [t.encode().decode("cp1252") for t in clean[:400] if t.encode().decode("cp1252", "replace").isprintable()]
    r = repairer(clean + garbled)
    few = ["the house was cafÃ© and tree.", *garbled[:50]]
    assert r.candidates(few).tolist() == list(range(len(few)))
    assert r.repair(few[0]) == ("the house was café and tree.", "cp1252>utf-8")
    assert all((got := r.repair(t)) and got[0] == t.encode("cp1252").decode() for t in garbled[:50])
    assert not len(r.candidates(clean[:50])) or not any(map(r.repair, clean[:50]))


def test_bytes_are_looked_up_before_lower_casing():
    r = repairer(sentences(1500, more=["didn’t", "“Until", "over.”"]))
    texts = ["he didnΓÇÖt go home", "he didnÔÇÖt go home"]  # cp437 and cp850: the small letters have other bytes, or none
    assert r.candidates(texts).tolist() == [0, 1]
    assert [r.repair(t)[0] for t in texts] == ["he didn’t go home"] * 2


def test_a_garbled_word_counts_in_a_long_text():
    odd = " ".join(f"x{a}q{b}" for a in "ďľřšťž" for b in "ąęłńśźżć")  # improbable words that no mapping betters
    clean = sentences(1500)
    r = repairer(clean)
    bad = "garçon".encode("cp1252").decode("cp437")
    text = f"{clean[0]} {odd} {clean[1]} the {bad} tree {clean[2]} {odd}"
    assert r.candidates([text]).tolist() == [0]
    assert r.repair(text)[0] == text.replace(bad, "garçon")


def test_text_garbled_many_times():
    r = repairer(sentences(1500))
    text = bad = "the garçon and the élève"
    for _ in range(6):
        bad = bad.encode().decode("cp1252")
    assert r.repair(bad)[0] == text


# --- 2


def test_heads_of_other_documents_leave_the_text(spark):
    rows = [(1, 1, 1, 1, "h1", "The Hidden Garden Gate"), (2, 1, 2, 1, "p", "he went along the river\nTHE HIDDEN GARDEN GATE | 26\nand then home"), (3, 1, 2, 2, "p", "he went home")]
    seg = spark.createDataFrame(rows, "seg_id long, book_id long, doc_no int, seg_no int, tag string, text string")
    books = spark.createDataFrame([(1, "Any Title Here", "A B")], "book_id long, title string, author string")
    log = spark.createDataFrame([], "log_id long, book_id long, doc_no int, entry string")
    assert ("segments", 2, "header") in {tuple(r) for r in scannoise.scan_noise(seg, books, log).collect()}
    assert {r["row_id"]: r["clean"] for r in scannoise.repaired_text(seg, books, log).collect()} == {2: "he went along the river and then home"}


def noise_tables(spark, rows, title="Any Title Here"):
    seg = spark.createDataFrame(rows, "seg_id long, book_id long, doc_no int, seg_no int, tag string, text string")
    books = spark.createDataFrame([(1, title, "A B")], "book_id long, title string, author string")
    return seg, books, spark.createDataFrame([], "log_id long, book_id long, doc_no int, entry string")


def headers(found):
    return {r["row_id"] for r in found.collect() if r["kind"] == "header"}


def test_a_one_word_title_beside_a_number(spark):
    t = noise_tables(spark, [(1, 1, 1, 1, "p", "they came to the old stone 12 Silverdale while nobody was looking")], "Silverdale")
    assert headers(scannoise.scan_noise(*t)) == {1}
    assert [r["clean"] for r in scannoise.repaired_text(*t).collect()] == ["they came to the old stone while nobody was looking"]


def test_headings_in_any_number_and_of_any_length(spark):
    long = "The Long And Winding Account Of How The Keeper Of The Lamps Went Down To The Harbour " * 3
    heads = [(i, 1, 1, i, "h1", f"Chapter of the Grove {i}") for i in range(300)] + [(900, 1, 7, 1, "h2", long.strip()), (901, 1, 8, 1, "h2", "Oaks")]
    texts = ["and so they\nCHAPTER OF THE GROVE 271 | 12\nwent away", f"and so they\n{long.strip()} 14\nwent away", "and so they\nOaks 15\nwent away", "and so they\nOaken 15 trees\nwent away", "they left CHAPTER OF THE GROVE 299 and went away"]
    t = noise_tables(spark, [*heads, *((1000 + i, 1, 2, i, "p", x) for i, x in enumerate(texts))])
    assert headers(scannoise.scan_noise(*t)) == {1000, 1001, 1002, 1004}
    fixed = {r["row_id"]: r["clean"] for r in scannoise.repaired_text(*t).collect()}
    assert [fixed[1000 + i] for i in (0, 1, 2, 4)] == ["and so they went away"] * 3 + ["they left and went away"]


def test_more_than_three_heads_in_a_line():
    text = " and then ".join(["SILVERDALE HOUSE 12"] * 6)
    clean, head, page = scannoise.edges(text, "p", "Silverdale House", None, ())
    assert (clean.split(), head, page) == (["and", "then"] * 5, True, False)


def test_a_page_number_before_a_numbered_head():
    text = "they went beyond the Page 325 737 | The Bright Parcel barns"
    assert scannoise.edges(text, "p", "The Bright Parcel", None, ()) == ("they went beyond the barns", True, True)


def test_frequent_words_apart(spark):
    edge = spark.createDataFrame([("segments", i, "the arid tbe") for i in range(50)] + [("segments", 99, "rnoon the")], "tbl string, row_id long, words string")
    fixes = spark.createDataFrame([("tbe", "the"), ("rnoon", "moon")], "word string, fixed string")
    counts = scannoise.word_counts(edge)
    few, many = (sorted(map(tuple, scannoise.misread_rows(edge, fixes, counts, n).collect())) for n in (10, 1))
    assert few == many and len(few) == 51


def test_words_of_texts_with_and_without_odd_characters(spark):
    from pyspark.sql import functions as F

    texts = ["Don't stop the rock’n’roll, it's 5 o'clock!", "a¢b 1e€t w|th he!lo <x1>word</x1> x", "l’été d’Anna ‘quoted’ 'tis", "Ⅷ x² ünï"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    full = df.select(scannoise.words_of(F.col("t"), F.lit(True)).alias("a"), scannoise.words_of(F.col("t"), F.lit(False)).alias("b")).collect()
    assert [r["a"] for r in full] == ["don't stop the rock’n’roll it's 5 o'clock", "a¢b 1e€t w|th he!lo word x", "l’été d’anna quoted tis", "ⅷ x² ünï"]
    assert all(r["a"] == r["b"] for r, t in zip(full, texts) if "¢" not in t)


def test_a_spaced_number_before_a_spaced_head():
    text = "the trudley dof- (764) 7 5 9 H I S B U T C H E R eued a nabayr"
    assert scannoise.edges(text, "p", "His Butcher", None, ()) == ("the trudley dof- eued a nabayr", True, True)


# --- 5


def test_refusals_of_any_length():
    long = "I'm sorry, but I can't translate this passage. " + "It seems to come from a published novel, and such books are usually protected, so a full version would not be right here. If you like, a short overview of the plot or a note on its style could be written instead, and questions about single words are welcome at any time as well, of course."
    assert len(pairs.words(long)) > 55 and pairs.is_refusal(long)
    assert pairs.is_refusal("Es tut mir leid. Ich kann diesen Abschnitt nicht übersetzen.")
    assert not pairs.is_refusal("the text to this request with my passage content")
    assert not pairs.is_refusal("“I can't help with that,” said the keeper, and the old miller went home over the bridge. Nobody saw him again.")


def test_a_copy_with_another_beginning():
    words = [f"word{i}" for i in range(200)]
    model = pairs.Languages([], pairs.np.zeros((pairs.BUCKETS, 0), pairs.np.float32))
    prompt, answer = " ".join(words), " ".join([f"other{i}" for i in range(12)] + words[12:])
    assert pairs.judge([prompt], [answer], ["en"], model) == ["copy"]


# --- 6


def test_a_hot_text_meets_its_variant_only(spark):
    rows = [(i, "same text") for i in range(300)] + [(900, "sаme text"), (901, "same\u00a0text")]
    seg = spark.createDataFrame(rows, "seg_id long, text string")
    got = {tuple(r) for r in confusables.look_alike_pairs(seg).collect()}
    assert got == {(i, k) for i in range(300) for k in (900, 901)} | {(900, 901)}


# --- 8


def test_the_driver_holds_a_row_per_source(spark):
    tokens = spark.range(60_000).selectExpr("id as doc_id", "if(id % 3 = 0, 'a', 'b') as source", "512L as n_tokens")
    targets = spark.createDataFrame([("a", 0.5, 4), ("b", 0.5, 4)], "source string, target_share double, max_repeats int")
    slots = mixing.mix_slots(tokens, targets)
    n = {r["source"]: r["count"] for r in slots.groupBy("source").count().collect()}
    assert n == {"a": 80_000, "b": 80_000}
    assert {r["count"] for r in slots.filter("source = 'a'").groupBy("block").count().collect()} == {4}
    assert slots.groupBy("shard").count().filter("count > 4096").count() == 0
