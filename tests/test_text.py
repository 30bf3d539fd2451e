from pyspark.sql import functions as F

from foliomill.functions import languages
from foliomill.functions import text as T


def values(spark, texts, made):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", made(F.col("t")).alias("x"))
    return [r["x"] for r in sorted(rows.collect(), key=lambda r: r["i"])]


def test_page_number_vectors(spark):
    true = ["12", "- 12 -", "[12]", "Page 12", "p. 12", "Página 7", "12 of 300", "12 / 300", "xii", "iv"]
    false = ["I", "mix", "12 monkeys", "Chapter 12", "civil"]
    assert values(spark, true + false, T.is_page_number) == [True] * len(true) + [False] * len(false)


def test_plain_and_translatable(spark):
    assert values(spark, ["a<x1>b</x1> &amp; <x2/>c", None], T.plain) == ["a b & c", None]
    assert values(spark, ["a<x1>b</x1> &lt;c", None], T.plain_tight) == ["ab <c", None]
    assert values(spark, ["<x1/> 12", "<x1>é</x1>", ""], T.is_translatable) == [False, True, False]


def test_folding(spark):
    assert values(spark, ["Éire—Ñandú 12!", "ＡＢ"], T.norm_key) == ["eirenandu 12", "ab"]
    assert values(spark, ["2 JANE DOE", "Part 12, x12"], T.header_key) == ["jane doe", "part x12"]


def test_character_repairs(spark):
    got = values(spark, ["ﬁne sepa- rate", "black- and white", "C H A P T E R one , two . . .", "a​b­c", "see OceanofPDF.com now", "A B C d"], T.characters_fixed)
    assert got == ["fine separate", "black- and white", "CHAPTER one, two . . .", "abc", "see now", "A B C d"]


def test_small_functions(spark):
    assert values(spark, ["Der große Tag!", "", "__"], T.slug) == ["Der_gro_e_Tag", "book", "book"]
    assert values(spark, ["one two three", "short"], lambda c: T.tail_of(c, 9)) == ["…three", "short"]
    assert values(spark, ["a key K1 b"], lambda c: T.redacted(c, ["K1", ""])) == ["a key *** b"]
    assert values(spark, ["<think>x\ny</think> ok "], T.without_thoughts) == ["ok"]
    assert values(spark, ["\n “Title: No” \nx"], T.title_reply) == ["No"]
    assert values(spark, ["bad; expected a\nb"], T.message_key) == ["bad"]
    assert values(spark, ["retryDelay: 37s", "none"], T.retry_delay) == [37, None]


def test_derived_uid(spark):
    import uuid

    want = str(uuid.uuid5(uuid.NAMESPACE_URL, "foliomill:abc:es"))
    rows = spark.createDataFrame([("abc",), ("urn:uuid:abc",)], "t string").select(T.derived_uid(F.col("t"), F.lit("es")).alias("x")).collect()
    assert rows[0]["x"] == want
    assert rows[1]["x"] == "urn:uuid:" + str(uuid.uuid5(uuid.NAMESPACE_URL, "foliomill:urn:uuid:abc:es"))


def test_languages(spark):
    cases = {"es": ("es", "Spanish"), "PT_BR": ("pt-br", "Brazilian Portuguese"), "Castellano": ("es", "Spanish"), "fr-ca": ("fr-ca", "French"), "Klingon": ("klingon", "Klingon"), "": ("und", "")}
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    code, name = languages.resolved(F.col("t"))
    assert {r["t"]: (r["c"], r["n"]) for r in rows.select("t", code.alias("c"), name.alias("n")).collect()} == cases
