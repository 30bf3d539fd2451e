"""Small tables on which a query is compared with its SQL, for what the test tables hold too rarely."""

import datetime

import pytest

duckdb = pytest.importorskip("duckdb")


def both(spark, at, name, **tables):
    """Rows of a query and of its SQL over tables given as (schema, rows), columns in order of name."""
    from foliomill.plans.catalog import QUERIES
    from foliomill.plans.oracles import ORACLES

    c = duckdb.connect()
    for t, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{t}.parquet")
        c.sql(f"create view {t} as select * from '{at}/{t}.parquet/*.parquet'")
    want = c.sql(ORACLES[name])
    order = sorted(want.columns)
    return sorted(tuple(r) for r in QUERIES[name](spark, str(at)).select(*order).collect()), sorted(want.select(*order).fetchall())


def segments(*texts):
    """A document of texts in book 1."""
    at = datetime.datetime(2024, 1, 1)
    schema = "seg_id long, book_id long, doc_no int, seg_no int, path string, tag string, text string, lead_ws string, trail_ws string, void_ids array<int>, ingested_at timestamp"
    return schema, [(i, 1, 1, i, "ch1", "p", t, "", "", [], at) for i, t in enumerate(texts)]


def test_prompt_blocks_are_in_order_of_their_lines(spark, tmp_path):
    """Zora is used most and Anna least: the order of uses is the opposite of that of the lines."""
    got, want = both(spark, tmp_path, "prompt_blocks", segments=segments("so Zora and Anna and Mila", "so Zora and Mila", "so Anna and Zora and Mila", "so Zora and Anna and Mila", "so Zora"))
    assert got == want
    assert ("Anna = Anna\nMila = Mila\nZora = Zora", 2) in got and ("Zora = Zora", 4) in got


def test_translated_titles_are_capitals_letter_by_letter(spark, tmp_path):
    """A letter whose capital form is several letters stays one letter: no SS, FI or ʼN."""
    titles = ["Straße und Fuß", "eﬃcient ﬁre", "ŉ ǰ և", "ᾳ ᾼ ὐ ῷ", "plain é 𐐨", None]
    books = "book_id long, path string, version string, title string, author string, lang string, series string, profile string", [(i, f"b{i}.epub", "3.0", t, None, "de", None, "p") for i, t in enumerate(titles)]
    schema, rows = segments("Ein Satz.")
    cache = "cache_id long, book_id long, doc_no int, src_sha1 string, target_lang string, translation string, finish_reason string, model string, written_at timestamp", []
    got, want = both(spark, tmp_path, "epub_translated", books=books, segments=(schema, [(i, i, *rows[0][2:]) for i in range(len(titles))]), segment_cache=cache)
    assert got == want
    assert [r[-1] for r in got if r[-2] == "b0.epub"] == ["STRAẞE UND FUẞ"]


def test_capitals_of_every_letter(spark):
    """All letters against DuckDB's upper, but for those newer than its tables, which Spark's have."""
    from pyspark.sql import functions as F

    from foliomill.functions import text as T

    codes = [i for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    rows = spark.createDataFrame([(i, f"a{chr(i)}\nß") for i in codes], "i int, t string").select("i", T.capitals(F.col("t")), F.upper(F.substring("t", 2, 1))).collect()
    c = duckdb.connect()
    want = dict(c.execute("select i, upper('a' || chr(i::int) || chr(10) || 'ß') from (select unnest($l) as i)", {"l": codes}).fetchall())
    wrong = [(i, made, want[i]) for i, made, spark_upper in rows if made != want[i] and not (want[i][1] == chr(i) and made == f"A{spark_upper}\nẞ" and len(spark_upper) == 1)]
    assert not wrong
