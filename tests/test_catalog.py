"""Every query with SQL gives the SQL's rows, on the smallest tables."""

import os
from collections import Counter

import pytest

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        c.sql(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return c


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(str(r[i]) if hasattr(r[i], "year") else r[i] for i in order) for r in rows)


def names():
    from foliomill.plans.oracles import ORACLES

    return sorted(ORACLES)


@pytest.mark.parametrize("name", names())
def test_matches_sql(spark, sql, name):
    from foliomill.plans.catalog import QUERIES
    from foliomill.plans.oracles import ORACLES

    want = sql.sql(ORACLES[name])
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    assert bag(got.columns, [tuple(r) for r in got.collect()]) == bag(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


UNCHECKED = {"split_units": "unit", "term_candidates": "term", "repaired_answers": "problems", "run_reports": "report", "document_segments": "text", "document_repairs": "kind", "translated_documents": "html", "prompt_texts": "prompt", "epub_cleaned": "item_path"}


@pytest.mark.parametrize("name", sorted(UNCHECKED))
def test_runs(spark, name):
    """Queries without SQL: they give rows, and what they are for is in each."""
    from foliomill.plans.catalog import QUERIES

    rows = QUERIES[name](spark, DATA if name != "repaired_answers" else DATA.replace("0.001", "0.01")).collect()  # the smallest tables have no damaged answer
    assert rows and all(r[UNCHECKED[name]] for r in rows)


def test_every_query_is_checked():
    from foliomill.plans.catalog import QUERIES
    from foliomill.plans.oracles import ORACLES

    assert set(QUERIES) == set(ORACLES) | set(UNCHECKED)


def test_names_of_terms_agree_with_a_plain_pattern(spark):
    """The chains of name words, against one pattern for the whole name."""
    import re

    from foliomill.operators import glossary

    word = glossary.NAME_WORD
    whole = re.compile(rf"{word}(?:(?:\s+(?:{glossary.JOINERS})){{0,2}}\s+{word})*")
    for (text,) in duckdb.connect().sql(f"select text from '{DATA}/segments.parquet' where text is not null").fetchall():
        spans = [m.span() for m in re.finditer(word, text)]
        linked = [glossary._JOINED.fullmatch(text, a[1], b[0]) is not None for a, b in zip(spans, spans[1:])]
        assert [text[spans[a][0] : spans[b][1]] for a, b in glossary._chains(linked, len(spans))] == [m[0] for m in whole.finditer(text)]
