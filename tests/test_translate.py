import json

import pytest

from foliomill.operators import checker
from foliomill.operators import translate as R
from foliomill.plans import config


def test_reply_and_prompt():
    assert R.numbered_reply("```\n[[1]] Uno\nwrapped\n[[3]] Tres\n```") == {1: "Uno wrapped", 3: "Tres"}
    assert R.numbered_prompt([(1, "a")]) == "[[1]] a"
    assert R.numbered_prompt([(1, "a")], "g", "c") == "GLOSSARY:\ng\n\nPREVIOUS PASSAGE (context only, do not output):\nc\n\nSEGMENTS:\n[[1]] a"


def test_halving_missing_and_backup():
    asked = []

    def call(prompt):
        asked.append(prompt)
        if "bad" in prompt:
            raise R.Blocked
        return "\n".join(line for line in R.echo(prompt).split("\n") if "lost" not in line or prompt.count("[[") == 1).upper()

    items = [(1, "one"), (2, "bad"), (3, "lost"), (4, "four")]
    assert R.translate_items(call, items) == {1: "ONE", 2: "bad", 3: "LOST", 4: "FOUR"}
    assert R.translate_items(call, items, backup=lambda p: "[[2]] from backup")[2] == "from backup"
    assert len(asked) > 4


def test_long_blocked_item_goes_in_parts():
    text = "A sentence that is fine. " * 40 + "This one is bad. " + "Another sentence here. " * 20

    def call(prompt):
        if "bad" in prompt:
            raise R.Blocked
        return R.echo(prompt).replace("fine", "FINE")

    got = R.translate_items(call, [(1, text.strip())])[1]
    assert "FINE" in got and "bad" in got and len(got) == len(text.strip())


def test_terms_go_with_the_requests_they_stand_in():
    asked = []

    def call(prompt):
        asked.append(prompt)
        return R.echo(prompt) if "Tom" not in prompt or "[[2]]" not in prompt else "[[2]] x"

    terms = [R.Term("Tom", "Tom = Tomás"), R.Term("Ann", "Ann = Ana")]
    assert R.translate_items(call, [(1, "Tom came"), (2, "Ann left")], terms, "SOURCE: a\nTRANSLATION: b") == {1: "Tom came", 2: "x"}
    assert asked[0].startswith("GLOSSARY:\nTom = Tomás\nAnn = Ana\n\nPREVIOUS") and asked[1].startswith("GLOSSARY:\nTom = Tomás\n\nPREVIOUS")


def test_cascade():
    def busy(prompt):
        raise R.Unavailable

    assert R.cascade([busy, lambda p: "<think>x</think> ok"])("p") == "ok"
    with pytest.raises(R.Blocked):
        R.cascade([busy, lambda p: ""])("p")


def test_checker(spark):
    def report(rows):
        return json.dumps({"messages": [{"ID": i, "severity": s, "message": m, "locations": [{"path": p, "line": 1}, {"path": "z", "line": 2}]} for i, s, m, p in rows]})

    before = spark.createDataFrame([(1, report([("A", "ERROR", "m; expected x", "p"), ("C", "ERROR", "gone", "p")])), (2, "no json")], "book_id long, json string")
    after = spark.createDataFrame([(1, report([("A", "ERROR", "m; expected y", "q"), ("B", "ERROR", "n", "q"), ("W", "WARNING", "w", "q")]))], "book_id long, json string")
    got = {r["book_id"]: r for r in checker.new_problems(checker.messages(before), checker.messages(after)).collect()}
    assert (got[1]["new_errors"], got[1]["new_warnings"], got[1]["preexisting"], got[1]["fixed"]) == (1, 1, 2, 1)
    assert checker.messages(after).first()["path"] == "q"


def test_config():
    c = config.load({"FOLIOMILL_RPM": "0", "FOLIOMILL_MAX_CHARS": "10", "FOLIOMILL_BILINGUAL": "yes", "FOLIOMILL_API_KEY": "secret"})
    assert (c.rpm, c.max_chars, c.bilingual) == (1, 2000, True) and "secret" not in repr(c)
    with pytest.raises(ValueError):
        config.load({"FOLIOMILL_RPM": "many"})
