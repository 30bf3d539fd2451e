"""Requests to a model: a pluggable call per batch, with recovery from blocked, missing and damaged replies.

The call is any function ``prompt -> reply`` that pickles; tests and queries use
``echo``, which answers each numbered segment with itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.operators.batching import sentence_parts
from foliomill.operators.quality import check_placeholders

#: Segments from which a blocked one is tried in parts; rounds through the backup models.
LEAST_SPLIT, ROUNDS = 800, 3

Call = Callable[[str], str]
# How a numbered text begins, and the fence some models put around a reply.
_MARK = re.compile(r"^\s*\[\[(\d+)\]\]\s?", re.M)
_FENCE = re.compile(r"^```[a-zA-Z]*\s*|```\s*$")


class Blocked(Exception):
    """The model refused the request or cut its reply."""


class Unavailable(Exception):
    """A model that can't answer now: another one may."""


def echo(prompt: str) -> str:
    return prompt.rpartition("SEGMENTS:\n")[2]


#: Heads of a prompt's parts.
TERMS, BEFORE, SEGMENTS = "GLOSSARY:\n", "PREVIOUS PASSAGE (context only, do not output):\n", "SEGMENTS:\n"


def numbered_prompt(items: list[tuple[int, str]], glossary: str = "", context: str = "") -> str:
    body = "\n".join(f"[[{i}]] {t}" for i, t in items)
    parts = [head + part for head, part in ((TERMS, glossary), (BEFORE, context)) if part]
    return "\n\n".join([*parts, SEGMENTS + body]) if parts else body


def numbered_reply(reply: str) -> dict[int, str]:
    """Segments of a reply; the last one of a number counts, text before the first is dropped."""
    _, *parts = _MARK.split(_FENCE.sub("", reply.strip()))
    return {int(number): " ".join(text.split()) for number, text in zip(parts[::2], parts[1::2])}


@dataclass(frozen=True)
class Term:
    """A glossary rule: its line goes with the requests its term stands in."""

    source: str
    line: str

    def stands_in(self, text: str) -> bool:
        plain = lambda x: x.replace("’", "'")
        return re.search(rf"(?<![\w']){re.escape(plain(self.source))}(?!\w)", plain(text)) is not None


@dataclass(frozen=True)
class Piece:
    """A text that is asked for: ``path`` is its item's number and, of a part, the numbers of the parts it lies in."""

    path: tuple[int, ...]
    text: str

    @property
    def number(self) -> int:
        return self.path[-1]


def cascade(models: list[Call], rounds: int = ROUNDS) -> Call:
    """Backup models in order, round by round, until one answers; reasoning blocks are taken off."""

    def call(prompt: str) -> str:
        for _ in range(rounds):
            for model in models:
                try:
                    reply = re.sub(r"(?s)<think>.*?</think>", "", model(prompt)).strip()
                except Unavailable:
                    continue
                if reply:
                    return reply
        raise Blocked("no backup model answered")

    return call


def translate_items(call: Call, items: list[tuple[int, str]], terms: Sequence[Term] = (), context: str = "", backup: Call | None = None) -> dict[int, str]:
    """{id: translation} of every item.

    Batches wait in a list.  What a reply lacks goes back as a smaller batch:
    the missing ones of it, the halves of one without any answer (a blocked
    one too), the sentence-aligned parts of a single long text.  A single text
    that can't be cut goes to the backup, and keeps its source if nothing helps.
    """
    made: dict[tuple[int, ...], str] = {}
    waiting = [[Piece((i,), t) for i, t in items]] if items else []
    while waiting:
        batch = waiting.pop()
        answered = _asked(call, batch, terms, context)
        made |= {p.path: answered[p.number] for p in batch if answered.get(p.number)}
        left = [p for p in batch if p.path not in made]
        if not left:
            continue
        if len(left) < len(batch):
            waiting.append(left)
        elif len(left) > 1:
            waiting += [left[len(left) // 2 :], left[: len(left) // 2]]
        elif len(parts := _parts(left[0])) > 1:
            waiting.append(parts)
        else:
            made[left[0].path] = _asked(backup, left, terms, context).get(left[0].number) or left[0].text
    out: dict[int, list[str]] = {}
    for path in sorted(made):
        out.setdefault(path[0], []).append(made[path])
    return {i: " ".join(texts) for i, texts in out.items()}


def _asked(call: Call | None, batch: list[Piece], terms: Sequence[Term], context: str) -> dict[int, str]:
    """What a call answers to a batch; nothing where it refuses."""
    if call is None:
        return {}
    body = "\n".join(p.text for p in batch)
    glossary = "\n".join(t.line for t in terms if t.stands_in(body))
    try:
        return numbered_reply(call(numbered_prompt([(p.number, p.text) for p in batch], glossary, context)))
    except Blocked:
        return {}


def _parts(piece: Piece) -> list[Piece]:
    texts = sentence_parts(piece.text, len(piece.text) // 2 + 1) if len(piece.text) >= LEAST_SPLIT else [piece.text]
    return [Piece((*piece.path, n), t) for n, t in enumerate(texts, 1)]


def translated_units(requests: DataFrame, call: Call, backup: Call | None = None) -> DataFrame:
    """(seg_id, part_no, translation) of (items, terms, context) requests, as ``requests_of`` makes them.

    A translation with damaged placeholders is asked for once more, alone, and
    replaced only if the second one is whole.
    """
    schema = pa.schema([("seg_id", pa.int64()), ("part_no", pa.int32()), ("translation", pa.string())])
    tags = re.compile(r"<x(\d+)/?>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for items, terms, context in zip(*(c.to_pylist() for c in batch.columns)):
                texts = list(enumerate((x["unit"] for x in items), 1))
                terms = [Term(t["source"], t["line"]) for t in terms or ()]
                got = translate_items(call, texts, terms, context or "", backup)
                damaged = [(i, t, known) for i, t in texts if check_placeholders(got[i], known := {int(k) for k in tags.findall(t)})]
                for i, text, known in damaged:
                    second = translate_items(call, [(i, text)], terms, "", backup)[i]
                    got[i] = got[i] if check_placeholders(second, known) else second
                rows += [(x["seg_id"], x["part_no"], got[i]) for i, x in enumerate(items, 1)]
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

    return requests.select("items", "terms", "context").mapInArrow(run, "seg_id long, part_no int, translation string")


def requests_of(units: DataFrame, plan: DataFrame, relevant: DataFrame | None = None, contexts: DataFrame | None = None) -> DataFrame:
    """(book_id, doc_no, chunk, items, terms, context): units of each planned request in order, what they need beside.

    ``relevant`` (seg_id, ord, source, line) has the rules of each text,
    ``contexts`` (book_id, doc_no, chunk, context) the passage before a request.
    """
    key = ["book_id", "doc_no", "chunk"]
    item = F.struct("seg_no", "part_no", "seg_id", "unit")
    rows = units.join(plan, "seg_id").groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("sorted"))
    rows = rows.withColumn("items", F.transform("sorted", lambda x: F.struct(x["seg_id"].alias("seg_id"), x["part_no"].alias("part_no"), x["unit"].alias("unit")))).drop("sorted")
    if relevant is not None:
        terms = units.select("seg_id", "book_id", "doc_no").distinct().join(plan, "seg_id").join(relevant.select("seg_id", "ord", "source", "line"), "seg_id")
        rows = rows.join(terms.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("ord", "source", "line"))).alias("terms")), key, "left")
    else:
        rows = rows.withColumn("terms", F.lit(None).cast("array<struct<ord:int,source:string,line:string>>"))
    if contexts is not None:
        return rows.join(contexts.select(*key, "context"), key, "left")
    return rows.withColumn("context", F.lit(None).cast("string"))


def prompt_of(requests: DataFrame) -> DataFrame:
    """(book_id, doc_no, chunk, prompt): the text of each request; parts that are empty are left out."""
    body = F.array_join(F.transform("items", lambda x, i: F.concat(F.lit("[["), (i + 1).cast("string"), F.lit("]] "), x["unit"])), "\n")
    lines = F.array_join(F.transform("terms", lambda x: x["line"]), "\n")
    part = lambda head, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(head), c))
    extra = F.concat_ws("\n\n", part(TERMS, lines), part(BEFORE, F.col("context")))
    prompt = F.when(extra == "", body).otherwise(F.concat(extra, F.lit("\n\n" + SEGMENTS), body))
    return requests.select("book_id", "doc_no", "chunk", prompt.alias("prompt"))
