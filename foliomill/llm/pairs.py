"""Problem 5: defective prompt and response pairs.

Prompt and response are joined by the hash of the prompt; each pair then gets
at most one defect, tested in this order:

``empty``       nothing visible once placeholders, markers and invisible
                characters are gone;
``refusal``     a sentence of the response aligns (longest common subsequence)
                with a refusal template and holds little else; it stands at
                the beginning, whatever follows, or makes up half of the
                response.  Templates that don't speak of the task ("I can't
                help with that") must make up nearly all of it.  Templates
                cover the eight languages of ``TEMPLATES``;
``copy``        prompt and response share nearly all word shingles and have a
                longest common subsequence of nearly the prompt's length;
``wrong_lang``  a character-trigram classifier prefers another language;
``truncated``   far fewer words and sentences than the prompt, more so where
                the response breaks off without an ending.

The classifier is fitted on at most ``TRAIN_ROWS`` labelled rows (the rows with
the smallest hash of their id); everything else covers all rows.

Defined cases: a null response is empty; entries whose key matches no segment
are left out; rows are judged one by one, repeated ones too; a null
``target_lang`` or one the classifier does not know is never ``wrong_lang``;
prompts of up to 25 letters are never copies; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm._codes import SEP, chunks, code_points, joined
from foliomill.plans.runtime import materialize, small

#: Labelled rows the language classifier is fitted on, at most.
TRAIN_ROWS = 20_000
#: Letters a prompt must have more than, to be a copy.
COPY_LETTERS = 25
#: Letters a label in front of a copy may have.
LABEL = 24
#: Entries from which a prompt's entries are joined apart.  There are at most rows / HOT_ROWS such prompts.
HOT_ROWS = 200_000
#: Trigram buckets of the classifier.
BUCKETS = 1 << 16

# Refusal templates; an apology may stand before each.
TEMPLATES = {
    "en": ["i can't translate this passage", "i cannot translate this text", "i am not able to help with that request", "i'm unable to assist with this", "i won't reproduce this content", "this text cannot be processed", "providing this translation would go against my guidelines", "the passage may be protected so i can only offer a summary", "i must decline", "i can't help with that", "i am not able to translate this passage"],
    "de": ["ich kann diesen abschnitt nicht übersetzen", "kann ich diesen abschnitt nicht übersetzen", "darf ich diesen inhalt nicht wiedergeben", "muss ich die übersetzung ablehnen", "ist es mir nicht möglich dabei zu helfen", "dieser text kann nicht verarbeitet werden"],
    "fr": ["je ne peux pas traduire ce passage", "je préfère ne pas reproduire ce texte", "il m'est impossible de répondre à cette demande", "ce contenu ne peut être traité", "je dois refuser de traduire ce texte"],
    "es": ["no puedo traducir este fragmento", "debo rechazar la petición de traducir el texto", "este contenido no se puede procesar", "no me es posible ayudar con esta solicitud"],
    "it": ["non posso tradurre questo brano", "non sono in grado di aiutare con questa richiesta", "questo contenuto non può essere elaborato", "devo rifiutare di tradurre il testo", "preferisco non riprodurre questo testo"],
    "pt": ["não posso traduzir este trecho", "não consigo ajudar com este pedido", "este conteúdo não pode ser processado", "devo recusar a tradução deste texto", "prefiro não reproduzir este texto"],
    "pl": ["nie mogę przetłumaczyć tego fragmentu", "nie jestem w stanie pomóc w tej sprawie", "ta treść nie może zostać przetworzona", "muszę odmówić tłumaczenia tego tekstu"],
    "ru": ["я не могу перевести этот отрывок", "я не могу помочь с этим запросом", "этот текст не может быть обработан", "я вынужден отказаться от перевода этого текста"],
}
# How refusals begin.
APOLOGIES = {
    "en": "i'm sorry but sorry i apologize unfortunately as a language model i must decline",
    "de": "es tut mir leid aber entschuldigung leider als sprachmodell ich bedaure",
    "fr": "je suis désolé mais désolée désolé malheureusement je m'excuse en tant que modèle de langage",
    "es": "lo siento pero disculpe lamentablemente como modelo de lenguaje",
    "it": "mi dispiace ma chiedo scusa purtroppo in quanto modello linguistico spiacente",
    "pt": "sinto muito mas peço desculpa infelizmente como modelo de linguagem lamento",
    "pl": "przepraszam ale niestety przykro mi jako model językowy",
    "ru": "извините но к сожалению простите как языковая модель",
}

_HIDDEN = re.compile("</?x\\d+\\s*/?>|\\[\\[[^\\[\\]]*\\]\\]|[\x00-\x08\x0b-\x1f\x7f-\x9f\xad͏؜ᅟᅠ᠎​-‏‪-‮⁠-⁯︀-️﻿ㅤ]")
_BREAK = re.compile(r"(?<=[^\W\d_])[-‐¬\xad]\s+(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
_STOP = re.compile(r"(?<![.!?…．！？])[.!?…．！？]++[\"'”“»«’)\]]*+(?=\s|$)")
_SENTENCE = re.compile(r"(?<=[.!?…．！？])[\"'”“»«’)\]]*\s+")
_ENDS = re.compile(r"[.!?…．！？][\"'”“»«’)\]]*$")


def visible(text: str | None) -> str:
    """What a reader sees: without placeholders, markers and invisible characters, blanks collapsed."""
    return " ".join(_HIDDEN.sub(" ", text.replace("\xad", "")).split()) if text else ""


def words(text: str) -> list[str]:
    return _WORD.findall(text.casefold())


_VOCABULARY = {lang: frozenset(w for t in ts for w in words(t)) | frozenset(words(APOLOGIES[lang])) for lang, ts in TEMPLATES.items()}
# Templates that say nothing of a text or request, so that a person in a story may say them.
GENERAL = {"i must decline", "i can't help with that", "ist es mir nicht möglich dabei zu helfen", "nie jestem w stanie pomóc w tej sprawie"}
_ALIGNED = [(lang, words(t), t in GENERAL) for lang, ts in TEMPLATES.items() for t in ts]
_TEMPLATES_OF: dict[str, list[int]] = {}
for _i, (_, _template, _) in enumerate(_ALIGNED):
    for _w in set(_template):
        _TEMPLATES_OF.setdefault(_w, []).append(_i)


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit parallelism."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for w in b:
        m = row & at.get(w, 0)
        row = (row + m | row - m) & full
    return len(a) - row.bit_count()


#: Share of a template's words that must align; share of its sentence, or of the whole response, in a template's and apology's words.
ALIGNED, OF_SENTENCE, OF_ANSWER = 0.75, 0.6, 0.8


def _refuses(said: list[str]) -> str | None:
    """Whether a sentence is a refusal: "task" if it speaks of the task, else "general"."""
    met: dict[int, int] = {}
    for w in set(said):
        for i in _TEMPLATES_OF.get(w, ()):
            met[i] = met.get(i, 0) + 1
    found = None
    for i, n in met.items():
        lang, template, general = _ALIGNED[i]
        if n < ALIGNED * len(set(template)) or (found and general):
            continue
        known = sum(w in _VOCABULARY[lang] for w in said)
        if known >= OF_SENTENCE * len(said) and lcs(template, said) >= ALIGNED * len(template):
            found = "general" if general else "task"
    return found


def is_refusal(answer: str) -> bool:
    """Whether a response, as a reader sees it, is a refusal."""
    sentences = [w for x in _SENTENCE.split(answer) if (w := words(x))]
    whole = [w for s in sentences for w in s]
    if len(whole) < 3:
        return False
    if _refuses(whole) and any(sum(w in v for w in whole) >= OF_ANSWER * len(whole) for v in _VOCABULARY.values()):
        return True
    tasks = [_refuses(s) == "task" for s in sentences]
    # an apology may be a sentence of its own
    return any(tasks[:2]) or sum(len(s) for s, task in zip(sentences, tasks) if task) >= len(whole) / 2


def is_copy(prompt: list[str], answer: list[str]) -> bool:
    """Shingle containment and longest common subsequence of at least nine tenths."""
    if not prompt or not 0.9 * len(prompt) <= len(answer) <= 1.1 * len(prompt) + 6:
        return False
    if len(prompt) >= 3:
        have = set(zip(answer, answer[1:], answer[2:]))
        mine = list(zip(prompt, prompt[1:], prompt[2:]))
        if sum(s in have for s in mine) < 0.85 * len(mine):
            return False
    return lcs(prompt, answer) >= 0.92 * len(prompt)


def is_truncated(prompt: str, answer: str) -> bool:
    """Whether the response stops well before the prompt is covered."""
    prompt = _BREAK.sub("", prompt)
    n, m = len(prompt.split()), len(answer.split())
    if n < 4:
        return False
    share = max(m / n, len(answer) / len(prompt))
    if share >= 0.8:
        return False
    ended = bool(_ENDS.search(prompt))
    abrupt = ended and (not _ENDS.search(answer) or bool(re.search(r"(…|\.\.\.)\S?$", answer)) and not re.search(r"(…|\.\.\.)\S?$", prompt))
    if share < 0.48 or abrupt and share < 0.78:
        return True
    stops = [x.end() for x in _STOP.finditer(prompt)]
    lost = len(stops) - len(_STOP.findall(answer))
    if lost < 1:
        return False
    tail = len(prompt[stops[-1 - lost] :].split()) if len(stops) > lost else n
    if lost <= 2 and tail <= 6 and max(m / max(1, n - tail), share) >= 0.68:
        return False  # a short last sentence is not "the rest"
    return share < (0.62 if len(stops) < 5 else 0.74)


class Languages:
    """Naive Bayes over hashed character trigrams."""

    def __init__(self, names: list[str], weights: np.ndarray):
        self.names, self.weights = names, weights

    @staticmethod
    def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes = code_points(joined(texts).lower())
        row = np.cumsum(codes == ord(SEP))
        letter = (codes > 96) & ((codes < 123) | (codes > 191)) & ((codes < 0x2000) | (codes > 0x2BFF)) & (codes != ord(SEP))
        c = np.where(letter, codes, 32).astype(np.uint32)
        key = ((c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1]) * np.uint32(0x85EBCA77) ^ c[2:]) * np.uint32(0xC2B2AE3D)
        keep = letter[1:-1] & (row[:-2] == row[2:])
        return row[:-2][keep], (key >> np.uint32(16))[keep].astype(np.int64)

    @classmethod
    def fit(cls, texts: list[str], labels: list[str]) -> Languages:
        names = sorted(set(labels))
        counts = np.full((len(names), BUCKETS), 0.3)
        for k, name in enumerate(names):
            own = [t for t, x in zip(texts, labels) if x == name]
            for a, b in chunks([len(t) for t in own]):
                counts[k] += np.bincount(cls._trigrams(own[a:b])[1], minlength=BUCKETS)
        return cls(names, np.log(counts / counts.sum(1, keepdims=True)).T.astype(np.float32).copy())

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(mean log probability per language, trigrams) of each text."""
        row, key = self._trigrams(texts)
        n = np.bincount(row, minlength=len(texts))
        sums = np.zeros((len(texts), len(self.names)))
        for k in range(len(self.names)):
            sums[:, k] = np.bincount(row, self.weights[key, k], len(texts))
        return sums / np.maximum(n, 1)[:, None], n


def language_model(segments: DataFrame, books: DataFrame, rows: int = TRAIN_ROWS) -> Languages:
    """Fitted on the texts of books whose language is stated; ``rows`` bounds the sample."""
    langs = books.select("book_id", "lang").filter("lang is not null").groupBy("book_id").agg(F.min("lang").alias("row_lang"))
    sample = segments.filter(F.length("text") > 40).select("book_id", "seg_id", "text").join(langs, "book_id").select("row_lang", "text", F.xxhash64("seg_id").alias("h"))
    # thinned by the same hash first, so that tasks don't each send their own ``rows`` smallest to the driver
    keep = max(1, segments.count() // (4 * rows))
    got = sample.filter(F.pmod(F.xxhash64(F.col("h")), F.lit(keep)) == 0).orderBy("h", "text").limit(rows).select("row_lang", "text").toPandas()
    return Languages.fit([visible(t) for t in got["text"]], got["row_lang"].tolist())


#: Mean log probability per trigram by which another language must win.
MARGIN = 0.25


def judge(prompts: list[str], answers: list[str | None], targets: list[str | None], model: Languages) -> list[str | None]:
    """The defect of each pair, or None."""
    shown = [visible(a) for a in answers]
    scores, n = model.scores(shown)
    index = {name: k for k, name in enumerate(model.names)}
    best = scores.max(1) if len(model.names) else np.zeros(len(shown))
    out: list[str | None] = []
    for i, (prompt, answer, target) in enumerate(zip(prompts, shown, targets)):
        if not answer:
            out.append("empty")
            continue
        if is_refusal(answer):
            out.append("refusal")
            continue
        said = words(answer)
        source = visible(prompt)
        asked = words(source)
        tight, other = "".join(asked), "".join(said)
        common = len(set(asked) & set(said)) >= 0.6 * len(set(asked)) > 0
        if tight and other.endswith(tight) and len(other) - len(tight) <= LABEL or common and is_copy(asked, said):
            out.append("copy" if sum(c.isalpha() for c in source) > COPY_LETTERS else None)
            continue
        k = index.get(target)
        if k is not None and n[i] >= 12 and best[i] - scores[i, k] > MARGIN + 3.0 / n[i]:
            out.append("wrong_lang")
            continue
        out.append("truncated" if is_truncated(source, answer) else None)
    return out


def joined_pairs(segments: DataFrame, cache: DataFrame) -> DataFrame:
    """(cache_id, target_lang, prompt, answer) of entries whose key matches a segment."""
    prompts = segments.filter("text is not null").select(F.col("book_id").alias("b"), F.col("doc_no").alias("d"), F.sha1(F.encode("text", "utf-8")).alias("h"), F.col("text").alias("prompt"))
    prompts = prompts.groupBy("b", "d", "h").agg(F.min("prompt").alias("prompt"))
    entries = cache.select(F.col("book_id").alias("b"), F.col("doc_no").alias("d"), F.lower("src_sha1").alias("h"), F.col("cache_id").cast("long").alias("row_id"), "target_lang", F.col("translation").alias("answer"))
    return _joined(entries, prompts, ["b", "d", "h"]).select("row_id", "target_lang", "prompt", "answer")


def _joined(entries: DataFrame, prompts: DataFrame, key: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """entries join prompts; keys that very many entries share are joined apart, to a broadcast of their few prompts."""
    hot = materialize(entries.groupBy(*key).count().filter(F.col("count") > hot_rows).select(*key), "hot-keys")
    if hot.isEmpty():
        return entries.join(prompts, key)
    usual = entries.join(F.broadcast(hot), key, "left_anti").join(prompts, key)
    few = small(materialize(prompts.join(F.broadcast(hot), key, "left_semi"), "hot-prompts"), 10_000)
    return usual.unionByName(entries.join(F.broadcast(hot), key, "left_semi").join(few, key))


def defective_pairs(segments: DataFrame, cache: DataFrame, books: DataFrame) -> DataFrame:
    """(cache_id, defect): defective entries and their one defect."""
    model = segments.sparkSession.sparkContext.broadcast(language_model(segments, books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, targets, prompts, answers = (c.to_pylist() for c in batch.columns)
            for a, b in chunks([len(p) + len(x or "") for p, x in zip(prompts, answers)]):
                bad = [(i, d) for i, d in zip(ids[a:b], judge(prompts[a:b], answers[a:b], targets[a:b], model.value)) if d]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in bad], pa.int64()), pa.array([d for _, d in bad], pa.string())], names=["cache_id", "defect"])

    return joined_pairs(segments, cache).mapInArrow(run, "cache_id long, defect string").distinct()


def reported_defects(defects: DataFrame, segments: DataFrame, cache: DataFrame, run_stats: DataFrame) -> DataFrame:
    """(defect, entries, reported): how many defective entries a run over their document listed.

    A run lists ``path#seg_no: message``; the lists miss cases and hold false ones.
    """
    listed = run_stats.select("book_id", "doc_no", F.explode(F.concat(F.coalesce("unchanged", F.array()), F.coalesce("incomplete", F.array()))).alias("item"))
    listed = listed.select("book_id", "doc_no", F.regexp_extract("item", r"#(\d+):", 1).cast("int").alias("seg_no")).filter("seg_no is not null").distinct().withColumn("listed", F.lit(1))
    where = segments.filter("text is not null").select("book_id", "doc_no", "seg_no", F.sha1(F.encode("text", "utf-8")).alias("src_sha1")).join(listed, ["book_id", "doc_no", "seg_no"])
    known = where.select("book_id", "doc_no", "src_sha1", "listed").distinct()
    rows = defects.join(cache.select("cache_id", "book_id", "doc_no", "src_sha1").distinct(), "cache_id").join(known, ["book_id", "doc_no", "src_sha1"], "left")
    return rows.groupBy("defect").agg(F.countDistinct("cache_id").alias("entries"), F.count_distinct(F.when(F.col("listed") == 1, F.col("cache_id"))).alias("reported"))
