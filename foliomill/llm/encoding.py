"""Problem 4: text that was decoded with the wrong character encoding.

Adjacent character pairs are counted over the whole corpus.  A pair is worth
what it brings to the mutual information of neighbouring characters,
``p(a,b) * log2(p(a,b) / (p(a) * p(b)))``; pairs that wrong decoding makes bring
next to nothing.  Per text, maximum-scoring segments over these values isolate
improbable runs, and only inside them inverse mappings (encode again with the
encoding that was used, decode with the right one) are tried, again and again
until none holds any more.  A mapping holds if the run's pairs become markedly more
probable, and more so than by replacing look-alike letters.

Defined cases: null and empty texts are never affected; a text with U+FFFD is
affected but not repairable there; repeated rows are reported each; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm._codes import chunks, code_points
from foliomill.llm._lookalike import prototypes

#: Pairs that bring less than this (per million pairs of the corpus) are improbable.
WEAK = 120.0
#: Bits a text's pairs must become more probable in all: for mappings to UTF-8 and to single-byte encodings.
GAIN_UTF8, GAIN_BYTE = 5.0, 10.0
#: Log probability (per million pairs) from which a pair counts as usual.
USUAL = 3.0
#: Bits a word gains besides for each byte that well-formed UTF-8 takes up, which is rare by chance.
WELL_FORMED = 6.0
# Characters that stand by themselves in ordinary text; alone they prove nothing.
ORDINARY = frozenset("„“”‚‘’«»—–…€£§¬|°")
# Dashes and quotes that stand next to a capital in ordinary text, so that one pair of them may be UTF-8 by chance.
MARKS = frozenset("„“”‚‘’«»—–…")
#: Bits a pair that a mapping makes must lie above the garbled one, where this is frequent itself.
MAPPED = 3.0
#: Words whose weights are kept.
KEPT_WORDS = 300_000
#: The last code point of the basic plane, a noncharacter; no encoding here has characters beyond.
LAST = 0xFFFF
#: Beyond so many distinct characters the pair table is searched instead of indexed.
DENSE = 4096

# Fixed values: (encoding that was used, right encoding) of the inverse mappings.
MAPPINGS = [(b, "utf-8") for b in ("cp1252", "cp1251", "cp437", "cp866", "mac_roman", "koi8_r", "cp850", "cp1250", "iso8859_2", "cp852", "iso8859_15")] + [
    ("cp1251", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("koi8_r", "cp1252"), ("cp1250", "cp1252"), ("iso8859_2", "cp1252"), ("cp866", "cp1252"),
    ("cp1252", "cp1251"), ("koi8_r", "cp1251"), ("cp866", "cp1251"), ("mac_roman", "cp1251"), ("cp437", "cp1251"),
    ("cp1251", "koi8_r"), ("cp1252", "koi8_r"), ("cp866", "koi8_r"),
    ("cp1252", "cp1250"), ("cp1252", "iso8859_2"), ("iso8859_2", "cp1250"), ("cp1250", "iso8859_2"), ("cp437", "cp1250"), ("cp1251", "cp1250"), ("cp437", "iso8859_2"), ("cp852", "cp1250"),
    ("cp1251", "cp866"), ("cp1252", "cp866"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp1252", "cp852"), ("cp1251", "mac_roman"),
]


def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (pair, n) of one task; a pair is ``first << 21 | second``."""
    total: dict[int, int] = {}
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for a, b in chunks([len(t) for t in texts]):
            codes = code_points("\n".join(texts[a:b]).lower())
            seen = np.flatnonzero(np.bincount(codes))
            index = np.zeros(int(seen[-1]) + 1 if len(seen) else 1, np.int64)
            index[seen] = np.arange(len(seen))
            at = index[codes]
            if len(seen) <= DENSE:
                n = np.bincount(at[:-1] * len(seen) + at[1:])
                which = np.flatnonzero(n)
                n = n[which]
            else:
                which, n = np.unique(at[:-1] * len(seen) + at[1:], return_counts=True)
            for x, y, c in zip(seen[which // len(seen)].tolist(), seen[which % len(seen)].tolist(), n.tolist()):
                total[x << 21 | y] = total.get(x << 21 | y, 0) + c
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["pair", "n"])


class PairModel:
    """Pair counts of the corpus: what a pair brings, and how probable it is."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray):
        order = np.argsort(pairs)
        self.pairs, n = pairs[order], counts[order].astype(float)
        total = max(n.sum(), 1.0)
        a, b = self.pairs >> 21, self.pairs & (1 << 21) - 1
        self.chars = np.unique(np.concatenate((a, b, [10, 32])))
        left = np.bincount(np.searchsorted(self.chars, a), n, len(self.chars))
        right = np.bincount(np.searchsorted(self.chars, b), n, len(self.chars))
        pmi = np.log2(n * total / (left[np.searchsorted(self.chars, a)] * right[np.searchsorted(self.chars, b)]))
        self.brings = (np.maximum(n * pmi, 0) / total * 1e6).astype(np.float32)
        self.logs = np.log2(n / total * 1e6 + 0.05).astype(np.float32)
        self.floor = float(np.log2(0.05))
        self._prepared = False

    def prepare(self) -> PairModel:
        if not self._prepared:
            self._prepared = True
            self.log = dict(zip((chr(p >> 21) + chr(p & (1 << 21) - 1) for p in self.pairs.tolist()), self.logs.tolist()))
            self.log_chars = {chr(c) for c in self.chars.tolist()}
            self.dense = None
            if len(self.chars) <= DENSE:
                k = len(self.chars)
                self.index = np.full(0x110000, k, np.int32)
                self.index[self.chars] = np.arange(k)
                self.dense = np.zeros((k + 1, k + 1), np.float32)
                self.dense_log = np.full((k + 1, k + 1), self.floor, np.float32)
                at = self.index[self.pairs >> 21], self.index[self.pairs & (1 << 21) - 1]
                self.dense[at], self.dense_log[at] = self.brings, self.logs
        return self

    def value(self, codes: np.ndarray) -> np.ndarray:
        """What each adjacent pair brings."""
        return self.value2(codes[:-1], codes[1:])

    def value2(self, a: np.ndarray, b: np.ndarray, what: str = "dense") -> np.ndarray:
        if self.dense is not None:
            return getattr(self, what)[self.index[a], self.index[b]]
        key = a.astype(np.int64) << 21 | b
        i = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[i] == key, (self.brings if what == "dense" else self.logs)[i], 0 if what == "dense" else self.floor)

    def log2(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.value2(a, b, "dense_log")


@lru_cache(None)
def _bytes_of(used: str) -> dict[str, int]:
    """Character -> byte; bytes an encoding leaves undefined may stand as control characters."""
    out = {}
    for i in range(256):
        try:
            out[bytes([i]).decode(used)] = i
        except UnicodeDecodeError:
            pass
    for i in range(0x80, 0x100 if used == "cp1252" else 0xA0):
        out.setdefault(chr(i), i)
    return out


@lru_cache(None)
def _chars_of(right: str) -> list[str]:
    """Byte -> character, blanks where there is none."""
    return [bytes([i]).decode(right, "replace").replace("\ufffd", " ") for i in range(256)]


def _raw(run: str, used: str) -> bytes | None:
    table = _bytes_of(used)
    try:
        return bytes([table[c] for c in run])
    except KeyError:
        return None


def inverse(run: str, used: str, right: str, raw: bytes | None = None) -> str | None:
    """The run encoded with ``used`` (``raw``, if at hand) and decoded with ``right``; None where that can't be."""
    raw = _raw(run, used) if raw is None else raw
    if raw is None:
        return None
    if right == "utf-8":
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return None
    new = "".join(map(_chars_of(right).__getitem__, raw))
    return new if new.count(" ") == run.count(" ") and new.replace("\xa0", "x").isprintable() else None


@lru_cache(None)
def _byte_lut(used: str) -> np.ndarray:
    """Code point, up to the last one of the basic plane, -> byte; 256 where there is none."""
    out = np.full(LAST + 1, 256, np.uint16)
    for c, i in _bytes_of(used).items():
        out[ord(c)] = i
    return out


@lru_cache(None)
def _char_lut(right: str) -> np.ndarray:
    """Byte -> small letter of its character; 0 where there is none (256 stands for no byte)."""
    chars = _chars_of(right)
    return np.array([ord(c.lower()[0]) if i < 128 or c != " " and (c == "\xa0" or c.isprintable()) else 0 for i, c in enumerate(chars)] + [0], np.uint32)


@lru_cache(1)
def _small() -> np.ndarray:
    """Code point -> that of its small letter."""
    return np.fromiter((ord(chr(i).lower()[0]) for i in range(0x110000)), np.uint32, 0x110000)


def _words(text: str) -> list[str]:
    """Words with a character beyond ASCII."""
    return [w for w in text.replace("\n", " ").replace("\t", " ").split(" ") if not w.isascii()]


def _votes(word: str) -> bool:
    """Whether a word is long enough to prove anything."""
    return len(word) > 2 or sum(c.isalpha() for c in word) > 1


def _by_chance(word: str, new: str) -> bool:
    """Whether the word's one UTF-8 character may be a letter beside a dash or quote."""
    if len(word) - len(new) != 1:
        return False
    at = next(i for i, c in enumerate(word) if c > "\x7f")
    inside = at > 0 and word[at - 1].isalnum() and word[at + 2 : at + 3].isalnum()
    return not inside and not MARKS.isdisjoint(word[at : at + 2])


def _rises(word: str) -> int:
    """Places where a capital follows a small letter, and a capital at the start."""
    return sum(a.islower() and b.isupper() for a, b in zip(word, word[1:])) + word[:1].isupper()


class Repairer:
    def __init__(self, model: PairModel):
        self.model = model.prepare()
        self.tries = lru_cache(200_000)(self._tries)
        self.weights: dict[str, np.ndarray | None] = {}

    def worth(self, word: str, most: float = np.inf) -> float:
        """Sum of log probabilities, above the usual and up to ``most``, of the pairs with a non-ASCII character."""
        s = f" {word.lower()} "
        get, low = self.model.log.get, self.model.floor
        return sum(min(most, get(s[i : i + 2], low) - USUAL) for i in range(len(s) - 1) if s[i] > "\x7f" or s[i + 1] > "\x7f")

    def _full(self, word: str) -> float:
        """Like ``worth``, over all pairs."""
        s = f" {word.lower()} "
        get, low = self.model.log.get, self.model.floor
        return sum(get(s[i : i + 2], low) - USUAL for i in range(len(s) - 1))

    def _tries(self, word: str) -> tuple[list[tuple[float, str] | None], float, float, np.ndarray]:
        """Gain and result of each mapping, the gain of replacing look-alikes, the same over all pairs, and the mappings' gains within bounds."""
        before, out = self.worth(word), []
        pairs = sum(max(a, b) > "\x7f" for a, b in zip(f" {word}", f"{word} "))
        odd = before < 0.0 or pairs < 3
        raws = {used: _raw(word, used) for used in dict(MAPPINGS)}
        for used, right in MAPPINGS:
            new = None if raws[used] is None else inverse(word, used, right, raws[used])
            if new is None or new == word:
                out.append(None)
            elif right == "utf-8":  # chance makes characters the corpus doesn't know
                known = all(c < "\x80" or c.lower() in self.model.log_chars or c in _bytes_of("cp1252") for c in new)
                # frequent garble must not vouch for itself
                least = before if _by_chance(word, new) else self.worth(word, 0.0)
                out.append((self.worth(new) - least + WELL_FORMED * (len(word) - len(new)), new) if known else None)
            elif all(x == y or x in ORDINARY for x, y in zip(word, new)):
                out.append((0.0, new))
            else:
                gain = self.worth(new) - before
                out.append((gain - 10.0 * (_rises(new) > _rises(word)) if odd or gain >= MAPPED * pairs else 0.0, new))
        plain = prototypes()[code_points(word.replace("\xa0", " "))]
        plain = plain[plain != 0].tobytes().decode("utf-32-le")
        gains = np.array([max(-3.0, min(40.0, t[0])) if t else -1.0 for t in out])
        return out, *((self.worth(plain) - before, self._full(plain) - self._full(word)) if plain != word else (0.0, 0.0)), gains

    def weigh(self, words: set[str]) -> None:
        """Into ``weights``: each word's gain by the single-byte mappings, infinite where it may be UTF-8; None where no mapping gains."""
        new = [w for w in words if w not in self.weights]
        if len(self.weights) + len(new) > KEPT_WORDS:
            self.weights.clear()
            new = list(words)
        self.weights |= dict.fromkeys(new)
        new = [w for w in new if _votes(w)]
        for start, stop in chunks([len(w) for w in new]):
            self._weigh(new[start:stop])

    def _weigh(self, words: list[str]) -> None:
        codes = code_points(" " + " ".join(words) + " ")
        at = np.flatnonzero((codes[:-1] > 127) | (codes[1:] > 127))
        which = (np.cumsum(codes == 32) - 1)[at]
        total = lambda x: np.bincount(which, x, len(words))
        first, second = codes[at], codes[at + 1]
        a, b = _small()[first], _small()[second]
        logs = self.model.log2(a, b)
        before, pairs = total(logs - USUAL), total(None)
        utf8 = np.zeros(len(words), bool)
        gains = np.zeros((len(words), len(MAPPINGS)), np.float32)
        for k, (used, right) in enumerate(MAPPINGS):
            x, y = _byte_lut(used)[np.minimum(first, LAST)], _byte_lut(used)[np.minimum(second, LAST)]
            if right == "utf-8":
                lead = (x >= 0xC2) & (x <= 0xF4)
                # no lead without its follower, no follower after ASCII, and nothing that has no byte
                wrong = (x > 255) | (y > 255) | (lead & ((y < 0x80) | (y > 0xBF))) | ((x < 0x80) & (y >= 0x80) & (y < 0xC2))
                utf8 |= (total(lead) > 0) & (total(wrong) == 0)
            else:
                c, d = _char_lut(right)[x], _char_lut(right)[y]
                gain = np.where(total((c == 0) | (d == 0)) > 0, -1.0, total(self.model.log2(c, d) - logs))
                gains[:, k] = np.where((before < 0) | (pairs < 3) | (gain >= MAPPED * pairs) | (gain < 0), np.clip(gain, -3.0, 40.0), 0.0)
        for i in np.flatnonzero(utf8 | (gains > 0).any(1)).tolist():
            self.weights[words[i]] = np.where(utf8[i], np.inf, gains[i])

    def _sure(self, word: str) -> bool:
        """Whether a mapping makes the word so much more probable that it needs no other evidence."""
        return self.weights.get(word) is not None and any(t and t[0] >= (GAIN_UTF8 if right == "utf-8" else GAIN_BYTE) for t, (_, right) in zip(self.tries(word)[0], MAPPINGS))

    def runs(self, text: str) -> list[tuple[int, int]]:
        """Maximum-scoring segments of improbable pairs, or of pairs far less probable than mapped, widened to whole words."""
        codes = code_points(text.lower() if len(text.lower()) == len(text) else text)
        wide = (codes[:-1] > 127) | (codes[1:] > 127)
        score = np.where(wide, np.log2((WEAK + 1) / (self.model.value(codes) + 1)), -1.0)
        self.weigh(set(_words(text)))
        for m in re.finditer(r"[^ \n\t]+", text):
            if not m[0].isascii() and self._sure(m[0]):
                own = slice(max(0, m.start() - 1), m.end())
                score[own] = np.where(wide[own], np.log2(WEAK + 1), score[own])
        out: list[list[int]] = []
        total, best, start, stop = 0.0, 0.0, 0, 0
        for i in np.flatnonzero(wide & (score > 0)).tolist():
            if out and total - (i - stop) > 0:  # the ASCII pairs between cost one each
                total -= i - stop
            else:
                total, best, start = 0.0, 0.0, i
                out.append([i, i + 2])
            total += float(score[i])
            stop = i + 1
            if total >= best:
                best, out[-1][1] = total, i + 2
        wider: list[tuple[int, int]] = []
        for a, b in out:
            done = wider[-1][1] if wider else 0
            if b <= done:
                continue
            while a > done and text[a - 1] not in " \n\t":
                a -= 1
            while b < len(text) and text[b] not in " \n\t":
                b += 1
            if wider and a <= wider[-1][1]:
                wider[-1] = (wider[-1][0], max(b, wider[-1][1]))
            else:
                wider.append((a, b))
        return wider

    def _best(self, votes: list[str], alone: bool = False) -> tuple[int | None, list[float]]:
        """(the mapping that holds for these words or None, each mapping's total); ``alone``: one word's gain may stand for them all."""
        got = [self.tries(w) for w in votes]
        if sum(g.max() for *_, g in got if g.max() > 0) < GAIN_UTF8:
            return None, []
        plain = max(sum(max(0.0, t[1]) for t in got), alone and sum(max(0.0, t[2]) for t in got))
        gains = np.array([g for *_, g in got])
        totals = np.maximum(gains.sum(0), gains.max(0) if alone else -np.inf).tolist()
        # well-formed UTF-8 is hardly ever chance, so these mappings come first
        which = max(range(len(MAPPINGS)), key=lambda k: (MAPPINGS[k][1] == "utf-8" and totals[k] >= GAIN_UTF8, totals[k]))
        holds = totals[which] >= (GAIN_UTF8 if MAPPINGS[which][1] == "utf-8" else GAIN_BYTE) and totals[which] > plain
        return which if holds else None, totals

    def _once(self, text: str) -> tuple[str, list[str]] | None:
        """The text after the best mapping of each improbable run: the whole text's, where the run has none that is markedly better."""
        runs = self.runs(text)
        words = [list(dict.fromkeys(_words(text[a:b]))) for a, b in runs]
        whole, _ = self._best([w for w in dict.fromkeys(w for run in words for w in run) if _votes(w)])
        out, last, used = [], 0, []
        inside = {w for own in words for w in own}
        home = {c for w in _words(text) if w not in inside for c in w} | {chr(c) for c in range(128)}
        for (a, b), own in zip(runs, words):
            # characters that stand in usual words of the text too need the whole text's evidence
            which, totals = self._best([w for w in own if _votes(w) and not home.issuperset(w)], alone=True)
            least = -3.0
            if whole is not None and (which is None or totals[whole] > totals[which] - GAIN_BYTE / 2):
                which, least = whole, -8.0
            if which is None:
                continue
            got = {w: self.tries(w)[0][which] for w in own}
            done = "".join([got[w][1] if got.get(w) and got[w][0] > least else w for w in re.split(r"([ \n\t])", text[a:b])])
            if done != text[a:b]:
                used.append(">".join(MAPPINGS[which]))
            out += [text[last:a], done]
            last = b
        return ("".join([*out, text[last:]]), list(dict.fromkeys(used))) if used else None

    def repair(self, text: str) -> tuple[str, str] | None:
        """(repaired text, mappings) of an affected text, None of others."""
        original, used = text, ["lost"] * ("\ufffd" in text)
        seen = {text}
        while (got := self._once(text)) is not None:
            text = got[0]
            used += got[1]
            if text in seen:  # mappings that undo each other
                break
            seen.add(text)
        if text == original and used[:1] != ["lost"]:
            return None
        return (text, ",".join(dict.fromkeys(used))) if used else None

    def candidates(self, texts: list[str]) -> np.ndarray:
        """Rows with words that some mapping makes more probable; words are weighed once, by whole-array arithmetic."""
        rows = [_words(t) for t in texts]
        self.weigh({w for words in rows for w in words})
        hit = []
        for i, (text, words) in enumerate(zip(texts, rows)):
            gains = [g for g in map(self.weights.get, words) if g is not None]
            if "\ufffd" in text or gains and np.maximum(gains, 0).sum(0).max() >= GAIN_BYTE * 0.99:
                hit.append(i)
        return np.array(hit, np.int64)


def pair_model(segments: DataFrame, text: str = "text") -> PairModel:
    """Counts over all texts; the table has a row per pair of characters in use, whatever the corpus' size."""
    rows = segments.select(F.col(text).alias("row_text")).filter("row_text is not null and row_text <> ''")
    counts = rows.mapInArrow(count_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    return PairModel(counts.column(0).to_numpy(), counts.column(1).to_numpy())


def repair_segments(segments: DataFrame, key: str = "seg_id", text: str = "text") -> DataFrame:
    """(key, repaired, mapping, lost): affected rows and their text as far as it can be had."""
    model = segments.sparkSession.sparkContext.broadcast(pair_model(segments, text))
    schema = pa.schema([("row_key", pa.int64()), ("repaired", pa.string()), ("mapping", pa.string()), ("lost", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = Repairer(model.value)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for a, b in chunks([len(t) for t in texts]):
                for i in repairer.candidates(texts[a:b]).tolist():
                    got = repairer.repair(texts[a + i])
                    if got:
                        rows.append((ids[a + i], got[0], got[1], "lost" in got[1].split(",")))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

    rows = segments.select(F.col(key).cast("long").alias("row_key"), F.col(text).alias("row_text")).filter("row_key is not null and row_text <> ''").filter(F.length("row_text") < F.octet_length("row_text"))
    return rows.mapInArrow(run, "row_key long, repaired string, mapping string, lost boolean").withColumnRenamed("row_key", key)
