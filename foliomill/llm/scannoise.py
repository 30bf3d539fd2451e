"""Problem 2: noise that scanning leaves in text, found and repaired.

Edge lines: a line, or a run of capitalised words, that is the book's title,
its author or a heading of the book is a running head; numbers in the usual
page-number shapes are page numbers.  Both are taken out first, so that words
broken around them come together.  Texts without a sign of any of these are
told apart a batch at a time and pass as they are.  Title and author travel with the row;
headings, of which a book may have any number, are met by an equi-join on the
first ``KEY`` letters at every place of every such line or run, and then on
whole names; the texts that meet one are judged again with these headings.

Hyphens: two word parts with a hyphen-like mark and a line end between are one
word.  Soft hyphens, not-signs and U+2010 are evidence by themselves; a plain
hyphen needs the joined word in the corpus, or a second part that is no word.

Characters: every word gets the anagram hash, the sum of its characters'
hashes.  A misreading changes it by a fixed difference, whatever the word and
wherever in it.  Rare words that hold a confusable piece are joined in SQL, by
hash less difference, with words that are far more frequent; the most frequent
variant is the correction.  Pieces no word is spelled with (``€`` or a digit
between letters) are replaced beforehand, and then a less frequent variant will
do.

Word counts and joins cover the whole corpus.  Defined cases: null and empty
texts have no noise; a text that is only a number or only a heading has none;
headings (h1 to h6) keep their lines; rows are judged one by one, repeated
ones too; books or authors that are missing give no names; extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.plans.runtime import BROADCAST_ROWS, materialize, small

#: A correction is so many times as frequent as the word it replaces: in general, and for words with a sure piece.
RATIO, RATIO_SURE = 12, 1
#: Letters a word has at least to be corrected.
LEAST = 3
#: Folded letters a name must have to be looked for inside a line; also the letters headings are first joined by.
KEY = 8
#: Words that are each more than one in so many of all: at most so many.
FREQUENT = 50_000
#: A second part so frequent (per million words) is a word of its own.
OWN_WORD = 4.0

# Misread piece -> true piece; the first group stands in no ordinary word.
SURE = [("€", "e"), ("|-|", "н"), ("|t", "и"), ("|", "i"), ("0", "o"), ("1", "l"), ("!", "l"), ("9", "g"), ("5", "s"), ("8", "b"), ("6", "б"), ("@", "а"), ("ﬁ", "fi"), ("ﬂ", "fl")]
CONFUSED = [("c", "e"), ("u", "n"), ("b", "h"), ("ii", "u"), ("vv", "w"), ("rn", "m"), ("m", "rn"), ("m", "in"), ("nn", "m"), ("cl", "d"), ("li", "h")]

_BR = re.compile(r"(\n|<x\d+\s*/>)")
_NUM = r"\d{1,4}"
#: No page line is longer: the longest shape has two numbers, a word, two blanks and a mark.
PAGE_LINE = 16
_ROMAN = r"(?=[ivxlc])(?:c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
_PAGE_LINE = re.compile(rf"(?:[·~(\[|—–-]\s?{_NUM}\s?[·~)\]|—–-]?|{_NUM}\s?[·~)\]|—–-]|{_NUM} ?(?:/|of|de|von|di|из|z|sur) ?{_NUM}|{_NUM}|(?:p\.|page|pag\.|pág\.|página|pagina|seite|s\.|str\.|стр\.) ?{_NUM}|{_ROMAN})\.?", re.I)
# Inside a line, blanks around; shapes that ordinary sentences hold are left out.
_PAGE_INLINE = re.compile(rf"(?:^|(?<=\s))(?:· ?{_NUM} ?·|~ ?{_NUM} ?~|\[{_NUM}\]|\({_NUM}\)|[—–] {_NUM} [—–]|- {_NUM} -|\| {_NUM}(?! \|)|{_NUM} (?:/|of) {_NUM}|(?<!cf\. )[Pp](?:\.|age) {_NUM}(?!\d|\.)|(?:xx|ii|iv|ix|xv|xi|xl|lx|(?=[ivxlc]{{3,7}}(?:\s|$)){_ROMAN}))(?=\s|$)")
_IN_WORD = re.compile(rf"(?<=[^\W\d_])([-‐¬\xad])\s+{_NUM}\s+(?=[^\W\d_])")
_TWO_NUMBERS = re.compile(rf"(?:(?<=\s)[Pp](?:\.|age) |(?<=[^\W\d_] )){_NUM} $")
_CAPITAL = "A-ZÀ-ÖØ-ÞĀĂĄĆĈČĎĐĒĘĚĞĢĪİĶŁŃŇŌŐŒŔŘŚŞŠŢŤŪŮŰŹŻŽΑ-ΩА-ЯЁЄІЇ"
# A word that starts with a capital, marks and digits aside, or has no letter; two such words or more in a row.
_CAP_WORD = rf"(?:[^\w\s]|[\d_])*+(?:[{_CAPITAL}]\S*+|(?=\s|$))"
_RUN = re.compile(rf"(?<!\S)(?=\S){_CAP_WORD}(?:\s+(?=\S){_CAP_WORD})+")
# Tests for whole batches (RE2): a text that meets none has no edge line and no broken word.
_MAY_LINES = r"\n|<x\d+\s*/>"
_MAY_CAPS = r"(?:^|[\s\pZ])[^\pL\s\pZ]*\p{Lu}[^\s\pZ]*[\s\pZ]+(?:[^\pL\s\pZ]*\p{Lu}|[^\pL\s\pZ]+(?:[\s\pZ]|$))|(?:^|[\s\pZ])[^\pL\s\pZ]+[\s\pZ]+[^\pL\s\pZ]*\p{Lu}"
_MAY_PAGE = r"[·~\[(|—–-] ?\d|\d (?:/|of) \d|[Pp](?:\.|age) \d|[-‐¬\x{AD}][\s\pZ]+\d|(?:^|[\s\pZ])(?:xx|ii|iv|ix|xv|xi|xl|lx|[ivxlc]{3,7})(?:[\s\pZ]|$)"
_MAY_BREAK = r"[-‐¬\x{AD}](?:[\s\pZ<]|\x{85})|\x{AD}-"
# Letters by their strokes: what is misread for each other has the same strokes, whatever stands beside it.
_FOLD = str.maketrans({**dict.fromkeys("|1l!ir", "i"), **dict.fromkeys("nu", "ii"), "m": "iii", "w": "vv", **dict.fromkeys("€ce", "e"), "0": "o", **dict.fromkeys("bh8", "h"), "9": "g", "5": "s", "@": "а", "6": "б", "ﬁ": "fi", "ﬂ": "fi"})
_HEADING = re.compile(r"h[1-6]$")


_NO_LETTER = re.compile(r"[^\w€|!@]+|_")


def compact(text: str) -> str:
    """Letters and what is misread for letters, in one class each; blanks and punctuation gone."""
    s = text.casefold()
    if "|" in s and re.search("[а-яё]", s):
        s = s.replace("|-|", "н").replace("|t", "и")
    return (s if s.isalnum() else _NO_LETTER.sub("", s)).translate(_FOLD)


@lru_cache(20_000)
def _forms(title: str | None, author: str | None, headings: tuple[str, ...]) -> tuple[frozenset[str], tuple[tuple[str, int], ...]]:
    """(compact names and their combinations, (compact name, words) from long to short)."""
    names = [title or "", *(title or "").split(":"), *(re.sub(r"^\s*\d+\s*[.:)]?\s+", "", h) for h in headings)]
    names = [n for n in dict.fromkeys(re.sub(r"<[^>]*>", " ", n).strip() for n in names) if sum(c.isalpha() for c in n) >= 4]
    whole = {compact(n) for n in names}
    plain = [(compact(n), len(n.split())) for n in names]
    whole |= {compact(title) + n for n in whole} if title else set()
    if author and sum(c.isalpha() for c in author) >= 4:
        a = compact(author)
        whole |= {a} | {a + n for n in whole} | {n + a for n in whole}
        plain.append((a, min(2, len(author.split()))))
    return frozenset(whole), tuple(sorted(set(plain), key=lambda x: -len(x[0])))


def _line_forms(line: str) -> set[str]:
    """Folded forms of a line: with and without the numbers at its ends, also where their digits are read as letters."""
    bare = _NO_LETTER.sub("", line.casefold())
    forms = {bare, re.sub(r"^[|\d]+|[|\d]+$", "", bare), bare.lstrip("|0123456789"), bare.rstrip("|0123456789"), bare.strip("|")}
    # a page number has up to four digits
    front, back = (len(m[0]) for m in (re.match(r"[\d|]*", bare), re.search(r"[\d|]*$", bare)))
    forms |= {bare[k:] for k in range(1, min(front, 4) + 1)} | {bare[:-k] for k in range(1, min(back, 4) + 1)}
    return {compact(f) for f in forms}


def _runs(line: str) -> list[tuple[int, str, str]]:
    """(start, run, folded) of the runs of capitalised words that can hold a name."""
    return [(m.start(), m[0], folded) for m in _RUN.finditer(line) if len(m[0]) >= KEY and len(folded := compact("".join(m[0].split()))) >= KEY]


def _inline_head(runs: list[tuple[int, str, str]], plain: tuple[tuple[str, int], ...]) -> tuple[int, int] | None:
    """Span of a running head inside a line."""
    for start, found, folded in runs:
        names = [x for x in plain if x[0] in folded and len(x[0]) >= KEY]
        if not names:
            continue
        tokens = [(m.start(), m.end()) for m in re.finditer(r"\S+", found)]
        run = [found[a:b] for a, b in tokens]
        for name, n_words in names:
            x, y = 0, len(run)
            while y - x > 1 and name in compact("".join(run[x + 1 : y])):
                x += 1
            while y - x > 1 and name in compact("".join(run[x : y - 1])):
                y -= 1
            core = " ".join(run[x:y])
            spaced = sum(len(t) == 1 for t in run[x:y]) > 0.7 * (y - x) and y - x > 4
            lower = sum(c.islower() for c in core)
            side = bool(x and re.search(r"[|/·\])\d]$", run[x - 1])) or bool(y < len(run) and re.match(r"[|/·(\[]|\d+\W*$", run[y]))
            if lower > 0.15 * len(core) and not side and not spaced and n_words < 3:
                continue
            # the marks beside a head are its own, and one number on either side, which may be spaced like the head
            digit = lambda k: spaced and 0 <= k < len(run) and len(run[k]) == 1 and run[k].isdigit()
            numbers = 0
            while x and re.fullmatch(r"[\W\d]+", run[x - 1]) and (numbers := numbers + (any(c.isdigit() for c in run[x - 1]) and not (digit(x - 1) and digit(x)))) < 2:
                x -= 1
            numbers = 0
            while y < len(run) and re.fullmatch(r"[|/·—()\[\]\d]+", run[y]) and (numbers := numbers + (any(c.isdigit() for c in run[y]) and not (digit(y) and digit(y - 1)))) < 2:
                y += 1
            return start + tokens[x][0], start + tokens[y - 1][1]
    return None


#: Starts the forms of a whole line, which hold a name from their first letter on or not at all.
WHOLE = "^"


def edges(text: str, tag: str | None, title: str | None, author: str | None, headings: tuple[str, ...], places: set[str] | None = None, may_page: bool = True) -> tuple[str, bool, bool]:
    """(text without running heads and page numbers, had a head, had a page number).

    Into ``places`` go the folded forms in which a heading of the book may
    stand: whole lines, and runs of capitalised words.
    """
    if tag and _HEADING.match(tag):
        return text, False, False
    whole, plain = _forms(title, author, headings)
    parts = _BR.split(text)
    several = len(parts) > 1 and sum(bool(p.strip()) for p in parts[::2]) > 1
    head = page = False
    for i in range(0, len(parts), 2):
        line = parts[i].strip()
        if not line:
            continue
        if several:
            if len(line) <= PAGE_LINE and _PAGE_LINE.fullmatch(line) and line.strip("."):
                page, parts[i] = True, ""
                continue
            forms = _line_forms(line)
            if places is not None:
                places |= _whole_places(forms, title, author)
            if not whole.isdisjoint(forms):
                head, parts[i] = True, ""
                continue
        line = parts[i]
        runs, changed = _runs(line), False
        if places is not None:
            places |= {folded for _, _, folded in runs}
        while runs and (span := _inline_head(runs, plain)) is not None:
            head = changed = True
            before = _TWO_NUMBERS.search(line[: span[0]])
            if before:
                page, span = True, (before.start(), span[1])
            line = line[: span[0]].rstrip() + " " + line[span[1] :].lstrip()
            runs = _runs(line)
        if may_page or changed:
            new = _IN_WORD.sub(r"\1 ", _PAGE_INLINE.sub("", line))
            if new != line:
                page, line = True, re.sub(r"  +", " ", new)
        parts[i] = line
    if not head and not page:
        return text, False, False
    if not several and (_PAGE_LINE.fullmatch(text.strip()) or not whole.isdisjoint(_line_forms(text.strip()))):
        return text, False, False  # a number or a heading by itself is none
    last = max((i for i in range(0, len(parts), 2) if parts[i].strip()), default=0)
    return "".join(p for i, p in enumerate(parts) if i % 2 == 0 or (i < last and parts[i - 1].strip())), head, page


@lru_cache(20_000)
def _beside(title: str | None, author: str | None) -> tuple[str, ...]:
    return tuple(compact(x) for x in (title, author) if x)


def _whole_places(forms: set[str], title: str | None, author: str | None) -> set[str]:
    """Forms of a whole line, also without a title or author beside them."""
    for x in _beside(title, author):
        forms |= {f.removeprefix(x) for f in forms} | {f.removesuffix(x) for f in forms}
    return {WHOLE + f for f in forms if len(f) >= 4}


_GAP = r"(?:\s|<x\d+\s*/>|</?x\d+>)+"
_SURE_BREAK = re.compile(rf"(?<=[^\W\d_])[‐¬\xad](?:{_GAP})(?=[^\W_])|(?<=[^\W\d_])\xad-?(?:{_GAP})(?=[^\W_])")
_OPEN_BREAK = re.compile(rf"(?<=[^\W\d_])-(?:{_GAP})([^\W\d_]+)")
#: Stands for a plain hyphen at a line end that waits for evidence.
OPEN = "\ue000"


def joined_breaks(text: str) -> tuple[str, bool, list[tuple[str, str]]]:
    """(text with sure breaks joined and open ones marked, had a sure one, open parts)."""
    if "-" not in text and "‐" not in text and "¬" not in text and "\xad" not in text:
        return text, False, []
    text, n = _SURE_BREAK.subn("", text)
    parts: list[tuple[str, str]] = []

    def mark(m: re.Match) -> str:
        a = m.start()
        while a and (text[a - 1].isalpha() or (text[a - 1] in "’'" and a > 1 and text[a - 2].isalpha())):
            a -= 1
        first = text[a : m.start()]
        if m[1][0].isupper() and not first.isupper():
            return m[0]
        parts.append((first, m[1]))
        return OPEN + m[1]

    return _OPEN_BREAK.sub(mark, text), n > 0, parts


# Symbols that ordinary text sets apart with blanks: next to letters they spoil the word, so they stay in it.
_SPOIL = "\x80-\x9f\xa2-\xa6\xa8-\xaa\xac-\xb6\xb8-\xba\xbc-\xbe\xd7\xf7ˆ˙-˝\u0300-\u036f\u200b-\u200f‰\u2060₠-₿℀-⏿─-◿\ufeff\ufffd"
_TOKEN = re.compile(rf"(?:[^\W_]|[{_SPOIL}]+(?=[^\W_])|\|-\||[€|@!](?=[^\W\d_]))(?:[^\W_]|\|-\||[{_SPOIL}€|@]|[’'!](?=[^\W\d_]))*")
# The same for the JVM, whose alternations must not repeat by recursion: hence possessive.  Most texts hold none of the
# odd characters, which a class of many ranges is slow to look for.
_AL, _LE = r"[\p{L}\p{N}]", r"[\p{L}\p{Nl}\p{No}]"
_JVM_TOKEN = rf"(?:{_AL}|[{_SPOIL}]+(?={_AL})|\|-\||[€|@!](?={_LE}))(?:{_AL}|\|-\||[{_SPOIL}€|@]|[’'!](?={_LE}))*+"
_JVM_PLAIN = rf"{_AL}++(?:[’'](?={_LE}){_AL}++)*+"
_ODD = rf"[{_SPOIL}€|@<]|!\pL|’['’]|'['’]"


_PARTS = pa.list_(pa.struct([("a", pa.string()), ("b", pa.string())]))
_EDGE_OUT = "tbl string, row_id long, book_id long, clean string, odd boolean, places array<string>, header boolean, page_number boolean, hyphen boolean, parts array<struct<a:string,b:string>>"
_EDGE_ARROW = pa.schema([("tbl", pa.string()), ("row_id", pa.int64()), ("book_id", pa.int64()), ("clean", pa.string()), ("odd", pa.bool_()), ("places", pa.list_(pa.string())), ("header", pa.bool_()), ("page_number", pa.bool_()), ("hyphen", pa.bool_()), ("parts", _PARTS)])


def _edge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tbl, row_id, book_id, row_text, tag, title, author, headings); texts without any sign of noise pass as they are."""
    may = pc.match_substring_regex
    for batch in batches:
        text = batch.column("row_text").cast(pa.string())
        segment = pc.equal(batch.column("tbl"), "segments")
        lines, caps, page, breaks = (may(text, p) for p in (_MAY_LINES, _MAY_CAPS, _MAY_PAGE, _MAY_BREAK))
        edge = pc.and_(segment, pc.or_(lines, pc.or_(caps, page)))
        asks = pc.or_(edge, breaks)
        odd = may(text, _ODD)
        rest = pc.invert(asks)
        left = [batch.column(i).cast(_EDGE_ARROW.types[i]).filter(rest) for i in range(3)] + [text.filter(rest), odd.filter(rest)]
        n = len(left[0])
        if n:
            no = pa.array(np.zeros(n, bool))
            yield pa.RecordBatch.from_arrays([*left, pa.nulls(n, pa.list_(pa.string())), no, no, no, pa.nulls(n, _PARTS)], schema=_EDGE_ARROW)
        keys = [batch.column(i).cast(_EDGE_ARROW.types[i]).filter(asks) for i in range(3)]
        out: list[list] = [[] for _ in range(7)]
        columns = [text, edge, page, *(batch.column(c) for c in ("tag", "title", "author", "headings"))]
        for text, edge, page, tag, title, author, headings in zip(*(c.filter(asks).to_pylist() for c in columns)):
            head = number = False
            places: set[str] | None = set() if headings is None else None
            new = text
            if edge:
                new, head, number = edges(text, tag, title, author, tuple(headings or ()), places, page)
            new, sure, parts = joined_breaks(new)
            for col, v in zip(out, (new, True, sorted(places or ()), head, number, sure, [{"a": a, "b": b} for a, b in parts])):
                col.append(v)
        yield pa.RecordBatch.from_arrays([*keys, *(pa.array(c, t) for c, t in zip(out, _EDGE_ARROW.types[3:]))], schema=_EDGE_ARROW)


def _quoted(entry: Column) -> Column:
    """The quoted text of a log entry; quotes that follow each other are lines."""
    inner = F.regexp_extract(entry, r"(?s)^[^']*'(.*)'[^']*$", 1)
    return F.regexp_replace(inner, r"' ?⏎ ?'", "\n")


def words_of(clean: Column, odd: Column) -> Column:
    """Lower-case words that may be misread, blanks between: letters, and pieces mistaken for them."""
    text = F.when(F.contains(clean, F.lit("<")), F.regexp_replace(clean, r"</?x\d+\s*/?>", " ")).otherwise(clean)
    text = F.when(F.contains(text, F.lit(OPEN)), F.regexp_replace(text, rf"\S*{OPEN}\S*", " ")).otherwise(text)
    found = F.when(odd, F.regexp_extract_all(F.lower(text), F.lit(_JVM_TOKEN), F.lit(0))).otherwise(F.regexp_extract_all(F.lower(clean), F.lit(_JVM_PLAIN), F.lit(0)))
    return F.array_join(found, " ")


def _edge_pass(rows: DataFrame, keep_text: bool, name: str) -> DataFrame:
    made = rows.select("tbl", "row_id", "book_id", "row_text", "tag", "title", "author", "headings").mapInArrow(_edge_rows, _EDGE_OUT)
    made = made.withColumn("words", words_of(F.col("clean"), F.col("odd"))).drop("odd")
    return materialize(made if keep_text else made.drop("clean"), name)


def edge_table(segments: DataFrame, books: DataFrame, cleanup_log: DataFrame, keep_text: bool = False) -> DataFrame:
    """Texts of both tables after edge lines and sure hyphens, written once for the passes that follow."""
    names = books.groupBy(F.col("book_id").alias("nb")).agg(F.max("title").alias("title"), F.max("author").alias("author"))
    names = small(materialize(names, "names"))
    seg = segments.filter("text is not null and text <> '' and seg_id is not null").select(F.lit("segments").alias("tbl"), F.col("seg_id").cast("long").alias("row_id"), F.col("book_id").cast("long").alias("book_id"), F.col("text").alias("row_text"), "tag")
    seg = seg.join(names, F.col("book_id") == F.col("nb"), "left").drop("nb").withColumn("headings", F.lit(None).cast("array<string>"))
    log = cleanup_log.select(F.lit("cleanup_log").alias("tbl"), F.col("log_id").cast("long").alias("row_id"), F.lit(None).cast("long").alias("book_id"), _quoted(F.col("entry")).alias("row_text")).filter("row_text <> '' and row_id is not null")
    edge = _edge_pass(seg.unionByName(log, allowMissingColumns=True), keep_text, "edge-lines")
    met = small(materialize(met_headings(edge, segments), "met-headings"))
    again = _edge_pass(seg.drop("headings").join(met, ["row_id", "book_id"]), keep_text, "edge-lines-again")
    others = edge.join(met.select("row_id", "book_id", F.lit("segments").alias("tbl")), ["tbl", "row_id", "book_id"], "left_anti").select(edge.columns)
    return others.union(again)


def heading_names(segments: DataFrame) -> DataFrame:
    """(book_id, name, heading): the headings of each book, folded, without their numbers, and one text of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [compact(re.sub(r"<[^>]*>", " ", re.sub(r"^\s*\d+\s*[.:)]?\s+", "", t))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), batch.column(1).cast(pa.string())], names=["book_id", "name", "heading"])

    rows = segments.filter(F.col("tag").rlike("^h[1-6]$") & (F.length("text") >= 4) & F.col("book_id").isNotNull()).select(F.col("book_id").cast("long").alias("book_id"), "text").distinct()
    return rows.mapInArrow(run, "book_id long, name string, heading string").filter(F.length("name") >= 4).groupBy("book_id", "name").agg(F.min("heading").alias("heading"))


def met_headings(edge: DataFrame, segments: DataFrame) -> DataFrame:
    """(row_id, book_id, headings): the texts in which a heading of their book stands, and which.

    Places are joined with names twice: on the first KEY letters, which brings
    the lengths of the names that start so, then on the whole name.  So a place
    never meets more names than have its own letters, however many headings of
    a book start alike.
    """
    names = materialize(heading_names(segments.select("book_id", "tag", "text")), "heading-names")
    longest = small(materialize(names.groupBy("book_id").agg(F.max(F.length("name")).alias("longest")), "heading-longest"))
    starts = small(materialize(names.groupBy("book_id", F.left("name", F.lit(KEY)).alias("start")).agg(F.collect_set(F.length("name")).alias("lengths")), "heading-starts"))
    place = F.col("place")
    whole = place.startswith(WHOLE)
    first = F.when(whole, 2).otherwise(1)
    last = F.when(whole, 2).otherwise(F.length(place) - KEY + 1)
    tried = edge.filter("size(places) > 0").select("row_id", "book_id", F.explode("places").alias("place")).join(longest, "book_id")
    tried = tried.select("row_id", "book_id", F.explode(F.transform(F.sequence(first, last), lambda i: F.substring(place, i, F.col("longest")))).alias("rest"))
    tried = tried.withColumn("start", F.left("rest", F.lit(KEY))).join(starts, ["book_id", "start"])
    tried = tried.select("row_id", "book_id", "rest", F.explode("lengths").alias("n")).filter(F.length("rest") >= F.col("n"))
    tried = tried.select("row_id", "book_id", F.left("rest", F.col("n")).alias("name")).distinct()
    return tried.join(small(names), ["book_id", "name"]).groupBy("row_id", "book_id").agg(F.sort_array(F.collect_set("heading")).alias("headings"))


_MASK = (1 << 56) - 1


def _anagram(word: Column) -> Column:
    """Sum of the characters' hashes modulo 2**56: the same for every order of the characters."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda a, c: F.when(c == "", a).otherwise((a + F.shiftright(F.xxhash64(c), 8)).bitwiseAND(F.lit(_MASK))))


def _sum(piece: str) -> int:
    """``_anagram`` of a literal."""
    signed = lambda h: h - (1 << 64) * (h >> 63)
    return sum(signed(xxhash.xxh64_intdigest(c.encode(), 42)) >> 8 for c in piece) & _MASK


#: Sure pieces of Cyrillic words: in them some pieces stand for other letters.
_CYRILLIC = {"|-|": "н", "|t": "и", "0": "о", "6": "б", "@": "а"}


def _replace_sure(word: Column) -> Column:
    russian = word.rlike("[а-яё]")
    for bad, good in _CYRILLIC.items():
        word = F.when(russian, F.replace(word, F.lit(bad), F.lit(good))).otherwise(word)
    for bad, good in SURE:
        if bad not in _CYRILLIC or bad == "0":
            word = F.replace(word, F.lit(bad), F.lit(good))
    return word


def word_counts(edge: DataFrame) -> DataFrame:
    """(word, n) over all texts of both tables."""
    return edge.select(F.explode(F.split("words", " ")).alias("word")).filter(F.length("word") >= 2).groupBy("word").agg(F.count("*").alias("n"))


def corrections(counts: DataFrame) -> DataFrame:
    """(word, fixed): words misread, and the most frequent word they can stand for."""
    table = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(bad).alias("bad"), F.lit(_sum(good) - _sum(bad) & _MASK).cast("long").alias("d")) for i, (bad, good) in enumerate(CONFUSED)))
    words = counts.filter(F.length("word") >= LEAST).withColumn("plain", _replace_sure(F.col("word"))).withColumn("letters", F.length(F.regexp_replace("word", r"[^\p{L}]", "")))
    words = words.filter("letters >= 2")
    words = materialize(words.withColumn("sure", F.col("plain") != F.col("word")).withColumn("h0", _anagram(F.col("plain"))), "anagrams")
    # a digit at the edge of a word, or alone among few letters, may be a label
    words = words.filter(~F.col("sure") | F.col("word").rlike(r"[€|@ﬁﬂ!]") | F.col("word").rlike(r"\p{L}[0-9]\p{L}") | F.col("letters").__ge__(3))
    plain = F.col("plain")
    step = lambda d, k: F.struct(d.alias("d"), F.lit(k).alias("k"))
    held = words.select("word", "n", "plain", "sure", "h0", F.filter(table, lambda x: F.contains(plain, x["bad"])).alias("held"))

    def seconds(x: Column) -> Column:
        again = F.length(plain) - F.length(F.replace(plain, x["bad"], F.lit(""))) >= 2 * F.length(x["bad"])
        return F.transform(F.filter("held", lambda y: (y["i"] > x["i"]) | ((y["i"] == x["i"]) & again)), lambda y: step(x["d"] + y["d"], 2))

    none = F.when(F.col("sure"), F.array(step(F.lit(0).cast("long"), 0))).otherwise(F.array().cast("array<struct<d:bigint,k:int>>"))
    steps = F.concat(none, F.transform("held", lambda x: step(x["d"], 1)), F.flatten(F.transform("held", seconds)))
    rare = held.select("word", "n", "plain", "sure", "h0", F.explode(steps).alias("s")).select("word", "n", "plain", "sure", (F.col("h0") + F.col("s.d")).bitwiseAND(F.lit(_MASK)).alias("h"), F.col("s.k").alias("steps"))
    good = words.filter("not sure and n >= 2").select(F.col("word").alias("fixed"), F.col("n").alias("m"), F.col("h0").alias("h"))
    pairs = rare.join(good, "h").filter("word <> fixed").filter(
        (F.col("sure") & (F.col("steps") == 0) & (F.col("m") >= F.col("n") * RATIO_SURE)) | (F.col("m") >= F.col("n") * RATIO * F.when(F.col("steps") == 2, 3).otherwise(1) * F.when(F.length("word") <= 3, 4).otherwise(1))
    )
    same = _canonical(F.col("plain")) == _canonical(F.col("fixed"))
    ranked = pairs.filter(same).groupBy("word").agg(F.max_by("fixed", F.struct(-F.col("steps"), F.col("m"), F.col("fixed"))).alias("fixed"))
    return ranked


def _canonical(word: Column) -> Column:
    """The word with confusable pieces in one class: keeps anagrams in other orders apart."""
    word = F.translate(word, "cub", "enh")
    for bad, good in (("ii", "n"), ("vv", "w"), ("rn", "m"), ("in", "m"), ("nn", "m"), ("el", "d"), ("li", "h")):
        word = F.replace(word, F.lit(bad), F.lit(good))
    return word


def misread_rows(edge: DataFrame, fixes: DataFrame, counts: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """(tbl, row_id, word, fixed): misread words where they stand.

    With too many corrections to broadcast, the most frequent words of the
    corpus, at most FREQUENT of them, are sorted out first: as corrections they
    are broadcast, as ordinary words they don't take part in the shuffle.
    """
    words = edge.select("tbl", "row_id", F.explode(F.array_distinct(F.split("words", " "))).alias("word"))
    if fixes.limit(rows + 1).count() <= rows:
        return words.join(F.broadcast(fixes), "word")
    total = counts.agg(F.sum("n")).first()[0]
    often = F.broadcast(materialize(counts.filter(F.col("n") * FREQUENT > total).select("word"), "frequent-words"))
    common = words.join(F.broadcast(fixes.join(often, "word", "left_semi")), "word")
    return common.unionByName(words.join(often, "word", "left_anti").join(fixes.join(often, "word", "left_anti"), "word"))


def hyphen_evidence(edge: DataFrame, counts: DataFrame) -> DataFrame:
    """(tbl, row_id, a, b): plain hyphens at line ends that break a word."""
    total = counts.agg(F.sum("n")).first()[0] or 1
    open_ = edge.filter(F.size("parts") > 0).select("tbl", "row_id", F.explode("parts").alias("p")).select("tbl", "row_id", "p.a", "p.b").withColumn("joined", F.lower(F.concat("a", "b"))).withColumn("second", F.lower("b"))
    open_ = materialize(open_, "open-hyphens")
    wanted = materialize(open_.select(F.col("joined").alias("word")).union(open_.select("second")).distinct(), "hyphen-words")
    known = materialize(counts.join(small(wanted), "word", "left_semi"), "hyphen-counts")
    known = small(known)
    whole = known.select(F.col("word").alias("joined"), F.col("n").alias("n_joined"))
    second = known.select(F.col("word").alias("second"), F.col("n").alias("n_second"))
    judged = open_.join(whole, "joined", "left").join(second, "second", "left")
    return judged.filter(F.col("n_joined").isNotNull() | F.col("n_second").isNull() | (F.col("n_second") < OWN_WORD * total / 1e6)).select("tbl", "row_id", "a", "b")


def scan_noise(segments: DataFrame, books: DataFrame, cleanup_log: DataFrame) -> DataFrame:
    """(tbl, row_id, kind): which noise stands where."""
    edge = edge_table(segments, books, cleanup_log)
    counts = materialize(word_counts(edge), "word-counts")
    fixes = materialize(corrections(counts), "corrections")
    of = lambda kind, rows: rows.select("tbl", "row_id", F.lit(kind).alias("kind"))
    flags = edge.select("tbl", "row_id", F.explode(F.array_compact(F.array(*(F.when(F.col(k), F.lit(k)) for k in ("header", "page_number", "hyphen"))))).alias("kind"))
    return flags.union(of("hyphen", hyphen_evidence(edge, counts))).union(of("chars", misread_rows(edge, fixes, counts))).distinct()


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("tbl", pa.string()), ("row_id", pa.int64()), ("clean", pa.string())])
    for batch in batches:
        out = []
        for clean, fixes, breaks in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
            whole = {(x["a"], x["b"]) for x in breaks or ()}
            clean = re.sub(rf"([^\W\d_]+(?:[’'][^\W\d_]+)?){OPEN}([^\W\d_]+)", lambda m: m[1] + ("" if (m[1], m[2]) in whole else "- ") + m[2], clean).replace(OPEN, "- ")
            if fixes:
                known = {x["word"]: x["fixed"] for x in fixes}

                def corrected(m: re.Match, known: dict[str, str] = known) -> str:
                    s, fixed = m[0], known.get(m[0].lower())
                    if fixed is None:
                        return s
                    return fixed.upper() if s.isupper() and len(s) > 1 else fixed.capitalize() if s[0].isupper() else fixed

                clean = _TOKEN.sub(corrected, clean)
            out.append(re.sub(r"[ \t]*\n[ \t]*(?=\S)", " ", clean))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array(out, pa.string())], schema=schema)


def repaired_text(segments: DataFrame, books: DataFrame, cleanup_log: DataFrame) -> DataFrame:
    """(tbl, row_id, clean): texts with noise, as continuous readable text."""
    edge = edge_table(segments, books, cleanup_log, keep_text=True)
    counts = materialize(word_counts(edge), "word-counts")
    fixes = materialize(misread_rows(edge, materialize(corrections(counts), "corrections"), counts), "misread")
    fixes = fixes.groupBy("tbl", "row_id").agg(F.sort_array(F.collect_set(F.struct("word", "fixed"))).alias("fixes"))
    breaks = hyphen_evidence(edge, counts).groupBy("tbl", "row_id").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("breaks"))
    rows = edge.select("tbl", "row_id", "clean", "header", "page_number", "hyphen").join(fixes, ["tbl", "row_id"], "left").join(breaks, ["tbl", "row_id"], "left")
    rows = rows.filter("header or page_number or hyphen or fixes is not null or breaks is not null")
    return rows.select("tbl", "row_id", "clean", "fixes", "breaks").mapInArrow(_repair, "tbl string, row_id long, clean string")
