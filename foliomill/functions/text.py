"""Scalar text functions as JVM-side columns.

Placeholders are ``<xN>``, ``</xN>`` and ``<xN/>``; blanks are the ASCII ones.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"</?x[0-9]+/?>"
BREAK = r"<x[0-9]+/>|\n"
BLANKS = r"[ \t\n\r\f]+"
# Presentation forms of ligatures; characters that are dropped.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
INVISIBLE = r"[\x{AD}\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
# Words a hyphen may hang before.
HANGING = "and|or|to|nor|y|o|e|u|et|ou|und|oder"
# Page numbers, alone on a line.
PAGE_DIGITS = r"(?i)^(?:[-–—\[(|]\s*)?(?:(?:page|p[aáÁ]gina|p[aáÁ]g|p)\.?\s*)?[0-9]{1,4}(?:\s*(?:of|de|/)\s*[0-9]{1,4})?(?:\s*[-–—\])|])?$"
PAGE_ROMAN = r"(?i)^c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$"
# Sites whose address is removed wherever it stands, and notes that fill a line.
SITES = r"(?i)[ ]?(?:https?://)?(?:www\.)?[A-Za-z0-9_.-]*(?:oceanofpdf|z-?library|z-lib|libgen|b-ok|dokumen|pdfdrive|epubpub|ebook3000)\.(?:com|org|net|pub|lib|sk|se|is|rs|li|to|io)[A-Za-z0-9_./-]*"
NOTES = r"(?i)scanned (?:and|&(?:amp;)?) proofed|scanned by|\bocr(?:'d| by)|proofed by|converted by|uploaded by|created (?:with|by) .{0,30}(?:pdf|converter)|get (?:more|free) e-?books|(?:this )?page (?:is )?intentionally (?:left )?blank|downloaded from|visit .{0,30}for more (?:free )?e-?books"
FOOTNOTE = r"^(?:[0-9]{1,2}|\*{1,3}|†|‡)\s+[A-Z]"
NUMBER = r"(?<![\p{L}\p{N}_])[0-9]{1,4}(?![\p{L}\p{N}_])"


def _folding() -> tuple[str, str]:
    """Characters with one ASCII base letter, and these letters: by decomposition."""
    pairs = {}
    for i in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        base = unicodedata.normalize("NFKD", chr(i)).encode("ascii", "ignore").decode()
        if len(base) == 1 and base.isalnum():
            pairs[chr(i)] = base
    return "".join(pairs), "".join(pairs.values())


FOLD_FROM, FOLD_TO = _folding()


def _capitals() -> tuple[str, str]:
    """Letters whose upper case is several letters, and the one letter each becomes instead: a title form, ẞ, or itself."""
    pairs = {c: c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1} | {"ß": "ẞ"}
    return "".join(pairs), "".join(pairs.values())


CAPITAL_FROM, CAPITAL_TO = _capitals()


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def ascii_fold(text: Column) -> Column:
    """Accents off, what is not ASCII dropped, lower case."""
    return F.lower(F.regexp_replace(F.translate(text, FOLD_FROM, FOLD_TO), r"[^\x00-\x7F]", ""))


def capitals(text: Column) -> Column:
    """Upper case letter by letter: each letter becomes one, ``ß`` becomes ``ẞ`` and not ``SS``."""
    parts = F.regexp_extract_all(text, F.lit(f"[{CAPITAL_FROM}]|[^{CAPITAL_FROM}]+"), F.lit(0))
    made = F.transform(parts, lambda p: F.when(F.contains(F.lit(CAPITAL_FROM), p), F.translate(p, CAPITAL_FROM, CAPITAL_TO)).otherwise(F.upper(p)))
    return F.when(text.rlike(f"[{CAPITAL_FROM}]"), F.array_join(made, "")).otherwise(F.upper(text))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", "")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def unescaped(text: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def _if_marked(text: Column, made: Column) -> Column:
    """``made`` for texts with placeholders or entities; most have none."""
    return F.when(F.contains(text, F.lit("<")) | F.contains(text, F.lit("&")), made).otherwise(text)


def plain(text: Column) -> Column:
    """Readable text: placeholders to blanks, entities resolved, blanks collapsed."""
    return collapsed(_if_marked(text, unescaped(F.regexp_replace(text, TOKEN, " "))))


def plain_tight(text: Column) -> Column:
    """Readable text with placeholders taken out without a trace."""
    return trimmed(_if_marked(text, unescaped(F.regexp_replace(text, TOKEN, ""))))


def norm_key(text: Column) -> Column:
    """Folded, punctuation to blanks, collapsed."""
    return collapsed(F.regexp_replace(ascii_fold(text), r"[^a-z0-9_ \t\n\r\f]", " "))


def header_key(line: Column) -> Column:
    return norm_key(F.regexp_replace(line, NUMBER, " "))


def is_page_number(line: Column) -> Column:
    return line.rlike(PAGE_DIGITS) | (F.length(line).between(2, 7) & line.rlike(PAGE_ROMAN) & line.rlike("(?i)^[ivxlc]+$"))


def is_translatable(text: Column) -> Column:
    return F.regexp_replace(text, TOKEN, "").rlike(r"\p{L}")


def ligatures_split(text: Column) -> Column:
    for a, b in LIGATURES.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


#: The part of SITES every address has; cheap to look for.
_SITE_NAME = r"(?i)(?:oceanofpdf|library|z-lib|libgen|b-ok|dokumen|pdfdrive|epubpub|ebook3000)\."
_CAP = "[A-ZÁÉÍÓÚÑ]"
_WORD_EDGE = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
# A gap between single capitals is closed if four of them are in a row around it.
_LETTER_GAPS = "|".join(f"(?<={_WORD_EDGE[0]}{' '.join([_CAP] * k)}) (?={' '.join([_CAP] * (4 - k))}{_WORD_EDGE[1]})" for k in (1, 2, 3))


def letters_closed(text: Column) -> Column:
    """Spaced-out capitals, four or more, as one word."""
    return F.regexp_replace(text, _LETTER_GAPS, "")


def characters_fixed(text: Column) -> Column:
    """Ligatures, invisible characters, site addresses, spaced capitals, broken hyphens, stray blanks: in this order."""
    # each costly pattern is preceded by a cheap test
    text = let(F.regexp_replace(ligatures_split(text), INVISIBLE, ""), lambda t: F.when(t.rlike(_SITE_NAME), F.regexp_replace(t, SITES, "")).otherwise(t))
    text = let(text, lambda t: F.when(t.rlike(" ".join([_CAP] * 4)), letters_closed(t)).otherwise(t))
    text = F.regexp_replace(text, rf"(?<=[a-záéíóúñü])- (?!(?:{HANGING})\b)(?=[a-záéíóúñü])", "")
    return F.regexp_replace(text, r"(?<=[\p{L}\p{N}_”’\"])[ ]+(?=[,.;!?](?:[ \t\n]|$|<))(?![.] [.])", "")


def slug(text: Column) -> Column:
    made = F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(made, F.lit("")), F.lit("book"))


def text_key(text: Column) -> Column:
    """Cache key: hexadecimal SHA-1 of the UTF-8 bytes."""
    return F.sha1(F.encode(text, "utf-8"))


def tail_of(text: Column, limit: int | Column) -> Column:
    """The last ``limit`` characters from a word's start, with an ellipsis, of a longer text."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.lit("…"), F.regexp_replace(F.right(text, limit if isinstance(limit, Column) else F.lit(limit)), "^[^ ]* ", "")))


def redacted(text: Column, secrets: list[str]) -> Column:
    for s in secrets:
        text = F.replace(text, F.lit(s), F.lit("***")) if s else text
    return text


def without_thoughts(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def title_reply(text: Column) -> Column:
    """First line of a model's reply that isn't blank, without quotes and label."""
    line = F.regexp_extract(text, r"^[ \t\n\r\f]*([^\n]+)", 1)
    return trimmed(F.regexp_replace(F.regexp_replace(trimmed(line), "^[\"“”«»*]+|[\"“”«»*]+$", ""), "^Title:", ""))


def reply_rules(text: Column) -> Column:
    """The rule lines of a model's glossary reply: fences off, notes and lines without ``=`` left out."""
    body = F.regexp_replace(trimmed(text), r"^```[a-zA-Z]*[ \t\n\r\f]*|```[ \t\n\r\f]*$", "")
    lines = F.transform(F.split(body, "\r?\n"), trimmed)
    return F.array_join(F.filter(lines, lambda x: F.contains(x, F.lit("=")) & ~x.startswith("#")), "\n")


def is_description(text: Column) -> Column:
    """Whether a description can be translated as text: it has letters and no markup."""
    return text.rlike(r"\p{L}") & ~F.contains(text, F.lit("<"))


def message_key(text: Column) -> Column:
    """A checker's message without its markup-dependent tail."""
    return F.regexp_replace(text, r"(?s);\s*expected\b.*$", "")


def quota_day(ts: Column) -> Column:
    """The day of a quota that starts at 08:00 UTC."""
    return F.to_date(ts - F.expr("INTERVAL 8 HOURS"))


def retry_delay(text: Column) -> Column:
    """Seconds a service asked to wait, null where it didn't."""
    return F.nullif(F.regexp_extract(text, r"(?i)retry(?:Delay|[ -]?after| in)[^0-9]{0,12}([0-9]+)", 1), F.lit("")).cast("int")


def derived_uid(old: Column, lang: Column, app: str = "foliomill") -> Column:
    """Name-based UUID (version 5, URL namespace) of ``app:old:lang``; keeps a urn prefix."""
    space = F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8"))
    h = F.substring(F.sha1(F.concat(space, F.encode(F.concat_ws(":", F.lit(app), old, lang), "utf-8"))), 1, 32)
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    made = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return F.when(old.startswith("urn:uuid:"), F.concat(F.lit("urn:uuid:"), made)).otherwise(made)
