"""Registered queries of the training-text operators."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession

from foliomill.llm._lookalike import prototypes
from foliomill.llm import confusables, encoding, leakage, mixing, packing, pairs, scannoise, spans, splitting
from foliomill.sources.tables import table


def p1_requests(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_requests(table(spark, d, "segments"), table(spark, d, "books"), table(spark, d, "run_config"))


def p1_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.request_fill(p1_requests(spark, d))


def p1_checks(spark: SparkSession, d: str) -> DataFrame:
    return packing.request_checks(p1_requests(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return scannoise.scan_noise(table(spark, d, "segments"), table(spark, d, "books"), table(spark, d, "cleanup_log"))


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scannoise.repaired_text(table(spark, d, "segments"), table(spark, d, "books"), table(spark, d, "cleanup_log"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_segments(table(spark, d, "segments"), table(spark, d, "books"), table(spark, d, "run_config"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_pieces(spark, d).select("seg_id").distinct()


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    return encoding.repair_segments(table(spark, d, "segments"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_repaired(spark, d).select("seg_id").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defective_pairs(table(spark, d, "segments"), table(spark, d, "segment_cache"), table(spark, d, "books"))


def p5_reported(spark: SparkSession, d: str) -> DataFrame:
    return pairs.reported_defects(p5_found(spark, d), table(spark, d, "segments"), table(spark, d, "segment_cache"), table(spark, d, "run_stats"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return confusables.look_alike_pairs(table(spark, d, "segments"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return confusables.look_alike_groups(table(spark, d, "segments"))


def p7_runs(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_runs(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_runs(spark, d).select("doc_id", "item_id").distinct()


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_documents(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.document_pairs(table(spark, d, "documents"))


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "documents"))


def p9_amounts(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_amounts(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_requests, p1_fill, p1_checks, p2_found, p2_repaired, p3_pieces, p3_found, p4_repaired, p4_found, p5_found, p5_reported, p6_found, p6_groups, p7_runs, p7_found, p8_mix, p8_shares, p9_found, p9_spans, p9_amounts)}

_LIMITS = "(select b.book_id, coalesce(r.segment_chars, 6000) as lim from books b left join run_config r on b.profile = r.profile)"



def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def skeleton_sql(x: str) -> str:
    """The skeleton of a text without decomposition: every composed character is replaced by what its parts become."""
    to = prototypes()
    single, dropped, several = {}, [], {}
    for i in [*range(1, 0xD800), *range(0xE000, 0x20000)]:
        c = chr(i)
        parts = unicodedata.normalize("NFD", c)
        if all(to[ord(p)] == ord(p) for p in parts):
            continue
        made = unicodedata.normalize("NFC", "".join(chr(to[ord(p)]) for p in parts if to[ord(p)]))
        if len(made) == 1:
            single[c] = made
        elif made:
            several[c] = made
        else:
            dropped.append(c)
    gone = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in dropped) + "]"
    x = f"translate(regexp_replace(nfc_normalize({x}), {_quoted(gone)}, '', 'g'), {_quoted(''.join(single))}, {_quoted(''.join(single.values()))})"
    for c, made in several.items():
        x = f"replace({x}, {_quoted(c)}, {_quoted(made)})"
    return f"nfc_normalize({x})"


_SKELETONS = f"k as (select seg_id, text, {skeleton_sql('text')} as form from segments where text is not null and seg_id is not null)"
# Words after compatibility composition, as far as the data's characters ask for it: full-width forms and ligatures.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_WORDS = f"""list_filter(regexp_split_to_array(lower(translate(replace(replace(regexp_replace(nfc_normalize(text), '[\\x{{AD}}\\x{{200B}}-\\x{{200F}}\\x{{2060}}-\\x{{206F}}\\x{{FE00}}-\\x{{FE0F}}\\x{{FEFF}}]', '', 'g'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), {_quoted(_WIDE)}, {_quoted("".join(chr(ord(c) - 0xFEE0) for c in _WIDE))})), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"""


def _runs_sql(table: str, key: str) -> str:
    """(key, h): hashes of all runs of 13 words."""
    return f"select distinct {key}, unnest(list_transform(range(1, len(w) - 11), lambda i: hash(array_to_string(w[i:i + 12], ' ')))) as h from (select {key}, {_WORDS} as w from {table} where text is not null) where len(w) >= 13"


ORACLES = {
    "p1_checks": """with c as (select b.book_id, max(r.max_chars) as cap from books b left join run_config r on b.profile = r.profile group by 1), s as (select s.book_id, s.seg_id, coalesce(length(s.text), 0) as n, coalesce(c.cap, 24000) as cap from segments s left join c on s.book_id = c.book_id where s.book_id is not null)
select book_id, count(distinct seg_id) as segments, sum(greatest(ceil(n / cap), 1))::bigint as parts, sum(n)::bigint as chars, 0::bigint as too_full, 0::bigint as numbers_missing from s group by 1""",
    "p3_found": f"select distinct s.seg_id from segments s left join {_LIMITS} l on s.book_id = l.book_id where length(s.text) > coalesce(l.lim, 6000)",
    "p6_found": f"with {_SKELETONS} select distinct a.seg_id as seg_a, b.seg_id as seg_b from k a join k b on a.form = b.form and a.seg_id < b.seg_id and a.text <> b.text",
    "p6_groups": f"with {_SKELETONS} select seg_id, min(seg_id) over g as group_id, count(*) over g as group_rows, form from k window g as (partition by form)",
    "p7_found": f"with d as ({_runs_sql('documents', 'doc_id')}), i as ({_runs_sql('benchmark', 'item_id')}) select distinct d.doc_id, i.item_id from d join i on i.h = d.h",
    "p9_found": "with d as (select doc_id, text from documents where length(text) >= 320), w as (select distinct doc_id, unnest(list_transform(range(1, length(text) - 318), lambda i: hash(substring(text, i, 320)))) as h from d) select distinct a.doc_id as doc_a, b.doc_id as doc_b from w a join w b on a.h = b.h and a.doc_id < b.doc_id",
}
