"""The registered queries in plain SQL, for an independent engine (RE2 patterns, no lookaround)."""

from __future__ import annotations

from foliomill.functions import languages
from foliomill.functions import text as T
from foliomill.operators.glossary import STOPWORDS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WS = r"[ \t\n\r\f]+"
ANY_WS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def trim(x: str) -> str:
    return f"regexp_replace({x}, {q('^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$')}, '', 'g')"


def collapse(x: str) -> str:
    return trim(f"regexp_replace({x}, {q(WS)}, ' ', 'g')")


def unescape(x: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, {q(entity)}, {q(char)})"
    return x


def plain(x: str) -> str:
    return collapse(unescape(f"regexp_replace({x}, {q(T.TOKEN)}, ' ', 'g')"))


def tight(x: str) -> str:
    return trim(unescape(f"regexp_replace({x}, {q(T.TOKEN)}, '', 'g')"))


def fold(x: str) -> str:
    return f"lower(regexp_replace(translate({x}, {q(T.FOLD_FROM)}, {q(T.FOLD_TO)}), {q('[^\\x00-\\x7F]')}, '', 'g'))"


def key(x: str) -> str:
    return collapse(f"regexp_replace({fold(x)}, {q('[^a-z0-9_ \\t\\n\\r\\f]')}, ' ', 'g')")


EDGE = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
HAS_NUMBER = f"{EDGE[0]}[0-9]{{1,4}}{EDGE[1]}"


def head_key(x: str) -> str:
    once = f"regexp_replace({x}, {q(HAS_NUMBER)}, '\\1 \\2', 'g')"
    return key(f"regexp_replace({once}, {q(HAS_NUMBER)}, '\\1 \\2', 'g')")


def page(x: str) -> str:
    return f"(regexp_matches({x}, {q(T.PAGE_DIGITS)}) or (length({x}) between 2 and 7 and regexp_matches({x}, {q(T.PAGE_ROMAN)}) and regexp_matches({x}, '(?i)^[ivxlc]+$')))"


TRANSLATABLE = f"regexp_matches(regexp_replace(text, {q(T.TOKEN)}, '', 'g'), '\\p{{L}}')"
LATEST = "ls as (select * from (select *, row_number() over (partition by book_id, doc_no, seg_no order by ingested_at desc, seg_id desc) as rn_ from segments where book_id is not null) where rn_ = 1)"
CACHE = "lc as (select * from (select *, row_number() over (partition by book_id, doc_no, src_sha1 order by written_at desc, cache_id desc) as rn_ from segment_cache) where rn_ = 1)"
LINES = f"""parts as (select seg_id, book_id, doc_no, tag, regexp_split_to_array(text, {q(T.BREAK)}) as p from segments where text is not null),
raw as (select seg_id, book_id, doc_no, tag, len(p) as n_lines, unnest(p) as r, generate_subscripts(p, 1) as line_no from parts),
ln as (select seg_id, book_id, doc_no, tag, n_lines, line_no, {plain("r")} as line from raw where {plain("r")} <> '')"""
NUMBERED = f"regexp_matches(line, {q(HAS_NUMBER)}) and not {page('line')}"
HEADS = f"heads as (select book_id, {head_key('line')} as key, count(*) as uses from ln where length(line) between 1 and 60 and {NUMBERED} and length({head_key('line')}) >= 3 group by 1, 2 having count(*) >= 3)"
CAPS = f"caps as (select book_id, line, count(*) as uses from ln where n_lines > 1 and length(line) between 6 and 40 and not regexp_matches(line, '\\p{{Ll}}') and len(regexp_extract_all(line, '\\p{{Lu}}')) >= 5 and not ({NUMBERED} and length({head_key('line')}) >= 3) group by 1, 2 having count(*) >= 5)"
NAMES = f"""names as (select distinct book_id, {key("n")} as key from (
select book_id, title as n from books union all select book_id, split_part(title, ':', 1) from books union all select book_id, author from books
union all select book_id, list_extract(string_split({trim("author")}, ' '), -1) from books) where n is not null and length({key("n")}) >= 3)"""
CLASSED = f"""cl as (select l.*, case when regexp_matches(coalesce(l.tag, ''), '^h[1-6]$') then null
when k.key is not null and regexp_matches(l.line, {q(HAS_NUMBER)}) and length(l.line) <= 60 then 'header'
when l.n_lines > 1 and {page("l.line")} then 'page number'
when length(l.line) <= 90 and regexp_matches(l.line, {q(T.NOTES)}) then 'watermark'
when l.n_lines > 1 and c.line is not null then 'caps' end as kind
from ln l left join (select book_id, key from heads union select book_id, key from names) k on k.book_id = l.book_id and k.key = {head_key("l.line")}
left join caps c on c.book_id = l.book_id and c.line = l.line)"""
CLASSIFIED = f"with {LINES}, {HEADS}, {CAPS}, {NAMES}, {CLASSED}"
PAIRS = f"{LATEST}, {CACHE}, pr as (select s.seg_id, s.book_id, s.doc_no, s.seg_no, s.path, s.text as source, c.translation from ls s join lc c on c.book_id = s.book_id and c.doc_no = s.doc_no and c.src_sha1 = sha1(s.text) where c.translation is not null and {TRANSLATABLE.replace('text', 's.text', 1)})"
PENDING = f"{LATEST}, pend as (select s.seg_id, s.book_id, s.doc_no, s.seg_no, s.text, sha1(s.text) as src_sha1 from ls s where {TRANSLATABLE.replace('text', 's.text', 1)} and not exists (select 1 from segment_cache c where c.book_id = s.book_id and c.doc_no = s.doc_no and c.src_sha1 = sha1(s.text)))"
STOP = ", ".join(q(w) for w in sorted(STOPWORDS))
WORDS = f"nw as (select book_id, w as word, count(*) as uses from (select book_id, unnest(regexp_extract_all({tight('text')}, '[a-z],? ([A-Z][a-z]+)', 1)) as w from segments where text is not null) where w not in ({STOP}) group by 1, 2 having count(*) >= 2)"
BODIES = f"bo as (select seg_id, book_id, {tight('text')} as body from ls where {TRANSLATABLE})"


def holds(text: str, word: str) -> str:
    return f"regexp_matches({text}, '(^|[^\\p{{L}}\\p{{N}}_''’])' || {word} || '($|[^\\p{{L}}\\p{{N}}_])')"


RELEVANT = f"rel as (select distinct b.seg_id, n.word as source from bo b join nw n on n.book_id = b.book_id and n.uses >= 3 and contains(b.body, n.word) and {holds('b.body', 'n.word')})"
ANSWERED = f"an as (select seg_id, book_id, {tight('source')} as body, {tight('translation')} as tr from pr)"
MISSING = f"with {PAIRS}, {WORDS}, {ANSWERED}, mi as (select distinct a.seg_id, n.word as source from an a join nw n on n.book_id = a.book_id and n.uses >= 3 and contains(a.body, n.word) and {holds('a.body', 'n.word')} where not {holds('a.tr', 'n.word')})"


def _rules(body: str) -> str:
    """Rule rows of a relation ``body`` (book_id, body)."""
    rule = "regexp_replace(line, '#.*$', '')"
    return f"""ra as (select book_id, unnest(string_split(body, chr(10))) as raw, generate_subscripts(string_split(body, chr(10)), 1) - 1 as pos from {body}),
rb as (select book_id, pos, {trim("raw")} as line from ra), rc as (select book_id, pos, line, {trim(f"regexp_replace({rule}, '=.*$', '')")} as source, regexp_replace({rule}, '^[^=]*=?', '') as target from rb where line <> '' and not starts_with(line, '#') and contains(line, '=')),
rd as (select *, list_filter(list_transform(string_split(target, '|'), lambda x: {trim("x")}), lambda x: x <> '') as rs from rc where source <> ''),
re as (select book_id, source, arg_max(array_to_string(rs, '|'), pos) as targets, arg_max(line, pos) as line, min(pos) as ord from rd where len(rs) > 0 group by 1, 2)"""


def _concat_lines(*parts: str) -> str:
    return f"concat_ws(chr(10), {', '.join(parts)})"


def _rule(source: str, targets: str) -> str:
    return f"case when {source} is not null then {source} || ' = ' || concat_ws(' | ', {targets}) end"


BASE = "bt as (select book_id, " + _concat_lines("'# terms'", "''", _rule("title", "title, series"), "author || '=' || author || '  # who wrote it'", "'no rule here'", _rule("author", "upper(substring(author, 1, 1)), author")) + " as body from books)"
NEW = "nt as (select book_id, " + _concat_lines(_rule("title", "title"), _rule("path", "profile, lang")) + " as body from books)"


def _renamed(sql: str, prefix: str) -> str:
    for name in ("ra", "rb", "rc", "rd", "re"):
        sql = sql.replace(f"{name} as (", f"{prefix}{name} as (").replace(f"from {name} ", f"from {prefix}{name} ").replace(f"from {name})", f"from {prefix}{name})")
    return sql


BOTH = f"with {BASE}, {NEW}, {_renamed(_rules('bt'), 'b')}, {_renamed(_rules('nt'), 'n')}"

def fixed(x: str) -> tuple[str, str]:
    """(expression after ligatures, invisible characters and sites, list of the spaced capitals of t)."""
    for a, b in T.LIGATURES.items():
        x = f"replace({x}, {q(a)}, {q(b)})"
    x = f"regexp_replace(regexp_replace({x}, {q(T.INVISIBLE)}, '', 'g'), {q(T.SITES)}, '', 'g')"
    cap = "[A-ZÁÉÍÓÚÑ]"
    return x, f"regexp_extract_all(t, {q(EDGE[0] + '((?:' + cap + ' ){3,}' + cap + ')' + EDGE[1])}, 2)"


def repaired() -> str:
    """Character repairs without lookaround: exceptions are marked first, the marks taken off last."""
    first, gaps = fixed("text")
    low, dash = "[a-záéíóúñü]", T.HANGING
    punct = q(r"([\p{L}\p{N}_”’\"])[ ]+([,.;!?])([ \t\n]|$|<)")
    keep = q(f"({low}- )({dash})" + r"([^\p{L}\p{N}_]|$)")
    return rf"""f1 as (select seg_id, text, {first} as t from segments where text is not null), f2 as (select seg_id, text, t, {gaps} as g from f1),
f3 as (select seg_id, text, list_reduce(list_prepend(t, g), lambda a, m: replace(a, m, replace(m, ' ', ''))) as t from f2),
f4 as (select seg_id, text, regexp_replace(t, {keep}, '\1' || chr(1) || '\2\3', 'g') as t from f3),
f5 as (select seg_id, text, regexp_replace(regexp_replace(t, '({low})- ({low})', '\1\2', 'g'), '({low})- ({low})', '\1\2', 'g') as t from f4),
f6 as (select seg_id, text, regexp_replace(replace(t, chr(1), ''), '([ ]+)([.] [.])', '\1' || chr(2) || '\2', 'g') as t from f5),
f7 as (select seg_id, text, replace(regexp_replace(regexp_replace(t, {punct}, '\1\2\3', 'g'), {punct}, '\1\2\3', 'g'), chr(2), '') as body from f6)"""


def times(text: str, word: str) -> str:
    """Uses of a word; separators are doubled, so that neighbours don't share one."""
    return rf"len(regexp_extract_all(regexp_replace({text}, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g'), '(^|[^\p{{L}}\p{{N}}_''’])' || {word} || '($|[^\p{{L}}\p{{N}}_])'))"


ORACLES = {
    "char_fix": f"with {repaired()} select seg_id, body from f7 where body <> text",
    "violations": f"""with {PAIRS}, {WORDS}, {ANSWERED}, hit as (select a.seg_id, a.body, a.tr, n.word as w, lower(left(n.word, 1)) || substring(n.word, 2) as o from an a join nw n on n.book_id = a.book_id and n.uses >= 3 and contains(a.body, n.word) and {holds("a.body", "n.word")}),
cnt as (select seg_id, w, o, {times("body", "w")} as k, {times("tr", "w")} as good, {times("tr", "o")} as low from hit)
select seg_id, w as source, case when low > 0 and low <= k - good then w || ': ''' || o || ''' should be ''' || w || '''' else w || ': expected ' || w end as problem from cnt where (low > 0 and low <= k - good) or good = 0""",
    "segment_lines": f"with {LINES} select seg_id, line_no, n_lines, line from ln",
    "translatable": f"select seg_id from segments where {TRANSLATABLE}",
    "plain_texts": f"select seg_id, {plain('text')} as body, {tight('text')} as tight from segments where text is not null",
    "numbered_text": f"with {LATEST} select book_id, doc_no, string_agg('[[' || seg_no || ']] ' || text, chr(10) order by seg_no) as body from ls where text is not null group by 1, 2",
    "plain_document": f"with {LATEST} select book_id, doc_no, string_agg({tight('text')}, chr(10) || chr(10) order by seg_no) as body from ls where {tight('text')} <> '' group by 1, 2",
    "parse_markers": f"with {LATEST} select book_id, doc_no, seg_no as item, {collapse('text')} as reply from ls where text is not null",
    "bilingual_rows": f"with {LATEST}, {CACHE}, b as (select s.book_id, s.doc_no, s.seg_no, s.text, c.translation from ls s join lc c on c.book_id = s.book_id and c.doc_no = s.doc_no and c.src_sha1 = sha1(s.text) where c.translation is not null and s.text is not null) select book_id, doc_no, seg_no, 0 as rank, text as body from b union all select book_id, doc_no, seg_no, 1, translation from b",
    "tag_census": f"select book_id, coalesce(tag, '?') as tag, count(*) as segments, sum(coalesce(len(regexp_extract_all(text, {q(T.TOKEN)})), 0))::bigint as placeholders from segments group by 1, 2",
    "ordered_dedup": "select book_id, doc_no, seg_no, seg_id, copies from (select *, row_number() over (partition by book_id, doc_no, seg_no order by extracted_at, seg_id) as rn, count(*) over (partition by book_id, doc_no, seg_no) as copies from segments) where rn = 1",
    "ncx_ids": f"""with {LATEST}, h as (select book_id, doc_no, seg_no, text as ident from ls where tag = 'h1' and text is not null),
n as (select *, row_number() over (partition by book_id, ident order by doc_no, seg_no) as nth from h), k as (select *, regexp_matches(ident, '^[A-Za-z_][A-Za-z0-9_.-]*$') and nth = 1 as kept from n),
b as (select *, case when kept then ident else 'np_' || regexp_replace(ident, '[^A-Za-z0-9_.-]', '_', 'g') end as base from k)
select book_id, doc_no, seg_no, ident, base || repeat('_', (row_number() over (partition by book_id, base order by kept desc, doc_no, seg_no) - 1)::int) as made from b""",
    "running_heads": f"with {LINES}, {HEADS} select * from heads",
    "repeated_caps": f"with {LINES}, {CAPS} select * from caps",
    "name_keys": f"with {NAMES} select * from names",
    "page_numbers": f"with {LINES} select seg_id, line_no, line from ln where {page('line')}",
    "line_class": f"{CLASSIFIED} select seg_id, line_no, coalesce(kind, 'text') as kind from cl",
    "footnote_suspects": f"{CLASSIFIED} select seg_id, line_no, substring(line, 1, 90) as line from cl where kind is null and line_no > 1 and regexp_matches(line, {q(T.FOOTNOTE)}) and length(line) < 300 and not regexp_matches(coalesce(tag, ''), '^h[1-6]$')",
    "strip_lines": f"{CLASSIFIED} select seg_id, count(kind)::int as removed, coalesce(string_agg(case when kind is null then line end, ' ' order by line_no), '') as body from cl group by 1 having count(kind) > 0",
    "join_broken": f"""with {LINES}, o as (select *, lead(line) over (partition by seg_id order by line_no) as after from ln where n_lines > 1),
j as (select *, coalesce((regexp_matches(after, '^\\p{{Ll}}') and (regexp_matches(line, '[a-záéíóúñüàèìòùâêîôûç0-9,;:-]$') or regexp_matches(line, '\\p{{L}}$'))) or (regexp_matches(after, '^\\p{{Lu}}') and length(line) >= 25 and regexp_matches(line, '[a-záéíóúñü,;]$')), false) as j from o)
select seg_id, sum(j::int)::int as joins, string_agg(case when j and regexp_matches(line, '\\p{{L}}-$') then regexp_replace(line, '-$', '') when j then line || ' ' when after is null then line else line || chr(10) end, '' order by line_no) as body from j group by 1 having sum(j::int) > 0""",
    "merge_paragraphs": f"""with {LATEST}, r as (select book_id, doc_no, seg_no, tag, {plain("text")} as line from ls),
o as (select *, lag(line) over w as bl, lag(tag) over w as bt, lag(seg_no) over w as bn from r window w as (partition by book_id, doc_no order by seg_no)),
f as (select *, case when coalesce(tag in ('p', 'div') and bt in ('p', 'div') and bn = seg_no - 1 and regexp_matches(bl, '[a-záéíóúñüàèìòùâêîôûç0-9,;:-]$') and regexp_matches(line, '^\\p{{Ll}}'), false) then 0 else 1 end as fresh from o),
g as (select *, sum(fresh) over (partition by book_id, doc_no order by seg_no rows unbounded preceding) as run from f)
select book_id, doc_no, min(seg_no) as seg_no, count(*)::int as merged, string_agg(line, ' ' order by seg_no) as body from g group by book_id, doc_no, run having count(*) > 1""",
    "cleanup_summary": """with w as (select book_id, regexp_extract(entry, '^[^:]*: (.*)$', 1) as e from cleanup_log) select book_id, count(*) filter (starts_with(e, 'removed header')) as headers, count(*) filter (starts_with(e, 'removed page number')) as page_numbers, count(*) filter (starts_with(e, 'removed watermark')) as watermarks,
count(*) filter (starts_with(e, 'joined broken line')) as line_joins, count(*) filter (starts_with(e, 'merged split paragraph')) as paragraph_merges, count(*) filter (starts_with(e, 'character fixes')) as char_fixes, count(*) filter (starts_with(e, 'POSSIBLE FOOTNOTE')) as footnotes from w group by 1""",
    "repairs_by_kind": "select regexp_extract(entry, '^[^:]*: ([A-Za-z]+ [A-Za-z]+)', 1) as kind, count(*) as n from cleanup_log where regexp_extract(entry, '^[^:]*: ([A-Za-z]+ [A-Za-z]+)', 1) <> '' group by 1 order by n desc, kind",
    "cache_hits": f"with {LATEST}, {CACHE} select s.seg_id, c.cache_id from ls s join lc c on c.book_id = s.book_id and c.doc_no = s.doc_no and c.src_sha1 = sha1(s.text) where {TRANSLATABLE.replace('text', 's.text', 1)}",
    "pending": f"with {PENDING} select seg_id, src_sha1 from pend",
    "cache_latest": f"with {CACHE} select cache_id, book_id, doc_no, src_sha1 from lc",
    "answer_status": f"select case when finish_reason is null then 'blocked: no candidate' when finish_reason = 'MAX_TOKENS' then 'truncated' when coalesce({trim('translation')}, '') = '' then 'empty' when finish_reason <> 'STOP' then 'blocked: ' || finish_reason else 'ok' end as status, count(*) as entries from segment_cache group by 1",
    "chunk_plan": f"""with recursive {PENDING}, o as (select p.seg_id, p.book_id, p.doc_no, length(p.text) + 8 as n, r.max_chars as cap, row_number() over (partition by p.book_id, p.doc_no order by p.seg_no, p.seg_id) as rn from pend p join books b on b.book_id = p.book_id join run_config r on r.profile = b.profile),
w as (select seg_id, book_id, doc_no, rn, n as size, 1 as chunk from o where rn = 1 union all select o.seg_id, o.book_id, o.doc_no, o.rn, case when w.size + o.n > o.cap then o.n else w.size + o.n end, case when w.size + o.n > o.cap then w.chunk + 1 else w.chunk end from w join o on o.book_id = w.book_id and o.doc_no = w.doc_no and o.rn = w.rn + 1)
select seg_id, chunk from w""",
    "chunk_stats": f"""with recursive {PENDING}, {WORDS}, g as (select book_id, ((count(*) + 149) // 150)::bigint as asked from nw group by 1), o as (select p.seg_id, p.book_id, p.doc_no, length(p.text) + 8 as n, r.max_chars as cap, r.rpd, row_number() over (partition by p.book_id, p.doc_no order by p.seg_no, p.seg_id) as rn from pend p join books b on b.book_id = p.book_id join run_config r on r.profile = b.profile),
w as (select book_id, doc_no, rn, n as size, 1 as chunk from o where rn = 1 union all select o.book_id, o.doc_no, o.rn, case when w.size + o.n > o.cap then o.n else w.size + o.n end, case when w.size + o.n > o.cap then w.chunk + 1 else w.chunk end from w join o on o.book_id = w.book_id and o.doc_no = w.doc_no and o.rn = w.rn + 1),
c as (select book_id, sum(m)::bigint as requests from (select book_id, doc_no, max(chunk) as m from w group by 1, 2) group by 1), t as (select book_id, count(*) as pending, sum(n - 8)::bigint as pending_chars, max(rpd) as rpd from o group by 1)
select t.book_id, t.pending, t.pending_chars, c.requests + coalesce(g.asked, 0) as requests, t.pending_chars // 4 as tokens, case when rpd > 0 then ((c.requests + coalesce(g.asked, 0) + rpd - 1) // rpd)::bigint end as days from t join c on c.book_id = t.book_id left join g on g.book_id = t.book_id""",
    "rejoined_units": f"with {LATEST} select seg_id, length(regexp_replace(text, {q(WS)}, '', 'g'))::int as chars from ls where {TRANSLATABLE}",
    "context_pairs": f"""with {LATEST}, n as (select seg_id, book_id, doc_no, seg_no, length({tight("text")}) as n from ls where {TRANSLATABLE}), u as (select *, sum(n) over (partition by book_id, doc_no order by seg_no rows unbounded preceding)::bigint as upto from n),
k as (select *, count(*) over r as k, sum(n) over r as s from u window r as (partition by book_id, doc_no order by upto range between 1300 preceding and current row))
select seg_id, coalesce(lag(k) over o, 0) as before, least(coalesce(lag(s) over o, 0), 1500)::bigint as chars from k window o as (partition by book_id, doc_no order by seg_no)""",
    "name_words": f"with {WORDS} select * from nw",
    "relevant_terms": f"with {LATEST}, {WORDS}, {BODIES}, {RELEVANT} select * from rel",
    "prompt_blocks": f"with {LATEST}, {WORDS}, {BODIES}, {RELEVANT} select seg_id, string_agg(source || ' = ' || source, chr(10) order by source || ' = ' || source) as block from rel group by 1",
    "missing_names": f"{MISSING} select * from mi",
    "names_report": f"{MISSING} select count(*) as issues, count(distinct seg_id) as segments from mi",
    "parse_glossary": f"with {BASE}, {_rules('bt')} select book_id, source, targets, line, ord from re",
    "glossary_merge": f"{BOTH} select coalesce(b.book_id, n.book_id) as book_id, coalesce(b.source, n.source) as source, coalesce(n.targets, b.targets) as targets, case when b.source is null then 'added' when n.source is not null and b.targets <> n.targets then 'changed' else 'kept' end as change, row_number() over (partition by coalesce(b.book_id, n.book_id) order by lower(coalesce(b.source, n.source)), coalesce(b.source, n.source))::int as ord from bre b full join nre n on n.book_id = b.book_id and n.source = b.source",
    "glossary_override": f"{BOTH} select book_id, source, arg_max(targets, layer) as targets, max(layer) as layer from (select *, 0 as layer from bre union all select *, 1 from nre) group by 1, 2",
    "known_terms_removed": f"with {WORDS} select nw.book_id, nw.word as term, nw.uses from nw where not exists (select 1 from books b where b.book_id = nw.book_id and split_part(b.author, ' ', 1) = nw.word)",
    "completeness": f"""with {PAIRS}, t as (select seg_id, {tight("source")} as s, {tight("translation")} as t from pr), w as (select seg_id, length(t) / length(s) as share, list_distinct(list_filter(regexp_extract_all(s, '\\p{{L}}{{3,}}'), lambda x: not regexp_matches(x, '[\\p{{Lu}}\\p{{Lt}}]'))) as sw, list_filter(regexp_extract_all(t, '\\p{{L}}{{3,}}'), lambda x: not regexp_matches(x, '[\\p{{Lu}}\\p{{Lt}}]')) as tw from t where length(s) >= 300),
p as (select seg_id, case when share < 0.6 then 'dropped' when len(tw) >= 30 and len(sw) > 0 and len(list_filter(tw, lambda x: list_contains(sw, x))) / len(tw) > 0.3 then 'partly untranslated' end as problem from w) select * from p where problem is not null""",
    "unchanged": f"with {PAIRS} select seg_id, path, seg_no from pr where {trim('source')} = {trim('translation')} and len(regexp_extract_all(source, '\\p{{L}}')) > 25",
    "tag_count_diff": f"with {PAIRS} select seg_id, len(regexp_extract_all(source, {q(T.TOKEN)})) as before, len(regexp_extract_all(translation, {q(T.TOKEN)})) as after from pr where len(regexp_extract_all(source, {q(T.TOKEN)})) <> len(regexp_extract_all(translation, {q(T.TOKEN)}))",
    "placeholder_check": f"""with {PAIRS}, t as (select seg_id, list_distinct(regexp_extract_all(source, '<x([0-9]+)/?>', 1)) as a, list_distinct(regexp_extract_all(translation, '<x([0-9]+)/?>', 1)) as b, list_prepend('', regexp_extract_all(translation, '<(/?x[0-9]+)>', 1)) as tags from pr),
r as (select seg_id, len(list_filter(b, lambda x: not list_contains(a, x)))::int as unknown, len(list_filter(a, lambda x: not list_contains(b, x)))::int as missing,
list_reduce(tags, lambda s, g: case when not starts_with(g, '/') then s || ',' || g when ends_with(s, ',' || replace(g, '/', '')) then left(s, length(s) - length(g)) else s || ',!' end) as rest from t)
select seg_id, unknown, missing, (rest <> '')::int as unbalanced from r where unknown > 0 or missing > 0 or rest <> ''""",
    "report_diff": """with e as (select book_id, doc_no, arg_min(run_id, (reported_at, run_id)) as a, arg_max(run_id, (reported_at, run_id)) as b from run_stats group by 1, 2),
i as (select run_id, book_id, doc_no, 'unchanged' as kind, unnest(unchanged) as item from run_stats union all select run_id, book_id, doc_no, 'incomplete', unnest(incomplete) from run_stats),
k as (select run_id, book_id, doc_no, kind, regexp_extract(item, '^(.*?)#([0-9]+): (.*)$', 2) as seg_no, regexp_replace(regexp_extract(item, '^(.*?)#([0-9]+): (.*)$', 3), '(?s);\\s*expected\\b.*$', '') as message from i),
x as (select k.*, k.run_id = e.b as is_last from k join e on e.book_id = k.book_id and e.doc_no = k.doc_no and e.a <> e.b and k.run_id in (e.a, e.b))
select book_id, doc_no, case when is_last then 'new' else 'fixed' end as change, count(*) as items from x where not exists (select 1 from x y where y.book_id = x.book_id and y.doc_no = x.doc_no and y.kind = x.kind and y.seg_no = x.seg_no and y.message = x.message and y.is_last <> x.is_last) group by 1, 2, 3""",
    "run_totals": """with l as (select *, row_number() over (partition by book_id, doc_no, target_lang order by reported_at desc, run_id desc) as nth from run_stats)
select target_lang, count(*) as runs, count(distinct (book_id, doc_no)) as documents, sum(segments)::bigint as segments, sum(translated)::bigint as translated, sum(coalesce(requests, 0))::bigint as requests, sum(len(unchanged))::bigint as unchanged, sum(len(incomplete))::bigint as incomplete from l where nth = 1 group by 1""",
    "issue_list": "with i as (select run_id, 'unchanged' as kind, unnest(unchanged) as item from run_stats union all select run_id, 'incomplete', unnest(incomplete) from run_stats) select run_id, kind, regexp_extract(item, '^(.*?)#([0-9]+): (.*)$', 1) as path, regexp_extract(item, '^(.*?)#([0-9]+): (.*)$', 2) as seg_no, regexp_extract(item, '^(.*?)#([0-9]+): (.*)$', 3) as message from i",
    "documents_without_runs": "select distinct book_id, doc_no from segments s where book_id is not null and not exists (select 1 from run_stats r where r.book_id = s.book_id and r.doc_no = s.doc_no)",
    "resource_hash": "select book_id, doc_no, seg_no, count(*) as rows, count(distinct sha256(text)) as versions from segments where text is not null group by 1, 2, 3 having count(*) > 1",
    "kept_answers": f"""with t as (select book_id, doc_no, src_sha1, arg_min(cache_id, (written_at, cache_id)) as first_id, arg_max(cache_id, (written_at, cache_id)) as last_id, arg_min(translation, (written_at, cache_id)) as old, arg_max(translation, (written_at, cache_id)) as new from segment_cache where translation is not null group by 1, 2, 3 having count(distinct cache_id) > 1),
s as (select distinct book_id, doc_no, sha1(text) as src_sha1, text as source from segments where text is not null),
n as (select t.*, s.source, len(regexp_extract_all(source, {q(T.TOKEN)})) as ns, len(regexp_extract_all(old, {q(T.TOKEN)})) as no_, len(regexp_extract_all(new, {q(T.TOKEN)})) as nn from t join s on s.book_id = t.book_id and s.doc_no = t.doc_no and s.src_sha1 = t.src_sha1)
select first_id, last_id, case when {trim("new")} = {trim("source")} or nn < ns or abs(nn - ns) >= abs(no_ - ns) + 1 then old else new end as answer from n""",
    "slugs": "select book_id, coalesce(nullif(regexp_replace(regexp_replace(title, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'book') as slug, case when series is not null then 'series/' || coalesce(nullif(regexp_replace(regexp_replace(lower(series), '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'book') || '/' || lang end as series_path, regexp_replace(regexp_replace(path, '^.*/', ''), '[.][^.]*$', '') || '_' || upper(lang) || '_bilingual.epub' as output from books",
    "derived_uid": """with o as (select book_id, case when book_id % 2 = 0 then 'urn:uuid:' || path else path end as old, lang from books), h as (select book_id, old, left(sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('foliomill:' || old || ':' || lang)), 32) as h from o)
select book_id, case when starts_with(old, 'urn:uuid:') then 'urn:uuid:' else '' end || substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || translate(substring(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substring(h, 18, 3) || '-' || substring(h, 21, 12) as uid from h""",
    "language_resolve": f"""with v as (select lang as v from books union select target_lang from segment_cache), m as (select distinct unnest([v, v || '_XX', upper(v), '  ' || v, 'Castellano', 'klingon', 'PT_br']) as value from v where v is not null),
l as (select * from (values {", ".join(f"({q(a)}, {q(b)})" for a, b in languages.LANGUAGES.items())}) t(code, name)), a as (select * from (values {", ".join(f"({q(a)}, {q(b)})" for a, b in languages.ALIASES.items())}) t(alias, code)),
k as (select value, trim(value) as raw, replace(lower(trim(value)), '_', '-') as key, split_part(replace(lower(trim(value)), '_', '-'), '-', 1) as base from m)
select k.value, case when l.code is not null then k.key when a.code is not null then a.code when b.code is not null then k.key else coalesce(nullif(substring(k.base, 1, 8), ''), 'und') end as code, coalesce(l.name, al.name, b.name, k.raw) as name
from k left join l on l.code = k.key left join a on a.alias = k.key left join l al on al.code = a.code left join l b on b.code = k.base where k.value is not null""",
    "scalar_texts": """select log_id as id, case when length(entry) <= 40 then entry else '…' || regexp_replace(right(entry, 40), '^[^ ]* ', '') end as tail, replace(replace(entry, 'OEBPS', '***'), 'xhtml', '***') as redacted, entry as answer,
regexp_replace(regexp_replace(regexp_replace(regexp_replace(split_part('Title: “' || substring(entry, 1, 30) || '”', chr(10), 1), '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g'), '^["“”«»*]+|["“”«»*]+$', '', 'g'), '^Title:', ''), '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g') as title,
entry as key, nullif(regexp_extract('retryDelay: ' || regexp_extract(entry, '#([0-9]+)', 1) || 's', '(?i)retry(?:Delay|[ -]?after| in)[^0-9]{0,12}([0-9]+)', 1), '')::int as delay from cleanup_log""",
    "echo_translation": f"with {PENDING} select p.seg_id, regexp_replace(p.text, {q(ANY_WS)}, '', 'g') as body from pend p join books b on b.book_id = p.book_id join run_config r on r.profile = b.profile",
    "checker_diff": """with m as (select book_id, regexp_extract(entry, '^[^:]*: ([A-Za-z]+ [A-Za-z]+)', 1) as id, case doc_no % 3 when 0 then 'ERROR' when 1 then 'WARNING' else 'INFO' end as s, month(logged_at) > 6 as late from cleanup_log),
x as (select book_id, count(*) filter (late and isnew and s = 'ERROR') as new_errors, count(*) filter (late and isnew and s = 'WARNING') as new_warnings, count(*) filter (not late) as preexisting, count(*) filter (not late and isnew) as fixed
from (select *, not exists (select 1 from m n where n.book_id = m.book_id and n.id = m.id and n.late <> m.late) as isnew from m) group by 1) select * from x""",
    "sliding_rate": "select event_id, user_id, calls from (select event_id, user_id, count(*) over (partition by user_id order by epoch_us(ts) range between 21599999999 preceding and current row) as calls from events) where calls > 2",
    "daily_quota": "select user_id, (ts - interval 8 hours)::date as day, count(*) as calls, greatest(0, count(*) - 1) as over from events group by 1, 2",
    "stream_daily_quota": "select user_id, (ts - interval 8 hours)::date as day, count(*) as calls from events group by 1, 2",
    "stream_sliding_rate": "select event_id, user_id, calls from (select event_id, user_id, count(*) over (partition by user_id order by epoch_us(ts) range between 21599999999 preceding and current row) as calls from events) where calls > 2",
}

PLAN = f"""{PENDING}, o as (select p.seg_id, p.book_id, p.doc_no, p.seg_no, length(p.text) + 8 as n, r.max_chars as cap, row_number() over (partition by p.book_id, p.doc_no order by p.seg_no, p.seg_id) as rn from pend p join books b on b.book_id = p.book_id join run_config r on r.profile = b.profile),
w as (select seg_id, book_id, doc_no, seg_no, rn, n as size, 1 as chunk from o where rn = 1 union all select o.seg_id, o.book_id, o.doc_no, o.seg_no, o.rn, case when w.size + o.n > o.cap then o.n else w.size + o.n end, case when w.size + o.n > o.cap then w.chunk + 1 else w.chunk end from w join o on o.book_id = w.book_id and o.doc_no = w.doc_no and o.rn = w.rn + 1)"""


def tail(x: str, n: str) -> str:
    return f"case when length({x}) <= {n} then {x} else '…' || regexp_replace(right({x}, ({n})::int), '^[^ ]* ', '') end"


ROOM = "(a.context_chars - (a.total - b.upto))"
SHARE = f"greatest(1, floor(length(b.translation) * {ROOM} / length(b.source)))::int"
# Pairs before each request, numbered from the document's carried ones on; sums count a pair and all before it.
CONTEXTS = f"""with recursive {PLAN}, {CACHE},
pr as (select s.book_id, s.doc_no, s.seg_no, {tight("s.text")} as source, {tight("c.translation")} as translation from ls s join lc c on c.book_id = s.book_id and c.doc_no = s.doc_no and c.src_sha1 = sha1(s.text) where c.translation is not null and {TRANSLATABLE.replace('text', 's.text', 1)} and {trim(tight("s.text"))} <> ''),
ds as (select distinct book_id, doc_no from segments where book_id is not null), ca as (select d.book_id, d.doc_no, max(p.doc_no) as src from ds d join (select distinct book_id, doc_no from pr) p on p.book_id = d.book_id and p.doc_no < d.doc_no group by 1, 2),
lt as (select *, row_number() over (partition by book_id, doc_no order by seg_no desc) as back from pr),
al as (select book_id, doc_no, seg_no, source, translation from pr union all select ca.book_id, ca.doc_no, -lt.back, lt.source, lt.translation from ca join lt on lt.book_id = ca.book_id and lt.doc_no = ca.src and lt.back <= 3),
up as (select *, sum(length(source)) over (partition by book_id, doc_no order by seg_no rows unbounded preceding) as upto from al),
st as (select w.book_id, w.doc_no, w.chunk, min(w.seg_no) as at, any_value(r.context_chars) as context_chars from w join books b on b.book_id = w.book_id join run_config r on r.profile = b.profile group by 1, 2, 3),
a as (select st.*, (select coalesce(max(u.upto), 0) from up u where u.book_id = st.book_id and u.doc_no = st.doc_no and u.seg_no < st.at) as total from st)"""

SERIES = f"""{LATEST}, {WORDS}, {BODIES}, r as (select distinct b.series, n.word from books b join nw n on n.book_id = b.book_id and n.uses >= 3 where b.series is not null),
k as (select distinct b.book_id, r.word from books b join r on r.series = b.series join bo t on t.book_id = b.book_id and contains(t.body, r.word) and {holds("t.body", "r.word")})"""

_V = ORACLES["violations"]
VIOLATED = _V[len("with ") : _V.rindex("\nselect seg_id, w as source")] + ", vi as (" + _V[_V.rindex("select seg_id, w as source") :] + ")"
_P = ORACLES["placeholder_check"]
DAMAGED = _P[_P.index("t as (select seg_id, list_distinct") : _P.rindex("\nselect seg_id, unknown")] + ", dm as (" + _P[_P.rindex("select seg_id, unknown") :] + ")"
_E = """pd as (select distinct book_id, doc_no from ls where text is not null and text <> ''), pf as (select book_id, count(*) as n from pd group by 1)"""

ORACLES |= {
    "names_files": f"""with {VIOLATED}, pl as (select s.book_id, concat_ws('#', s.path, s.seg_no) as place, concat_ws(': ', concat_ws('#', s.path, s.seg_no), v.problem) as issue from vi v join segments s on s.seg_id = v.seg_id)
select book_id, count(*) as issues, count(distinct place) as segments, count(*) || ' glossary rule(s) broken' || chr(10) || chr(10) || string_agg(issue, chr(10) order by issue) || chr(10) as body from pl group by 1""",
    "report_counts": f"""with {VIOLATED}, {DAMAGED}, {_E}, ck as ({ORACLES["checker_diff"]}),
rl as (select *, row_number() over (partition by book_id, doc_no order by reported_at desc, run_id desc) as nth from run_stats), tt as (select book_id, max(target_lang) as target_language, count(*) as documents, sum(segments)::bigint as segments, sum(translated)::bigint as translated_segments, sum(coalesce(requests, 0))::bigint as api_requests_this_run, sum(len(unchanged))::int as possibly_untranslated, sum(len(incomplete))::int as possibly_incomplete from rl where nth = 1 group by 1)
select tt.book_id, regexp_replace(b.path, '[.]epub$', '_translated.epub') as output, r.model, tt.target_language, b.series, tt.documents, tt.segments, tt.translated_segments, tt.api_requests_this_run, tt.possibly_untranslated, tt.possibly_incomplete,
(select count(*) from nw where nw.book_id = tt.book_id and nw.uses >= 3) as glossary_terms, (select count(*) from dm join ls on ls.seg_id = dm.seg_id where ls.book_id = tt.book_id)::int as inline_tag_warnings, (select count(*) from vi join ls on ls.seg_id = vi.seg_id where ls.book_id = tt.book_id)::int as name_consistency_issues,
coalesce((select case when n > 1 then n else 0 end from pf where pf.book_id = tt.book_id), 0)::int as validation_problems, (select new_errors from ck where ck.book_id = tt.book_id) as new_errors
from tt join books b on b.book_id = tt.book_id left join run_config r on r.profile = b.profile""",
}

ORACLES |= {
    "request_context": f"""{CONTEXTS} select a.book_id, a.doc_no, a.chunk, string_agg(case when b.source is not null then 'SOURCE: ' || case when length(b.source) > {ROOM} then {tail("b.source", ROOM)} else b.source end || chr(10) || 'TRANSLATION: ' || case when length(b.source) > {ROOM} then {tail("b.translation", SHARE)} else b.translation end end, chr(10) order by b.seg_no) as context
from a left join up b on b.book_id = a.book_id and b.doc_no = a.doc_no and b.seg_no < a.at and a.context_chars > 0 and {ROOM} >= 200 group by 1, 2, 3""",
    "prompt_parts": f"""{CONTEXTS}, {WORDS}, bo as (select w.book_id, w.doc_no, w.chunk, {tight("p.text")} as body from w join pend p on p.seg_id = w.seg_id),
k as (select b.book_id, b.doc_no, b.chunk, count(distinct n.word) as rules from bo b join nw n on n.book_id = b.book_id and n.uses >= 3 and contains(b.body, n.word) and {holds("b.body", "n.word")} group by 1, 2, 3),
x as (select a.book_id, a.doc_no, a.chunk, count(b.seg_no) as pairs from a left join up b on b.book_id = a.book_id and b.doc_no = a.doc_no and b.seg_no < a.at and a.context_chars > 0 and {ROOM} >= 200 group by 1, 2, 3)
select x.book_id, x.doc_no, x.chunk, coalesce(k.rules, 0)::int as rules, x.pairs::int as pairs from x left join k on k.book_id = x.book_id and k.doc_no = x.doc_no and k.chunk = x.chunk""",
    "page_heads": f"""with d as (select d.book_id, d.chapter, b.title, b.author from documents d join books b on b.book_id = d.book_id), ln as (select book_id, unnest([concat_ws(' ', chapter, title), concat_ws(' ', 'p.', chapter)]) as line from d union all select book_id, upper(author) from d where author is not null)
select book_id, {head_key("line")} as key, count(*) as uses from ln where length(line) between 1 and 60 and {NUMBERED} and length({head_key("line")}) >= 3 group by 1, 2 having count(*) >= 3""",
    "page_caps": "with d as (select d.book_id, upper(b.author) as line from documents d join books b on b.book_id = d.book_id) select book_id, line, count(*) as uses from d where length(line) between 6 and 40 and len(regexp_extract_all(line, '\\p{Lu}')) >= 5 and not regexp_matches(line, '\\p{Ll}') group by 1, 2 having count(*) >= 5",
    "name_search": f"""with s as (select book_id, path, lower(regexp_replace(path, '^.*/', '')) as name, trim(regexp_replace({fold("regexp_replace(regexp_replace(path, '^.*/', ''), '[.][^.]*$', '')")}, '[ \\t\\n\\r\\f_.-]+', ' ', 'g')) as stem from books where ends_with(lower(path), '.epub')),
a as (select book_id as asked, unnest([path, upper(regexp_replace(path, '^.*/', '')), string_split(title, ' ')[1] || ' ' || string_split(title, ' ')[-1], substring(string_split(title, ' ')[-1], 1, 4)]) as q, unnest([0, 1, 2, 3]) as nth from books where title is not null),
p as (select asked, nth, book_id from a join s on s.path = a.q), e as (select distinct asked, nth, book_id from a join s on s.name in (lower(a.q), lower(a.q) || '.epub') where not exists (select 1 from p where p.asked = a.asked and p.nth = a.nth)),
w as (select asked, nth, list_filter(string_split(trim(regexp_replace({fold("q")}, '[ \\t\\n\\r\\f_.-]+', ' ', 'g')), ' '), lambda x: x <> '') as ws from a where not exists (select 1 from p where p.asked = a.asked and p.nth = a.nth) and not exists (select 1 from e where e.asked = a.asked and e.nth = a.nth))
select * from p union all select * from e union all select w.asked, w.nth, s.book_id from w join s on len(w.ws) > 0 and len(list_filter(w.ws, lambda x: contains(s.stem, x))) = len(w.ws)""",
    "report_diff_books": ORACLES["report_diff"].replace("from run_stats", "from rs").replace("with e as", "with rs as (select * exclude (doc_no), 0 as doc_no from run_stats), e as"),
    "documents_without_counts": "select distinct book_id, doc_no from segments s where book_id is not null and not exists (select 1 from run_stats r where r.book_id = s.book_id and r.doc_no = s.doc_no and r.requests is not null)",
    "series_terms": f"""with {SERIES} select book_id, word as source, word || ' = ' || word as line from k""",
    "new_candidates": f"with {SERIES} select nw.book_id, nw.word as term, nw.uses from nw where not exists (select 1 from k where k.book_id = nw.book_id and k.word = nw.word)",
    "glossary_replies": "select log_id, array_to_string(list_filter([trim(replace(entry, ': ', ' = ')), trim(entry)], lambda x: contains(x, '=') and not starts_with(x, '#')), chr(10)) as rules from cleanup_log",
    "metadata_keys": "select book_id, sha1('title' || chr(10) || title) as key, regexp_matches(title, '\\p{L}') and not contains(title, '<') as plain, false as marked from books where title is not null",
    "label_translations": f"with {LATEST}, {CACHE} select s.book_id, s.doc_no, s.seg_no, coalesce(c.translation, s.text) as label from ls s left join lc c on c.book_id = s.book_id and c.doc_no = s.doc_no and c.src_sha1 = sha1(s.text) where regexp_matches(s.tag, '^h[1-3]$') and {collapse('s.text')} <> ''",
    "epub_metadata": f"with {LATEST}, d as (select book_id, count(distinct doc_no) as documents from ls where text is not null and text <> '' group by 1) select b.path, coalesce(b.title, '') as title, coalesce(b.author, '') as author, coalesce(b.lang, '') as lang, coalesce(b.series, '') as series, b.version, 'book-' || b.book_id as identifier, d.documents::int as documents from books b join d on d.book_id = b.book_id",
    "epub_round_trip": f"with {LATEST}, d as (select distinct book_id, doc_no from ls where text is not null and text <> '') select b.path, row_number() over (partition by b.path order by d.doc_no)::int as doc_no, 'OEBPS/ch' || lpad(d.doc_no::varchar, 5, '0') || '.xhtml' as item_path from books b join d on d.book_id = b.book_id",
    "epub_translated": f"""with {LATEST}, d as (select book_id, count(distinct doc_no) as documents from ls where text is not null and text <> '' group by 1), h as (select book_id, left(sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('foliomill:book-' || book_id || ':es')), 32) as h from books)
select b.path, coalesce(upper(b.title), '') as title, 'es' as lang, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || translate(substring(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substring(h, 18, 3) || '-' || substring(h, 21, 12) as identifier, d.documents::int as documents from books b join d on d.book_id = b.book_id join h on h.book_id = b.book_id""",
    "epub_problems": f"""with {LATEST}, d as (select distinct book_id, doc_no, 'OEBPS/ch' || lpad(doc_no::varchar, 5, '0') || '.xhtml' as name from ls where text is not null and text <> ''), f as (select book_id, min(doc_no) as doc_no, count(*) as n from d group by 1)
select b.path, case when f.doc_no is not null then 'missing from output: ' || d.name else d.name || ': <img> count changed 0 -> 1' end as problem from d join books b on b.book_id = d.book_id join f g on g.book_id = d.book_id and g.n > 1 left join f on f.book_id = d.book_id and f.doc_no = d.doc_no""",
    "relevant_phrases": f"""with {LATEST}, {BODIES}, np as (select book_id, w as source from (select book_id, unnest(regexp_extract_all({tight('text')}, '[a-z],? ([A-Z][a-z]+ [a-z]+)', 1)) as w from segments where text is not null) group by 1, 2 having count(*) >= 2)
select distinct b.seg_id, n.source from bo b join np n on n.book_id = b.book_id and contains(b.body, n.source) and {holds("b.body", "n.source")}""",
    "admitted_calls": """with recursive e as (select event_id, user_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as n from events),
r as (select event_id, user_id, us, n, us as start, null::bigint as before from e where n = 1 union all
select e.event_id, e.user_id, e.us, e.n, greatest(e.us, r.start, coalesce(r.before + 21600000000, 0)), r.start from r join e on e.user_id = r.user_id and e.n = r.n + 1)
select event_id, user_id, start as start_us, start - us as waited_us from r""",
    "phrase_cases": f"""with {LATEST}, {BODIES}, np as (select book_id, w as source from (select book_id, unnest(regexp_extract_all({tight('text')}, '[a-z],? ([A-Z][a-z]+ [a-z]+)', 1)) as w from segments where text is not null) group by 1, 2 having count(*) >= 2),
h as (select b.seg_id, n.source, {times("b.body", "replace(n.source, ' ', '  ')")} as k, len(regexp_extract_all(b.body, '(^|[.!?¿¡…:;«»“”"‘()\\[\\]•—–-])[ \\t\\n\\r\\f]{{0,3}}' || n.source || '($|[^\\p{{L}}\\p{{N}}_])')) + len(regexp_extract_all(b.body, '[''’][ \\t\\n\\r\\f]{{1,3}}' || n.source || '($|[^\\p{{L}}\\p{{N}}_])')) as first from bo b join np n on n.book_id = b.book_id and contains(b.body, n.source) and {holds("b.body", "n.source")})
select seg_id, source, source || ': ''' || source || ''' should be ''' || lower(source) || '''' as problem from h where k > first""",
}
