"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

from trendlab.llm.chat import CONTROLS
from trendlab.llm.common import LOWER, UPPER
from trendlab.llm.infill import MIDDLE, PLAIN_PERCENT, PREFIX, SPM_PERCENT, SUFFIX
from trendlab.llm.shards import HASH_BITS, LIMIT_BYTES
from trendlab.llm.urls import RULES

_LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
_SPACE = r"[\x20\x09-\x0D]+"


def _sharding() -> str:
    return f"""
with d as (
  select doc_id, cast(strlen(coalesce(text, '')) as bigint) as n_bytes,
    cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, {HASH_BITS // 4}) as bigint) as h
  from documents),
paths as (select d.*, depth, h >> ({HASH_BITS} - depth) as prefix from d, range(0, {HASH_BITS + 1}) t(depth)),
buckets as (
  select depth, prefix, sum(n_bytes) as shard_bytes from paths group by 1, 2
  having sum(n_bytes) <= {LIMIT_BYTES} or min(h) = max(h) or depth = {HASH_BITS}),
leaves as (
  select doc_id, n_bytes, min_by(struct_pack(depth := p.depth, prefix := p.prefix, size := shard_bytes), p.depth) as leaf
  from paths p join buckets b on p.depth = b.depth and p.prefix = b.prefix
  group by doc_id, n_bytes, h)
select doc_id, n_bytes,
  case when leaf.depth = 0 then '' else right(lpad(bin(leaf.prefix), {HASH_BITS + 4}, '0'), cast(leaf.depth as integer)) end as shard,
  cast(leaf.depth as integer) as local_depth, cast(leaf.size as bigint) as shard_bytes, leaf.size > {LIMIT_BYTES} as oversized
from leaves"""


def _chat() -> str:
    def escaped(column: str) -> str:
        out = rf"replace({column}, '\', '\\')"
        for control in CONTROLS:
            out = rf"replace({out}, '{control}', '{control[0]}\{control[1:]}')"
        return out

    said = "</s>[INST] ok [/INST]"
    name = rf"replace({escaped('role')}, chr(10), '\' || chr(10))"
    return f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{said}' union all select -1, 1, 'assistant', '{said}'),
t as (
  select conv_id, count(*) as n_turns,
    string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as turns,
    coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '') as loss,
    sum(length({name}) + length({escaped('text')}) + length('<s>' || chr(10) || '</s>' || chr(10))) as formatted_chars
  from c group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256,
  cast(formatted_chars as bigint) as formatted_chars
from t"""


def _suffix_dedup() -> str:
    # bytes as two hex digits each
    return """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x, strlen(coalesce(text, '')) as n from documents),
w as (select doc_id, k, substr(x, 2 * k + 1, 100) as s from d, lateral (select unnest(range(0, n - 49)) as k)),
f as (select s, min(doc_id) as first from w group by s having min(doc_id) < max(doc_id)),
gone as (select w.doc_id, k from w join f on w.s = f.s where first < w.doc_id),
marked as (select doc_id, k, case when k - 50 <= lag(k) over (partition by doc_id order by k) then 0 else 1 end as new from gone),
runs as (select doc_id, k, sum(new) over (partition by doc_id order by k) as run from marked),
spans as (select doc_id, run, min(k) as a, max(k) + 50 as b from runs group by 1, 2),
cuts as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from spans),
ends as (select doc_id, count(*) as n_spans, sum(b - a) as n_removed, max(b) as last from cuts group by 1),
heads as (
  select c.doc_id, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' order by a) as head
  from cuts c join d on c.doc_id = d.doc_id group by 1)
select d.doc_id, cast(n as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) as kept_sha256
from d left join ends e on d.doc_id = e.doc_id left join heads h on d.doc_id = h.doc_id"""


def _decontamination() -> str:
    words = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
with d as (select doc_id, {words} as w from documents),
b as (select item_id, {words} as w from benchmark where text is not null),
win as (
  select distinct item_id, least(len(w), 10) as size, array_to_string(list_slice(w, k, k + least(len(w), 10) - 1), ' ') as s
  from b, lateral (select unnest(range(1, cast(len(w) - least(len(w), 10) + 2 as bigint))) as k) where len(w) > 0),
sizes as (select distinct size from win),
places as (
  select doc_id, size, k, array_to_string(list_slice(w, k, k + size - 1), ' ') as s
  from d, sizes, lateral (select unnest(range(1, cast(len(w) - size + 2 as bigint))) as k)),
hit as (select doc_id, item_id, win.size, k from places join win on places.s = win.s and places.size = win.size),
words as (select doc_id, count(distinct p) as n_hit from hit, lateral (select unnest(range(k, k + size)) as p) group by 1),
items as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as names from (select distinct doc_id, cast(item_id as varchar) as i from hit) group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words on d.doc_id = words.doc_id left join items on d.doc_id = items.doc_id"""


def _urls() -> str:
    rules = ", ".join(f"('{verdict}', '{host}', '{path}')" for verdict, host, path in RULES)
    return f"""
with p as (
  select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
r(verdict, host, path) as (values {rules}),
best as (
  select page_id, max_by(struct_pack(rule := r.host || r.path, verdict := r.verdict), length(r.host || r.path)) as b
  from h join r on ends_with('.' || h.host, '.' || r.host) and starts_with(h.path, r.path) and h.host <> ''
  group by page_id)
select h.page_id, host, path, b.rule as rule, coalesce(b.verdict, 'allow') as verdict from h left join best on h.page_id = best.page_id"""


def _quality() -> str:
    return rf"""
with d as (select doc_id, coalesce(text, '') as t, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') as w from documents),
g as (
  select doc_id, k, array_to_string(list_slice(w, k, k + 4), ' ') as s
  from d, lateral (select unnest(range(1, cast(len(w) - 3 as bigint))) as k)),
twice as (select doc_id, s from g group by 1, 2 having count(*) > 1),
repeated as (
  select doc_id, count(distinct p) as n from (select g.doc_id, unnest(range(k, k + 5)) as p from g join twice on g.doc_id = twice.doc_id and g.s = twice.s) group by 1),
m as (
  select d.doc_id, t, cast(len(w) as bigint) as n_words,
    cast(length(regexp_replace(t, '{_SPACE}', '', 'g')) as bigint) as word_chars,
    cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
    coalesce(n, 0) as n_repeat_words
  from d left join repeated on d.doc_id = repeated.doc_id),
r as (
  select *, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
    n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed
  from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 16 * n_symbols > word_chars or 3 * n_dup_lines > length(t) - length(replace(t, chr(10), '')) + 1
    or word_chars < 2 * n_words or word_chars > 25 * n_words) as kept
from r"""


def _infill() -> str:
    marks = " or ".join(f"contains(t, '{mark}')" for mark in (PREFIX, SUFFIX, MIDDLE))
    number = lambda k: f"cast('0x' || substr(d, {8 * k + 1}, 8) as bigint)"
    return f"""
with u as (
  select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as d,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as units
  from documents),
h as (
  select *, cast(len(units) as bigint) as n, {number(0)} % (len(units) + 1) as x, {number(1)} % (len(units) + 1) as y,
    case when t = '' or {marks} or {number(2)} % 100 >= {100 - PLAIN_PERCENT} then 'plain' when {number(3)} % 100 < {SPM_PERCENT} then 'spm' else 'psm' end as form
  from u),
c as (
  select *, array_to_string(units[1:least(x, y)], '') as a, array_to_string(units[least(x, y) + 1:greatest(x, y)], '') as b,
    array_to_string(units[greatest(x, y) + 1:], '') as c
  from h)
select doc_id, n, form, case when form <> 'plain' then cast(length(a) as bigint) end as prefix_chars,
  case when form <> 'plain' then cast(length(b) as bigint) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '{PREFIX}' || a || '{SUFFIX}' || c || '{MIDDLE}' || b
    else '{SUFFIX}' || c || '{PREFIX}' || a || '{MIDDLE}' || b end) as output_sha256,
  sha256(t) as restored_sha256
from c"""


SQL: dict[str, str] = {
    "op1_sharding": _sharding(),
    "op3_chat": _chat(),
    "op4_suffix_dedup": _suffix_dedup(),
    "op5_decontamination": _decontamination(),
    "op7_url_filters": _urls(),
    "op10_quality": _quality(),
    "op13_fill_in_middle": _infill(),
}
