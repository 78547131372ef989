"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

from textloom.llm.rules import STOP_WORDS, THRESHOLDS
from textloom.llm.tokencounts import ADDRESS, LEAST_WORDS, MASK
from textloom.llm.urlfilter import DEFAULT_VERDICT, RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOW = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_PLAIN_WORDS = rf"list_filter(regexp_split_to_array({_LOW}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

SUBSTRING = rf"""
with w as (select doc_id, {_WORDS} as ws from documents),
 win as (select doc_id, i, array_to_string(ws[i:i+34], ' ') as k from w, unnest(range(1, len(ws) - 33)) t(i)),
 rec as (select k from win group by k having count(*) > 1),
 cov as (select distinct doc_id, p from (select doc_id, i from win semi join rec using (k)), unnest(range(i, i + 35)) t(p)),
 one as (select doc_id, p, ws[p] as word from w, unnest(range(1, len(ws) + 1)) t(p)),
 kept as (select doc_id, string_agg(word, ' ' order by p) as k, count(*) as n from one anti join cov using (doc_id, p) group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(k, '')) as kept_sha256
from w left join kept using (doc_id)"""

LINES = rf"""
with l as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
 one as (select doc_id, p, ls[p] as line, translate(trim(ls[p], {_SPACES}), '{_UPPER}', '{_LOWER}') as k from l, unnest(range(1, len(ls) + 1)) t(p)),
 bad as (select k, max(doc_id) as top from one where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
 kept as (select one.doc_id, string_agg(line, chr(10) order by p) as s, count(*) as n from one left join bad on one.k = bad.k where bad.k is null or one.doc_id = bad.top group by one.doc_id)
select l.doc_id, cast(len(ls) as bigint) as n_lines, cast(len(ls) - coalesce(n, 0) as bigint) as n_dropped, sha256(coalesce(s, '')) as kept_sha256
from l left join kept using (doc_id)"""


def _url_filter() -> str:
    host = rf"translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}')"
    table = ", ".join("('%s', '%s', '%s')" % (a, r.partition("/")[0], "/" + r.partition("/")[2]) for a, r in RULES)
    return rf"""
with u as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
 s as (select page_id, {host} as host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from u),
 r(action, h, p) as (values {table}),
 b as (select page_id, max_by(struct_pack(rule := h || p, action := action), length(h || p)) as best
  from s join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id)
select s.page_id, host, path, best.rule as rule, coalesce(best.action, '{DEFAULT_VERDICT}') as verdict from s left join b using (page_id)"""


def _quality_rules() -> str:
    tests = []
    for t in THRESHOLDS:
        bounds = ([f"{t.statistic} < {t.least}"] if t.least is not None else []) + ([f"{t.statistic} > {t.most}"] if t.most is not None else [])
        tests.append(f"(({' or '.join(bounds)}) and n_words >= {t.words_from})")
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
with w as (select doc_id, coalesce(text, '') as t, {_WORDS} as ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {_SPACES}) <> '') as ls from documents),
 win as (select doc_id, i, array_to_string(ws[i:i+7], ' ') as k from w, unnest(range(1, len(ws) - 6)) t(i)),
 rec as (select doc_id, k from win group by doc_id, k having count(*) > 1),
 cov as (select doc_id, count(distinct p) as n from (select doc_id, i from win semi join rec using (doc_id, k)), unnest(range(i, i + 8)) t(p) group by doc_id),
 m as (select doc_id, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
  cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
  cast(coalesce(n, 0) as bigint) as n_repeat_words, len(list_filter(ws, lambda w: translate(w, '{_UPPER}', '{_LOWER}') in ({stop}))) as stop, len(list_filter(ws, lambda w: regexp_matches(w, '\p{{L}}'))) as alpha,
  len(ls) as n_lines, len(list_filter(ls, lambda x: trim(x)[1] in ('-', '*', '•', '·'))) as bullets, len(list_filter(ls, lambda x: ends_with(trim(x), '...') or ends_with(trim(x), '…'))) as ellipses
  from w left join cov using (doc_id)),
 q as (select *, case when n_words > 0 then n_symbols / n_words else 0 end as symbol_ratio, case when n_words > 0 then word_chars / n_words else 0 end as mean_word_length,
  case when n_lines > 0 then n_dup_lines / n_lines else 0 end as dup_line_ratio, case when n_lines > 0 then bullets / n_lines else 0 end as bullet_line_ratio,
  case when n_lines > 0 then ellipses / n_lines else 0 end as ellipsis_line_ratio, case when n_words > 0 then alpha / n_words else 0 end as alpha_ratio, case when n_words > 0 then stop / n_words else 0 end as stop_ratio,
  n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not ({" or ".join(tests)}) as kept from q"""


#: The end of a corpus's life: short texts are gone, addresses are masked.
TOKEN_COUNTS = rf"""
with d as (select source, lang, regexp_replace(coalesce(text, ''), '{ADDRESS}', '{MASK}', 'g') as t from documents where len({_WORDS}) >= {LEAST_WORDS}),
 v as (select source, lang, 'space-1' as tokenizer_version, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) as n, length(t) as c from d
  union all select source, lang, 'marks-2', len(regexp_extract_all(t, '[0-9A-Za-z\x{{80}}-\x{{10FFFF}}]+|[!-/:-@\[-`{{-~]')), length(t) from d)
select source, lang, tokenizer_version, cast(count(*) as bigint) as n_docs, cast(sum(n) as bigint) as n_tokens, cast(sum(c) as bigint) as n_chars from v group by all"""

DECONTAMINATION = rf"""
with d as (select doc_id, {_PLAIN_WORDS} as ws from documents),
 b as (select cast(item_id as varchar) as item, {_PLAIN_WORDS} as ws from benchmark),
 win as (select distinct item, array_to_string(ws[i:i+9], ' ') as k, least(len(ws), 10) as n from b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) t(i) where len(ws) > 0),
 sizes as (select distinct n from win),
 own as (select doc_id, i, n, array_to_string(ws[i:i+n-1], ' ') as k from d, sizes, unnest(range(1, len(ws) - n + 2)) t(i)),
 hit as (select own.doc_id, i, own.n, item from own join win on own.k = win.k and own.n = win.n),
 cov as (select doc_id, count(distinct p) as n from hit, unnest(range(i, i + n)) t(p) group by doc_id),
 items as (select doc_id, count(distinct item) as n, string_agg(distinct item, ',' order by item) as s from hit group by doc_id)
select d.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(cov.n, 0) as bigint) as n_hit, cast(coalesce(items.n, 0) as bigint) as n_items,
 sha256(coalesce(s, '')) as items_sha256, coalesce(cov.n, 0) > 0 as contaminated
from d left join cov using (doc_id) left join items using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": SUBSTRING,
        "op3_line_dedup": LINES,
        "op6_url_filter": _url_filter(),
        "op7_quality_rules": _quality_rules(),
        "op9_token_counts": TOKEN_COUNTS,
        "op10_decontamination": DECONTAMINATION,
    }
