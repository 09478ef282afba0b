"""DuckDB SQL of the operators that SQL expresses."""

from __future__ import annotations

from factloom.llm import url_filters as U

#: The pages' main element, tags off (inline ones leave no blank), references decoded, white space folded.
HTML = """with a as (select page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') as h from pages),
t as (select page_id, url, replace(replace(replace(replace(regexp_replace(regexp_replace(h, '</?b>', '', 'g'), '<[^>]+>', ' ', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') as h from a),
n as (select page_id, url, trim(regexp_replace(h, '\\s+', ' ', 'g')) as text from t)
select page_id, url, text, cast(length(text) as bigint) as n_chars from n"""

#: The eight rules written out, one bit each; the policy rejects on any, the base on the first two.
_LEDGER = """with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, list_filter(string_split_regex(text, '[ \\t-\\r]+'), lambda x: x <> '') as words, list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[ \\t-\\r]+', '', 'g') <> '') as lines from d),
g as (select doc_id, i, array_to_string(words[i:i + 4], ' ') as k from (select doc_id, words, unnest(range(1, len(words) - 3)) as i from w)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, k) as c from g) where c > 1),
c as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest(range(i, i + 5)) as p from r) group by doc_id),
m as (select w.doc_id, cast(len(words) as bigint) as n_words, cast(length(regexp_replace(text, '[ \\t-\\r]+', '', 'g')) as bigint) as word_chars,
  cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
  cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) as n_capitals, len(lines) as n_lines from w left join c using (doc_id)),
f as (select *, cast((n_words < 10)::int + 2 * (n_repeat_words > 0.2 * n_words)::int + 4 * (n_symbols > 0.2 * n_words)::int + 8 * (n_lines > 3 and n_dup_lines > 0.3 * n_lines)::int
  + 16 * (n_words > 0 and n_capitals > 0.5 * word_chars)::int + 32 * (word_chars < 2 * n_words)::int + 64 * (word_chars > 25 * n_words)::int + 128 * (n_words > 10000000)::int as bigint) as failed from m)"""

QUALITY = _LEDGER + """
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or n_repeat_words > 0.2 * n_words as base_failed, failed = 0 as kept, failed from f"""

ABLATIONS = _LEDGER + """, k(bit, rule) as (values (0, 'few_words'), (1, 'repeated_windows'), (2, 'symbols'), (3, 'repeated_lines'), (4, 'shouting'), (5, 'short_words'), (6, 'long_words'), (7, 'many_words'))
select rule, cast(count(*) filter (where failed & (1 << bit) <> 0) as bigint) as n_failed, cast(count(*) filter (where failed = 1 << bit) as bigint) as n_only, cast(count(*) filter (where failed & ~(1 << bit) = 0) as bigint) as n_kept_without from f, k group by 1"""


def _rules() -> tuple[str, str]:
    rule, verdict = "", ""
    for v, r in sorted(U.RULES, key=lambda x: (len(x[1]), x[0] == "block", x[1]), reverse=True):
        host, _, path = r.partition("/")
        fits = f"when (host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '/{path}') then"
        rule += f"{fits} '{r}' "
        verdict += f"{fits} '{v}' "
    return f"case {rule}end", f"case {verdict}end"


#: Levels of a path that the SQL writes out; the query has no such bound.
LEVELS = 6


def urls(held_out: bool = False) -> str:
    """From the definition: every level written out, all branches compared, evidence of siblings, hosts and domains by joins. ``held_out`` hides the
    verdicts of a quarter of the pages from the tree and gives what it says about them."""
    rule, verdict = _rules()
    hidden = "coalesce(page_id % 4 = 2, false)"
    seen = f"case when not {hidden} then {verdict} end" if held_out else verdict
    segment = (
        "case when regexp_matches(x, '^[0-9]+([.][A-Za-z]{1,5})?$') then '#' || regexp_extract(x, '^[0-9]+((?:[.][A-Za-z]{1,5})?)$', 1) "
        "when regexp_matches(x, '^[0-9a-fA-F-]{8,}$') then '#x' else regexp_replace(x, '[0-9]+', '#', 'g') end"
    )
    sql = f"""with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, lower(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), '')) as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from u),
j as (select *, {rule} as rule, {verdict} as told, {seen} as verdict, '/' || array_to_string(list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: {segment}), '/') as shape from p),
t0 as (select host, array_to_string(string_split(host, '.')[-2:], '.') as domain, shape, count(verdict) as labelled, count(*) filter (where verdict = 'block') as blocked, string_split(shape, '/') as parts, '' as node, 0.0 as sr, 0 as sm from j group by host, shape)"""
    for d in range(1, LEVELS + 1):
        sql += f""",
s{d} as (select *, coalesce(parts[{d + 1}], '') as part from t{d - 1}),
b{d} as (select host, node, part, sum(labelled) as l, sum(blocked) as b from s{d} group by 1, 2, 3),
a{d} as (select host, node, sum(l) as al, sum(b) as ab, sum(b / l) filter (where l > 0) as r, count(*) filter (where l > 0) as m from b{d} group by 1, 2),
m{d} as (select host, node, part, l, r, m, case when part <> '' and l > 0 and al - l > 0 and abs(b / l - (ab - b) / (al - l)) <= {U.Z} * sqrt((ab / al) * (1 - ab / al) * (1 / l + 1 / (al - l))) then '*' else part end as nxt
  from b{d} join a{d} using (host, node)),
t{d} as (select s.host, s.domain, shape, labelled, blocked, parts, case when nxt = '' then s.node else s.node || '/' || nxt end as node,
  case when l = 0 and m > 0 and sm = 0 then r else sr end as sr, case when l = 0 and m > 0 and sm = 0 then m else sm end as sm
  from s{d} s join m{d} m on s.host = m.host and s.node = m.node and s.part = m.part)"""
    sql += f""",
t as (select host, domain, shape, labelled, blocked, case when labelled > 0 then blocked / labelled end as own, node as template, sr, sm from t{LEVELS}),
n as (select domain, shape, sum(own) as r, count(*) as m from t where labelled > 0 group by 1, 2),
f as (select shape, sum(r / m) as r, count(*) as m from n group by 1),
pa as (select t.*, (coalesce(f.r, 0) - coalesce(n.r / n.m, 0) + 1) / (coalesce(f.m, 0) - (case when n.m is null then 0 else 1 end) + 2) as a, coalesce(n.r, 0) - coalesce(own, 0) as nr, coalesce(n.m, 0) - (case when own is null then 0 else 1 end) as nm
  from t left join n on t.domain = n.domain and t.shape = n.shape left join f on t.shape = f.shape),
c as (select host, template, sum(labelled) as l, sum(blocked) as b from t group by 1, 2),
y as (select pa.host, shape, pa.template, (b + 2 * (sr + 2 * (nr + 2 * a) / (nm + 2)) / (sm + 2)) / (l + 2) as purity from pa join c on pa.host = c.host and pa.template = c.template)
"""
    if held_out:
        return sql + f"select page_id, told, case when purity >= {U.PURITY} then 'block' else 'allow' end as verdict, y.template, cast(purity as double) as purity from j join y on j.host = y.host and j.shape = y.shape where {hidden} and told is not null"
    return sql + f"""select page_id, j.host, path, rule, coalesce(verdict, case when purity >= {U.PURITY} then 'block' else 'allow' end) as verdict, y.template, cast(purity as double) as purity
from j join y on j.host = y.host and j.shape = y.shape"""


#: All documents that share a term with an item, scored by the definition.
SEARCH = """with x as (
  select 'd' as kind, doc_id, cast(null as bigint) as item_id, text from documents union all select 'i', null, item_id, text from (select distinct item_id, text from benchmark)),
t as (select kind, doc_id, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from x),
d as (select doc_id, term, count(*) as tf from t where kind = 'd' group by 1, 2),
n as (select doc_id, sum(tf) as n from d group by 1),
s as (select count(*) as docs, sum(n) as terms from n),
m as (select doc_id, 25 + (75 * cast(n as bigint) * docs) // cast(terms as bigint) as m from n, s),
w as (select term, cast(floor(1000 * ln(cast(2 * docs + 2 as double) / (2 * count(*) + 1))) as bigint) as w from d, s group by term, docs),
q as (select item_id, term, count(*) as n from t where kind = 'i' group by 1, 2),
c as (select item_id, doc_id, cast(sum(q.n * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score from q join d using (term) join w using (term) join m using (doc_id) group by 1, 2),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from c where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from r where rank <= 10"""

#: Damage and faults by their definition; the edits by a recursion over a conversation's rows that keeps, for each state, the least (cost, initials) and what is written so far.
REPAIR = """with d as (select *, coalesce(role, ' ') as r, coalesce(text, ' ') as x from conversations),
k as (select *, HASH % 20 as kind from d),
g as (select conv_id, turn, case when kind = 4 then 'user' else r end as role, case kind when 1 then '' when 2 then regexp_replace(x, '[.!?]', '', 'g') else x end as text, unnest(range(case when kind = 3 then 2 else 1 end)) as copy from k where kind <> 0),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i, regexp_replace(text, '[ \\t-\\r]+$', '') as body from g),
f as (select *, body = '' as blank, row_number() over (partition by conv_id, role, text order by i) > 1 as again, body <> '' and not regexp_matches(body, '[.!?]$') as cut, substr(role, 1, 1) as c, lag(substr(role, 1, 1)) over (partition by conv_id order by i) as before from o),
n as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where blank) as blank, count(*) filter (where again and not blank) as duplicate, count(*) filter (where cut and not again) as truncated, count(*) filter (where i > 1 and before || c not in ('su', 'ua', 'au')) as illegal, count(*) as rows from f group by 1),
follow(s, c, t) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ins(s, t, e, w) as (values (0, 0, '', ''), (1, 1, '', ''), (2, 2, '', ''), (3, 3, '', ''), (0, 2, 'I', 'user:'), (1, 2, 'I', 'user:'), (2, 3, 'I', 'assistant:'), (3, 2, 'I', 'user:'), (0, 3, 'II', 'user:' || chr(10) || 'assistant:'), (1, 3, 'II', 'user:' || chr(10) || 'assistant:')),
e as (
  select f.conv_id, i, s, s as t, 2 as cost, 'D' as e, '' as w from f, (select distinct s from ins)
  union all select f.conv_id, i, s, t, case when cut then 5 else 0 end, 'K', role || ':' || text from f, follow where f.c = follow.c and not blank and not again
  union all select f.conv_id, i, s, t, case when cut then 6 else 1 end, 'R', case follow.c when 'u' then 'user:' else 'assistant:' end || text from f, follow where follow.c <> 's' and not blank and not again),
p as (select e.conv_id, i, ins.s, e.t, cost + 5 * len(ins.e) as cost, ins.e || e.e as e, case when ins.w <> '' and e.w <> '' then ins.w || chr(10) || e.w else ins.w || e.w end as w from e join ins on ins.t = e.s)
"""


def repair(key: str) -> str:
    """The recursion as steps: ``p`` has all edits of row i from one state to another, with the messages inserted before it."""
    sql = REPAIR.replace("HASH", key).replace("with d as", "with recursive d as", 1)
    return sql + """, best(conv_id, i, t, b) as (
  select distinct conv_id, 0, 0, {'cost': 0, 'e': '', 'w': ''} from conversations
  union all
  select conv_id, i, t, b from (select p.conv_id, p.i, p.t, min({'cost': best.b.cost + p.cost, 'e': best.b.e || p.e, 'w': case when best.b.w <> '' and p.w <> '' then best.b.w || chr(10) || p.w else best.b.w || p.w end}) as b
    from best join p on p.conv_id = best.conv_id and p.i = best.i + 1 and p.s = best.t group by 1, 2, 3)),
z as (select best.conv_id, min({'cost': b.cost + 5 * len(ins.e), 'e': b.e || ins.e, 'w': case when b.w <> '' and ins.w <> '' then b.w || chr(10) || ins.w else b.w || ins.w end}) as b
  from best left join n on n.conv_id = best.conv_id join ins on ins.s = best.t where best.i = coalesce(n.rows, 0) and ins.t in (0, 3) group by 1)
select z.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(n.blank, 0) as blank, coalesce(n.duplicate, 0) as duplicate, coalesce(n.truncated, 0) as truncated, coalesce(n.illegal, 0) as illegal,
  cast(b.cost as bigint) as cost, b.e as audit, sha256(b.w) as repaired_sha256 from z left join n on z.conv_id = n.conv_id"""


#: crc32 of an ASCII text by its polynomial, bit by bit.
CRC = """xor(4294967295, list_reduce([4294967295] || list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda x: cast(ascii(x) as bigint)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: case when r & 1 = 1 then xor(r >> 1, 3988292384) else r >> 1 end)))"""

ORACLES = {"op1_html_extraction": HTML, "op3_quality_rules": QUALITY, "quality_ablations": ABLATIONS, "op7_url_filters": urls(), "url_holdout": urls(held_out=True), "op11_ranked_search": SEARCH, "op12_conversation_repair": repair(CRC)}
