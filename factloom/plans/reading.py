"""Rules on written values, lines and lists of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import reading as R
from factloom.operators import matching as M
from factloom.plans.registry import register
from factloom.plans.tables import spread, table

_LINES = "l as (select doc_id, unnest(range(len(string_split(text, chr(10))))) as pos, unnest(string_split(text, chr(10))) as line from documents)"


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@register("list_items", f"""with {_LINES}, p as (select doc_id, pos, unnest(string_split_regex(line, '[,;]| and ')) as part, unnest(range(len(string_split_regex(line, '[,;]| and ')))) as i from l),
b as (select doc_id, pos, i, part, list_filter(list_transform(string_split_regex(part, '[/\\\\|+]'), lambda x: trim(x)), lambda x: x <> '') as bits from p),
q as (select doc_id, pos, i, case when len(list_filter(bits, lambda x: length(regexp_replace(x, '[^A-Za-z]', '', 'g')) < 2)) = 0 then bits else [trim(part)] end as bits from b),
u as (select doc_id, pos, i, unnest(range(len(bits))) as j, unnest(bits) as x from q),
c as (select doc_id, pos, i, j, trim(regexp_replace(regexp_replace(x, '^\\s*(?:[(]?[0-9]{{1,2}}[.)])\\s*', ''), '\\s*[-:=]\\s*[0-9]+(?:[.][0-9]+)?\\s*$', '')) as item from u),
d as (select *, row_number() over (partition by doc_id, pos, lower(item) order by i, j) as rn from c where length(regexp_replace(item, '[^A-Za-z]', '', 'g')) >= 2)
select doc_id, cast(pos as bigint) as pos, row_number() over (partition by doc_id, pos order by i, j) as seq, item from d where rn = 1""")
def list_items(spark, sf_dir):
    """One written line to one row per entry."""
    return R.split_list(_lines(spark, sf_dir).withColumn("pos", F.col("pos").cast("long")), ["doc_id", "pos"], "line")


#: Reasons in order of priority.
_REASONS = [("contact", "[0-9]{3}[- ][0-9]{3}[- ][0-9]{4}|@"), ("licence line", "(licensed|released) under"), ("secret", "password|api_key|token ="), ("table", "[|]"), ("number only", "^[0-9 .,-]+$"), ("web", "https?://|www[.]")]


@register("line_reasons", f"with {_LINES}, r as (select doc_id, cast(pos as bigint) as pos, case " + " ".join(f"when regexp_matches(lower(line), '{p}') then '{r}'" for r, p in _REASONS) + " end as reason from l) select doc_id, pos, reason from r where reason is not null")
def line_reasons(spark, sf_dir):
    """Why a line is no entry, by the first rule that fits."""
    rows = _lines(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), R.first_reason(F.lower("line"), _REASONS).alias("reason"))
    return rows.where("reason is not null")


_SIGNALS = ["[0-9]+", "[|]", "[$%&#*]", "[A-Z]{2,}", "[a-z]+_[a-z]+"]


@register("signal_lines", f"with {_LINES} select doc_id, count(*) as n from l where " + " + ".join(f"cast(regexp_matches(line, '{p}') as int)" for p in _SIGNALS) + " >= 2 group by 1")
def signal_lines(spark, sf_dir):
    """Lines that bear two or more signals of another kind of entry."""
    return _lines(spark, sf_dir).where(R.two_signals(F.col("line"), _SIGNALS)).groupBy("doc_id").agg(F.count("*").alias("n"))


#: A token read as digits; its number part; whether half or more of that part's letters are digits as written.
_READ = "translate(t, 'OoDQlI|iSsBZz', '0000111155822')"
_N = f"length(regexp_extract({_READ}, '^[0-9½.,/-]*'))"
_LETTERS = f"regexp_replace(substr(t, 1, {_N}), '[.,/-]', '', 'g')"
_DIGITS = f"length(regexp_replace({_LETTERS}, '[^0-9]', '', 'g'))"
_TOKEN = f"case when {_DIGITS} > 0 and {_DIGITS} * 2 >= length({_LETTERS}) and regexp_full_match(substr(t, {_N} + 1), '[a-zA-Z%µ/]*') then substr({_READ}, 1, {_N}) || substr(t, {_N} + 1) else t end"
_NUM = f"regexp_extract_all(lower(array_to_string(list_transform(list_filter(string_split_regex({{}}, '\\s+'), lambda t: t <> ''), lambda t: {_TOKEN}), ' ')), '([0-9]+(?:[.][0-9]+)?(?:/[0-9]+)?|½)', 1)"


@register("repaired_numbers", f"""with t as (select event_id, replace(cast(round(value, 2) as varchar), '0', 'O') || ' of ' || props as s from events), n as (select event_id, {_NUM.format('s')} as n from t) select event_id, len(n) as n_numbers, array_to_string(n, ' ') as numbers from n""")
def repaired_numbers(spark, sf_dir):
    """Letters read for digits, put right in mostly-digit tokens only."""
    text = F.concat(F.replace(F.round("value", 2).cast("string"), F.lit("0"), F.lit("O")), F.lit(" of "), "props")
    n = table(spark, sf_dir, "events").select("event_id", R.numbers_in(text).alias("n"))
    return n.select("event_id", F.size("n").cast("long").alias("n_numbers"), F.array_join("n", " ").alias("numbers"))


@register("compared_readers", f"""with r as (select p_partkey, p_name || ' ' || p_size as a, case when p_partkey % 7 = 0 then null else substr(p_name, 1, length(p_name) - 1) || ' ' || (p_size + case when p_size > 40 then 1 else 0 end) end as b from part)
select p_partkey, case when b is null then 'single' when {_NUM.format('a')} = {_NUM.format('b')} and 1 - levenshtein(a, b) / greatest(length(a), length(b)) >= 0.85 then 'agree' else 'disagree' end as state from r""")
def compared_readers(spark, sf_dir):
    """Two readings of a line: equal numbers and alike texts agree."""
    p = spread(table(spark, sf_dir, "part"))
    a = F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))
    b = F.when(F.col("p_partkey") % 7 != 0, F.concat(F.expr("substr(p_name, 1, length(p_name) - 1)"), F.lit(" "), (F.col("p_size") + F.when(F.col("p_size") > 40, 1).otherwise(0)).cast("string")))
    return R.compared_readers(p.select("p_partkey", a.alias("a"), b.alias("b")), "a", "b").select("p_partkey", "state")


_NUMBERS = "regexp_extract_all({}, '([0-9]+(?:[.][0-9]+)?(?:/[0-9]+)?|½)', 1)"


@register("grounded_values", f"""with v as (select conv_id, array_to_string(string_split_regex(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' +')[2:4], ' ') as v from conversations where turn = 0),
r as (select conv_id, turn, list_transform(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' +'), lambda x: x <> ''), lambda t: {_TOKEN}) as r from conversations where turn > 0),
d as (select distinct conv_id, v, list_transform(list_filter(string_split(v, ' '), lambda x: x <> ''), lambda t: {_TOKEN}) as w from v where v <> ''),
j as (select conv_id, v, turn, array_to_string(w, ' ') as t, len(w) as k, r from d join r using (conv_id) where len(r) > 0),
s as (select conv_id, v, turn, max(1 - levenshtein(t, x) / greatest(length(t), length(x))) as s from (select conv_id, v, turn, t, unnest(list_transform(range(1, greatest(1, len(r) - n + 1) + 1), lambda i: array_to_string(r[i:i + n - 1], ' '))) as x from (select *, unnest([k - 1, k, k + 1]) as n from j) where n >= 1) group by 1, 2, 3),
n as (select conv_id, v, turn, {_NUMBERS.format('t')} as a, {_NUMBERS.format("array_to_string(r, ' ')")} as b from j),
o as (select s.*, len(list_filter(list_distinct(a), lambda y: len(list_filter(a, lambda z: z = y)) > len(list_filter(b, lambda z: z = y)))) = 0 as ok from s join n using (conv_id, v, turn)),
m as (select conv_id, v, max({{'ok': ok, 's': s}}) as m from o group by 1, 2)
select d.conv_id, d.v as value, round(coalesce(m.s, 0), 3) as similarity, coalesce(m.ok, false) as numbers_ok, coalesce(m.ok and m.s >= 0.72, false) as grounded from d left join m on m.conv_id = d.conv_id and m.v = d.v""")
def grounded_values(spark, sf_dir):
    """Values held against word windows of all readings of their document, numbers first."""
    c = table(spark, sf_dir, "conversations").withColumn("text", F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")))
    v = c.where("turn = 0").select("conv_id", F.array_join(F.slice(F.split("text", " +"), 2, 3), " ").alias("value")).where("value != ''").distinct()
    out = R.grounded(v.withColumn("key", F.col("value")), c.where("turn > 0"), "conv_id", "key", "value", "text")
    return out.select("conv_id", F.col("key").alias("value"), "similarity", "numbers_ok", "grounded")


_SPELT = "substr(p_name, 1, cast(p_partkey % length(p_name) as int)) || substr(p_name, cast(p_partkey % length(p_name) as int) + 2)"


@register("lexicon_members", f"""with x as (select distinct unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z]{{4,}}')) as word from part), w as (select distinct unnest(regexp_extract_all(lower({_SPELT}), '[a-z]{{4,}}')) as word from part),
n as (select w.word, x.word as member, 1 - levenshtein(w.word, x.word) / greatest(length(w.word), length(x.word)) as s from w join x on substr(w.word, 1, 1) = substr(x.word, 1, 1) and abs(length(w.word) - length(x.word)) <= 1 where length(w.word) >= 6 and w.word not in (select word from x))
select word, word as member, true as exact from w where word in (select word from x) union all select word, member, false from (select *, row_number() over (partition by word order by s desc, member) as rn from n where s >= 0.8) where rn = 1""")
def lexicon_members(spark, sf_dir):
    """Words of a lexicon, exact or one misread letter off."""
    p = table(spark, sf_dir, "part")
    lexicon = p.select(F.explode(F.regexp_extract_all(F.lower(F.concat_ws(" ", "p_name", "p_type")), F.lit("([a-z]{4,})"), F.lit(1))).alias("word")).distinct()
    words = p.select(F.explode(F.regexp_extract_all(F.lower(F.expr(_SPELT)), F.lit("([a-z]{4,})"), F.lit(1))).alias("w"))
    return R.lexicon_members(words, "w", lexicon, floor=0.8)


@register("suggestions", f"""with r as (select distinct {_SPELT} as text from part), n as (select distinct p_name as name from part), s as (select text, name, 1 - levenshtein(text, name) / greatest(length(text), length(name)) as score from r join n on abs(length(text) - length(name)) <= 5)
select text, name, round(score, 4) as score, rank from (select *, row_number() over (partition by text order by score desc, name) as rank from s where score >= 0.7) where rank <= 3""")
def suggestions(spark, sf_dir):
    """The three most alike names above a floor."""
    p = table(spark, sf_dir, "part")
    return R.suggestions(p.select(F.expr(_SPELT).alias("reading")), "reading", p, "p_name").withColumn("score", F.round("score", 4))


@register("drug_lookup")
def drug_lookup(spark, sf_dir):
    """Medicines by brand of three or two words, first word, or one misread word (held against brute force in a test)."""
    p = table(spark, sf_dir, "part")
    word = lambda k: F.get(F.split("p_name", " "), F.lit(k))
    names = p.select(F.lit("brand").alias("kind"), F.col("p_name").alias("name")).union(p.select(F.lit("generic"), word(1))).union(p.select(F.lit("substance"), word(0))).where("name is not null").distinct()
    texts = p.select(F.concat(F.lit("Tab "), F.expr(_SPELT), F.lit(" 40 mg")).alias("t"))
    return R.drug_lookup(texts, "t", names)


@register("one_letter_slips", """with n as (select distinct unnest(regexp_extract_all(lower(p_name), '[a-z]+')) as name from part), t as (select distinct unnest(string_split_regex(lower(text), '[^a-z]+')) as token from documents),
p as (select token, name from t join n on length(token) = length(name) and length(token) > 1 and levenshtein(token, name) = 1 where token not in (select name from n))
select token, min(name) as name from p group by 1 having count(*) = 1""")
def one_letter_slips(spark, sf_dir):
    """Words one letter away, at one place, from exactly one known name."""
    names = table(spark, sf_dir, "part").select(F.explode(F.regexp_extract_all(F.lower("p_name"), F.lit("([a-z]+)"), F.lit(1))).alias("name"))
    tokens = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("t"))
    return R.one_letter_slips(tokens, "t", names, "name")


@register("dictionary_scan", f"""with {_LINES}, d(name) as (values ('the'), ('licensed under'), ('under the'), ('licensed under the'), ('token'), ('of the'), ('and'), ('the and')),
w as (select doc_id, pos, list_filter(string_split_regex(lower(line), '[^a-z0-9]+'), lambda x: x <> '') as w from l),
g as (select doc_id, pos, n as words, unnest(range(0, len(w) - n + 1)) as "at", unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) as name from (select *, unnest([1, 2, 3]) as n from w) where len(w) >= n),
f as (select g.* from g join d using (name))
select doc_id, cast(pos as bigint) as pos, cast("at" as bigint) as "at", cast(words as bigint) as words, name from f x where not exists (select 1 from f y where y.doc_id = x.doc_id and y.pos = x.pos and y."at" < x."at" + x.words and x."at" < y."at" + y.words and (y.words > x.words or (y.words = x.words and y."at" < x."at")))""")
def dictionary_scan(spark, sf_dir):
    """The longest dictionary names in each line, overlaps resolved."""
    names = spark.createDataFrame([(n,) for n in ("the", "licensed under", "under the", "licensed under the", "token", "of the", "and", "the and")], "name string")
    out = R.dictionary_scan(_lines(spark, sf_dir), ["doc_id", "pos"], "line", names, "name")
    return out.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("at").cast("long").alias("at"), F.col("words").cast("long").alias("words"), "name")


@register("covered_entries", f"""with {_LINES}, e as (select distinct doc_id, lower(trim(line)) as entry from l where trim(line) <> ''),
w as (select *, list_filter(string_split_regex(entry, '[^a-z0-9]+'), lambda x: x <> '') as w from e),
s as (select doc_id, entry, list_distinct(case when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from w)
select a.doc_id, a.entry, min(b.entry) as "by" from s a join s b on a.doc_id = b.doc_id and a.entry <> b.entry and len(list_intersect(a.s, b.s)) >= 0.8 * len(a.s) and (len(b.s) > len(a.s) or (len(b.s) = len(a.s) and b.entry < a.entry)) where len(list_intersect(a.s, b.s)) > 0 group by 1, 2""")
def covered_entries(spark, sf_dir):
    """Lines of a document that another line nearly repeats or covers."""
    return M.covered_entries(_lines(spark, sf_dir), "doc_id", "line")


@register("specific_entries", f"""with {_LINES}, u as (select doc_id, unnest(string_split_regex(line, '[,;.]')) as part from l), e as (select distinct doc_id, lower(trim(part)) as entry from u where trim(part) <> ''),
b as (select *, list_distinct(list_filter(string_split_regex(entry, '[^a-z0-9]+'), lambda y: y <> '')) as ws from e), g as (select * from b where len(ws) > 0 and len(list_filter(ws, lambda y: y not in ('the', 'la', 'der', 'die', 'est', 'und'))) = 0),
d as (select distinct g.doc_id, g.entry from g join b on g.doc_id = b.doc_id where len(b.ws) > len(g.ws) and list_has_all(b.ws, g.ws))
select b.doc_id, b.entry, d.doc_id is null as kept from b left join d on d.doc_id = b.doc_id and d.entry = b.entry""")
def specific_entries(spark, sf_dir):
    """Entries of generic words only, dropped beside a fuller one of their document."""
    parts = _lines(spark, sf_dir).select("doc_id", F.explode(F.split("line", "[,;.]")).alias("part"))
    return M.specific_entries(parts, "doc_id", "part", ["the", "la", "der", "die", "est", "und"])


@register("ages", """with t as (select c_custkey, (c_custkey % 140) || case c_nationkey % 4 when 0 then ' yrs' when 1 then ' months' when 2 then 'y' else '' end as s, case c_nationkey % 3 when 0 then 'F' when 1 then ' male' else '?' end as x from customer),
m as (select c_custkey, x, try_cast(regexp_extract(s, '([0-9]{1,3}) ?(years?|yrs?|y|months?|m|days?|d)?', 1) as int) as n, substr(regexp_extract(s, '([0-9]{1,3}) ?(years?|yrs?|y|months?|m|days?|d)?', 2), 1, 1) as u from t),
y as (select c_custkey, x, cast(case when u = 'm' then floor(n / 12) when u = 'd' then floor(n / 365) else n end as bigint) as y from m)
select c_custkey, case when y <= 120 then y end as years, case x when 'F' then 'female' when ' male' then 'male' end as sex from y""")
def ages(spark, sf_dir):
    """Age texts to years, written sexes to two."""
    text = F.expr("concat(c_custkey % 140, case c_nationkey % 4 when 0 then ' yrs' when 1 then ' months' when 2 then 'y' else '' end)")
    written = F.expr("case c_nationkey % 3 when 0 then 'F' when 1 then ' male' else '?' end")
    return table(spark, sf_dir, "customer").select("c_custkey", R.age_years(text).alias("years"), R.sex(written).alias("sex"))


@register("follow_ups", """with t as (select o_orderkey, case o_orderpriority when '1-URGENT' then 'Review after ' || (o_orderkey % 9 + 1) || '-' || (o_orderkey % 9 + 3) || ' weeks' when '2-HIGH' then 'in ' || (o_orderkey % 5 + 1) || ' months' when '3-MEDIUM' then 'come on ' || strftime(o_orderdate, '%Y-%m-%d') when '4-NOT SPECIFIED' then 'SOS' else 'see note' end as s from orders)
select o_orderkey, case when s = 'SOS' then 'as_needed' when s = 'see note' then 'unclear' when s like 'come on%' then 'date' else 'interval' end as kind, case when s like '%after%' or s like 'in %' then cast(regexp_extract(s, '([0-9]+)', 1) as bigint) end as n_from,
  case when s like '%after%' then cast(regexp_extract(s, '-([0-9]+)', 1) as bigint) end as n_to, case when s like '%week%' then 'week' when s like '%month%' then 'month' end as unit from t""")
def follow_ups(spark, sf_dir):
    """Follow-up texts to ranges, intervals, dates, as needed."""
    text = F.expr("""case o_orderpriority when '1-URGENT' then concat('Review after ', o_orderkey % 9 + 1, '-', o_orderkey % 9 + 3, ' weeks') when '2-HIGH' then concat('in ', o_orderkey % 5 + 1, ' months')
      when '3-MEDIUM' then concat('come on ', date_format(o_orderdate, 'yyyy-MM-dd')) when '4-NOT SPECIFIED' then 'SOS' else 'see note' end""")
    kind, low, high, unit = R.follow_up(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"), low.alias("n_from"), high.alias("n_to"), unit.alias("unit"))


@register("rerouted", """with n as (select doc_id, source, len(regexp_extract_all(lower(text), '[|]')) as tables, len(regexp_extract_all(lower(text), 'licens')) as licence, len(regexp_extract_all(lower(text), 'token|password')) as secret from documents)
select doc_id, case when tables >= 2 and tables > licence and tables > secret then 'table' when licence >= 2 and licence > tables and licence > secret then 'licence' when secret >= 2 and secret > tables and secret > licence then 'secret' else source end as kind from n""")
def rerouted(spark, sf_dir):
    """I16: the type of a document by its own text, where that is clear."""
    times = lambda p: F.size(F.regexp_extract_all(F.lower("text"), F.lit(f"({p})"), F.lit(1)))
    kinds = {"table": times("[|]"), "licence": times("licens"), "secret": times("token|password")}
    return table(spark, sf_dir, "documents").select("doc_id", R.reroute(F.col("source"), kinds).alias("kind"))


@register("unreadable_lines", f"""with {_LINES}, q as (select doc_id, pos, length(regexp_replace(line, '[A-Za-z ]', '', 'g')) * 5 > length(line) as u, regexp_matches(lower(line), 'licens|token|password') as cue from l),
w as (select *, max(cue::int) over (partition by doc_id order by pos rows between 2 preceding and 2 following) = 1 as near, row_number() over (partition by doc_id order by pos desc) as p from q)
select doc_id, cast(pos as bigint) as pos, case when near then 'near a cue' else 'at the foot' end as why from w where u and (near or p <= 2)""")
def unreadable_lines(spark, sf_dir):
    """Unreadable lines near a cue or at the foot."""
    low = F.lower("line")
    odd = F.length(F.regexp_replace("line", "[A-Za-z ]", "")) * 5 > F.length("line")
    return R.near_cue_or_foot(_lines(spark, sf_dir).withColumn("pos", F.col("pos").cast("long")), "doc_id", "pos", odd, low.rlike("licens|token|password"))


_RULES = [("license", "legal", 1), ("the", "english", 2), ("der", "german", 3), ("und", "german", 3), ("la", "romance", 4), ("de", "romance", 4)]


@register("header_departments", f"""with {_LINES}, k(keyword, name, priority) as (values {", ".join(str(r) for r in _RULES)}), w as (select distinct doc_id, unnest(string_split_regex(lower(line), '[^a-z0-9]+')) as keyword from l where pos < 3)
select doc_id, name from (select doc_id, name, row_number() over (partition by doc_id order by priority, name) as rn from w join k using (keyword)) where rn = 1""")
def header_departments(spark, sf_dir):
    """A name from the first lines of a document, by the priority of rules."""
    rules = spark.createDataFrame(_RULES, "keyword string, name string, priority int")
    head = _lines(spark, sf_dir).where("pos < 3")
    return R.by_priority(head, "doc_id", "line", rules)


@register("surname_options", """with r as (select distinct substr(p_name, 1, cast(p_partkey % length(p_name) as int)) || '?' || substr(p_name, cast(p_partkey % length(p_name) as int) + 2) as reading from part), n as (select distinct p_name as name from part),
o as (select reading, name, reading = substr(name, 1, instr(reading, '?') - 1) || '?' || substr(name, instr(reading, '?') + 1) as fits, 1 - levenshtein(reading, name) / greatest(length(reading), length(name)) as s from r, n)
select reading, name, rank from (select *, row_number() over (partition by reading order by case when fits then 0 else 1 end, case when fits then -1.0 else -s end, name) as rank from o where fits or s >= 0.7) where rank <= 7""")
def surname_options(spark, sf_dir):
    """Names for a reading with an unread letter, seven at most."""
    p = table(spark, sf_dir, "part")
    at = F.expr("cast(p_partkey % length(p_name) as int)")
    masked = F.concat(F.expr("substr(p_name, 1, cast(p_partkey % length(p_name) as int))"), F.lit("?"), F.expr("substr(p_name, cast(p_partkey % length(p_name) as int) + 2)"))
    return R.wildcard_options(p.where(at >= 0).select(masked.alias("reading")), "reading", p, "p_name")


@register("snap_scores", f"""with r as (select distinct p_name as truth, {_SPELT} as reading from part), n as (select distinct p_name as name from part), s as (select truth, reading, name, 1 - levenshtein(reading, name) / greatest(length(reading), length(name)) as s from r, n),
b as (select truth, reading, name, s from (select *, row_number() over (partition by truth, reading order by s desc, name) as rn from s where s >= 0.6) where rn = 1), t as (select r.truth, r.reading, b.name, b.s from r left join b using (truth, reading)), c(cutoff) as (values (0.7), (0.8), (0.9), (0.95)),
x as (select cast(cutoff as double) as cutoff, truth, reading, case when s >= cutoff then name else reading end as w from t, c)
select cutoff, count(*) filter (where w <> reading) as changed, count(*) filter (where reading <> truth and w = truth) as fixed, count(*) filter (where reading = truth and w <> truth) as harmed, count(*) filter (where w = truth) as exact, round(sum(levenshtein(truth, w)) / sum(length(truth)), 6) as cer from x group by 1""")
def snap_scores(spark, sf_dir):
    """What snapping readings to names changes, fixes and harms, per cutoff."""
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("truth"), F.expr(_SPELT).alias("reading")).distinct()
    best = R.suggestions(p, "reading", p, "truth", 1, 0.6).select(F.col("text").alias("reading"), "name", "score")
    return R.snap_scores(p.join(best, "reading", "left"), "truth", "reading", "name", "score", [0.7, 0.8, 0.9, 0.95])


@register("assessed_facts", f"""with r as (select p_partkey, p_name || ' ' || p_size as a, case when p_partkey % 7 = 0 then null else substr(p_name, 1, length(p_name) - 1) || ' ' || (p_size + case when p_size > 40 then 1 else 0 end) end as b, p_size, p_type from part),
s as (select p_partkey, case when b is null then 'single' when {_NUM.format('a')} = {_NUM.format('b')} and 1 - levenshtein(a, b) / greatest(length(a), length(b)) >= 0.85 then 'agree' else 'disagree' end as state, case when p_size between 5 and 45 then 'in range' else 'out of range' end as range, p_type from r)
select p_partkey, 'readers:' || state || '>range:' || range || '>code:' || p_type as trace, case when state <> 'agree' then 'held: readers' when range <> 'in range' then 'held: range' when p_type = 'PROMO' then 'held: code' else 'supported' end as verdict from s""")
def assessed_facts(spark, sf_dir):
    """Readers, range and code of a fact, each with its outcome; the first that fails decides."""
    p = spread(table(spark, sf_dir, "part"))
    a = F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))
    b = F.when(F.col("p_partkey") % 7 != 0, F.concat(F.expr("substr(p_name, 1, length(p_name) - 1)"), F.lit(" "), (F.col("p_size") + F.when(F.col("p_size") > 40, 1).otherwise(0)).cast("string")))
    rows = R.compared_readers(p.select("p_partkey", "p_size", "p_type", a.alias("a"), b.alias("b")), "a", "b")
    fits = F.col("p_size").between(5, 45)
    tiers = [("readers", F.col("state"), F.col("state") == "agree"), ("range", F.when(fits, "in range").otherwise("out of range"), fits), ("code", F.col("p_type"), F.col("p_type") != "PROMO")]
    return R.assessed(rows, tiers).select("p_partkey", "trace", "verdict")
