"""Binding and matching over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions.similarity import jaro_winkler, similarity_join
from factloom.operators import matching as M
from factloom.plans.registry import register
from factloom.plans.tables import table

#: A misspelling by rule: the character at position key mod length is left out.
_SPELT = "substr(p_name, 1, cast(p_partkey % length(p_name) as int)) || substr(p_name, cast(p_partkey % length(p_name) as int) + 2)"


def _misspelt(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", F.expr(_SPELT).alias("reading"))


_KEY = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')"
_CASCADE = f"""r as (select distinct {_SPELT} as reading from part), rk as (select reading, {_KEY.format('reading')} as key from r),
a as (select distinct p_name as alias, p_brand as concept, {_KEY.format('p_name')} as akey from part),
sure as (select reading, concept, 1 as level, 1.0 as score from rk join a on reading = alias
  union all select reading, concept, 2, 0.97 from rk join a on key = akey and reading <> alias),
near as (select reading, concept, 3 as level, (1 - levenshtein(key, akey) / greatest(length(key), length(akey))) * 0.95 as score from rk join a
  on abs(length(key) - length(akey)) <= 0.18 * greatest(length(key), length(akey)) and regexp_replace(key, '[^0-9]+', '', 'g') = regexp_replace(akey, '[^0-9]+', '', 'g')
  where reading not in (select reading from sure) and 1 - levenshtein(key, akey) / greatest(length(key), length(akey)) >= 0.82),
best as (select reading, concept, max(cast(score as double)) as score, min(level) as level from (select * from sure union all select * from near) group by 1, 2),
ranked as (select *, row_number() over (partition by reading order by score desc, concept) as rank from best)"""


def _cascade(spark, sf_dir):
    p = _misspelt(spark, sf_dir)
    return M.alias_cascade(p.select("reading"), table(spark, sf_dir, "part").select(F.col("p_name").alias("alias"), F.col("p_brand").alias("concept")))


@register("alias_cascade", f"with {_CASCADE} select reading, concept, cast(level as integer) as level, round(score, 3) as score, rank from ranked where rank <= 5")
def alias_cascade(spark, sf_dir):
    """Exact, normalised, then all fuzzy candidates with the same digits, whichever letter is wrong."""
    return _cascade(spark, sf_dir).withColumn("score", F.round("score", 3)).select("reading", "concept", "level", "score", "rank")


@register("ambiguous_aliases", f"""with {_CASCADE}, k as (select * from ranked where rank <= 5), t as (select reading, max(score) as top from k group by 1)
select reading, count(*) filter (where score >= top - 0.03) > 1 as collision, count(*) as n from k join t using (reading) group by reading""")
def ambiguous_aliases(spark, sf_dir):
    """Readings whose best candidates are too close."""
    return M.mark_collisions(_cascade(spark, sf_dir), "reading").groupBy("reading").agg(F.bool_or("collision").alias("collision"), F.count("*").alias("n"))


#: Names as written (a character left out), the id where it was read, and a birth year that is at times off.
_WRITTEN = _SPELT.replace("p_name", "c_name").replace("p_partkey", "c_custkey")
_YEAR = "1930 + c_custkey % 60"


@register("resolve_names", f"""with w as (select distinct {_WRITTEN} as a from customer)
select a, c_name as b, round(1 - levenshtein(a, c_name) / greatest(length(a), length(c_name)), 4) as score from w join (select distinct c_name from customer) c
on abs(length(a) - length(c_name)) <= 1 where 1 - levenshtein(a, c_name) / greatest(length(a), length(c_name)) >= 0.94""")
def resolve_names(spark, sf_dir):
    """All written readings of customer names against all customers."""
    c = table(spark, sf_dir, "customer").select("c_name", F.expr(_WRITTEN).alias("reading"))
    return similarity_join(c, c, "reading", "c_name", 0.94).withColumn("score", F.round("score", 4))


@register("resolve_entities", f"""with w as (select c_custkey as key, case when c_acctbal < 0 then c_custkey end as id, {_WRITTEN} as name, {_YEAR} + case when c_nationkey < 5 then 4 else 0 end as year from customer),
k as (select c_custkey as person, c_name as name, {_YEAR} as year from customer),
s as (select key, person, 1 - levenshtein(w.name, k.name) / greatest(length(w.name), length(k.name)) as plain, w.year as wy, k.year as ky from w join k on abs(length(w.name) - length(k.name)) <= 1 where id is null),
t as (select key, person, plain - case when abs(wy - ky) > 1 then 0.3 else 0 end as s from s where plain >= 0.94),
b as (select key, person, s from (select *, row_number() over (partition by key order by s desc, person) as rn from t where s >= 0.94) where rn = 1)
select w.key, coalesce(w.id, b.person) as matched, case when w.id is not null then 'id' when b.person is not null then 'name' else 'new' end as method,
  round(case when w.id is not null then 1.0 else b.s end, 4) as score, case when w.id is null and b.person is null then 'N' || substr(sha256(w.name || '|' || cast(w.year as varchar)), 1, 12) end as new_id
from w left join b on b.key = w.key""")
def resolve_entities(spark, sf_dir):
    """Exact id, else the best name less a penalty for another birth year, else a new id."""
    c = table(spark, sf_dir, "customer")
    year = F.expr(_YEAR)
    w = c.select(F.col("c_custkey").alias("key"), F.when(F.col("c_acctbal") < 0, F.col("c_custkey")).alias("id"), F.expr(_WRITTEN).alias("name"), (year + F.when(F.col("c_nationkey") < 5, 4).otherwise(0)).alias("year"))
    k = c.select(F.col("c_custkey").alias("person"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), year.alias("year"))
    return M.resolve_entities(w, k, floor=0.94)


@register("code_binding", """with codes as (select distinct upper(p_type) as key, 'C' || cast(length(p_type) as varchar) as code, case when length(p_type) % 2 = 0 then 'open' else 'closed' end as system from part),
n as (select regexp_replace(lower(key), '[^a-z0-9]+', '', 'g') as k, min(code) as code, min(system) as system, count(distinct code) as n from codes group by 1)
select p_partkey, case when n.n = 1 and n.system = 'open' then n.code end as code, case when n.n > 1 then 'candidate' when n.n is null then 'unbound' when n.system = 'open' then 'bound' else 'local_only' end as code_status
from part left join n on regexp_replace(lower(p_type), '[^a-z0-9]+', '', 'g') = n.k""")
def code_binding(spark, sf_dir):
    """Spellings to codes, masked by licence."""
    p = table(spark, sf_dir, "part")
    size = F.length("p_type")
    codes = p.select(F.upper("p_type").alias("key"), F.concat(F.lit("C"), size.cast("string")).alias("code"), F.when(size % 2 == 0, "open").otherwise("closed").alias("system")).distinct()
    return M.bind_codes(p.select("p_partkey", "p_type"), "p_type", codes, ["open"]).select("p_partkey", "code", "code_status")


@register("evidence_overlap", """with a as (select item_id, count(*) over (partition by item_id) as n, w from (select distinct item_id, unnest(string_split_regex(lower(text), '[^a-z]+')) as w from benchmark) where w <> ''),
b as (select distinct doc_id, w from (select doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) as w from documents) where w <> ''),
h as (select item_id, doc_id, count(*) as shared, round(count(*) / max(n), 4) as share from a join b using (w) group by 1, 2 having count(*) >= 0.6 * max(n))
select item_id, doc_id, shared, share, rank from (select *, row_number() over (partition by item_id order by share desc, doc_id) as rank from h) where rank <= 4""")
def evidence_overlap(spark, sf_dir):
    """Documents that hold most words of a passage."""
    words = lambda df, k: df.select(k, F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "").alias("t"))
    return M.token_overlap_join(words(table(spark, sf_dir, "benchmark"), "item_id"), words(table(spark, sf_dir, "documents"), "doc_id"), "item_id", "t", "doc_id", "t")


@register("consensus", """with v as (select c_nationkey as k, c_mktsegment as v, count(*) as n from customer group by 1, 2),
s as (select a.k, a.v, a.n, round(sum(b.n * (1 - levenshtein(a.v, b.v) / greatest(length(a.v), length(b.v)))), 6) as s from v a join v b on a.k = b.k group by 1, 2, 3)
select k as c_nationkey, v as c_mktsegment, n as votes from (select *, row_number() over (partition by k order by s desc, n desc, v) as rn from s) where rn = 1""")
def consensus(spark, sf_dir):
    """The value closest to all others of its key."""
    return M.consensus(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment")


@register("votes", """with n as (select user_id, event_type, count(*) as n from events group by 1, 2 having count(*) >= 2)
select user_id, event_type, n from (select *, row_number() over (partition by user_id order by n desc, event_type) as rn from n) where rn = 1""")
def votes(spark, sf_dir):
    """A value that two readings agree on."""
    return M.votes(table(spark, sf_dir, "events"), "user_id", "event_type")


_LINKS = """m as (select s_suppkey as master, s_name as name, 'R' || cast(s_suppkey * 7 as varchar) as reg_no, s_nationkey % 5 as field from supplier),
w as (select s_suppkey as key, substr(s_name, 1, length(s_name) - 1) || '0' as name, case when s_acctbal > 5000 then 'R' || cast(s_suppkey * 7 as varchar) end as reg_no, case when s_acctbal < 0 then -1 else s_nationkey % 5 end as field from supplier),
p as (select key, master, w.field as wf, m.field as mf, w.reg_no is not distinct from m.reg_no as numbered, 1 - levenshtein(w.name, m.name) / greatest(length(w.name), length(m.name)) as s from w join m on w.reg_no = m.reg_no or levenshtein(w.name, m.name) <= 1),
f as (select key, master, max(greatest(case when numbered then case when s >= 0.8 then 0.99 else 0.9 end else 0 end, case when s >= 0.93 then s * case when wf = mf then 1.0 else 0.97 end else 0 end)) as score from p group by 1, 2),
r as (select *, row_number() over (partition by key order by score desc, master) as rn, lead(score) over (partition by key order by score desc, master) as second, count(*) over (partition by key) as n from f where score > 0)"""
_LINKED = "select w.key, case when score >= 0.93 and (second is null or score - second >= 0.03 - 1e-9) then master end as linked, round(score, 4) as score, coalesce(least(n, 5), 0) as n from w left join r on r.key = w.key and rn = 1"


@register("practitioner_match", f"with {_LINKS} {_LINKED}")
def practitioner_match(spark, sf_dir):
    """By registration number, else by name and field; a link needs a high score and a clear gap to the runner-up."""
    return _practitioners(spark, sf_dir)


def _practitioners(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    reg, field = F.concat(F.lit("R"), (F.col("s_suppkey") * 7).cast("string")), F.col("s_nationkey") % 5
    m = s.select(F.col("s_suppkey").alias("master"), F.col("s_name").alias("name"), reg.alias("reg_no"), field.alias("field"))
    w = s.select(F.col("s_suppkey").alias("key"), F.expr("substr(s_name, 1, length(s_name) - 1) || '0'").alias("name"), F.when(F.col("s_acctbal") > 5000, reg).alias("reg_no"), F.when(F.col("s_acctbal") < 0, -1).otherwise(field).alias("field"))
    return M.practitioner_links(w, m, floor=0.93)


@register("box_overlap", """with b as (select event_id as id, user_id as page, event_id % 500 as x0, (event_id * 7) % 900 as y0, event_id % 500 + 40 as x1, (event_id * 7) % 900 + 30 as y1 from events)
select a.page, a.id as a_id, count(*) as n, min(b.id) as first_id from b a join b on a.page = b.page and a.id <> b.id
where greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) >= 0.5 * 40 * 30 group by 1, 2""")
def box_overlap(spark, sf_dir):
    """Boxes of one page that others cover by half, with their number and the first of them."""
    e = table(spark, sf_dir, "events")
    x, y = F.col("event_id") % 500, (F.col("event_id") * 7) % 900
    b = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("page"), x.alias("x0"), y.alias("y0"), (x + 40).alias("x1"), (y + 30).alias("y1"))
    return M.box_overlap_join(b, b, "page", same=True)


@register("ratcliff_names")
def ratcliff_names(spark, sf_dir):
    """Matching-block and Jaro-Winkler scores of all readings and names at least 0.8 alike (held against all pairs in a test)."""
    p = _misspelt(spark, sf_dir)
    found = similarity_join(p, p, "reading", "p_name", 0.8, "ratcliff")
    return found.select(F.col("a").alias("reading"), F.col("b").alias("name"), F.round("score", 4).alias("ratcliff"), F.round(jaro_winkler("a", "b"), 4).alias("jaro_winkler"))



@register("fact_candidates", f"""with {_CASCADE}, k as (select * from ranked where rank <= 5), t as (select reading, max(score) as top from k group by 1), c as (select k.reading, max(case when rank = 1 then concept end) as best, count(*) filter (where score >= top - 0.03) as near, count(*) as n from k join t using (reading) group by 1)
select p_partkey, {_SPELT} as reading, case when near = 1 then best end as code, case when n is null then 'unresolved' when near = 1 then 'bound' else 'candidates' end as status, coalesce(n, 0) as n_candidates from part left join c on c.reading = {_SPELT}""")
def fact_candidates(spark, sf_dir):
    """Candidates of each fact; the reading is kept, an unbound fact gains the top code where it is clear."""
    c = M.mark_collisions(_cascade(spark, sf_dir), "reading").groupBy("reading").agg(F.max(F.when(F.col("selected"), F.col("concept"))).alias("code"), F.count("*").alias("n"))
    rows = _misspelt(spark, sf_dir).join(c, "reading", "left")
    status = F.when(F.col("n").isNull(), "unresolved").when(F.col("code").isNotNull(), "bound").otherwise("candidates")
    return rows.select("p_partkey", "reading", "code", status.alias("status"), F.coalesce("n", F.lit(0)).alias("n_candidates"))


@register("linked_documents", f"with {_LINKS}, k as ({_LINKED}) select l_orderkey, l_linenumber, l_partkey, linked, case when linked is null then 'no clear link' else 'score ' || cast(round(score, 2) as varchar) end as evidence from lineitem join k on key = l_suppkey")
def linked_documents(spark, sf_dir):
    """The practitioner link written back to each document with its evidence."""
    k = _practitioners(spark, sf_dir)
    evidence = F.when(F.col("linked").isNull(), "no clear link").otherwise(F.concat(F.lit("score "), F.round("score", 2).cast("string")))
    return table(spark, sf_dir, "lineitem").join(k, F.col("key") == F.col("l_suppkey")).select("l_orderkey", "l_linenumber", "l_partkey", "linked", evidence.alias("evidence"))
