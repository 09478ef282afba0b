"""Ages, persons, promotion and written orders over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from factloom.functions import orders as O
from factloom.operators import people as P
from factloom.plans.reading import _lines
from factloom.plans.registry import register
from factloom.plans.tables import spread, table

_AGE = "case when o_orderkey % 11 = 0 then 'unknown' when o_orderkey % 7 = 0 then cast(o_orderkey % 30 as varchar) || ' months' when o_orderkey % 5 = 0 then cast(o_orderkey % 140 as varchar) else cast(2024 - year(o_orderdate) + o_orderkey % 4 as varchar) || ' yrs' end"
_BORN = "case when o_orderkey % 13 = 0 then null when o_orderkey % 17 = 0 then 'in spring' when o_orderkey % 3 = 0 then strftime(o_orderdate, '%d/%m/%y') when o_orderkey % 3 = 1 then strftime(o_orderdate, '%Y-%m-%d') else strftime(o_orderdate, '%d.%m.%Y') end"


@register("checked_ages", f"""with w as (select o_orderkey, o_orderdate, {_AGE} as a, {_BORN} as b from orders),
p as (select *, case when a = 'unknown' then null when a like '%months' then try_cast(split_part(a, ' ', 1) as int) // 12 else try_cast(split_part(a, ' ', 1) as int) end as y0, case when b is null or b = 'in spring' then null else cast(o_orderdate as date) end as d from w),
q as (select *, case when y0 <= 120 then y0 end as years, date_sub('month', d, date '2024-07-01') // 12 as derived from p),
r as (select *, years is not null and d is not null and abs(derived - years) > 1 as apart from q)
select o_orderkey, years, case when d is not null then d else make_date(2024 - years, 1, 1) end as birth_date, case when years is null or apart then 'needs check' else 'checked' end as age_status,
  case when b is null then 'absent' when d is null or apart then 'needs check' else 'checked' end as born_status, case when b is not null and d is null then 'not a readable date' when years is null then 'age not plausible' when apart then 'age and date of birth do not agree' end as reason from r""")
def checked_ages(spark, sf_dir):
    """Written ages and dates of birth (three forms, two-digit years), each plausible, and not more than a year apart."""
    o = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    key = F.col("o_orderkey")
    age = F.when(key % 11 == 0, "unknown").when(key % 7 == 0, F.concat((key % 30).cast("string"), F.lit(" months"))).when(key % 5 == 0, (key % 140).cast("string")).otherwise(F.concat((2024 - F.year(day) + key % 4).cast("string"), F.lit(" yrs")))
    born = F.when(key % 13 == 0, F.lit(None)).when(key % 17 == 0, "in spring").when(key % 3 == 0, F.date_format(day, "dd/MM/yy")).when(key % 3 == 1, F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "dd.MM.yyyy"))
    return P.checked_age(o.select("o_orderkey", age.alias("age"), born.alias("born")), "o_orderkey", "age", "born", F.to_date(F.lit("2024-07-01")))


@register("guarded_facts", """with d as (select o_orderkey as doc, o_custkey as person, case when o_orderkey % 9 = 0 then 'Wrong Name' when o_orderkey % 4 = 0 then null else c_mktsegment || ' ' || n_name end as name, cast(o_orderdate as date) as born from orders join customer c on c.c_custkey = o_custkey join nation on n_nationkey = c.c_nationkey),
r as (select c_custkey as person, n_name || ' ' || c_mktsegment as name, date '1995-01-01' + cast(c_custkey % 2000 as int) as born from customer join nation on n_nationkey = c_nationkey),
f as (select doc, (d.name is null or d.name <> 'Wrong Name') as nf, abs(d.born - r.born) <= 366 as bf from d join r using (person))
select case when nf and bf then 'fits' when not nf and not bf then 'another person' when not nf then 'another name' else 'another birth date' end as outcome, count(distinct doc) as documents, count(l_orderkey) filter (where nf and bf) as facts from f left join lineitem on l_orderkey = doc group by 1""")
def guarded_facts(spark, sf_dir):
    """Documents against the person chosen for them, by name and date of birth; facts of documents that do not fit are withdrawn."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = table(spark, sf_dir, "customer").join(n, "c_nationkey")
    o = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    name = F.when(F.col("o_orderkey") % 9 == 0, "Wrong Name").when(F.col("o_orderkey") % 4 != 0, F.concat_ws(" ", "c_mktsegment", "n_name"))
    d = o.select(F.col("o_orderkey").alias("doc"), F.col("o_custkey").alias("person"), name.alias("name"), F.col("o_orderdate").cast("date").alias("birth_date"))
    r = c.select(F.col("c_custkey").alias("person"), F.concat_ws(" ", "n_name", "c_mktsegment").alias("name"), F.expr("date_add(date'1995-01-01', cast(c_custkey % 2000 as int))").alias("birth_date"))
    checked, facts = P.guarded(d, r, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), "l_linenumber"), "doc", "person")
    stay = checked.select("doc", "outcome").join(facts.groupBy("doc").agg(F.count("*").alias("n")), "doc", "left")
    return stay.groupBy("outcome").agg(F.count("*").alias("documents"), F.sum(F.coalesce("n", F.lit(0))).alias("facts"))


_DECIDED = "select l_orderkey * 10 + l_linenumber as id, l_orderkey as doc, case l_returnflag when 'R' then 'medication' when 'A' then 'observation' else 'order' end as kind, case when l_tax > 0.06 then 'reject' when l_tax > 0.04 then 'correct' else 'accept' end as decision, cast(l_quantity as double) as value, case when l_tax > 0.05 then round(l_extendedprice, 2) end as corrected, l_suppkey, l_partkey from lineitem"


@register("promoted_rows", f"""with e as ({_DECIDED}), a as (select *, case when decision = 'correct' then coalesce(corrected, value) else value end as final from e where decision <> 'reject' and id % 5 <> 0)
select kind as target, doc, count(*) as n, round(sum(final), 2) as total from a group by 1, 2 union all select 'provenance', doc, count(*), null from a group by doc
union all select 'verification:' || case when decision = 'accept' or final = value then 'confirmed' else 'changed' end, doc, count(*), round(sum(final), 2) from a group by 1, doc union all select 'report', doc, count(*), null from a where kind = 'observation' group by doc""")
def promoted_rows(spark, sf_dir):
    """C11, C14: accepted and corrected elements to their tables, with provenance, verification and one report a document; promoted ones are skipped."""
    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "medication").when(F.col("l_returnflag") == "A", "observation").otherwise("order")
    decision = F.when(F.col("l_tax") > 0.06, "reject").when(F.col("l_tax") > 0.04, "correct").otherwise("accept")
    e = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("doc"), kind.alias("kind"), decision.alias("decision"), F.col("l_quantity").cast("double").alias("value"), F.when(F.col("l_tax") > 0.05, F.round("l_extendedprice", 2).cast("double")).alias("corrected"), "l_suppkey", "l_partkey")
    # every item is decided once: repeated keys of the table are items of their own
    targets = {"medication": {"part": F.col("l_partkey"), "final": F.col("final")}, "observation": {"code": F.col("l_partkey"), "performer": F.col("l_suppkey"), "final": F.col("final")}, "order": {"item": F.col("l_partkey"), "final": F.col("final")}}
    out = P.promoted(e, e.where("id % 5 = 0").select("id"), "id", "doc", targets, "reviewer")
    none = F.lit(None).cast("double")
    rows = [out[k].groupBy("doc").agg(F.count("*").alias("n"), F.round(F.sum("final"), 2).alias("total")).select(F.lit(k).alias("target"), "doc", "n", "total") for k in targets]
    rows.append(out["provenance"].groupBy("doc").agg(F.count("*").alias("n")).select(F.lit("provenance").alias("target"), "doc", "n", none.alias("total")))
    v = out["verification"].withColumn("doc", F.expr("id div 10"))
    rows.append(v.groupBy(F.concat(F.lit("verification:"), "outcome").alias("target"), "doc").agg(F.count("*").alias("n"), F.round(F.sum("verified"), 2).alias("total")))
    rows.append(out["report"].select(F.lit("report").alias("target"), "doc", "n", none.alias("total")))
    return reduce(lambda x, y: x.union(y), rows)


@register("split_orders")
def split_orders(spark, sf_dir):
    """Written lists taken apart with the names that the parts table knows (held against given lists and a loop in a test)."""
    p = spread(table(spark, sf_dir, "part"))
    names = p.select(F.explode(F.split("p_name", " ")).alias("name")).union(p.select("p_type")).distinct()
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat_ws("/", "p_type", "p_name")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("1) "), F.replace("p_name", F.lit(" "), F.lit("")), F.lit(", sugar F PP"))).otherwise(F.concat_ws(" + ", "p_name", F.concat(F.lit("serum "), "p_type")))
    return O.split_orders(p.select("p_partkey", text.alias("text")), ["p_partkey"], "text", names, "name")


@register("not_ordered")
def not_ordered(spark, sf_dir):
    """Words of the lines with bars that no plain line of their document holds (held against given pages in a test)."""
    pages = _lines(spark, sf_dir)
    words = F.array_distinct(F.split(F.lower("line"), "[^a-z]+"))
    names = pages.where("contains(line, '|')").select("doc_id", F.explode(words).alias("name")).where("length(name) >= 3").distinct()
    return O.not_ordered(names, "name", pages, "doc_id", "pos", "line", spark.createDataFrame([("token",)], "name string"), 1)


@register("medicine_grammar", """with m as (select l_orderkey, l_linenumber, l_partkey, cast(cast(l_quantity as int) as varchar) || case l_suppkey % 3 when 0 then ' mg' when 1 then 'ml' else ' boxes' end as s, case l_returnflag when 'R' then 'b.d' when 'A' then '1-0-1' else 'often' end as f, case when l_linenumber % 2 = 0 then 'x ' || l_linenumber || ' wks' end as d from lineitem)
select l_orderkey * 10 + l_linenumber as id, 'strength' as field, count(*) as n, count(*) filter (where s like '%boxes') as bad from m group by 1 union all select l_orderkey * 10 + l_linenumber, 'frequency', count(*), count(*) filter (where f = 'often') from m group by 1
union all select l_orderkey * 10 + l_linenumber, 'duration', count(*), 0 from m where d is not null group by 1""")
def medicine_grammar(spark, sf_dir):
    """Strength, frequency and duration of a medicine by their grammar."""
    li = table(spark, sf_dir, "lineitem")
    mode = F.col("l_suppkey") % 3
    m = li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat(F.col("l_quantity").cast("int").cast("string"), F.when(mode == 0, " mg").when(mode == 1, "ml").otherwise(" boxes")).alias("s"),
        F.when(F.col("l_returnflag") == "R", "b.d").when(F.col("l_returnflag") == "A", "1-0-1").otherwise("often").alias("f"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("x "), "l_linenumber", F.lit(" wks"))).alias("d"),
    )
    return O.medicine_grammar(m, "id", strength="s", frequency="f", duration="d").groupBy("id", "field").agg(F.count("*").alias("n"), F.count_if(F.col("problem").isNotNull()).alias("bad"))
