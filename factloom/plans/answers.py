"""Nested answers built from orders and their lines as JSON text, parsed and fanned out; SQL reads the tables directly."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import answers as A
from factloom.plans.registry import register
from factloom.plans.tables import table

# of each line of an order: a medicine, a test result and an ordered test; the order's status chooses the document type
_BASE = """b as (select o_orderkey, o_orderstatus, o_custkey, l_linenumber, l_partkey, l_quantity, l_discount, p_name, p_brand, p_type, p_size,
  row_number() over (partition by o_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as seq from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey)"""
_STATUS = "case when l_discount > 0.08 then 'rejected' when l_discount < 0.01 then 'needs_check' else 'accepted' end"


def _answers(spark, sf_dir):
    """(document_id, schema_name, payload, created): two answers a document, the older one empty."""
    o, li, p = (table(spark, sf_dir, n) for n in ("orders", "lineitem", "part"))
    lines = li.join(p, F.col("p_partkey") == F.col("l_partkey"))
    status = F.when(F.col("l_discount") > 0.08, "rejected").when(F.col("l_discount") < 0.01, "needs_check").otherwise("accepted")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    # an order's lines are brought together by what their texts are made of, which is shorter than the texts
    item = F.struct(*order, "p_name", "p_brand", status.alias("status"), "p_type", "p_size")
    e = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(item)).alias("e"))
    d = o.join(e, "o_orderkey")
    pulse = F.struct(F.lit("HR").alias("name"), F.size("e").cast("string").alias("value"))
    pressure = F.struct(F.lit(" BP ").alias("name"), F.concat((F.col("o_custkey") % 60 + 100).cast("string"), F.lit("/"), (F.col("o_custkey") % 30 + 60).cast("string")).alias("value"))
    again = F.struct(F.lit("pulse").alias("name"), F.lit("1").alias("value"))
    name = F.struct(F.struct(F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("value"), F.when(F.col("o_custkey") % 2 == 0, "checked").otherwise("needs_check").alias("status")).alias("name"))
    medicine = lambda x: F.struct(F.concat(F.lit("Tab "), x["p_name"], F.lit(" "), x["p_size"].cast("string"), F.lit(" mg")).alias("text"), F.when(x["p_size"] > 25, "1-0-1").otherwise("q8h").alias("frequency"), F.concat((x["p_size"] % 9 + 1).cast("string"), F.lit(" days")).alias("duration"))
    result = lambda x: F.struct(F.struct(x["p_brand"].alias("value"), x["status"].alias("status")).alias("name"), x["l_quantity"].alias("value"), F.lit("mg").alias("unit"), (x["p_size"] > 15).alias("recognised"))
    pick = lambda f: F.transform("e", f)
    body = F.to_json(F.struct(name.alias("patient"), pick(medicine).alias("medications"), F.col("e")["p_type"].alias("investigations"), F.array(F.lit("rest")).alias("advice"), pick(result).alias("results"), F.array(pressure, pulse, again).alias("vitals")))
    kind = F.when(F.col("o_orderstatus") == "O", "prescription").when(F.col("o_orderstatus") == "F", "lab_report").otherwise("vitals")
    # both answers are made of one row, so that lines and parts are joined once
    made = d.withColumn("created", F.explode(F.array(F.lit(2), F.lit(1)))).select(F.col("o_orderkey").alias("document_id"), kind.alias("schema_name"), F.when(F.col("created") == 2, body).otherwise("{}").alias("payload"), "created")
    return A.latest_answers(made, "document_id", "payload", [F.desc("created")])


@register("answer_facts", f"""with {_BASE}
select o_orderkey as document_id, 'medication' as fact_type, seq, p_name as name, cast(p_size as double) as value_num, null as value_text, 'mg' as unit from b where o_orderstatus = 'O'
union all select o_orderkey, 'order', seq, p_type, null, null, null from b where o_orderstatus = 'O' union all select distinct o_orderkey, 'advice', 1, 'advice', null, 'rest', null from b where o_orderstatus = 'O'
union all select o_orderkey, 'observation', seq, p_brand, l_quantity, null, 'mg' from b where o_orderstatus = 'F' and l_discount <= 0.08
union all select distinct o_orderkey, 'vital', 1, 'systolic', cast(o_custkey % 60 + 100 as double), null, null from b where o_orderstatus not in ('O', 'F') union all select distinct o_orderkey, 'vital', 1, 'diastolic', cast(o_custkey % 30 + 60 as double), null, null from b where o_orderstatus not in ('O', 'F')
union all select o_orderkey, 'vital', 1, 'pulse', cast(count(*) as double), null, null from b where o_orderstatus not in ('O', 'F') group by 1""")
def answer_facts(spark, sf_dir):
    """The latest nested answer of each document to fact rows, by its document type."""
    return A.fan_out_answers(_answers(spark, sf_dir))


@register("medication_rows", f"""with {_BASE} select o_orderkey as document_id, seq, p_name as name, cast(p_size as double) as strength, 'mg' as unit, cast(case when p_size > 25 then 2 else 3 end as double) as per_day, cast(p_size % 9 + 1 as bigint) as days from b where o_orderstatus = 'O'""")
def medication_rows(spark, sf_dir):
    """C4: strength, doses a day and days of each medicine of an answer."""
    return A.medications(_answers(spark, sf_dir).where("schema_name = 'prescription'"))


@register("flat_tests", f"""with {_BASE}, t as (select o_orderkey, o_custkey, p_brand, {_STATUS} as status, l_quantity, row_number() over (partition by o_orderkey order by seq) as k from b where l_discount <= 0.08 and p_size > 15),
d as (select distinct o_orderkey, o_custkey from b)
select d.o_orderkey as document_id, 'P' || d.o_custkey as patient_name, case when d.o_custkey % 2 = 0 then 'checked' else 'needs_check' end as patient_name_status, case when k is null then 'no_lab_test' else 'lab_test' end as row_kind, k as seq, p_brand as test, status as test_status, l_quantity as value from d left join t using (o_orderkey)""")
def flat_tests(spark, sf_dir):
    """One row per recognised test, else one row that says there is none."""
    return A.flat_tests(_answers(spark, sf_dir))


@register("document_states", f"""with {_BASE} select o_orderkey as document_id, count(*) as n_tests, count(*) as n_medications, case when bool_or({_STATUS} = 'needs_check') then 'needs_check' else 'complete' end as status from b group by 1""")
def document_states(spark, sf_dir):
    """Buckets of an answer and the state of its document."""
    return A.document_states(_answers(spark, sf_dir))


@register("visit_identity", """with v as (select user_id, case when value > 50 then event_type end as name, case when value < 30 then event_id end as number, row_number() over (partition by user_id order by ts, event_id) as rn from events)
select user_id, min_by(name, rn) filter (where name is not null) as name, min_by(number, rn) filter (where number is not null) as number from v group by 1""")
def visit_identity(spark, sf_dir):
    """Identity filled from the first visit that has it."""
    v = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.when(F.col("value") > 50, F.col("event_type")).alias("name"), F.when(F.col("value") < 30, F.col("event_id")).alias("number"))
    return A.patient_identity(v, "user_id", [F.col("ts"), F.col("event_id")], ["name", "number"])
