"""Rules, gate, policies, conflicts and review tasks over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import rules as R
from factloom.plans.registry import register
from factloom.plans.tables import FACTS, facts, table

#: Plausible values by kind, shared by query and SQL.
RANGES = [("click", 0.0, 90.0), ("view", 1.0, 80.0), ("purchase", 5.0, 95.0), ("error", 0.0, 50.0)]
_RANGES = ", ".join(f"('{k}', {lo}, {hi})" for k, lo, hi in RANGES)

_FINDINGS = """found as (
  select l_orderkey * 10 + l_linenumber as fact_id, l_orderkey, l_returnflag, l_linestatus, case when l_discount < 0.095 then round(1 - l_discount, 4) end as conf, l_tax > 0.07 as partial,
    case when l_quantity > 45 then 1 else 0 end as n_block, (case when l_extendedprice > 50000 then 1 else 0 end) + (case when l_quantity < 3 then 1 else 0 end) as n_warn,
    l_returnflag = 'R' and (l_quantity > 45 or l_quantity < 3) as dosed
  from lineitem),
cal as (select *, round(greatest(0.0, least(coalesce(conf, 0.0) - case when partial then 0.30 else 0.0 end, case when n_block > 0 then 0.5 when n_warn > 0 then 0.9 else 1.0 end)), 3) as calibrated from found)"""
_POLICY = """p(kind, state, action, min_conf) as (values ('R', 'F', 'review', cast(0.95 as double)), ('R', null, 'auto', 0.9), ('A', null, 'auto', 0.92)),
ruled as (select cal.*, coalesce(s.action, d.action, 'review') as action, coalesce(s.min_conf, d.min_conf) as min_conf
  from cal left join p s on s.kind = l_returnflag and s.state = l_linestatus left join p d on d.kind = l_returnflag and d.state is null),
gated as (select *, case when n_block > 0 or partial or action = 'review' or calibrated < 0.85 or coalesce(calibrated < min_conf, false) or dosed then 'review'
  when calibrated >= 0.985 and n_block + n_warn = 0 then 'auto_accepted' when calibrated >= 0.95 then 'auto_accepted' else 'review' end as gate from ruled)"""
POLICY = [("R", "F", "review", 0.95), ("R", None, "auto", 0.9), ("A", None, "auto", 0.92)]


def _lines(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    low, high = F.col("l_quantity") < 3, F.col("l_quantity") > 45
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact_id"), "l_orderkey", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice",
        F.when(F.col("l_discount") < 0.095, F.round(1 - F.col("l_discount"), 4)).alias("conf"), (F.col("l_tax") > 0.07).alias("partial"),
        high.cast("long").alias("n_block"), ((F.col("l_extendedprice") > 50000).cast("long") + low.cast("long")).alias("n_warn"), ((F.col("l_returnflag") == "R") & (low | high)).alias("dosed"),
    )


def _policy_table(spark):
    return spark.createDataFrame(POLICY, "kind string, state string, action string, min_conf double")


def _gated(spark, sf_dir):
    c = R.calibrated(F.col("conf"), F.col("partial"), F.col("n_warn"), F.col("n_block"))
    rows = R.with_policy(_lines(spark, sf_dir).withColumn("calibrated", c), _policy_table(spark), "l_returnflag", "l_linestatus")
    state = R.gate_state(F.col("calibrated"), F.col("partial"), F.col("n_block") + F.col("n_warn"), F.col("n_block"), F.col("action"), F.col("min_conf"), F.col("dosed"))
    return rows.withColumn("gate", state)


@register("range_findings", f"""with r(kind, lo, hi) as (values {_RANGES})
select event_id, 'warning' as severity, 'below_range' as code from events join r on event_type = kind where value < lo
union all select event_id, 'warning', 'above_range' from events join r on event_type = kind where value > hi
union all select event_id, 'info', 'no_value' from events join r on event_type = kind where value is null""")
def range_findings(spark, sf_dir):
    """Values outside the range of their kind."""
    ranges = spark.createDataFrame(RANGES, "kind string, lo double, hi double")
    return R.range_findings(table(spark, sf_dir, "events"), "event_id", "event_type", "value", ranges)


@register("findings_table", """select l_orderkey * 10 + l_linenumber as fact_id, 'blocker' as severity, 'dose_ceiling' as code from lineitem where l_quantity > 45
union all select l_orderkey * 10 + l_linenumber, 'warning', 'price_high' from lineitem where l_extendedprice > 50000
union all select l_orderkey * 10 + l_linenumber, 'warning', 'quantity_low' from lineitem where l_quantity < 3""")
def findings_table(spark, sf_dir):
    """One row per rule that a fact breaks."""
    rules = [(F.col("l_quantity") > 45, "blocker", "dose_ceiling"), (F.col("l_extendedprice") > 50000, "warning", "price_high"), (F.col("l_quantity") < 3, "warning", "quantity_low")]
    return R.findings(_lines(spark, sf_dir), "fact_id", rules)


@register("calibrate", f"with {_FINDINGS} select fact_id, calibrated from cal")
def calibrate(spark, sf_dir):
    """Confidence after penalties and caps."""
    c = R.calibrated(F.col("conf"), F.col("partial"), F.col("n_warn"), F.col("n_block"))
    return _lines(spark, sf_dir).select("fact_id", c.alias("calibrated"))


@register("gate", f"with {_FINDINGS}, {_POLICY} select fact_id, gate as state from gated")
def gate(spark, sf_dir):
    """Accept or review, by findings, partial readings, the policy of the field, medication findings and confidence."""
    return _gated(spark, sf_dir).select("fact_id", F.col("gate").alias("state"))


@register("policy", """with p(kind, state, action, min_conf) as (values ('R', 'F', 'review', cast(0.95 as double)), ('R', null, 'auto', 0.9), ('A', null, 'auto', 0.92))
select l_orderkey * 10 + l_linenumber as fact_id, coalesce(s.action, d.action, 'review') as action, coalesce(s.min_conf, d.min_conf) as min_conf
from lineitem left join p s on s.kind = l_returnflag and s.state = l_linestatus left join p d on d.kind = l_returnflag and d.state is null""")
def policy(spark, sf_dir):
    """Action by fact type and evidence state, with a default row per type."""
    return R.with_policy(_lines(spark, sf_dir), _policy_table(spark), "l_returnflag", "l_linestatus").select("fact_id", "action", "min_conf")


@register("audit_sample", f"with {_FINDINGS}, {_POLICY} select fact_id from gated where gate = 'auto_accepted' and cast('0x' || substr(md5(cast(fact_id as varchar)), 1, 8) as bigint) % 1000 < 100")
def audit_sample(spark, sf_dir):
    """A repeatable tenth of the accepted facts."""
    return R.audit_sample(_gated(spark, sf_dir).where("gate = 'auto_accepted'"), "fact_id").select("fact_id")


@register("value_conflicts", f"""with {FACTS}, f as (select *, cast(date_trunc('month', effective) as date) as month from facts),
v as (select patient_id, brand, fact_type, month, round(value_num / 1e-6) as step, min(value_num) as value_num, min(fact_id) as keep_id, count(*) as n from f group by 1, 2, 3, 4, 5)
select patient_id, brand, fact_type, cast(month as varchar) as month, value_num, keep_id, n, case when count(*) over w > 1 then 'value_mismatch' else 'duplicate' end as kind from v
window w as (partition by patient_id, brand, fact_type, month) qualify sum(n) over w > 1""")
def value_conflicts(spark, sf_dir):
    """What is stated more than once of a patient, thing, type and month, by value, with its smallest fact."""
    f = facts(spark, sf_dir).withColumn("month", F.trunc("effective", "month"))
    found = R.value_conflicts(f, "fact_id", ["patient_id", "brand", "fact_type", "month"], "value_num")
    return found.withColumn("month", F.col("month").cast("string"))


@register("review_tasks", f"""with {_FINDINGS}, {_POLICY}
select l_orderkey, count(*) as n_held, min(fact_id) as first_fact, min(case when n_block > 0 then 'blocker' when partial then 'partial' else 'confidence' end) as kind from gated where gate = 'review' group by l_orderkey""")
def review_tasks(spark, sf_dir):
    """One task per document with held facts."""
    kind = F.when(F.col("n_block") > 0, "blocker").when(F.col("partial"), "partial").otherwise("confidence")
    return R.review_tasks(_gated(spark, sf_dir).withColumn("kind", kind), "l_orderkey", "fact_id", "gate", "kind")


#: Kinds of a task in order of precedence, with the codes that belong to them.
KINDS = {"handwriting": ["no-reading", "grounding-failed"], "dose_check": ["med-"], "low_confidence": ["value-", "date-"], "unmapped_terminology": ["unmapped-concept"]}


@register("dominant_kinds", """with f as (select l_orderkey, unnest([case when l_tax > 0.075 then 'grounding-failed' end, case when l_quantity > 45 then 'med-dose' end, case when l_extendedprice > 50000 then 'value-out-of-range' end,
  case when l_returnflag = 'A' then 'unmapped-concept' end, case when l_discount > 0.09 then 'weak-evidence' end]) as code from lineitem)
select l_orderkey, case min(case when code = 'grounding-failed' then 0 when code like 'med-%' then 1 when code like 'value-%' then 2 when code = 'unmapped-concept' then 3 else 4 end)
  when 0 then 'handwriting' when 1 then 'dose_check' when 3 then 'unmapped_terminology' else 'low_confidence' end as kind from f where code is not null group by 1""")
def dominant_kinds(spark, sf_dir):
    """The kind of a document's findings that comes first by precedence."""
    codes = [(F.col("l_tax") > 0.075, "warning", "grounding-failed"), (F.col("l_quantity") > 45, "blocker", "med-dose"), (F.col("l_extendedprice") > 50000, "warning", "value-out-of-range"),
             (F.col("l_returnflag") == "A", "warning", "unmapped-concept"), (F.col("l_discount") > 0.09, "info", "weak-evidence")]
    return R.dominant_kind(R.findings(table(spark, sf_dir, "lineitem"), "l_orderkey", codes), "l_orderkey", "code", KINDS)


@register("task_closure", "select l_orderkey, bool_and(l_linestatus <> 'O') as closed, count(*) filter (where l_linestatus = 'O') as n_pending from lineitem group by 1")
def task_closure(spark, sf_dir):
    """A task closes when none of its facts is pending."""
    return R.closed_tasks(table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_linestatus") == "O")


@register("worst_state", """select l_orderkey, case min(case l_returnflag when 'R' then 1 when 'A' then 2 else 3 end) when 1 then 'R' when 2 then 'A' else 'N' end as l_returnflag from lineitem group by 1""")
def worst_state(spark, sf_dir):
    """The worst evidence state of each document."""
    return R.worst_state(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", ["R", "A", "N"])


@register("capped_confidence", """select l_orderkey * 10 + l_linenumber as fact_id, least(coalesce(case when l_discount < 0.095 then round(1 - l_discount, 4) end, 0.0), case l_returnflag when 'N' then 1.0 when 'A' then 0.98 when 'R' then 0.6 else 0.0 end) as conf from lineitem""")
def capped_confidence(spark, sf_dir):
    """Confidence under the cap of its evidence state."""
    return _lines(spark, sf_dir).select("fact_id", R.capped_confidence(F.col("conf"), F.col("l_returnflag"), {"N": 1.0, "A": 0.98, "R": 0.6}).alias("conf"))


@register("date_band", """select l_orderkey * 10 + l_linenumber as fact_id, date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date)) as gap
from lineitem join orders on l_orderkey = o_orderkey where abs(date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date))) > 400""")
def date_band(spark, sf_dir):
    """Facts dated more than 400 days from their encounter."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    gap = F.datediff("l_shipdate", "o_orderdate").cast("long")
    return li.join(o, li.l_orderkey == o.o_orderkey).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact_id"), gap.alias("gap")).where(F.abs("gap") > 400)


@register("planned_work", """with t(target) as (values ('screen'), ('billing'), ('archive')),
done as (select sha256(cast(o_orderkey as varchar) || '|billing') as k from orders where o_orderkey % 5 = 0)
select o_orderkey, target, sha256(cast(o_orderkey as varchar) || '|' || target) as work_key from orders, t
where o_orderstatus = 'F' and sha256(cast(o_orderkey as varchar) || '|' || target) not in (select k from done)""")
def planned_work(spark, sf_dir):
    """Ready documents times their targets, less what was dispatched (an array of targets, not a join)."""
    o = table(spark, sf_dir, "orders")
    key = lambda t: F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), t), 256).alias("work_key")
    todo = o.where("o_orderstatus = 'F'").select("o_orderkey", F.explode(F.array(*map(F.lit, ("screen", "billing", "archive")))).alias("target"))
    done = o.where("o_orderkey % 5 = 0").select(key(F.lit("billing")))
    return todo.withColumn("work_key", F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "target"), 256)).join(done, "work_key", "left_anti").select("o_orderkey", "target", "work_key")


@register("promotion", """select l_orderkey * 10 + l_linenumber as fact_id, l_orderkey, case when l_returnflag = 'R' then 'medication' when l_returnflag = 'A' then 'observation' else 'order' end as target,
  coalesce(case when l_tax > 0.04 then l_extendedprice end, l_quantity) as final_value from lineitem where l_linestatus = 'F' and l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'O')""")
def promotion(spark, sf_dir):
    """Accepted elements to their target table, with the reviewer's value where there is one; promoted items are skipped."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    target = F.when(F.col("l_returnflag") == "R", "medication").when(F.col("l_returnflag") == "A", "observation").otherwise("order")
    final = F.coalesce(F.when(F.col("l_tax") > 0.04, F.col("l_extendedprice")), F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").join(done, "l_orderkey", "left_anti").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact_id"), "l_orderkey", target.alias("target"), final.alias("final_value")
    )
