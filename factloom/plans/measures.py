"""Evaluation and monitoring over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions.similarity import wilson_lower, word_distance
from factloom.operators import evaluation as E
from factloom.operators import tables as T
from factloom.plans.registry import register
from factloom.plans.tables import table

_SCORED = """scored as (select d.doc_id, lang, source, quality as expected, case when doc_id % 13 = 0 then null when n_chars % 4 = 0 then 1 - quality else quality end as got
  from documents d join labels using (doc_id))"""
_METRICS = """count(expected) as expected, count(got) as accepted, count(*) filter (where expected = got) as right, count(*) filter (where expected <> got) as wrong,
  count(*) filter (where expected is not null and got is null) as missed, count(*) filter (where expected is null and got is not null) as spurious"""


def _low(right: str, n: str) -> str:
    p = f"(cast({right} as double) / {n})"
    return f"greatest(0.0, ({p} + 3.8416 / (2 * {n}) - 1.96 * sqrt(({p} * (1 - {p}) + 3.8416 / (4 * {n})) / {n})) / (1 + 3.8416 / {n}))"


def _scored(spark, sf_dir):
    d, q = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    got = F.when(F.col("doc_id") % 13 == 0, None).when(F.col("n_chars") % 4 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
    return d.join(q, "doc_id").select("doc_id", "lang", "source", F.col("quality").alias("expected"), got.alias("got"))


@register("tally", f"""with {_SCORED}, t as (select lang, {_METRICS} from scored group by lang)
select *, round(case when accepted > 0 then "right" / accepted end, 4) as precision, round(case when accepted > 0 then {_low('"right"', 'accepted')} end, 4) as precision_low,
  round(case when expected > 0 then "right" / expected end, 4) as recall from t""".replace("as right,", 'as "right",'))
def tally(spark, sf_dir):
    """Values right, wrong, missed and spurious, with bounds."""
    return E.tally(_scored(spark, sf_dir), ["lang"], "expected", "got")


_BOARD = f"""{_SCORED}, cells as (select 'all' as slice, 'all' as value, expected, got from scored union all select 'lang', lang, expected, got from scored union all select 'source', source, expected, got from scored),
t as (select slice, value, {_METRICS} from cells group by 1, 2), board as (select *, round(case when accepted > 0 then "right" / accepted end, 4) as precision,
  round(case when accepted > 0 then {_low('"right"', 'accepted')} end, 4) as precision_low, round(case when expected > 0 then "right" / expected end, 4) as recall from t)""".replace("as right,", 'as "right",')


@register("scoreboard", f"with {_BOARD} select * from board")
def scoreboard(spark, sf_dir):
    """The tally overall and per slice."""
    return E.scoreboard(_scored(spark, sf_dir), ["lang", "source"], "expected", "got")


@register("gate_release", f"""with {_BOARD}, r as (select slice, value, concat_ws('; ', case when precision_low is null or precision_low < 0.7 then 'precision_low < 0.7' end, case when recall is null or recall < 0.75 then 'recall < 0.75' end) as reasons from board)
select slice, value, reasons, reasons = '' as released from r""")
def gate_release(spark, sf_dir):
    """Thresholds with reasons."""
    return E.release_gate(E.scoreboard(_scored(spark, sf_dir), ["lang", "source"], "expected", "got"), [("precision_low", 0.7), ("recall", 0.75)]).select("slice", "value", "reasons", "released")


@register("compare_boards", f"""with {_SCORED}, a as (select source, avg(case when expected = got then 1.0 else 0.0 end) as s from scored where doc_id % 2 = 0 group by 1), b as (select source, avg(case when expected = got then 1.0 else 0.0 end) as s from scored where doc_id % 2 = 1 group by 1)
select source, case when coalesce(b.s, 0) - coalesce(a.s, 0) > 0.02 then 'win' when coalesce(b.s, 0) - coalesce(a.s, 0) < -0.02 then 'loss' else 'tie' end as verdict from a full join b using (source)""")
def compare_boards(spark, sf_dir):
    """Champion against candidate per slice."""
    s = _scored(spark, sf_dir)
    board = lambda df: df.groupBy("source").agg(F.avg(F.when(F.col("expected") == F.col("got"), 1.0).otherwise(0.0)).alias("s"))
    return E.compare_boards(board(s.where("doc_id % 2 = 0")), board(s.where("doc_id % 2 = 1")), ["source"], "s", 0.02).select("source", "verdict")


@register("wilson", f"with t as (select source, count(*) as n, sum(quality) as k from documents join labels using (doc_id) group by 1) select source, n, cast(k as bigint) as k, round({_low('k', 'n')}, 6) as low from t")
def wilson(spark, sf_dir):
    """Lower bound of a share."""
    t = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("k"))
    return t.withColumn("low", F.round(wilson_lower(F.col("k"), F.col("n")), 6))


@register("drift_alarm", """with d as (select event_type as slice, cast(cast(ts as date) as varchar) as day, avg(case when value > 50 then 1.0 else 0.0 end) as rate from events group by 1, 2),
s as (select *, count(*) over w as runs, avg(rate) over w as mean, stddev_pop(rate) over w as sd from d window w as (partition by slice order by day rows between 10 preceding and 1 preceding))
select slice, day, round(rate, 6) as rate, runs, runs >= 5 and abs(rate - mean) > greatest(2 * sd, 0.05) as alarm from s""")
def drift_alarm(spark, sf_dir):
    """A rate against its trailing mean."""
    d = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("slice"), F.to_date("ts").cast("string").alias("day")).agg(F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)).alias("rate"))
    a = E.drift_alarm(d, ["day"], "rate", 10, least=5, sigma=2.0, tolerance=0.05, by=["slice"])
    return a.select("slice", "day", F.round("rate", 6).alias("rate"), "runs", F.coalesce("alarm", F.lit(False)).alias("alarm"))


@register("percentiles", """select event_type, round(quantile_cont(value, 0.5), 4) as p50, round(quantile_cont(value, 0.9), 4) as p90, round(quantile_cont(value, 0.99), 4) as p99, count(*) as n from events group by 1""")
def percentiles(spark, sf_dir):
    """Interpolated percentiles."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(*[F.round(F.percentile("value", F.lit(p)), 4).alias(f"p{round(p * 100)}") for p in (0.5, 0.9, 0.99)], F.count("*").alias("n"))


@register("auc", """with n as (select lang, n_chars as s, count(*) as n, sum(quality) as p from documents join labels using (doc_id) group by 1, 2),
r as (select *, coalesce(sum(n) over (partition by lang order by s rows between unbounded preceding and 1 preceding), 0) as before from n),
t as (select lang, sum(p * (before + (n + 1) / 2)) as r, sum(p) as pos, sum(n - p) as neg from r group by 1)
select lang, cast(pos as bigint) as pos, cast(neg as bigint) as neg, round(case when pos > 0 and neg > 0 then (r - pos * (pos + 1) / 2) / (pos * neg) end, 6) as auc from t""")
def auc(spark, sf_dir):
    """Area under the curve, ties half."""
    df = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return E.auc(df, "n_chars", "quality", ["lang"]).select("lang", F.col("pos").cast("long").alias("pos"), F.col("neg").cast("long").alias("neg"), "auc")


@register("false_accepts", "select lang, count(*) as n, count(*) filter (where quality = 0 and n_chars > 800) as false_accept, count(*) filter (where quality = 1 and n_chars <= 800) as false_reject from documents join labels using (doc_id) group by lang")
def false_accepts(spark, sf_dir):
    """Wrong accepts and rejects of a length rule."""
    df = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("got", F.col("n_chars") > 800)
    return E.false_rates(df, "lang", "quality", "got")


_READ = "substr(p_name, 1, cast(p_partkey % length(p_name) as int)) || substr(p_name, cast(p_partkey % length(p_name) as int) + 2)"


@register("error_rates", f"""with r as (select p_brand, p_name as truth, case when p_partkey % 3 = 0 then p_name else {_READ} end as pred from part)
select p_brand, count(*) as lines, cast(sum(levenshtein(truth, pred)) as bigint) as edits, cast(sum(length(truth)) as bigint) as length, count(*) filter (where truth = pred) as exact,
  round(sum(levenshtein(truth, pred)) / sum(length(truth)), 6) as cer from r group by 1""")
def error_rates(spark, sf_dir):
    """Character error rate and exact matches."""
    r = table(spark, sf_dir, "part").select("p_brand", F.col("p_name").alias("truth"), F.expr(f"case when p_partkey % 3 = 0 then p_name else {_READ} end").alias("pred"))
    return E.error_rates(r, ["p_brand"], "truth", "pred")


@register("word_error_rates")
def word_error_rates(spark, sf_dir):
    """Word error rate (edits between word arrays)."""
    r = table(spark, sf_dir, "part").select("p_brand", F.split("p_name", " ").alias("truth"), F.split(F.expr(f"case when p_partkey % 3 = 0 then p_name else {_READ} end"), " ").alias("pred"))
    n = r.withColumn("d", word_distance("truth", "pred")).groupBy("p_brand").agg(F.sum("d").alias("edits"), F.sum(F.size("truth")).alias("length"))
    return n.withColumn("wer", F.round(F.col("edits") / F.col("length"), 6))


@register("set_scores", """with e as (select distinct o_custkey as g, l_partkey as i from orders join lineitem on l_orderkey = o_orderkey where l_quantity > 20),
r as (select distinct o_custkey as g, l_partkey as i from orders join lineitem on l_orderkey = o_orderkey where l_extendedprice > 20000),
n as (select coalesce(e.g, r.g) as g, count(e.i) as expected, count(r.i) as got, count(*) filter (where e.i is not null and r.i is not null) as hits from e full join r on e.g = r.g and e.i = r.i group by 1)
select g as o_custkey, expected, got, hits, round(case when got > 0 then hits / got end, 4) as precision, round(case when expected > 0 then hits / expected end, 4) as recall from n""")
def set_scores(spark, sf_dir):
    """Precision and recall of a list field."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return E.set_scores(j.where("l_quantity > 20"), j.where("l_extendedprice > 20000"), "o_custkey", "l_partkey")


@register("read_drift", """with r as (select user_id, cast(ts as date) as day, array_to_string(list_sort(list(distinct event_type)), ',') as found from events group by 1, 2) select user_id, count(distinct found) > 1 as drifted, count(*) as n_reads, count(distinct found) as n_results from r group by 1""")
def read_drift(spark, sf_dir):
    """Inputs whose repeated reads (one a day) gave different result sets."""
    reads = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("found"))
    return reads.groupBy("user_id").agg((F.countDistinct("found") > 1).alias("drifted"), F.count("*").alias("n_reads"), F.countDistinct("found").alias("n_results"))


@register("lexicon_counts", """select user_id, event_type, count(*) as uses, count(*) filter (where value > 50) as verified, cast(cast(min(ts) as date) as varchar) as first_seen, cast(cast(max(ts) as date) as varchar) as last_seen from events group by 1, 2""")
def lexicon_counts(spark, sf_dir):
    """Counts of a correction log instead of a mutable counter."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(
        F.count("*").alias("uses"), F.count_if(F.col("value") > 50).alias("verified"), F.to_date(F.min("ts")).cast("string").alias("first_seen"), F.to_date(F.max("ts")).cast("string").alias("last_seen")
    )


@register("alias_promotion", """with v as (select o_custkey, o_orderpriority as writing, o_orderstatus as concept, count(*) as n from orders where o_totalprice > 1000 group by 1, 2, 3 having count(*) >= 3)
select o_custkey, writing, min(concept) as concept, cast(max(n) as bigint) as verified from v group by 1, 2 having count(distinct concept) = 1""")
def alias_promotion(spark, sf_dir):
    """A writing is learned when three verified uses point to one concept."""
    o = table(spark, sf_dir, "orders").where("o_totalprice > 1000")
    v = o.groupBy("o_custkey", F.col("o_orderpriority").alias("writing"), F.col("o_orderstatus").alias("concept")).agg(F.count("*").alias("n")).where("n >= 3")
    return v.groupBy("o_custkey", "writing").agg(F.min("concept").alias("concept"), F.max("n").alias("verified"), F.countDistinct("concept").alias("k")).where("k = 1").drop("k")


@register("distinct_behind_grain", "select l_returnflag, count(*) as n_rows, count(distinct l_orderkey) as n_documents from lineitem group by 1")
def distinct_behind_grain(spark, sf_dir):
    """Documents behind a repeated grain."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n_rows"), F.countDistinct("l_orderkey").alias("n_documents"))


@register("metrics_long", """select 'orders' as metric, o_orderstatus as label, cast(count(*) as double) as value from orders group by 2
union all select 'events', event_type, cast(count(*) as double) from events group by 2 union all select 'mean_value', event_type, round(avg(value), 4) from events group by 2""")
def metrics_long(spark, sf_dir):
    """Metrics as (name, label, value) rows."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("label")).agg(F.count("*").cast("double").alias("value")).withColumn("metric", F.lit("orders"))
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("label")).agg(F.count("*").cast("double").alias("n"), F.round(F.avg("value"), 4).alias("m"))
    rows = F.inline(F.array(F.struct(F.lit("events").alias("metric"), F.col("n").alias("value")), F.struct(F.lit("mean_value").alias("metric"), F.col("m").alias("value"))))
    return o.select("metric", "label", "value").unionByName(e.select("label", rows).select("metric", "label", "value"))


@register("latest_label", "select doc_id, quality, toxic from (select *, row_number() over (partition by doc_id order by quality desc, toxic desc) as rn from labels) where rn = 1")
def latest_label(spark, sf_dir):
    """A5: one answer per document."""
    return T.latest_per_key(table(spark, sf_dir, "labels"), ["doc_id"], [F.desc("quality"), F.desc("toxic")]).select("doc_id", "quality", "toxic")


@register("disagreement_rates", """select strftime(ts, '%Y-%m-%d') as day, round(case when count(*) filter (where event_type in ('error', 'click')) > 0 then count(*) filter (where event_type = 'error') / count(*) filter (where event_type in ('error', 'click')) end, 6) as rate from events group by 1""")
def disagreement_rates(spark, sf_dir):
    """The share of one state among some, from a map of states per run."""
    n = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))
    runs = n.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("states"))
    return E.disagreement_rates(runs, "day", "states", "error", ["error", "click"])


@register("paired_lists")
def paired_lists(spark, sf_dir):
    """The names of a document against those read, paired greedily (held against examples in a test)."""
    written = F.expr("substr(p_name, 1, cast(p_partkey % length(p_name) as int)) || substr(p_name, cast(p_partkey % length(p_name) as int) + 2)")
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    item = lambda c: F.struct("l_linenumber", "l_partkey", c.alias("n"))
    lists = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item(F.col("p_name"))))["n"].alias("want"), F.array_sort(F.collect_list(F.when(F.col("l_discount") < 0.08, item(written))))["n"].alias("have"))
    return E.paired_edits(lists, "want", "have")
