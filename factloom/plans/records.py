"""Read models, sources and sinks over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators import tables as T
from factloom.plans.registry import register
from factloom.plans.tables import FACTS, facts, table


@register("problem_list", f"""with {FACTS}
select patient_id, code, min(local_text) as local_text, max(state) as status, cast(min(effective) as varchar) as onset,
       cast(max(effective) as varchar) as last_seen, count(distinct fact_id) as n_facts, max(confidence) as confidence
from facts where state = 'F' group by patient_id, code""")
def problem_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Governed facts per patient and code."""
    return facts(spark, sf_dir).where("state = 'F'").groupBy("patient_id", "code").agg(
        F.min("local_text").alias("local_text"), F.max("state").alias("status"), F.min("effective").cast("string").alias("onset"),
        F.max("effective").cast("string").alias("last_seen"), F.countDistinct("fact_id").alias("n_facts"), F.max("confidence").alias("confidence"),
    )


@register("medication_list", f"""with {FACTS}
select patient_id, code, brand, fact_type, count(*) as n, min(value_num) as low, max(value_num) as high,
       cast(max(effective) as varchar) as last_seen
from facts where fact_type = 'R' group by patient_id, code, brand, fact_type""")
def medication_list(spark, sf_dir):
    """Facts of one type with their detail columns."""
    return facts(spark, sf_dir).where("fact_type = 'R'").groupBy("patient_id", "code", "brand", "fact_type").agg(
        F.count("*").alias("n"), F.min("value_num").alias("low"), F.max("value_num").alias("high"), F.max("effective").cast("string").alias("last_seen")
    )


@register("encounter_timeline", """select o_orderkey as encounter_id, o_custkey as patient_id, cast(cast(o_orderdate as date) as varchar) as started,
  count(l_orderkey) filter (where l_returnflag = 'R') as n_r, count(l_orderkey) filter (where l_returnflag = 'A') as n_a,
  count(l_orderkey) filter (where l_returnflag = 'N') as n_n
from orders left join lineitem on l_orderkey = o_orderkey and l_quantity > 10 group by 1, 2, 3""")
def encounter_timeline(spark, sf_dir):
    """Encounters with counts of their facts by type; the fact filter stands before the outer join."""
    o = table(spark, sf_dir, "orders")
    n = table(spark, sf_dir, "lineitem").where("l_quantity > 10").groupBy("l_orderkey").agg(
        *[F.count_if(F.col("l_returnflag") == f).alias(f"n_{f.lower()}") for f in "RAN"]
    )
    return o.join(n, o.o_orderkey == n.l_orderkey, "left").select(
        F.col("o_orderkey").alias("encounter_id"), F.col("o_custkey").alias("patient_id"), F.to_date("o_orderdate").cast("string").alias("started"),
        *[F.coalesce(f"n_{f}", F.lit(0)).alias(f"n_{f}") for f in "ran"],
    )


@register("results_grid", """select user_id, cast(cast(ts as date) as varchar) as day, event_type, count(*) as n, round(min(value), 4) as low, round(max(value), 4) as high
from events where value is not null group by 1, 2, 3""")
def results_grid(spark, sf_dir):
    """Values by patient, day and kind."""
    e = table(spark, sf_dir, "events").where("value is not null")
    return e.groupBy("user_id", F.to_date("ts").cast("string").alias("day"), "event_type").agg(
        F.count("*").alias("n"), F.round(F.min("value"), 4).alias("low"), F.round(F.max("value"), 4).alias("high")
    )


@register("latest_per_key", """select o_custkey, o_orderkey, o_totalprice from (
  select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) where rn = 1""")
def latest_per_key(spark, sf_dir):
    """G1: last order of each customer."""
    return T.latest_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@register("top_orders", """select o_custkey, o_orderkey, rank from (
  select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders) where rank <= 3""")
def top_orders(spark, sf_dir):
    """Top three per key."""
    return T.top_k(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@register("current_observations", """with e as (
  select event_id, user_id, event_type, lag(event_id) over (partition by user_id, event_type order by ts, event_id) as prev from events)
select event_id, user_id, event_type from e where event_id not in (select prev from e where prev is not null)""")
def current_observations(spark, sf_dir):
    """Observations that no later reading supersedes."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("supersedes", F.array_compact(F.array(F.lag("event_id").over(w))))
    return T.current_rows(e, "event_id", "supersedes").select("event_id", "user_id", "event_type")


_CHANGES = """changes as (
  select c_custkey, c_name, case when c_custkey % 14 = 0 then null else c_acctbal + 1 end as c_acctbal, c_mktsegment from customer where c_custkey % 7 = 0
  union all select c_custkey + (select max(c_custkey) from customer), c_name, c_acctbal, c_mktsegment from customer where c_custkey % 11 = 0)"""


def _changes(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    top = c.agg(F.max("c_custkey").alias("top"))
    updated = c.where("c_custkey % 7 = 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 14 == 0, None).otherwise(F.col("c_acctbal") + 1))
    new = c.where("c_custkey % 11 = 0").join(F.broadcast(top)).withColumn("c_custkey", F.col("c_custkey") + F.col("top")).drop("top")
    return c, updated.unionByName(new)


@register("upsert_registry", f"""with {_CHANGES}
select coalesce(n.c_custkey, o.c_custkey) as c_custkey, coalesce(n.c_name, o.c_name) as c_name, round(coalesce(n.c_acctbal, o.c_acctbal), 2) as c_acctbal
from customer o full join changes n on o.c_custkey = n.c_custkey""")
def upsert_registry(spark, sf_dir):
    """Upsert that keeps the old value where the new one is null."""
    old, new = _changes(spark, sf_dir)
    return T.upsert_keep(old, new, {"k": F.col("c_custkey")}).select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal"))


@register("replace_rows", f"""with {_CHANGES}
select c_custkey, c_name, round(c_acctbal, 2) as c_acctbal from changes
union all select c_custkey, c_name, round(c_acctbal, 2) from customer where c_custkey not in (select c_custkey from changes)""")
def replace_rows(spark, sf_dir):
    """B1, B2: rows of changed keys are replaced."""
    old, new = _changes(spark, sf_dir)
    return T.replace_by_key(old, new, ["c_custkey"]).select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal"))


@register("insert_absent", f"""with {_CHANGES}
select c_custkey, c_mktsegment from customer union all select c_custkey, c_mktsegment from changes where c_custkey not in (select c_custkey from customer)""")
def insert_absent(spark, sf_dir):
    """Only new keys are inserted."""
    old, new = _changes(spark, sf_dir)
    return T.insert_absent(old, new, ["c_custkey"]).select("c_custkey", "c_mktsegment")


@register("table_diff", f"""with {_CHANGES}
select coalesce(n.c_custkey, o.c_custkey) as c_custkey,
  case when o.c_custkey is null then 'added' when n.c_custkey is null then 'removed' else 'changed' end as change
from customer o full join changes n on o.c_custkey = n.c_custkey
where o.c_custkey is null or n.c_custkey is null or o.c_name is distinct from n.c_name or o.c_acctbal is distinct from n.c_acctbal""")
def table_diff(spark, sf_dir):
    """What changed between two versions of a table."""
    old, new = _changes(spark, sf_dir)
    return T.table_diff(old, new, ["c_custkey"], ["c_name", "c_acctbal"])


@register("dedupe_content", """select content_hash, doc_id, source, copies from (
  select sha256(coalesce(length(text) || ':' || text, '-') || coalesce(length(source) || ':' || source, '-')) as content_hash, doc_id, source, count(*) over (partition by sha256(coalesce(length(text) || ':' || text, '-') || coalesce(length(source) || ':' || source, '-'))) as copies,
         row_number() over (partition by sha256(coalesce(length(text) || ':' || text, '-') || coalesce(length(source) || ':' || source, '-')) order by doc_id) as rn from documents) where rn = 1""")
def dedupe_content(spark, sf_dir):
    """A4: one document per content and scope."""
    return T.dedupe_documents(table(spark, sf_dir, "documents"), "text", ["source"], [F.col("doc_id")]).select("content_hash", "doc_id", "source", "copies")


@register("admit_documents", """with h as (select doc_id, sha256(text) as content_hash from documents),
known as (select content_hash, max(doc_id % 6 = 0) as held from h where doc_id % 3 = 0 group by content_hash)
select doc_id, case when held is null then 'new' when held then 'reprocess' else 'known' end as route from h left join known using (content_hash)""")
def admit_documents(spark, sf_dir):
    """A4: known content is not read again unless it is on hold."""
    h = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    known = h.where("doc_id % 3 = 0").select("content_hash", F.when(F.col("doc_id") % 6 == 0, "quality_hold").otherwise("done").alias("state"))
    return T.admit_documents(h, known).select("doc_id", "route")


@register("snapshot_versions", """with h as (
  select o_custkey, o_orderkey, o_orderdate, sha256(coalesce(length(o_orderstatus) || ':' || o_orderstatus, '-') || coalesce(length(o_orderpriority) || ':' || o_orderpriority, '-')) as payload_hash from orders),
c as (select *, lag(payload_hash) over (partition by o_custkey order by o_orderdate, o_orderkey) as p from h)
select o_custkey, o_orderkey, payload_hash, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as version
from c where p is null or p <> payload_hash""")
def snapshot_versions(spark, sf_dir):
    """A new version only for new content."""
    v = T.snapshot_versions(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], ["o_orderstatus", "o_orderpriority"])
    return v.select("o_custkey", "o_orderkey", "payload_hash", "version")


@register("flat_rows", """select c.conv_id, cast(turn as bigint) as turn, role, length(text) as n_chars, row_number() over (partition by conv_id order by turn, role, text) as seq,
  count(*) over (partition by conv_id) as n_turns from conversations c""")
def flat_rows(spark, sf_dir):
    """One row per document and item, numbered, with the document's count."""
    w = Window.partitionBy("conv_id")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "role", F.length("text").cast("long").alias("n_chars"),
        F.row_number().over(w.orderBy("turn", "role", "text")).cast("long").alias("seq"), F.count("*").over(w).alias("n_turns"),
    )


@register("fan_out_props", """select event_id, 'k' as name, cast(json_extract_string(props, '$.k') as bigint) as value from events where json_extract_string(props, '$.k') is not null""")
def fan_out_props(spark, sf_dir):
    """Nested answers to one row per name and value."""
    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,bigint>").alias("m"))
    return e.select("event_id", F.explode("m").alias("name", "value")).where("name = 'k' and value is not null")


@register("patient_counts", """select c_custkey, coalesce(n_orders, 0) as n_orders, coalesce(n_lines, 0) as n_lines, coalesce(n_late, 0) as n_late from customer
left join (select o_custkey, count(*) as n_orders, count(*) filter (where o_orderstatus = 'F') as n_late from orders group by 1) o on o.o_custkey = c_custkey
left join (select o_custkey, count(*) as n_lines from lineitem join orders on l_orderkey = o_orderkey group by 1) l on l.o_custkey = c_custkey""")
def patient_counts(spark, sf_dir):
    """Counts per entity, each child summed before it is joined."""
    c, o, li = (table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem"))
    per = li.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    n = o.join(per, o.o_orderkey == per.l_orderkey, "left").groupBy("o_custkey").agg(
        F.count("*").alias("n_orders"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_lines"), F.count_if(F.col("o_orderstatus") == "F").alias("n_late")
    )
    return c.join(n, c.c_custkey == n.o_custkey, "left").select("c_custkey", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("n_orders", "n_lines", "n_late")])


@register("patient_360", """select c_custkey, c_name, list_aggregate(list_sort(list(o_orderkey) filter (where o_orderkey is not null)), 'string_agg', ',') as orders,
  count(o_orderkey) as n_orders from customer left join orders on o_custkey = c_custkey group by c_custkey, c_name""")
def patient_360(spark, sf_dir):
    """A patient's children as ordered arrays (an array holds what belongs to one patient)."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    kids = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"))
    return c.join(kids, c.c_custkey == kids.o_custkey, "left").select("c_custkey", "c_name", F.array_join("ids", ",").alias("orders"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_orders"))


@register("confirmed_values", """with d as (select user_id, event_type, round(value, 4) as value, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events)
select user_id, event_type as decision, case when event_type = 'purchase' then value else null end as shown from d where rn = 1""")
def confirmed_values(spark, sf_dir):
    """The latest decision of each key decides what is shown."""
    e = T.latest_per_key(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return e.select("user_id", F.col("event_type").alias("decision"), F.when(F.col("event_type") == "purchase", F.round("value", 4)).alias("shown"))


@register("status_counts", """select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as n_f, count(*) filter (where o_orderstatus = 'O') as n_o,
  count(*) filter (where o_orderstatus = 'P') as n_p from orders group by 1""")
def status_counts(spark, sf_dir):
    """E5: counts per state as columns."""
    p = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return p.select("o_orderpriority", *[F.coalesce(s, F.lit(0)).alias(f"n_{s.lower()}") for s in "FOP"])


@register("stage_stats", """with a as (select max(ts) as as_of from events)
select event_type, count(*) as runs, round(avg(value), 4) as mean_value from events, a where ts > as_of - interval 5 day group by 1""")
def stage_stats(spark, sf_dir):
    """Runs and means of the last days before a reference time."""
    e = table(spark, sf_dir, "events")
    as_of = e.agg(F.max("ts").alias("as_of"))  # one row
    recent = e.join(F.broadcast(as_of)).where("ts > as_of - interval 5 days")
    return recent.groupBy("event_type").agg(F.count("*").alias("runs"), F.round(F.avg("value"), 4).alias("mean_value"))


@register("oldest_open", """with a as (select max(o_orderdate) as as_of from orders)
select o_orderpriority, coalesce(max(date_diff('day', cast(o_orderdate as date), cast(as_of as date))) filter (where o_orderstatus = 'O'), 0) as age_days from orders, a group by 1""")
def oldest_open(spark, sf_dir):
    """Age of the oldest unfinished item, 0 where all are finished."""
    o = table(spark, sf_dir, "orders")
    as_of = o.agg(F.max("o_orderdate").alias("as_of"))
    age = F.max(F.when(F.col("o_orderstatus") == "O", F.datediff("as_of", "o_orderdate")))
    return o.join(F.broadcast(as_of)).groupBy("o_orderpriority").agg(F.coalesce(age, F.lit(0)).cast("long").alias("age_days"))


@register("overview_rollup", """select r_name, n_name, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
group by rollup (r_name, n_name)""")
def overview_rollup(spark, sf_dir):
    """Counts with group and grand totals."""
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).rollup("r_name", "n_name").agg(F.count("*").alias("n"))


@register("mode_tiebreak", """with n as (select c_nationkey, c_mktsegment, count(*) as n from customer group by 1, 2),
r as (select *, row_number() over (partition by c_nationkey order by n desc, length(c_mktsegment) desc, c_mktsegment) as rn, sum(n) over (partition by c_nationkey) as total from n)
select c_nationkey, c_mktsegment, n as votes, cast(total as bigint) as total, round(least(0.99, 0.5 + 0.25 * (n / total)), 4) as agreement from r where rn = 1""")
def mode_tiebreak(spark, sf_dir):
    """Most frequent value with a tie rule and its agreement."""
    return T.mode_with_tie(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment")


@register("identity_cascade", """with q as (select c_custkey, case when c_custkey % 3 = 0 then c_custkey end as k1, case when c_custkey % 2 = 0 then c_name end as k2 from customer),
h as (select q.c_custkey, 0 as p, r.c_custkey as hit from q join customer r on q.k1 = r.c_custkey union all
      select q.c_custkey, 1, r.c_custkey from q join customer r on q.k2 = r.c_name)
select q.c_custkey, b.hit as resolved, cast(b.p as bigint) as matched_by from q left join (
  select c_custkey, p, hit from (select *, row_number() over (partition by c_custkey order by p, hit) as rn from h) where rn = 1) b on b.c_custkey = q.c_custkey""")
def identity_cascade(spark, sf_dir):
    """The first of several lookup keys that hits."""
    c = table(spark, sf_dir, "customer")
    q = c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).alias("k1"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("k2"))
    known = c.select(F.col("c_custkey").alias("r1"), F.col("c_name").alias("r2"), F.col("c_custkey").alias("resolved"))
    return T.lookup_cascade(q, known, [("k1", "r1"), ("k2", "r2")], "c_custkey", "resolved").select("c_custkey", "resolved", "matched_by")


@register("contract_violations", """select o_orderkey, 'o_orderpriority' as field, 'not allowed' as reason from orders where o_orderpriority not in ('1-URGENT', '2-HIGH', '3-MEDIUM')
union all select o_orderkey, 'o_orderstatus', 'not allowed' from orders where o_orderstatus not in ('F', 'O')""")
def contract_violations(spark, sf_dir):
    """Values outside a contract, with field and reason."""
    return T.contract_violations(table(spark, sf_dir, "orders"), "o_orderkey", ["o_custkey"], {"o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM"], "o_orderstatus": ["F", "O"]})


@register("token_conflicts", """with e as (select event_id, event_type, user_id, ts, floor(value * 100) as token, cast(ts as date) as day from events),
p as (select a.event_id, b.event_id as other_id, row_number() over (partition by a.event_id order by b.ts desc, b.event_id desc) as rn from e a join e b
  on a.event_type = b.event_type and a.token = b.token and a.day = b.day and a.user_id <> b.user_id)
select event_id, other_id from p where rn = 1""")
def token_conflicts(spark, sf_dir):
    """The newest event with the same token on the same day under another key; no pairs, two candidates a token and day."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "ts", F.floor(F.col("value") * 100).alias("token"), F.to_date("ts").alias("day"))
    return T.newest_of_another(e, ["event_type", "token", "day"], "user_id", [F.col("ts"), F.col("event_id")], "event_id", "other_id")


@register("latest_visit", """select o_custkey, o_orderkey, visit from (select o_custkey, o_orderkey,
  row_number() over (partition by o_custkey order by case when o_orderstatus = 'P' then null else o_orderdate end desc nulls last, o_orderkey) as visit from orders) where visit <= 2""")
def latest_visit(spark, sf_dir):
    """Newest dated entries first, undated last."""
    dated = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    return T.top_k(table(spark, sf_dir, "orders"), ["o_custkey"], [dated.desc_nulls_last(), F.col("o_orderkey")], 2, "visit").select("o_custkey", "o_orderkey", "visit")


@register("reading_order", """with l as (select conv_id, turn, role, text, cast(turn * 24 + length(text) % 13 as double) as yc, length(text) % 700 as x, 18 + length(text) % 9 as height from conversations),
b as (select *, floor(yc / (0.7 * median(height) over (partition by conv_id))) as band from l)
select conv_id, cast(turn as bigint) as turn, row_number() over (partition by conv_id order by band, x, turn, role, text) as place from b""")
def reading_order(spark, sf_dir):
    """Bands of 0.7 of the median line height, then the left edge; boxes of lines follow from turn and text length."""
    size = F.length("text")
    lines = table(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", (F.col("turn") * 24 + size % 13).cast("double").alias("yc"), (size % 700).alias("x"), (18 + size % 9).alias("height")
    )
    return T.reading_order(lines, "conv_id", "yc", "x", "height", [F.col("turn"), F.col("role"), F.col("text")]).select("conv_id", "turn", "place")


@register("json_bundle", """select o_orderkey, count(*) as n_entries, sha256(string_agg(cast(l_linenumber as varchar) || ':' || cast(l_partkey as varchar), ',' order by l_linenumber, l_partkey)) as digest
from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey""")
def json_bundle(spark, sf_dir):
    """One ordered bundle per document; its id is a digest of its content."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    entries = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    b = li.join(o, li.l_orderkey == o.o_orderkey, "left_semi").groupBy("l_orderkey").agg(entries.alias("e"))
    text = F.array_join(F.transform("e", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",")
    return b.select(F.col("l_orderkey").alias("o_orderkey"), F.size("e").cast("long").alias("n_entries"), F.sha2(text, 256).alias("digest"))


@register("dangling_refs", """select l_orderkey as bundle, 'part/' || cast(l_partkey + case when l_linenumber = 7 then 1000000000 else 0 end as varchar) as ref
from lineitem where l_linenumber = 7 or l_partkey not in (select p_partkey from part)""")
def dangling_refs(spark, sf_dir):
    """References of a bundle that resolve to nothing."""
    li = table(spark, sf_dir, "lineitem")
    ref = F.concat(F.lit("part/"), (F.col("l_partkey") + F.when(F.col("l_linenumber") == 7, 1000000000).otherwise(0)).cast("string"))
    known = table(spark, sf_dir, "part").select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("ref"))
    return li.select(F.col("l_orderkey").alias("bundle"), ref.alias("ref")).join(known, "ref", "left_anti").select("bundle", "ref")
