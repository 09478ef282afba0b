"""Read models, searches, work lists, decisions and resources over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions.similarity import lev_ratio
from factloom.operators import lines as L
from factloom.operators import tables as T
from factloom.operators import views as V
from factloom.plans.registry import register
from factloom.plans.tables import FACTS, facts, table


@register("current_facts", f"""with {FACTS}, g as (select patient_id, code, list(distinct encounter_id) as ids, max(state) as state from facts group by 1, 2),
l as (select o_custkey as patient_id, max(o_orderkey) as last_id from orders group by 1)
select patient_id, code, len(ids) as n_sources from g join l using (patient_id) where state = 'O' and list_contains(ids, last_id)""")
def current_facts(spark, sf_dir):
    """Open facts that name a patient's latest document among their sources."""
    g = facts(spark, sf_dir).groupBy("patient_id", "code").agg(F.collect_set("encounter_id").alias("ids"), F.max("state").alias("state"))
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("patient_id")).agg(F.max("o_orderkey").alias("last_id"))
    return g.where("state = 'O'").join(last, "patient_id").where(F.array_contains("ids", F.col("last_id"))).select("patient_id", "code", F.size("ids").cast("long").alias("n_sources"))


@register("facts_of_documents", f"""with {FACTS}, g as (select patient_id, code, list(distinct encounter_id) as ids from facts group by 1, 2), e as (select distinct patient_id, code, unnest(ids) as o_orderkey from g)
select o_orderkey, count(*) as n_facts from e join orders using (o_orderkey) where o_orderstatus = 'F' group by 1""")
def facts_of_documents(spark, sf_dir):
    """Facts by the documents that their source array names."""
    g = facts(spark, sf_dir).groupBy("patient_id", "code").agg(F.collect_set("encounter_id").alias("ids")).withColumn("fact", F.struct("patient_id", "code"))
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return V.facts_of_documents(g, done, "fact", "ids", "o_orderkey").groupBy("o_orderkey").agg(F.count("*").alias("n_facts"))


@register("governed_lines", """select l_orderkey, l_linenumber, p_brand, o_orderpriority from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey where l_returnflag = 'R' and o_orderstatus = 'F' and p_size > 10""")
def governed_lines(spark, sf_dir):
    """D3: fact, detail and header of governed lines."""
    li, p, o = (table(spark, sf_dir, n) for n in ("lineitem", "part", "orders"))
    return li.where("l_returnflag = 'R'").join(p.where("p_size > 10"), F.col("l_partkey") == F.col("p_partkey")).join(o.where("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "p_brand", "o_orderpriority")


@register("lines_of_pages", """select l_orderkey, l_linenumber, l_partkey from lineitem where l_orderkey in (select o_orderkey from orders where o_orderpriority = '1-URGENT')""")
def lines_of_pages(spark, sf_dir):
    """Lines of the chosen pages, by semi join."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(urgent, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@register("flat_search", """with o as (select o_custkey, max(o_orderdate) as last_order from orders group by 1)
select c_custkey, right(regexp_replace(c_name, '[^0-9]', '', 'g'), 10) as phone, strftime(last_order, '%Y-%m-%d') as last_order from customer left join o on o_custkey = c_custkey
where contains(right(regexp_replace(c_name, '[^0-9]', '', 'g'), 10), '7') and contains(lower(c_mktsegment), 'mach') order by last_order desc nulls last, c_custkey limit 50""")
def flat_search(spark, sf_dir):
    """The newest fifty rows whose last ten digits and token contain what is searched for."""
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    phone = F.right(F.regexp_replace("c_name", "[^0-9]", ""), F.lit(10))
    found = table(spark, sf_dir, "customer").withColumn("phone", phone).where(F.contains("phone", F.lit("7")) & F.contains(F.lower("c_mktsegment"), F.lit("mach")))
    return found.join(last, "c_custkey", "left").orderBy(F.desc_nulls_last("last"), "c_custkey").limit(50).select("c_custkey", "phone", F.date_format("last", "yyyy-MM-dd").alias("last_order"))


@register("patient_search", """select c_nationkey as phone, coalesce(nullif(c_mktsegment, 'MACHINERY'), '') as name, count(*) as n, strftime(max(o_orderdate), '%Y-%m-%d') as last_seen
from customer join orders on o_custkey = c_custkey where starts_with(cast(c_nationkey as varchar), '1') or contains(lower(c_mktsegment), 'auto') group by 1, 2""")
def patient_search(spark, sf_dir):
    """People by the start of a number or a part of their name, grouped by number and name."""
    c = table(spark, sf_dir, "customer").where(F.col("c_nationkey").cast("string").startswith("1") | F.contains(F.lower("c_mktsegment"), F.lit("auto")))
    rows = c.join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    name = F.coalesce(F.nullif("c_mktsegment", F.lit("MACHINERY")), F.lit(""))
    return rows.groupBy(F.col("c_nationkey").alias("phone"), name.alias("name")).agg(F.count("*").alias("n"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_seen"))


@register("find_pages", """select p.page_id, l.quality from pages p left join labels l on l.doc_id = p.page_id where contains(lower(p.url), '/en/1') or contains(lower(p.html), '%en')""")
def find_pages(spark, sf_dir):
    """Pages by a literal part of one of two columns (no pattern, so nothing is escaped)."""
    p = table(spark, sf_dir, "pages")
    hit = p.where(F.contains(F.lower("url"), F.lit("/en/1")) | F.contains(F.lower("html"), F.lit("%en"))).select("page_id")
    return hit.join(table(spark, sf_dir, "labels"), F.col("doc_id") == F.col("page_id"), "left").select("page_id", "quality")


@register("work_items", """select l_orderkey, count(*) as n_elements, bool_or(1 - l_discount < 0.92) as urgent, min(coalesce(case when l_tax > 0.06 then l_extendedprice end, case when l_returnflag = 'R' then l_tax end, l_quantity)) as least_value from lineitem group by 1""")
def work_items(spark, sf_dir):
    """One item per document, urgent if one element is uncertain; a value is the first of three that is given."""
    value = F.coalesce(F.when(F.col("l_tax") > 0.06, F.col("l_extendedprice")), F.when(F.col("l_returnflag") == "R", F.col("l_tax")), F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_elements"), F.bool_or(1 - F.col("l_discount") < 0.92).alias("urgent"), F.min(value).alias("least_value"))


_ITEMS = "string_agg(cast(l_linenumber as varchar) || ':' || cast(l_partkey as varchar), ',' order by l_linenumber, l_partkey)"


@register("record_view", f"""select o_orderkey, c_name, {_ITEMS} as items from orders join customer on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey where l_linestatus = 'F' group by 1, 2""")
def record_view(spark, sf_dir):
    """Header with its governed children in order."""
    li = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("e"))
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    items = F.array_join(F.transform("e", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",")
    return o.join(li, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "c_name", items.alias("items"))


@register("mapped_projection", """select o_orderkey as id, o_orderpriority as priority, string_agg(cast(l_partkey as varchar), ',' order by l_linenumber, l_partkey) as codes from orders join lineitem on l_orderkey = o_orderkey group by 1, 2""")
def mapped_projection(spark, sf_dir):
    """C17: columns by configured paths into a nested record."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").alias("code")))).alias("items"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.struct(F.col("o_orderpriority").alias("priority")).alias("header"))
    nested = o.join(li, F.col("l_orderkey") == F.col("o_orderkey"))
    return V.apply_mapping(nested, {"id": "o_orderkey", "priority": "header.priority", "codes": "items[*].code|join:,"})


@register("listed_once", """select l_orderkey, l_linenumber, l_partkey, case when rn = 1 then 'listed' else 'rejected' end as status, case when rn > 1 then 'already listed in this document' end as reason from (
  select l_orderkey, l_linenumber, l_partkey, row_number() over (partition by l_orderkey, lower(p_brand) order by l_linenumber, l_partkey, l_suppkey) as rn from lineitem join part on p_partkey = l_partkey)""")
def listed_once(spark, sf_dir):
    """C20: one standard name once per document."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    found = V.listed_once(rows, "l_orderkey", F.col("p_brand"), [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")])
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "status", "reason")


@register("earlier_readings", """with r as (select user_id, event_type, event_id, ts, value, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn from events)
select a.user_id, a.event_type, a.event_id, (select string_agg(cast(b.event_id as varchar), ',' order by b.ts, b.event_id) from r b where b.user_id = a.user_id and b.event_type = a.event_type and b.rn > 1) as earlier from r a where a.rn = 1""")
def earlier_readings(spark, sf_dir):
    """The reading that stands, with those before it."""
    g = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("l"))
    before = F.transform(F.slice("l", F.lit(1), F.size("l") - 1), lambda x: x["event_id"].cast("string"))
    return g.select("user_id", "event_type", F.element_at("l", -1)["event_id"].alias("event_id"), F.nullif(F.array_join(before, ","), F.lit("")).alias("earlier"))


@register("page_notes", """with p as (select conv_id, turn, list_filter([case when length(text) < 60 then 'short' end, case when contains(text, '?') then 'question' end, case when role = 'system' then 'system' end], lambda x: x is not null) as r from conversations where text is not null),
f as (select conv_id, turn, unnest(r) as y, unnest(range(len(r))) as i from p), g as (select conv_id, string_agg(cast(turn as varchar) || ':' || y, ';' order by turn, i) as notes, count(*) as n from f group by 1)
select d.conv_id, coalesce(notes, '') as notes, coalesce(n, 0) as n_notes from (select distinct conv_id from p) d left join g using (conv_id)""")
def page_notes(spark, sf_dir):
    """Reasons behind their page numbers."""
    r = F.array_compact(F.array(F.when(F.length("text") < 60, "short"), F.when(F.contains("text", F.lit("?")), "question"), F.when(F.col("role") == "system", "system")))
    pages = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", r.alias("r"))
    return V.page_notes(pages, "conv_id", "turn", "r").select("conv_id", "notes", "n_notes")


@register("billing", f"""select o_orderkey, o_custkey, {_ITEMS} as items from orders join lineitem on l_orderkey = o_orderkey where l_returnflag <> 'R' group by 1, 2""")
def billing(spark, sf_dir):
    """Documents with their items that are not rejected; none, no row."""
    entries = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag")))
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(entries.alias("e")).withColumn("e", F.filter("e", lambda x: x["l_returnflag"] != "R")).where("size(e) > 0")
    items = F.array_join(F.transform("e", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",")
    return g.join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_custkey", items.alias("items"))


@register("status_mapping", """select o_orderkey, case o_orderstatus when 'F' then 'accepted' when 'P' then 'corrected' else 'needs_review' end as status from orders""")
def status_mapping(spark, sf_dir):
    """Review states to published ones."""
    known = F.create_map(F.lit("F"), F.lit("accepted"), F.lit("P"), F.lit("corrected"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(F.try_element_at(known, F.col("o_orderstatus")), F.lit("needs_review")).alias("status"))


@register("decisions_applied", """with d as (select user_id, event_type, value, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events)
select c_custkey, round(case when event_type = 'purchase' then coalesce(value, c_acctbal) else c_acctbal end, 2) as c_acctbal,
  case event_type when 'view' then 'accepted' when 'signup' then 'accepted' when 'purchase' then 'corrected' when 'error' then 'rejected' else 'pending' end as state, event_type is distinct from 'error' as is_current
from customer left join d on user_id = c_custkey and rn = 1""")
def decisions_applied(spark, sf_dir):
    """The latest decision per fact, applied as data."""
    kind = F.when(F.col("event_type").isin("view", "signup"), "accept").when(F.col("event_type") == "purchase", "correct").when(F.col("event_type") == "error", "reject").otherwise("defer")
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), kind.alias("decision"), F.col("value").alias("new_c_acctbal"), "ts", "event_id")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    out = V.decisions_applied(rows, log, "c_custkey", [F.desc("ts"), F.desc("event_id")], ["c_acctbal"])
    return out.select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"), "state", "is_current")


@register("documents_of_patient", """select o_custkey, o_orderkey, rn as rank, (select count(*) from orders b where b.o_custkey = a.o_custkey and b.o_orderstatus <> 'P') as n_good
from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) a where rn <= 5""")
def documents_of_patient(spark, sf_dir):
    """The newest five documents of each patient, and how many were read without failure."""
    o = table(spark, sf_dir, "orders")
    good = o.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") != "P").alias("n_good"))
    return T.top_k(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 5).join(good, "o_custkey").select("o_custkey", "o_orderkey", "rank", "n_good")


@register("context_links", """with t as (select conv_id, turn, [turn, turn + 1] as l from conversations where role = 'user'), r as (select conv_id, [turn] as l from conversations where role <> 'user' and contains(text, 'the'))
select t.conv_id, cast(t.turn as bigint) as turn, case when exists (select 1 from r where r.conv_id = t.conv_id and list_has_any(r.l, t.l)) then 'same_line' when exists (select 1 from r where r.conv_id = t.conv_id) then 'same_page' end as link from (select distinct * from t) t""")
def context_links(spark, sf_dir):
    """Orders and reasons that share an evidence line, else a page."""
    c = table(spark, sf_dir, "conversations").withColumn("turn", F.col("turn").cast("long"))
    tests = c.where("role = 'user'").select("conv_id", "turn", F.array("turn", F.col("turn") + 1).alias("l")).distinct()
    reasons = c.where("role != 'user' and contains(text, 'the')").select("conv_id", F.array("turn").alias("l"))
    return V.context_links(tests, reasons, "conv_id", "turn", "l")


@register("key_vs_results", """select coalesce(l.doc_id, d.doc_id) as doc_id, case when d.doc_id is null then 'result missing' when l.doc_id is null then 'no key' when quality = 1 and n_chars > 1000 then 'right' else 'other' end as outcome
from labels l full join (select doc_id, n_chars from documents where n_chars > 500) d on d.doc_id = l.doc_id""")
def key_vs_results(spark, sf_dir):
    """Answer key against results; what is missing on either side is listed."""
    d = table(spark, sf_dir, "documents").where("n_chars > 500").select("doc_id", "n_chars", F.lit(True).alias("r"))
    k = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("k"))
    outcome = F.when(F.col("r").isNull(), "result missing").when(F.col("k").isNull(), "no key").when((F.col("quality") == 1) & (F.col("n_chars") > 1000), "right").otherwise("other")
    return k.join(d, "doc_id", "full_outer").select("doc_id", outcome.alias("outcome"))


@register("confirmed_names", """with n as (select c_custkey, c_custkey // 10 as phone, c_name, c_mktsegment from customer),
p as (select a.c_custkey, b.c_name as offered, 1 - levenshtein(a.c_name, b.c_name) / greatest(length(a.c_name), length(b.c_name)) as s from n a join n b on a.phone = b.phone and a.c_custkey <> b.c_custkey and b.c_mktsegment = 'BUILDING')
select c_custkey, offered, rank from (select *, row_number() over (partition by c_custkey order by s desc, offered) as rank from p where s >= 0.75) where rank <= 3""")
def confirmed_names(spark, sf_dir):
    """Confirmed names of the same number that are alike, three at most; a number has few people."""
    n = table(spark, sf_dir, "customer").select("c_custkey", F.expr("c_custkey div 10").alias("phone"), "c_name", "c_mktsegment")
    b = n.where("c_mktsegment = 'BUILDING'").select("phone", F.col("c_custkey").alias("other"), F.col("c_name").alias("offered"))
    p = n.join(b, "phone").where("c_custkey != other").withColumn("s", lev_ratio(F.col("c_name"), F.col("offered"))).where("s >= 0.75")
    return T.top_k(p, ["c_custkey"], [F.desc("s"), F.col("offered")], 3).select("c_custkey", "offered", "rank")


_WORDS = "list_distinct(list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda x: x <> ''))"


@register("wrong_person", f"""with j as (select l_orderkey, l_linenumber, l_partkey, a.p_name as x, b.p_name as y, a.p_size as s, b.p_size as t from lineitem join part a on a.p_partkey = l_partkey join part b on b.p_partkey = l_suppkey),
w as (select *, {_WORDS.format('x')} as u, {_WORDS.format('y')} as v from j)
select l_orderkey, l_linenumber, l_partkey, (lower(x) = lower(y) or len(list_filter(u, lambda q: not list_contains(v, q))) = 0 or len(list_filter(v, lambda q: not list_contains(u, q))) = 0 or len(list_intersect(u, v)) >= 2
  or 1 - levenshtein(x, y) / greatest(length(x), length(y)) >= 0.72) and abs(s - t) <= 20 as fits from w""")
def wrong_person(spark, sf_dir):
    """The name and number on a document against those of the record that was chosen for it; what does not fit is withdrawn."""
    p = table(spark, sf_dir, "part")
    a = p.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("x"), F.col("p_size").alias("s"))
    b = p.select(F.col("p_partkey").alias("l_suppkey"), F.col("p_name").alias("y"), F.col("p_size").alias("t"))
    j = table(spark, sf_dir, "lineitem").join(a, "l_partkey").join(b, "l_suppkey")
    fits = V.name_fit(F.col("x"), F.col("y"), lev_ratio(F.col("x"), F.col("y"))) & (F.abs(F.col("s") - F.col("t")) <= 20)
    return j.select("l_orderkey", "l_linenumber", "l_partkey", fits.alias("fits"))


@register("evidence_blocks", """with f as (select conv_id, min(turn) as a, max(turn) as b from conversations group by 1), e as (select conv_id, unnest([a, b]) as turn from f)
select conv_id, cast(turn as bigint) as turn, role, row_number() over (partition by conv_id order by turn nulls last, role, length(text)) as place, length(text) as n_chars from (select distinct * from e) e join conversations using (conv_id, turn)""")
def evidence_blocks(spark, sf_dir):
    """A fact's evidence blocks in page and reading order."""
    c = table(spark, sf_dir, "conversations")
    e = c.groupBy("conv_id").agg(F.min("turn").alias("a"), F.max("turn").alias("b")).select("conv_id", F.explode(F.array_distinct(F.array("a", "b"))).alias("turn"))
    w = Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("turn"), "role", F.length("text"))
    return e.join(c, ["conv_id", "turn"]).select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.row_number().over(w).cast("long").alias("place"), F.length("text").cast("long").alias("n_chars"))


@register("allergy_list", f"""with {FACTS} select patient_id, code, min(local_text) as local_text, max(state) as status, cast(min(effective) as varchar) as onset, string_agg(distinct brand, ',' order by brand) as brands from facts where fact_type = 'A' group by 1, 2""")
def allergy_list(spark, sf_dir):
    """Facts of one type per patient and code."""
    f = facts(spark, sf_dir).where("fact_type = 'A'")
    return f.groupBy("patient_id", "code").agg(F.min("local_text").alias("local_text"), F.max("state").alias("status"), F.min("effective").cast("string").alias("onset"), F.array_join(F.array_sort(F.collect_set("brand")), ",").alias("brands"))


@register("document_blocks", """select conv_id, count(*) as n_blocks, count(distinct role) as n_roles, round(avg(length(text)), 3) as mean_chars from conversations group by 1""")
def document_blocks(spark, sf_dir):
    """Block counts and means per document."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_blocks"), F.countDistinct("role").alias("n_roles"), F.round(F.avg(F.length("text")), 3).alias("mean_chars"))


@register("workbasket", """select o_orderkey, o_orderpriority, o_orderstatus from orders order by (o_orderpriority = '1-URGENT') desc, (o_orderstatus = 'O') desc, o_orderdate, o_orderkey limit 100""")
def workbasket(spark, sf_dir):
    """The first hundred by boolean priorities."""
    o = table(spark, sf_dir, "orders")
    return o.orderBy((F.col("o_orderpriority") == "1-URGENT").desc(), (F.col("o_orderstatus") == "O").desc(), "o_orderdate", "o_orderkey").limit(100).select("o_orderkey", "o_orderpriority", "o_orderstatus")


@register("oldest_batch", """select event_id, user_id from events where event_type = 'error' order by ts, event_id limit 64""")
def oldest_batch(spark, sf_dir):
    """The oldest batch of what waits."""
    return table(spark, sf_dir, "events").where("event_type = 'error'").orderBy("ts", "event_id").limit(64).select("event_id", "user_id")


@register("resolved_concepts", """select p_brand as concept, p_name as written from part where p_size > 25 union select p_brand, lower(p_type) from part where p_size <= 25""")
def resolved_concepts(spark, sf_dir):
    """Two ways to a concept, united without repeats."""
    p = table(spark, sf_dir, "part")
    return p.where("p_size > 25").select(F.col("p_brand").alias("concept"), F.col("p_name").alias("written")).unionByName(p.where("p_size <= 25").select(F.col("p_brand").alias("concept"), F.lower("p_type").alias("written"))).distinct()


@register("fits_context", """with d as (select doc_id, list_distinct(string_split_regex(lower(text), '[^a-z]+')) as w from documents) select doc_id, list_has_any(w, ['license', 'apache', 'token', 'the']) as fits from d where w is not null""")
def fits_context(spark, sf_dir):
    """S3: documents whose words meet a list."""
    words = F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))
    wanted = F.array(*map(F.lit, ("license", "apache", "token", "the")))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.arrays_overlap(words, wanted).alias("fits"))


@register("manifest_check", """select doc_id, 'quality' as field, 'not allowed' as reason from labels where quality not in (1) union all select doc_id, 'document', 'missing' from labels l where not exists (select 1 from documents d where d.doc_id = l.doc_id and d.n_chars > 100)""")
def manifest_check(spark, sf_dir):
    """Labels of a manifest that are not allowed or have no document."""
    labels = table(spark, sf_dir, "labels")
    wrong = T.contract_violations(labels, "doc_id", (), {"quality": [1]})
    lost = labels.join(table(spark, sf_dir, "documents").where("n_chars > 100").select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit("document").alias("field"), F.lit("missing").alias("reason"))
    return wrong.unionByName(lost)


@register("table_preview", """select event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts from events order by events.ts desc, event_id limit 20""")
def table_preview(spark, sf_dir):
    """A bounded preview by the first time column, newest first."""
    e = table(spark, sf_dir, "events")
    by = next(c for c, t in e.dtypes if t.startswith("timestamp"))
    return e.orderBy(F.desc(by), "event_id").limit(20).select("event_id", "event_type", F.date_format(by, "yyyy-MM-dd HH:mm:ss").alias("ts"))


@register("immutability", """select event_id, event_type from events where event_type = 'error' and value > 150""")
def immutability(spark, sf_dir):
    """Rows of an append-only table that a later state no longer holds as they were."""
    before = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    after = before.where("not (event_type = 'error' and value > 150)").unionByName(before.where("event_type = 'error' and value > 150").withColumn("value", F.col("value") + 1))
    return V.immutable_violations(before, after).select("event_id", "event_type")


@register("json_documents", """select o_orderkey, '{"id":' || cast(o_orderkey as varchar) || ',"status":"' || o_orderstatus || '","items":' || cast(n as varchar) || '}' as body from orders join (select l_orderkey, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey
where o_orderstatus in ('F', 'O') and o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM')""")
def json_documents(spark, sf_dir):
    """One JSON of fixed order per document that keeps its contract; others are never written."""
    o = table(spark, sf_dir, "orders")
    bad = T.contract_violations(o, "o_orderkey", ["o_custkey"], {"o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM"], "o_orderstatus": ["F", "O"]}).select("o_orderkey").distinct()
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    body = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("n").alias("items")))
    return o.join(bad, "o_orderkey", "left_anti").join(n, "o_orderkey").select("o_orderkey", body.alias("body"))


@register("training_export", """select event_id, user_id, event_type from events where ts >= timestamp '2024-01-05' and event_type in ('purchase', 'error') order by ts, event_id limit 500""")
def training_export(spark, sf_dir):
    """Corrections since a time, oldest first, bounded."""
    e = table(spark, sf_dir, "events").where("ts >= timestamp_ntz '2024-01-05' and event_type in ('purchase', 'error')")
    return e.orderBy("ts", "event_id").limit(500).select("event_id", "user_id", "event_type")


@register("ledger_rows", f"""with {FACTS}, a as (select fact_id, unnest(['code', 'brand', 'value']) as name, unnest([code, nullif(brand, 'Brand#13'), case when value_num > 10 then cast(cast(value_num as bigint) as varchar) end]) as value from facts where state = 'F' and confidence >= 0.95)
select fact_id, name, value from a where value is not null""")
def ledger_rows(spark, sf_dir):
    """Governed values of accepted facts, without missing ones."""
    f = facts(spark, sf_dir).where("state = 'F' and confidence >= 0.95")
    values = F.create_map(F.lit("code"), F.col("code"), F.lit("brand"), F.nullif("brand", F.lit("Brand#13")), F.lit("value"), F.when(F.col("value_num") > 10, F.col("value_num").cast("long").cast("string")))
    return f.select("fact_id", F.explode(F.map_filter(values, lambda k, v: v.isNotNull())).alias("name", "value"))


@register("fallback_blockers", """select l_orderkey, l_linenumber, l_partkey, 'fallback-reading' as code from lineitem where l_orderkey in (select l_orderkey from lineitem join supplier on s_suppkey = l_suppkey where s_acctbal < 0)""")
def fallback_blockers(spark, sf_dir):
    """Everything of a document that the fallback read in part is held."""
    li = table(spark, sf_dir, "lineitem")
    fallback = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    held = li.join(fallback, "l_suppkey", "left_semi").select("l_orderkey").distinct()
    return li.join(held, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey", F.lit("fallback-reading").alias("code"))


@register("field_checks", """with c as (select c_custkey, right(regexp_replace(c_name, '[^0-9]', '', 'g'), 10) as phone, c_mktsegment, c_acctbal from customer)
select c_custkey, 'phone' as field, phone as value, case when length(phone) = 10 then 'checked' else 'needs_check' end as status, case when length(phone) <> 10 then 'digits' end as reason from c
union all select c_custkey, 'segment', c_mktsegment, case when c_mktsegment in ('BUILDING', 'AUTOMOBILE') then 'checked' else 'needs_check' end, case when c_mktsegment not in ('BUILDING', 'AUTOMOBILE') then 'unknown' end from c
union all select c_custkey, 'balance', null, case when c_acctbal >= 0 then 'checked' else 'rejected' end, case when c_acctbal < 0 then 'negative' end from c""")
def field_checks(spark, sf_dir):
    """One long table of checked fields with status and reason."""
    digits = F.right(F.regexp_replace("c_name", "[^0-9]", ""), F.lit(10))
    known = F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE")

    def row(field, value, bad, status, reason):
        return F.struct(F.lit(field).alias("field"), value.alias("value"), F.when(bad, status).otherwise("checked").alias("status"), F.when(bad, reason).alias("reason"))

    checks = F.array(row("phone", digits, F.length(digits) != 10, "needs_check", "digits"), row("segment", F.col("c_mktsegment"), ~known, "needs_check", "unknown"), row("balance", F.lit(None).cast("string"), F.col("c_acctbal") < 0, "rejected", "negative"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.inline(checks))


@register("field_status", """select c_custkey, 'balance:' || case when c_acctbal >= 0 then 'checked' else 'rejected' end || ',segment:' || case when c_mktsegment in ('BUILDING', 'AUTOMOBILE') then 'checked' else 'needs_check' end as field_status, case when c_mktsegment in ('BUILDING', 'AUTOMOBILE') then 0 else 1 end as n_check from customer""")
def field_status(spark, sf_dir):
    """Checked fields as a map and the number that still needs a check."""
    pairs = F.array(
        F.struct(F.lit("balance"), F.when(F.col("c_acctbal") >= 0, "checked").otherwise("rejected")), F.struct(F.lit("segment"), F.when(F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE"), "checked").otherwise("needs_check"))
    )
    m = table(spark, sf_dir, "customer").select("c_custkey", F.map_from_entries(pairs).alias("m"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",")
    return m.select("c_custkey", text.alias("field_status"), F.size(F.filter(F.map_values("m"), lambda v: v == "needs_check")).alias("n_check"))


@register("resource_bundles", """with r as (select l_orderkey, l_linenumber, l_partkey, case l_returnflag when 'R' then '{"resourceType":"R","line":' || l_linenumber || ',"medication":' || l_partkey || '}' when 'A' then '{"resourceType":"A","line":' || l_linenumber || ',"observation":' || l_partkey || ',"performer":' || l_suppkey || '}' else '{"resourceType":"N","line":' || l_linenumber || '}' end as j, l_returnflag as k from lineitem)
select l_orderkey, count(*) as n, string_agg(distinct k, ',' order by k) as kinds, sha256('[' || string_agg(j, ',' order by cast(l_linenumber as bigint) * 1000000000 + l_partkey, j) || ']') as digest,
  array_to_string(list_filter(['A', 'N', 'R'], lambda x: not list_contains(list(distinct k), x)), ',') as missing from r group by 1""")
def resource_bundles(spark, sf_dir):
    """Facts as JSON resources by type, one ordered bundle per document, and the types it lacks."""
    line = F.col("l_linenumber").alias("line")
    kinds = {"R": [line, F.col("l_partkey").alias("medication")], "A": [line, F.col("l_partkey").alias("observation"), F.col("l_suppkey").alias("performer")], "N": [line]}
    return V.resources(table(spark, sf_dir, "lineitem"), kinds, "l_returnflag", "l_orderkey", F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey"))


@register("reranked", """with c as (select user_id, event_type, max(value) as score, max(case when props like '%"k": 1%' then 0 when value > 100 then 1 else 2 end) as band from events group by 1, 2)
select user_id, event_type, band, row_number() over (partition by user_id order by band, score desc, event_type) as place from c""")
def reranked(spark, sf_dir):
    """Candidates by fit, then score."""
    band = F.when(F.contains("props", F.lit('"k": 1')), 0).when(F.col("value") > 100, 1).otherwise(2)
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("score"), F.max(band).alias("band"))
    return V.reranked(c, "user_id", F.col("band"), "score", "event_type").select("user_id", "event_type", "band", "place")


@register("yes_share", """with v as (select user_id, cast(ts as date) as view, sum(case when event_type in ('click', 'purchase') then exp(-value / 50) else 0 end) / sum(exp(-value / 50)) as p from events group by 1, 2) select user_id, round(max(p), 6) as best from v group by 1""")
def yes_share(spark, sf_dir):
    """The share of yes among two kinds of scores, the best over views."""
    e = F.exp(-F.col("value") / 50)
    v = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("view")).agg((F.sum(F.when(F.col("event_type").isin("click", "purchase"), e).otherwise(0.0)) / F.sum(e)).alias("p"))
    return v.groupBy("user_id").agg(F.round(F.max("p"), 6).alias("best"))


@register("misfiled", """with w as (select distinct l_suppkey, l_partkey from lineitem where l_returnflag = 'R'), g as (select distinct l_suppkey, l_partkey from lineitem where l_returnflag = 'A')
select l_suppkey, count(*) as n_got, count(w.l_partkey) as n_misfiled from g left join w using (l_suppkey, l_partkey) group by 1""")
def misfiled(spark, sf_dir):
    """Entries that stand in another category than the one they were expected in."""
    li = table(spark, sf_dir, "lineitem")
    w = li.where("l_returnflag = 'R'").select("l_suppkey", "l_partkey").distinct().withColumn("hit", F.lit(1))
    return li.where("l_returnflag = 'A'").select("l_suppkey", "l_partkey").distinct().join(w, ["l_suppkey", "l_partkey"], "left").groupBy("l_suppkey").agg(F.count("*").alias("n_got"), F.count("hit").alias("n_misfiled"))


@register("bad_line_shares", """with p as (select conv_id, role, avg(case when length(text) < 120 then 1.0 else 0.0 end) as share from conversations group by 1, 2) select coalesce(role, 'all') as role, count(*) as pages, round(avg(share), 6) as mean_share, round(median(share), 6) as median_share from p group by rollup (role)""")
def bad_line_shares(spark, sf_dir):
    """Shares of bad lines per page, by role and in all."""
    p = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.avg(F.when(F.length("text") < 120, 1.0).otherwise(0.0)).alias("share"))
    r = p.rollup("role").agg(F.count("*").alias("pages"), F.round(F.avg("share"), 6).alias("mean_share"), F.round(F.median("share"), 6).alias("median_share"))
    return r.withColumn("role", F.coalesce("role", F.lit("all")))


@register("load_summary", """select event_type, count(*) as n, round(count(*) / (date_diff('second', min(ts), max(ts)) / 3600.0), 4) as per_hour, round(quantile_cont(value, 0.5), 4) as p50, round(quantile_cont(value, 0.95), 4) as p95,
  round(count(*) / (date_diff('second', min(ts), max(ts)) / 3600.0) * avg(value) / 3600, 6) as in_flight from events group by 1""")
def load_summary(spark, sf_dir):
    """Rate, interpolated percentiles, and the load that rate and mean time imply."""
    hours = F.expr("timestampdiff(second, min(ts), max(ts))") / 3600.0
    p = lambda q: F.round(F.percentile("value", F.lit(q)), 4)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.count("*") / hours, 4).alias("per_hour"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.round(F.count("*") / hours * F.avg("value") / 3600, 6).alias("in_flight"))


@register("profiles", """with n as (select user_id, event_type, count(*) as n from events group by 1, 2) select user_id, string_agg(event_type || ':' || n, ',' order by n desc, event_type) as entries, count(*) filter (where n >= 3) as promoted from n group by 1""")
def profiles(spark, sf_dir):
    """A profile's entries by count, and how many are promoted."""
    n = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    g = n.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "event_type"))).alias("l"), F.count_if(F.col("n") >= 3).alias("promoted"))
    return g.select("user_id", F.array_join(F.transform("l", lambda x: F.concat(x["event_type"], F.lit(":"), (-x["m"]).cast("string"))), ",").alias("entries"), "promoted")


@register("page_support", """with t as (select distinct conv_id, array_to_string(string_split_regex(lower(text), '[^a-z]+')[1:3], ' ') as name from conversations where turn = 0), w as (select distinct conv_id, unnest(string_split_regex(lower(text), '[^a-z]+')) as v from conversations where turn > 0),
e as (select conv_id, name, unnest(string_split(name, ' ')) as q, unnest(range(len(string_split(name, ' ')))) as i from t where name <> ''), s as (select e.conv_id, name, i, coalesce(max(case when v = q then 1.0 when contains(v, q) then 0.9 else 1 - levenshtein(q, v) / greatest(length(q), length(v)) end), 0.0) as p
  from e left join (select * from w where v <> '') w using (conv_id) group by 1, 2, 3) select conv_id, name, round(avg(p), 4) as support from s group by 1, 2""")
def page_support(spark, sf_dir):
    """How well a page supports a name."""
    c = table(spark, sf_dir, "conversations")
    words = F.split(F.lower("text"), "[^a-z]+")
    names = c.where("turn = 0").select("conv_id", F.array_join(F.slice(words, 1, 3), " ").alias("name")).where("name != ''").distinct()
    page = c.where("turn > 0").select("conv_id", F.explode(words).alias("v")).where("v != ''")
    return V.page_support(names.withColumn("key", F.col("name")), page, "conv_id", "key", "name", "v").select("conv_id", F.col("key").alias("name"), "support")


@register("superseded", """with n as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as rn from events where event_type = 'purchase'), o as (select user_id, string_agg(cast(event_id as varchar), ',' order by event_id) as ids from events where event_type = 'view' group by 1)
select n.user_id, n.event_id, case when rn = 1 then coalesce(ids, '') else '' end as supersedes from n left join o using (user_id)""")
def superseded(spark, sf_dir):
    """The first new reading of a key names all that stood before."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    out = T.supersede(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), ["user_id"], "event_id", [F.col("ts"), F.col("event_id")])
    return out.select("user_id", "event_id", F.array_join(F.transform("supersedes", lambda x: x.cast("string")), ",").alias("supersedes"))


@register("variants", """with v as (select p_partkey % 3 as variant, p_name as truth, substr(p_name, 1, cast(p_partkey % length(p_name) as int)) || substr(p_name, cast(p_partkey % length(p_name) as int) + 2) as pred, p_size from part)
select cast(variant as bigint) as variant, count(*) as n, round(sum(levenshtein(truth, pred)) / sum(length(truth)), 6) as cer, count(*) filter (where p_size > 10) as accepted, count(*) filter (where p_size > 10 and truth <> pred) as silent,
  count(*) filter (where p_size > 10 and regexp_replace(truth, '[^a-z]', '', 'g') <> regexp_replace(pred, '[^a-z]', '', 'g')) as silent_letters from v group by 1""")
def variants(spark, sf_dir):
    """Error rates, accepted rows and silent errors (with and without punctuation) of reader variants."""
    pred = F.expr("substr(p_name, 1, cast(p_partkey % length(p_name) as int)) || substr(p_name, cast(p_partkey % length(p_name) as int) + 2)")
    v = table(spark, sf_dir, "part").select((F.col("p_partkey") % 3).cast("long").alias("variant"), F.col("p_name").alias("truth"), pred.alias("pred"), (F.col("p_size") > 10).alias("ok"))
    letters = lambda c: F.regexp_replace(c, "[^a-z]", "")
    return v.groupBy("variant").agg(
        F.count("*").alias("n"), F.round(F.sum(F.levenshtein("truth", "pred")) / F.sum(F.length("truth")), 6).alias("cer"), F.count_if("ok").alias("accepted"),
        F.count_if(F.col("ok") & (F.col("truth") != F.col("pred"))).alias("silent"), F.count_if(F.col("ok") & (letters("truth") != letters("pred"))).alias("silent_letters"),
    )


@register("field_records", """with v as (select conv_id, unnest([0, 1, 1]) as turn from (select distinct conv_id from conversations)), u as (select distinct conv_id, turn from v),
l as (select conv_id, turn, role || ' ' || length(text) as t from conversations)
select conv_id, 1 as field, string_agg(t, ' / ' order by turn, t) as reading, string_agg(distinct substr(sha256(t), 1, 8), ',' order by substr(sha256(t), 1, 8)) as crops, count(*) as n from u join l using (conv_id, turn) group by 1""")
def field_records(spark, sf_dir):
    """The lines behind a value, in order, with their digests."""
    c = table(spark, sf_dir, "conversations")
    lines = c.select("conv_id", F.col("turn").cast("long").alias("turn"), F.concat_ws(" ", "role", F.length("text").cast("string")).alias("t"))
    values = c.select("conv_id").distinct().select("conv_id", F.lit(1).alias("field"), F.array(*[F.lit(k).cast("long") for k in (0, 1, 1)]).alias("ids"))
    return V.field_records(values, lines, "conv_id", "field", "ids", "turn", "t")


@register("note_targets", """with n as (select distinct conv_id, turn, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') as w from conversations where turn > 0), t as (select distinct conv_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) as t from conversations where turn = 0),
m as (select n.conv_id, n.turn, case when list_contains(w, 'all') then 0 when len(w) > 0 and t is not null and 1 - levenshtein(w[1], t) / greatest(length(w[1]), length(t)) >= 0.8 then 1 when t is not null and list_contains(w, t) then 2 else 3 end as r from n left join (select * from t where t <> '') t on t.conv_id = n.conv_id)
select conv_id, cast(turn as bigint) as turn, case min(r) when 0 then 'all' when 1 then 'named' when 2 then 'mentioned' else 'unclear' end as applies from m group by 1, 2""")
def note_targets(spark, sf_dir):
    """What a note applies to."""
    c = table(spark, sf_dir, "conversations").withColumn("turn", F.col("turn").cast("long"))
    tests = c.where("turn = 0").select("conv_id", F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("t")).where("t != ''")
    return V.note_targets(c.where("turn > 0").select("conv_id", "turn", "text").distinct(), tests, "conv_id", "turn", "text", "t")


@register("line_labels", """with e as (select event_id, user_id, event_type, (event_id * 7) % 900 // 90 as band, event_id % 500 as x0, event_id % 500 + 100 + event_id % 37 as x1, 1 - value / 400 as conf from events),
o as (select * from e where event_type <> 'view'), a as (select * from e where event_type = 'view'),
p as (select *, max(x1) over (partition by user_id, band order by x0, x1 rows between unbounded preceding and 1 preceding) as reach from o),
i as (select *, sum(case when reach is null or x0 > reach then 1 else 0 end) over (partition by user_id, band order by x0, x1 rows unbounded preceding) as island from p),
u as (select user_id, band, island, min(x0) as u0, max(x1) as u1 from i group by 1, 2, 3),
c as (select a.event_id, coalesce(sum(case when u0 is not null then greatest(0, least(x1, u1) - greatest(x0, u0)) end), 0) as covered from a left join u on a.user_id = u.user_id and a.band = u.band group by 1),
m as (select a.event_id, avg(o.conf) as f from a join o on a.user_id = o.user_id and a.band = o.band and o.x0 < a.x1 and o.x1 > a.x0 group by 1),
g as (select a.user_id, a.event_id, least(1.0, covered / (x1 - x0)) as c, f from a join c using (event_id) left join m using (event_id))
select user_id, event_id, round(c, 4) as coverage, case when c >= 0.6 and f >= 0.85 then 'printed' when c < 0.3 then 'handwritten' when f >= 0.85 then 'mixed' else 'uncertain' end as label from g
union all select user_id, event_id, 1.0, 'printed' from o where not exists (select 1 from a where a.user_id = o.user_id and a.band = o.band and a.x0 < o.x1 and a.x1 > o.x0)""")
def line_labels(spark, sf_dir):
    """Lines by the share that was read on them (boxes together) and its confidence; boxes on no line are lines of their own."""
    x0 = F.col("event_id") % 500
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.expr("(event_id * 7) % 900 div 90").alias("band"), x0.alias("x0"), (x0 + 100 + F.col("event_id") % 37).alias("x1"), (1 - F.col("value") / 400).alias("conf"))
    return L.line_labels(e.where("event_type = 'view'"), e.where("event_type != 'view'"), "user_id", "event_id")
