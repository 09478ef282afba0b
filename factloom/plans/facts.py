"""Fan-out, routing, evidence and code sets over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import facts as X
from factloom.plans.registry import register
from factloom.plans.tables import table
from factloom.sources import files as S


@register("fan_out_lists", """select o_orderkey, 'part' as fact_type, row_number() over (partition by o_orderkey order by l_linenumber, l_partkey) as seq, l_partkey as value from orders join lineitem on l_orderkey = o_orderkey
union all select o_orderkey, 'supplier', row_number() over (partition by o_orderkey order by l_suppkey), l_suppkey from (select distinct o_orderkey, l_suppkey from orders join lineitem on l_orderkey = o_orderkey)""")
def fan_out_lists(spark, sf_dir):
    """Lists of an answer to numbered fact rows."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))["l_partkey"].alias("parts"), F.array_sort(F.collect_set("l_suppkey")).alias("suppliers")
    )
    answers = table(spark, sf_dir, "orders").select("o_orderkey").join(n, "o_orderkey")
    return X.fan_out(answers, "o_orderkey", {"part": "parts", "supplier": "suppliers"})


@register("pressure_pairs", """select event_id, 'systolic' as name, cast(100 + event_id % 60 as double) as value from events where event_id % 3 <> 0 union all select event_id, 'diastolic', cast(60 + event_id % 30 as double) from events where event_id % 3 <> 0""")
def pressure_pairs(spark, sf_dir):
    """One written pair to two values."""
    text = F.expr("case when event_id % 3 = 0 then 'n/a' else concat(cast(100 + event_id % 60 as string), '/', cast(60 + event_id % 30 as string)) end")
    return table(spark, sf_dir, "events").select("event_id", F.inline(X.pressure_pair(text))).where("value is not null")


@register("routed_lines", """with t as (select conv_id, turn, unnest(range(len(string_split(text, chr(10))))) as pos, lower(unnest(string_split(text, chr(10)))) as line, case role when 'user' then 'medication' when 'assistant' then 'test' else role end as listed from conversations)
select conv_id, cast(turn as bigint) as turn, cast(pos as bigint) as pos, case when listed = 'medication' and regexp_matches(line, '\\b(drink|avoid|rest|walk|diet)\\b') then 'advice' when listed = 'test' and regexp_matches(line, '\\b(tab|cap|syp|inj)\\b|[0-9] ?(mg|ml|mcg)\\b') then 'medication'
  when listed = 'medication' and len(string_split(line, ',')) >= 3 and not regexp_matches(line, '\\b(tab|cap|syp|inj)\\b|[0-9] ?(mg|ml|mcg)\\b') then 'test' else listed end as fact_type from t""")
def routed_lines(spark, sf_dir):
    """Lines of turns that are filed under the wrong type."""
    listed = F.when(F.col("role") == "user", "medication").when(F.col("role") == "assistant", "test").otherwise(F.col("role"))
    lines = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), listed.alias("listed"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), X.routed(F.col("line"), F.col("listed")).alias("fact_type"))


@register("evidence_rollup", """select o_orderkey, round(coalesce(avg(1 - l_discount), 0.5), 4) as conf, min(l_linenumber) as x0, min(l_partkey) as y0, max(l_linenumber) as x1, max(l_partkey) as y1
from orders left join lineitem on l_orderkey = o_orderkey and l_quantity > 40 group by o_orderkey""")
def evidence_rollup(spark, sf_dir):
    """Mean confidence and union box of a fact's evidence."""
    li = table(spark, sf_dir, "lineitem").where("l_quantity > 40").withColumn("block_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("string")))
    ids = li.groupBy("l_orderkey").agg(F.collect_list("block_id").alias("ids"))
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    f = o.join(ids, o.o_orderkey == ids.l_orderkey, "left")
    blocks = li.select("block_id", (1 - F.col("l_discount")).alias("conf"), F.col("l_linenumber").alias("x0"), F.col("l_partkey").alias("y0"), F.col("l_linenumber").alias("x1"), F.col("l_partkey").alias("y1")).dropDuplicates(["block_id"])
    return X.evidence_rollup(f, blocks, "o_orderkey", "ids")


@register("nearest_following", """with l as (select user_id, event_id, (event_id * 13) % 2000 as y, (event_id * 7) % 700 as x from events),
n as (select a.user_id, a.event_id as a, b.event_id as b, abs(b.y - a.y) * 10 + abs(b.x - a.x) as d from l a join l b on a.user_id = b.user_id and a.event_id <> b.event_id
  where (abs(b.y - a.y) * 2 <= 20 and b.x > a.x) or ((b.y - a.y) * 2 > 20 and b.y - a.y <= 40))
select user_id, a, b as following, d as distance from (select *, row_number() over (partition by user_id, a order by d, b) as rn from n) where rn = 1""")
def nearest_following(spark, sf_dir):
    """The nearest line to the right or just below."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", ((F.col("event_id") * 13) % 2000).alias("y"), ((F.col("event_id") * 7) % 700).alias("x"))
    return X.nearest_following(e, "user_id", "event_id", "y", "x", 20)


@register("keyword_groups", """with k(keyword, grp) as (values ('license', 'licence'), ('mit license', 'licence'), ('apache', 'licence'), ('token', 'secret'), ('the', 'english')),
w as (select doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') as w from documents),
g as (select doc_id, unnest(w) as keyword from w union select doc_id, w[i] || ' ' || w[i + 1] from (select doc_id, w, unnest(range(1, len(w))) as i from w))
select distinct doc_id, grp as "group" from g join k using (keyword)""")
def keyword_groups(spark, sf_dir):
    """Keywords as whole words, met as n-grams."""
    k = spark.createDataFrame([("license", "licence"), ("mit license", "licence"), ("apache", "licence"), ("token", "secret"), ("the", "english")], "keyword string, group string")
    return X.keyword_groups(table(spark, sf_dir, "documents"), "doc_id", "text", k)


@register("numbers_supported", """with n as (select event_id, regexp_extract_all(cast(user_id as varchar) || ' and ' || regexp_extract(props, '([0-9]+)', 1), '([0-9]+(?:[.][0-9]+)?)', 1) as v, regexp_extract_all(props || ' ' || (user_id % 7), '([0-9]+(?:[.][0-9]+)?)', 1) as r from events)
select event_id, len(list_filter(list_distinct(v), lambda x: len(list_filter(r, lambda y: y = x)) < len(list_filter(v, lambda y: y = x)))) = 0 as supported from n""")
def numbers_supported(spark, sf_dir):
    """Every number of a value stands in its reading at least as often."""
    value = F.concat(F.col("user_id").cast("string"), F.lit(" and "), F.regexp_extract("props", "([0-9]+)", 1))
    reading = F.concat("props", F.lit(" "), (F.col("user_id") % 7).cast("string"))
    return X.numbers_supported(table(spark, sf_dir, "events").select("event_id", value.alias("v"), reading.alias("r")), "event_id", "v", "r")


@register("alias_rows", """with p as (select distinct p_brand as n, p_type as a from part) select n as name, unnest([n, a, 'x ' || a]) as alias, 'Blood' as specimen from p""")
def alias_rows(spark, sf_dir):
    """Names with their aliases."""
    lines = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit(" ("), "p_type", F.lit("; x "), "p_type", F.lit("), Blood")).alias("line")).distinct()
    return S.alias_rows(lines, "line")


@register("overlay", """select p_partkey, case when p_partkey % 3 = 0 then upper(p_name) else p_name end as p_name from part where p_partkey % 5 <> 0""")
def overlay(spark, sf_dir):
    """User rows over seed rows; disabled ones remove the seed."""
    p = table(spark, sf_dir, "part")
    user = p.where("p_partkey % 3 = 0 or p_partkey % 5 = 0").select("p_partkey", F.upper("p_name").alias("p_name"), (F.col("p_partkey") % 5 != 0).alias("enabled"))
    return S.overlay(p.select("p_partkey", "p_name"), user, "p_partkey", "p_name")


@register("lexicon", """with w as (select unnest(regexp_extract_all(lower(p_name), '[a-z]{4,}')) as word from part union select unnest(regexp_extract_all(lower(p_type), '[a-z]{4,}')) from part)
select distinct word from w where word not in ('ring', 'steel')""")
def lexicon(spark, sf_dir):
    """Words of several columns without stop words."""
    stop = spark.createDataFrame([("ring",), ("steel",)], "word string")
    return S.lexicon(table(spark, sf_dir, "part"), ["p_name", "p_type"], stop)


@register("clusters_within_key")
def clusters_within_key(spark, sf_dir):
    """Greedy merge of alike names inside one key."""
    return X.clusters_within_key(table(spark, sf_dir, "part").select("p_brand", "p_name"), "p_brand", "p_name")


@register("scanned_files")
def scanned_files(spark, sf_dir):
    """A1: the files of a folder by name and size, those left out with a reason (their content is not read)."""
    return S.scan_files(spark, sf_dir, keep="[.]parquet$", ignore=(("^[._]", "hidden"), ("^lineitem", "not wanted"))).select("name", "length", "reason")


@register("sniffed_types", """select page_id, case when html like '<!%' or html like '<htm%' then 'text/html' when lower(url) like '%.pdf' then 'application/pdf' end as kind from pages""")
def sniffed_types(spark, sf_dir):
    """A3: types by first bytes, by name only where those say nothing."""
    return table(spark, sf_dir, "pages").select("page_id", S.sniffed_type(F.encode("html", "UTF-8"), F.lower("url")).alias("kind"))


@register("sidecars", """select page_id, 'q' || doc_id as legacy_ref, case when quality = 1 then '2024-01-0' || (doc_id % 9 + 1) end as captured from pages left join labels on doc_id = page_id""")
def sidecars(spark, sf_dir):
    """A2: metadata of ``x.pdf.json``, else ``x.json``; a bad date is none."""
    files = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".pdf")).alias("name"))
    k = F.col("doc_id").cast("string")
    stem = F.concat(F.lit("P"), k, F.when(F.col("doc_id") % 2 == 0, ".pdf.json").otherwise(".json"))
    day = F.when(F.col("quality") == 1, F.concat(F.lit("2024-01-0"), (F.col("doc_id") % 9 + 1).cast("string"))).otherwise("no date")
    side = table(spark, sf_dir, "labels").select(stem.alias("name"), F.concat(F.lit("q"), k).alias("legacy_ref"), day.alias("captured_at"))
    return S.with_sidecars(files, side).select("page_id", "legacy_ref", F.date_format("captured_at", "yyyy-MM-dd").alias("captured"))


@register("master_index", """select p_brand as brand, string_agg(distinct p_type, ',' order by p_type) as generics, count(distinct p_type) as n from part group by 1""")
def master_index(spark, sf_dir):
    """Brands to their generics from tab-separated lines."""
    return S.master_index(table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("\t "), "p_type").alias("line")), "line")


@register("alias_owners", """with a as (select p_name as alias, p_brand as name, case when p_size > 30 then 'test' when p_size > 15 then 'analyte' else 'catalogue' end as kind from part union all select p_type, p_brand, 'other' from part),
k as (select regexp_replace(lower(alias), '[^a-z0-9]+', '', 'g') as alias_key, case kind when 'test' then 1 when 'analyte' then 2 when 'catalogue' then 3 else 4 end as r, name, kind from a)
select alias_key, name, kind, n_claims from (select *, row_number() over (partition by alias_key order by r, name, kind) as rn from k) join (select alias_key, count(distinct (r, name, kind)) as n_claims from k group by 1) using (alias_key) where rn = 1""")
def alias_owners(spark, sf_dir):
    """Who owns an alias that several claim: tests before analytes before the catalogue."""
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") > 30, "test").when(F.col("p_size") > 15, "analyte").otherwise("catalogue")
    a = p.select(F.col("p_name").alias("alias"), F.col("p_brand").alias("name"), kind.alias("kind")).union(p.select("p_type", "p_brand", F.lit("other")))
    return S.alias_owners(a, ["test", "analyte", "catalogue"])
