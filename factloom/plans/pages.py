"""Readings that agree, vocabularies, islands of lines, coverage, policies, stores and resources over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import reading as R
from factloom.operators import consensus as K
from factloom.operators import lines as L
from factloom.operators import resources as S
from factloom.operators import rules
from factloom.plans.reading import _LINES, _lines
from factloom.plans.registry import register
from factloom.plans.tables import table
from factloom.streaming import jobs as J
from factloom.streaming.sinks import Store


@register("group_consensus")
def group_consensus(spark, sf_dir):
    """The reading that a brand's largest group of alike readings agrees on (held against a plain loop in a test)."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.expr("substr(p_name, 1, cast(p_partkey % length(p_name) as int)) || substr(p_name, cast(p_partkey % length(p_name) as int) + 2)").alias("reading"))
    return K.group_consensus(p, "p_brand", "reading", "p_partkey")


@register("left_out_words", """with w as (select distinct conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9]*')) as word from conversations), c as (select conv_id, word, count(distinct turn) as n, min(turn) as turn from w where length(word) >= 3 group by 1, 2),
p as (select a.conv_id, a.turn, a.word, b.word as known from c a join c b on a.conv_id = b.conv_id and a.word <> b.word and abs(length(a.word) - length(b.word)) <= 2 and (b.n > 1 or b.turn <> a.turn)
  where a.n = 1 and levenshtein(a.word, b.word) <= case when length(a.word) < 6 then 1 else 2 end)
select conv_id, turn, word, min(known) as snapped from p group by 1, 2, 3 having count(*) = 1""")
def left_out_words(spark, sf_dir):
    """Words of a turn that are near exactly one word of the conversation's other turns."""
    return K.left_out_words(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


_DICTIONARY = ["licensed under", "released under", "under the", "token", "the", "der", "les", "una"]


@register("supported_names", f"""with {_LINES}, d(name) as (values {", ".join(f"('{n}')" for n in _DICTIONARY)}),
w as (select doc_id, cast(pos as bigint) as pos, list_filter(string_split_regex(lower(line), '[^a-z0-9]+'), lambda x: x <> '') as w from l),
g as (select doc_id, pos, n as words, unnest(range(0, len(w) - n + 1)) as "at", unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) as name from (select *, unnest([1, 2, 3]) as n from w) where len(w) >= n),
f as (select g.* from g join d using (name)),
h as (select distinct doc_id, pos, name, words > 1 or name = 'token' as strong from f x where not exists (select 1 from f y where y.doc_id = x.doc_id and y.pos = x.pos and y."at" < x."at" + x.words and x."at" < y."at" + y.words and (y.words > x.words or (y.words = x.words and y."at" < x."at")))),
i as (select doc_id, pos, bool_or(strong) as s from h group by 1, 2), j as (select *, coalesce(cast(pos - lag(pos) over (partition by doc_id order by pos) > 2 as int), 1) as b from i),
k as (select *, sum(b) over (partition by doc_id order by pos) as island from j), m as (select *, bool_or(s) over (partition by doc_id, island) as t from k)
select h.doc_id, h.pos, h.name, cast(m.island as bigint) as island, strong or t as kept from h join m on h.doc_id = m.doc_id and h.pos = m.pos""")
def supported_names(spark, sf_dir):
    """Names of a dictionary in the lines; single common words stay only in an island of lines that holds a strong name."""
    names = spark.createDataFrame([(n,) for n in _DICTIONARY], "name string")
    hits = R.dictionary_scan(_lines(spark, sf_dir).withColumn("pos", F.col("pos").cast("long")), ["doc_id", "pos"], "line", names, "name")
    hits = hits.select("doc_id", "pos", "name", ((F.col("words") > 1) | (F.col("name") == "token")).alias("strong")).distinct()
    return L.supported_names(hits, "doc_id", "pos", "name", "strong")


_BASE = [(None, "F", "gate", 0.95), (None, "O", "gate", None), ("R", "F", "review", None), ("A", "O", "gate", 0.92)]
_OVERRIDE = [("R", "F", "auto", 0.5), ("A", "O", "auto", 0.9), ("N", "O", "auto", None), (None, "F", "auto", 0.8)]
_FLOORS = [("R", "F", "review", None), (None, "F", "gate", 0.9), ("A", None, "gate", 0.91)]
_sql = lambda rows: ", ".join("(" + ", ".join("null" if v is None else f"'{v}'" if isinstance(v, str) else f"cast({v} as double)" for v in r) + ")" for r in rows)


@register("policy_lattice", f"""with b(kind, state, action, m) as (values {_sql(_BASE)}), o(kind, state, action, m) as (values {_sql(_OVERRIDE)}), f(kind, state, action, m) as (values {_sql(_FLOORS)}), s(action, r) as (values ('auto', 1), ('gate', 2), ('review', 3), ('reject', 4)),
x as (select l_orderkey * 10 + l_linenumber as fact_id, l_returnflag as k, l_linestatus as t from lineitem),
c as (select x.*, coalesce(os.action, bs.action, og.action, bg.action, 'review') as a, case when os.action is not null then os.m when bs.action is not null then bs.m when og.action is not null then og.m else bg.m end as m,
  case when os.action is not null then 'override:' || k || ':' || t when bs.action is not null then 'base:' || k || ':' || t when og.action is not null then 'override:any:' || t when bg.action is not null then 'base:any:' || t else 'none' end as rule
  from x left join o os on os.kind = k and os.state = t left join b bs on bs.kind = k and bs.state = t left join o og on og.kind is null and og.state = t left join b bg on bg.kind is null and bg.state = t),
z as (select k, t, max(r) as r, max(m) as m from (select distinct k, t from x) y join f on (f.kind is null or f.kind = k) and (f.state is null or f.state = t) join s using (action) group by 1, 2)
select fact_id, e.action, case when z.m is null then c.m when c.m is null then z.m else greatest(c.m, z.m) end as min_conf, rule, (coalesce(z.r, 0) > s.r or coalesce(case when z.m is null then c.m when c.m is null then z.m else greatest(c.m, z.m) end, -1) > coalesce(c.m, -1)) as tightened
from c join s on s.action = a left join z on z.k = c.k and z.t = c.t join s e on e.r = greatest(s.r, coalesce(z.r, 0))""")
def policy_lattice(spark, sf_dir):
    """Base policy and override, above structural floors that no override can loosen."""
    rule_table = lambda rows: spark.createDataFrame(rows, "kind string, state string, action string, min_conf double")
    facts = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact_id"), "l_returnflag", "l_linestatus")
    out = rules.merged_policy(facts, "l_returnflag", "l_linestatus", [("base", rule_table(_BASE)), ("override", rule_table(_OVERRIDE))], rule_table(_FLOORS))
    return out.select("fact_id", "action", "min_conf", "rule", "tightened")


@register("ledger_appends", """select user_id, event_type, cast(ts as date) as day, round(min(value), 2) as value from events where value is not null group by 1, 2, 3 having count(distinct round(value, 2)) = 1""")
def ledger_appends(spark, sf_dir):
    """Governed values of a stream in an append-only store; repetitions are left out, changed values refused; the keys that were never contradicted."""
    base = J.shared_folder(spark)
    rows = J.event_stream(spark, sf_dir).where("value is not null").select("user_id", "event_type", F.to_date("ts").alias("day"), F.round("value", 2).alias("value"))
    store = Store(spark, f"{base}/store", "user_id long, event_type string, day date, value double", ["user_id", "event_type", "day"])
    store.write_stream(rows, f"{base}/state")
    return store.rows().join(store.refused().select(*store.key).distinct(), store.key, "left_anti")


@register("job_leases")
def job_leases(spark, sf_dir):
    """K3: claims, renewals and expiries of jobs (held against a plain loop in a test)."""
    e = J.event_stream(spark, sf_dir).where("ts is not null and user_id is not null")
    kind = F.when(F.col("event_type").isin("click", "view"), "claim").when(F.col("event_type") == "purchase", "done").otherwise("renew")
    rows = e.select(F.concat(F.lit("j"), F.col("user_id").cast("string")).alias("job"), F.col("event_id").alias("id"), "ts", F.concat(F.lit("w"), (F.col("event_id") % 2).cast("string")).alias("worker"), kind.alias("kind"))
    return J.run_available(J.leases(rows, 48 * 3600, 5))


_SHAPE_SQL = """with f as (select l_orderkey as doc, l_linenumber as line, l_partkey, l_suppkey, l_quantity, l_returnflag as k, l_quantity > 45 as held, s_acctbal >= 0 as known from lineitem left join supplier on s_suppkey = l_suppkey),
o as (select doc, k, line, l_partkey, bool_and(held) as held, min(l_suppkey) as sup from f group by 1, 2, 3, 4),
p as (select distinct doc, l_suppkey as sup from f where known),
b as (select doc, count(*) filter (where not held) as stated, count(*) filter (where held) as n_held from o group by 1)"""


def _bundles(spark, sf_dir):
    li, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") >= 0).alias("known"))
    # a line is a fact and, if its supplier is known, that person; dealt by document while rows are short
    rows = li.join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left").withColumn("doc", F.col("l_orderkey")).repartition("doc")
    rows = rows.withColumn("kind", F.explode(F.when(F.col("known"), F.array("l_returnflag", F.lit("P"))).otherwise(F.array("l_returnflag"))))
    person = F.col("kind") == "P"
    rows = rows.withColumns({"k1": F.when(person, F.col("l_suppkey")).otherwise(F.col("doc")), "k2": F.when(~person, F.col("l_linenumber")), "k3": F.when(~person, F.col("l_partkey"))})
    by = S.reference("Practitioner", F.col("l_suppkey"))
    coded = {"coding": [{"system": "parts", "code": F.col("l_partkey").cast("string")}]}
    shapes = {
        "R": ("MedicationStatement", "Medications", {"medication": coded, "asserter": by}),
        "A": ("Observation", "Results", {"code": coded, "performer": [by], "valueQuantity": F.when(F.col("l_discount") > 0, F.struct(F.col("l_quantity").cast("double").alias("value"), F.lit("1").alias("unit")))}),
        "N": ("Procedure", "Procedures", {"code": coded}),
        "P": ("Practitioner", None, {"identifier": [{"value": F.col("l_suppkey").cast("string")}]}),
    }
    return S.bundles(S.resources(rows, "doc", "kind", ["k1", "k2", "k3"], shapes, ~person & (F.col("l_quantity") > 45)), "doc", ["Medications", "Results", "Procedures"])


@register("document_bundles", f"""{_SHAPE_SQL}, q as (select doc, count(*) as n from p group by 1) select b.doc, case when n_held > 0 then 'draft' else 'ready' end as status, stated + coalesce(q.n, 0) + 1 as n_entries, n_held from b left join q on q.doc = b.doc""")
def document_bundles(spark, sf_dir):
    """The facts of a document as nested resources in one bundle with sections and references; held facts are listed."""
    return _bundles(spark, sf_dir).select("doc", "status", F.col("n_entries").cast("long").alias("n_entries"), F.col("n_held").cast("long").alias("n_held"))


@register("bundle_findings", f"""{_SHAPE_SQL}, v as (select l_orderkey as doc, l_returnflag as k, l_linenumber as line, l_partkey, min(l_discount) as lo, max(l_discount) as hi from lineitem group by 1, 2, 3, 4),
t(type, k) as (values ('MedicationStatement', 'R'), ('Observation', 'A'), ('Procedure', 'N')),
m as (select b.doc, t.type from b, t where not exists (select 1 from o where o.doc = b.doc and o.k = t.k and not o.held)),
x as (select doc from b where doc not in (select doc from p))
select doc, 'missing type' as problem, type as what, 1 as n from m union all select doc, 'missing type', 'Practitioner', 1 from x
union all select o.doc, 'dangling reference', 'Practitioner', count(*) from o left join p on p.doc = o.doc and p.sup = o.sup where not held and k in ('R', 'A') and p.sup is null group by 1
union all select o.doc, 'no value', 'Observation.valueQuantity.value', count(*) from o join v on v.doc = o.doc and v.k = o.k and v.line = o.line and v.l_partkey = o.l_partkey where not held and o.k = 'A' and v.hi <= 0 group by 1""")
def bundle_findings(spark, sf_dir):
    """What the bundles lack: types, referenced resources, values."""
    return S.conformance(_bundles(spark, sf_dir), "doc", ["MedicationStatement", "Observation", "Procedure", "Practitioner"], {"Observation": ["valueQuantity.value", "code.coding[0].code"], "Practitioner": ["identifier[0].value"]})
