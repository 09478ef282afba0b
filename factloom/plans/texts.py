"""Text, date and number normalisation and line rules over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import normalise as N
from factloom.plans.registry import register
from factloom.plans.tables import table

#: Weighted patterns per class, shared by query and SQL.
SIGNALS = {
    "licence": [("licensed under|released under", 6), ("apache|mit license", 3)],
    "secret": [("token = |password|api_key", 6), ("[0-9a-f]{32}", 4)],
    "table": [(" [|] ", 5), ("[|]\\n", 3)],
}


def _score(patterns) -> str:
    return " + ".join(f"(case when regexp_matches(lower(text), '{p}') then {w} else 0 end)" for p, w in patterns)


_SCORES = ", ".join(f"{_score(p)} as {c}" for c, p in SIGNALS.items())


@register("classify_documents", f"""with s as (select doc_id, {_SCORES} from documents),
l as (select doc_id, unnest(['licence', 'secret', 'table']) as class, unnest([licence, secret, "table"]) as score from s),
r as (select *, row_number() over (partition by doc_id order by score desc, class desc) as rn, lead(score) over (partition by doc_id order by score desc, class desc) as second from l)
select doc_id, case when score >= 5 and score - second >= 3 then class else 'unknown' end as class, cast(score as bigint) as score from r where rn = 1""".replace("as table,", 'as "table",').replace("as table from", 'as "table" from'))
def classify_documents(spark, sf_dir):
    """Weighted rules with a margin."""
    return N.classify_documents(table(spark, sf_dir, "documents"), "doc_id", "text", SIGNALS)


_FLAGS = [("injection", "ignore (all|previous)|disregard|system prompt"), ("phone", "[0-9]{3}[- ][0-9]{3}[- ][0-9]{4}"), ("email", "[a-z0-9._]+@[a-z0-9]+[.][a-z]+"), ("key", "[0-9a-f]{32}")]


@register("flag_lines", "with l as (select doc_id, unnest(range(len(string_split(text, chr(10))))) as pos, unnest(string_split(text, chr(10))) as line from documents)\n" + " union all ".join(
    f"select doc_id, cast(pos as bigint) as pos, '{n}' as flag from l where regexp_matches(lower(line), '{p}')" for n, p in _FLAGS))
def flag_lines(spark, sf_dir):
    """Lines with instructions, phones, e-mails or keys."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    low = F.lower("line")
    flags = F.explode(F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(n)) for n, p in _FLAGS]))).alias("flag")
    return lines.select("doc_id", F.col("pos").cast("long").alias("pos"), flags)


@register("normalise_names", """select c_custkey, case when k = '' then '' else upper(substr(k, 1, 1)) || substr(k, 2) end as normal from (
  select c_custkey, trim(regexp_replace(lower(c_name), '[^a-z]+', ' ', 'g')) as k from customer)""")
def normalise_names(spark, sf_dir):
    """One rule run per distinct spelling, joined back."""
    return N.normalise_column(table(spark, sf_dir, "customer"), "c_name", N.person_name).select("c_custkey", "normal")


_DOSE = "p_name || ' ' || cast(p_size as varchar) || case p_partkey % 4 when 0 then ' mg' when 1 then ' g' when 2 then 'mcg' else ' drops' end"


@register("parse_units", f"""with t as (select p_partkey, lower({_DOSE}) as s from part),
m as (select p_partkey, try_cast(regexp_extract(s, '([0-9]+(?:[.][0-9]+)?) ?(mg|mcg|g|ml|iu)', 1) as double) as n, regexp_extract(s, '([0-9]+(?:[.][0-9]+)?) ?(mg|mcg|g|ml|iu)', 2) as u from t)
select p_partkey, case when u = 'g' then n * 1000 when u = 'mcg' then n / 1000 else n end as strength, case when u in ('g', 'mcg') then 'mg' when u <> '' then u end as unit from m""")
def parse_units(spark, sf_dir):
    """Strength and unit of a text."""
    tail = F.expr("case p_partkey % 4 when 0 then ' mg' when 1 then ' g' when 2 then 'mcg' else ' drops' end")
    strength, unit = N.dose(F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), tail))
    return table(spark, sf_dir, "part").select("p_partkey", strength.alias("strength"), unit.alias("unit"))


@register("parse_intervals", """select o_orderkey, cast((o_orderkey % 12 + 1) * case o_orderkey % 4 when 0 then 1 when 1 then 7 when 2 then 30 end as bigint) as days,
  case o_orderkey % 4 when 0 then cast(o_orderkey % 3 as double) + 1 when 1 then 24.0 / 8 when 2 then 2.0 end as per_day from orders""")
def parse_intervals(spark, sf_dir):
    """Durations and daily frequencies written in words."""
    span = F.expr("concat(cast(o_orderkey % 12 + 1 as string), case o_orderkey % 4 when 0 then ' days' when 1 then ' weeks' when 2 then ' month' else ' cycles' end)")
    often = F.expr("case o_orderkey % 4 when 0 then concat('1-0-', cast(o_orderkey % 3 as string)) when 1 then 'q8h' when 2 then 'BD' else 'as told' end")
    return table(spark, sf_dir, "orders").select("o_orderkey", N.duration_days(span).alias("days"), N.per_day(often).alias("per_day"))


@register("written_dates", """select o_orderkey, cast(case o_orderkey % 3 when 0 then cast(o_orderdate as date) when 1 then cast(date_trunc('month', o_orderdate) as date) else cast(date_trunc('year', o_orderdate) as date) end as varchar) as day,
  case o_orderkey % 3 when 0 then 'day' when 1 then 'month' else 'year' end as precision from orders""")
def written_dates(spark, sf_dir):
    """I8: written dates with their precision."""
    text = F.expr("case o_orderkey % 3 when 0 then date_format(o_orderdate, 'dd/MM/yyyy') when 1 then date_format(o_orderdate, 'MM/yyyy') else date_format(o_orderdate, 'yyyy') end")
    day, precision = N.written_date(F.col("w"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("w")).select("o_orderkey", day.cast("string").alias("day"), precision.alias("precision"))


@register("temperatures", "select event_id, round(case when value > 45 then (value - 32) * 5 / 9 else value end, 2) as celsius from events")
def temperatures(spark, sf_dir):
    """I4: one scale for a value."""
    return table(spark, sf_dir, "events").select("event_id", N.celsius(F.col("value")).alias("celsius"))


@register("near_duplicates", """with l as (select doc_id, unnest(range(len(string_split(text, chr(10))))) as pos, unnest(string_split(text, chr(10))) as entry from documents),
r as (select *, row_number() over (partition by doc_id, lower(trim(entry)) order by pos) as rn, count(*) over (partition by doc_id, lower(trim(entry))) as copies from l where trim(entry) <> '')
select doc_id, entry, copies from r where rn = 1 and copies > 1""")
def near_duplicates(spark, sf_dir):
    """Repeated entries of a list, the first kept."""
    return N.repeated_entries(table(spark, sf_dir, "documents").withColumn("lines", F.split("text", "\n")), "doc_id", "lines")


@register("first_match", """with l as (select doc_id, unnest(range(len(string_split(text, chr(10))))) as pos, unnest(string_split(text, chr(10))) as line from documents),
h as (select doc_id, pos, 0 as rank, regexp_extract(line, '(?:Licensed|Released) under (?:the )?([A-Za-z]+)', 1) as value from l union all select doc_id, pos, 1, regexp_extract(line, '^([A-Z][a-z]+)[.]$', 1) from l)
select doc_id, value, cast(rank as bigint) as rank from (select *, row_number() over (partition by doc_id order by rank, pos) as rn from h where value <> '') where rn = 1""")
def first_match(spark, sf_dir):
    """Ordered patterns over ordered lines."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return N.first_match(lines, "doc_id", "pos", "line", ["(?:Licensed|Released) under (?:the )?([A-Za-z]+)", "^([A-Z][a-z]+)[.]$"])


@register("vocab_snap")
def vocab_snap(spark, sf_dir):
    """A rare word of any length that is one or two edits from exactly one of its group's common words."""
    return N.snap_words(table(spark, sf_dir, "documents"), "source", "doc_id", "text")
