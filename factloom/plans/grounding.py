"""What is written where: notes on their page, results beside names, people by parts of their names, spellings without a block."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import alignment as A
from factloom.functions import names as N
from factloom.functions.similarity import similarity_join
from factloom.operators import results as W
from factloom.plans.reading import _LINES, _lines
from factloom.plans.registry import register
from factloom.plans.tables import table

#: Kinds of a note by its words, in order.
_KINDS = [("secret", "token password key api"), ("licence", "licensed license mit apache"), ("count", "the of and a is", "in to for by"), ("text", "the of and la le der die el de")]
_FOLD = "trim(regexp_replace(lower({}), '[^a-z0-9.]+', ' ', 'g'))"
_HAS = "list_has_any(string_split(v, ' '), [{}])"
_KIND_SQL = "case " + " ".join("when " + " and ".join(_HAS.format(", ".join(f"'{w}'" for w in g.split())) for g in groups) + f" then '{kind}'" for kind, *groups in _KINDS) + " end"
_NOTE = "[^ ]+ [^ ]+ [^ ]*[0-9][^ ]* [^ ]+"


@register("grounded_notes", f"""with {_LINES}, p as (select doc_id, cast(pos as bigint) as pos, {_FOLD.format('line')} as t from l),
w as (select doc_id, pos, unnest(regexp_extract_all(t, '{_NOTE}')) as note, unnest(range(len(regexp_extract_all(t, '{_NOTE}')))) as i from p),
n as (select case when (doc_id + i) % 5 = 0 then doc_id + 1 else doc_id end as doc_id, doc_id || '-' || pos || '-' || i as note_id,
  case when i % 3 = 1 then regexp_replace(note, '[0-9]', cast((doc_id + pos) % 10 as varchar)) else substr(note, 1, cast(pos % length(note) as int)) || substr(note, cast(pos % length(note) as int) + 2) end as v0 from w),
v as (select doc_id, note_id, {_FOLD.format('v0')} as v from n where {_FOLD.format('v0')} <> ''),
k as (select *, cast(floor(0.2 * length(v) + 1e-9) as int) as k from v),
s as (select k.*, pos, t, unnest(range(1, length(t) + 1)) as b from k join p using (doc_id) where length(t) > 0),
x as (select *, unnest(range(greatest(1, length(v) - k), length(v) + k + 1)) as size from s),
e as (select doc_id, note_id, v, pos, t, b, size, levenshtein(v, substr(t, cast(b as int), cast(size as int))) as e from x where b + size - 1 <= length(t)),
h as (select *, row_number() over (partition by doc_id, note_id, pos order by e, b + size, size) as rn from e where e <= cast(floor(0.2 * length(v) + 1e-9) as int)),
f as (select *, regexp_extract(substr(t, 1, cast(b as int) - 1), '([^ ]*)$', 1) || substr(t, cast(b as int), cast(size as int)) || regexp_extract(substr(t, cast(b + size as int)), '^([^ ]*)', 1) as stretch from h where rn = 1),
g as (select *, regexp_extract_all(v, '[0-9]+(?:[.][0-9]+)?') as a, regexp_extract_all(stretch, '[0-9]+(?:[.][0-9]+)?') as c from f),
o as (select *, len(list_filter(list_distinct(a), lambda y: len(list_filter(a, lambda z: z = y)) > len(list_filter(c, lambda z: z = y)))) = 0 as ok from g),
r as (select *, row_number() over (partition by doc_id, note_id order by not ok, e, pos, stretch) as best from o)
select v.doc_id, v.note_id, case when r.e is null then 'retracted' when ok and kind is not null then 'checked' else 'needs check' end as status,
  case when r.e is null then 'not on the page' when kind is null and not ok then 'kind not recognised; number not on the page' when kind is null then 'kind not recognised' when not ok then 'number not on the page' end as reason,
  kind, pos, stretch, round(1 - r.e / length(v.v), 4) as similarity from (select *, {_KIND_SQL} as kind from v) v left join r on r.doc_id = v.doc_id and r.note_id = v.note_id and best = 1""")
def grounded_notes(spark, sf_dir):
    """Notes with a number, as a reader gave them (a letter lost, a number changed, some from another document), held against
    the whole page: place, likeness and literal numbers; made-up ones are retracted."""
    pages = _lines(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), "line")
    # a note has a number: no other line is folded
    written = pages.where(F.col("line").rlike("[0-9]")).select("doc_id", "pos", F.posexplode(F.regexp_extract_all(A.folded(F.col("line")), F.lit(f"({_NOTE})"), F.lit(1))).alias("i", "note"))
    at = (F.col("pos") % F.length("note")).cast("int")
    lost = F.concat(F.substring(F.col("note"), F.lit(1), at), F.substring(F.col("note"), at + 2, F.length("note")))
    changed = F.regexp_replace("note", F.lit("^([^0-9]*)[0-9]"), F.concat(F.lit("$1"), ((F.col("doc_id") + F.col("pos")) % 10).cast("string")))
    notes = written.select(
        F.when((F.col("doc_id") + F.col("i")) % 5 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id")).alias("doc_id"),
        F.concat_ws("-", "doc_id", "pos", "i").alias("note_id"), F.when(F.col("i") % 3 == 1, changed).otherwise(lost).alias("note"),
    )
    return A.grounded_notes(notes, pages, "doc_id", "note_id", "note", "pos", "line", A.kind_of(F.col("value"), _KINDS), 0.8)


_TOKENS = "list_filter(string_split_regex(regexp_replace(regexp_replace(lower({}), '([/,&+:=();|-])', ' \\1 ', 'g'), '[.]([^0-9]|$)', ' . \\1', 'g'), '[ \\t\\n\\r]+'), lambda w: w <> '')"
_NAMED = "[a-z]{2,}"


@register("results_on_page", f"""with {_LINES}, t as (select doc_id, pos, {_TOKENS.format('line')} as t from l), n as (select *, lead(t) over (partition by doc_id order by pos) as nxt from t),
p as (select doc_id, pos, t, nxt, unnest(range(1, len(t) + 1)) as i, unnest(t) as w from n),
d as (select distinct w as name from p where regexp_full_match(w, '{_NAMED}') and regexp_matches(coalesce(t[i + 1], ''), '^[<>]?[0-9]+([.][0-9]+)?%?$')),
o as (select doc_id, name, array_to_string(t[i + 1:i + {W.REACH}] || case when i + {W.REACH} > len(t) then coalesce(nxt[1:{W.REACH}], []) else [] end, ' ') as behind from p join d on w = name),
v as (select doc_id, name, regexp_matches(behind, '{W._VALUE}') and not regexp_matches(behind, '{W._OTHER}') as valued from o)
select doc_id, name, count(*) as seen, count(*) filter (where valued) as valued, bool_and(valued) as result from v group by 1, 2""")
def results_on_page(spark, sf_dir):
    """Words that stand before a number anywhere are names; a name is a result in its document if every place of it has a value."""
    pages = _lines(spark, sf_dir)
    # a line without a digit has no number
    tokens = pages.where(F.col("line").rlike("[0-9]")).select(W.tokens(F.col("line")).alias("t"))
    before = F.filter(F.transform("t", lambda w, i: F.when(F.coalesce(F.get("t", i + 1), F.lit("")).rlike("^[<>]?[0-9]+([.][0-9]+)?%?$") & w.rlike(f"^{_NAMED}$"), w)), lambda w: w.isNotNull())
    names = tokens.select(F.explode(before).alias("name")).distinct()
    return W.results_on_page(W.occurrences(pages, "doc_id", "pos", "line", names, "name", 1), "doc_id")


#: People named by the first two words of a document; below, as written: an initial, a letter lost, or only the surname.
def _people(spark, sf_dir):
    # the rest of a text is not cut into words
    name = F.trim(F.regexp_replace(F.lower(F.substring_index("text", " ", 2)), "[^a-z]+", " "))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("name")).where("length(name) > 3 and contains(name, ' ')")


@register("initial_names")
def initial_names(spark, sf_dir):
    """Written people against known ones by their parts; an initial, a lost letter or a missing given name (held against all pairs in
    a test: in SQL, an odd number of moved letters is rounded down)."""
    m = _people(spark, sf_dir)
    last, first = F.element_at(F.split("name", " "), -1), F.substring("name", 1, 1)
    form = F.when(F.col("doc_id") % 3 == 0, F.concat(first, F.lit(" "), last)).when(F.col("doc_id") % 3 == 1, F.expr("substr(name, 1, length(name) - 1)")).otherwise(last)
    return N.name_join(m.select(form.alias("written")), m, "written", "name", 0.9).select(F.col("a").alias("written"), F.col("b").alias("known"), F.round("score", 3).alias("score"))


@register("practitioner_initials")
def practitioner_initials(spark, sf_dir):
    """Written people linked to masters by number or parts of the name; near ties and initials of two masters are not linked
    (held against its rules in a test)."""
    m = _people(spark, sf_dir).withColumns({"reg_no": F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("R-"), "doc_id")), "field": F.col("doc_id") % 7})
    last, first = F.element_at(F.split("name", " "), -1), F.substring("name", 1, 1)
    form = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Dr. "), first, F.lit(". "), last)).otherwise(F.concat(F.initcap("name"), F.lit(", MD")))
    w = m.select(F.col("doc_id").alias("key"), form.alias("name"), F.when(F.col("doc_id") % 8 == 0, F.lower("reg_no")).alias("reg_no"), "field")
    return N.practitioner_matches(w, m.withColumnRenamed("doc_id", "master"))


@register("jaro_winkler_names")
def jaro_winkler_names(spark, sf_dir):
    """All readings and names at least 0.9 alike (held against all pairs in a test, for the same reason)."""
    p = table(spark, sf_dir, "part").select("p_name", F.expr("substr(p_name, 1, cast(p_partkey % length(p_name) as int)) || substr(p_name, cast(p_partkey % length(p_name) as int) + 2)").alias("reading"))
    return similarity_join(p, p, "reading", "p_name", 0.9, "jaro_winkler").select(F.col("a").alias("reading"), F.col("b").alias("name"), F.round("score", 4).alias("score"))
