"""Whose document it is: ages and birth dates that agree, the guard against a wrong person, and what promotion writes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.similarity import lev_ratio

# fixed values: the oldest age, days that a birth date may differ, likeness of two names of one person
OLDEST, BIRTH_DAYS, SAME_PERSON = 120, 366, 0.72


def dated(c: Column, as_of: Column) -> Column:
    """Day of a written date: year first, day first with ``/``, ``-`` or ``.``, or a two-digit year (the century that does not lie ahead of
    ``as_of``). Null for what is no such date."""
    text = F.regexp_replace(F.trim(c), "[./-]", "/")
    iso = F.regexp_extract(text, "^([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})$", 0)
    part = lambda pattern, i: F.regexp_extract(text, pattern, i).try_cast("int")
    own = "^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}|[0-9]{2})$"
    year = part(own, 3)
    century = F.when(year < 100, year + F.when(2000 + year > F.year(as_of), 1900).otherwise(2000)).otherwise(year)
    made = lambda y, m, d: F.try_to_timestamp(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
    first = "^([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})$"
    return F.when(iso != "", made(part(first, 1), part(first, 2), part(first, 3))).when(year.isNotNull(), made(century, part(own, 2), part(own, 1)))


def age_of(c: Column, as_of: Column) -> tuple[Column, Column]:
    """(years, about when born) of an age text: years (``45 Y``, ``73/F``, a bare number), or months, weeks and days, which are no year yet."""
    low = F.lower(F.trim(c))
    n, unit = F.regexp_extract(low, "^([0-9]{1,3}) ?([a-z]*)", 1).try_cast("int"), F.regexp_extract(low, "^([0-9]{1,3}) ?([a-z]*)", 2)
    whole = unit.isin("", "y", "yr", "yrs", "year", "years")
    years = F.when(whole, n).when(unit.isin("m", "mo", "month", "months"), F.floor(n / 12).cast("int")).when(unit.isin("w", "wk", "week", "weeks", "d", "day", "days"), 0)
    years = F.when(years <= OLDEST, years)
    return years, F.make_date(F.year(as_of) - years, F.lit(1), F.lit(1))


def checked_age(df: DataFrame, key: str, age: str, born: str, as_of: Column) -> DataFrame:
    """(key, years, birth_date, age_status, born_status, reason) of a written age and a written date of birth: each is plausible by itself, and
    together they are at most a year apart, else both need a check. Without a written date the age gives about when."""
    now = F.col("_now")
    years, about = age_of(F.col("_a"), now)
    rows = df.select(key, F.col(age).alias("_a"), F.col(born).alias("_b"), as_of.alias("_now")).withColumns({"years": years, "about": about, "date": dated(F.col("_b"), now)})
    given = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    derived = F.floor(F.months_between("_now", "date") / 12)
    ahead = (F.col("date") > F.col("_now")) | (F.year("_now") - F.year("date") > OLDEST)
    apart = F.col("years").isNotNull() & F.col("date").isNotNull() & ~ahead & (F.abs(derived - F.col("years")) > 1)
    reason = F.when(given("_b") & F.col("date").isNull(), "not a readable date").when(ahead, "date of birth not plausible").when(given("_a") & F.col("years").isNull(), "age not plausible").when(apart, "age and date of birth do not agree")
    state = lambda has, bad: F.when(~has, "absent").when(F.coalesce(bad, F.lit(False)), "needs check").otherwise("checked")
    return rows.select(
        key, "years", F.when(F.col("date").isNotNull() & ~F.coalesce(ahead, F.lit(False)), F.col("date")).otherwise(F.col("about")).alias("birth_date"),
        state(given("_a"), F.col("years").isNull() | apart).alias("age_status"), state(given("_b"), F.col("date").isNull() | ahead | apart).alias("born_status"), reason.alias("reason"),
    )


def same_name(a: Column, b: Column, likeness: Column | None = None) -> Column:
    """Whether two written names may be one person's: nothing to compare, equal, one holds the other's words, two words in common, or alike."""
    fold = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z]+", " "))
    x, y = fold(a), fold(b)
    u, v = F.array_distinct(F.split(x, " ")), F.array_distinct(F.split(y, " "))
    inside = (F.size(F.array_except(u, v)) == 0) | (F.size(F.array_except(v, u)) == 0)
    alike = lev_ratio(x, y) if likeness is None else likeness
    return (x == "") | (y == "") | inside | (F.size(F.array_intersect(u, v)) >= 2) | (alike >= SAME_PERSON)


def guarded(documents: DataFrame, records: DataFrame, facts: DataFrame, document: str, record: str) -> tuple[DataFrame, DataFrame]:
    """(checked documents, facts that stay). A document (document, record, name, birth_date) is held against the record (record, name, birth_date) that
    was chosen for it: a name that fits by ``same_name`` and a birth date within ``BIRTH_DAYS``. The facts of a document that does not fit are
    withdrawn: they are not in the second table. A document whose record is missing is not judged."""
    r = records.select(F.col(record), F.col("name").alias("_name"), F.col("birth_date").alias("_born"))
    joined = documents.join(r, record, "left")
    near = F.coalesce(F.abs(F.datediff("birth_date", "_born")) <= BIRTH_DAYS, F.lit(True))
    name = same_name(F.col("name"), F.col("_name"))
    checked = joined.select(document, record, name.alias("name_fits"), near.alias("birth_fits"), F.when(name & near, "fits").when(~name & ~near, "another person").when(~name, "another name").otherwise("another birth date").alias("outcome"))
    return checked, facts.join(checked.where("outcome != 'fits'").select(document).distinct(), document, "left_anti")


def promoted(elements: DataFrame, done: DataFrame, key: str, document: str, targets: Mapping[str, Mapping[str, Column]], reviewer: str) -> dict[str, DataFrame]:
    """What the accepted and corrected elements (key, document, kind, decision, value, corrected) write, by table: one row a kind with the columns of its
    target; ``provenance``, one row an element; ``verification``, one row an element with what was suggested and what was verified; ``report``, one a
    document over its observations. Elements in ``done`` are skipped, so that a second run writes nothing. The elements are read once."""
    final = F.when(F.col("decision") == "correct", F.coalesce("corrected", "value")).otherwise(F.col("value"))
    accepted = elements.where(F.col("decision").isin("accept", "correct")).join(done.select(key).distinct(), key, "left_anti").withColumn("final", final)
    out = {name: accepted.where(F.col("kind") == name).select(key, document, *[c.alias(n) for n, c in columns.items()]) for name, columns in targets.items()}
    known = accepted.where(F.col("kind").isin(list(targets)))
    out["provenance"] = known.select(key, document, F.lit("promote").alias("activity"), F.lit(reviewer).alias("agent"), F.col("kind").alias("target"), F.sha2(F.concat_ws("|", F.lit("provenance"), F.col(key).cast("string")), 256).alias("provenance_id"))
    outcome = F.when(F.col("decision") == "accept", "confirmed").when(final.eqNullSafe(F.col("value")), "confirmed").otherwise("changed")
    out["verification"] = known.select(key, F.col("value").alias("suggested"), F.col("final").alias("verified"), outcome.alias("outcome"))
    # what is collected is one document's observations
    out["report"] = known.where("kind = 'observation'").groupBy(document).agg(F.sort_array(F.collect_list(key)).alias("results"), F.count("*").alias("n"))
    return out
