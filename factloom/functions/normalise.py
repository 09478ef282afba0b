"""Normalisation of distinct spellings, and rules over lines of text; native expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.similarity import deletion_keys, edit_keys
from factloom.sources.scratch import stored

#: Letters of a word up to which it meets others by its deletions.
LONG = 32


def normalise_column(df: DataFrame, column: str, rule, name: str = "normal") -> DataFrame:
    """``df`` with ``name``: the rule runs once per distinct spelling and is joined back (rejected ones give null)."""
    spelt = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn(name, rule(F.col(column)))
    return df.join(spelt, column, "left")


# fixed values: titles before a name
TITLES = ("dr", "mr", "mrs", "ms", "miss", "prof", "shri", "smt")


def person_name(c: Column) -> Column:
    """Titles off, letters only, single blanks, capitalised."""
    letters = F.trim(F.regexp_replace(F.lower(c), "[^a-z]+", " "))
    return F.initcap(F.trim(F.regexp_replace(letters, "^((" + "|".join(TITLES) + ") )+", "")))


def written_dose(c: Column) -> tuple[Column, Column]:
    """Number and unit of a medicine text, as written."""
    number = F.regexp_extract(F.lower(c), "([0-9]+(?:[.][0-9]+)?) ?(mg|mcg|g|ml|iu)", 1).try_cast("double")
    return number, F.regexp_extract(F.lower(c), "([0-9]+(?:[.][0-9]+)?) ?(mg|mcg|g|ml|iu)", 2)


def in_mg(number: Column, unit: Column) -> tuple[Column, Column]:
    """Strength and unit of a written dose; g and mcg are given in mg."""
    return F.when(unit == "g", number * 1000).when(unit == "mcg", number / 1000).otherwise(number), F.when(unit.isin("g", "mcg"), "mg").when(unit != "", unit)


def dose(c: Column) -> tuple[Column, Column]:
    """Strength and unit of a medicine text; g and mcg are given in mg."""
    return in_mg(*written_dose(c))


def per_day(c: Column) -> Column:
    """Times a day: ``1-0-1``, ``q8h``, ``n times``, or a token; the longest token first."""
    low = F.lower(c)
    pattern = F.regexp_extract(low, "([0-9])-([0-9])-([0-9])", 0)
    parts = F.split(pattern, "-")
    hours = F.regexp_extract(low, "q([0-9]{1,2})h", 1).try_cast("double")
    times = F.regexp_extract(low, "([0-9]{1,2}) ?(?:times|x)", 1).try_cast("double")
    return (
        F.when(pattern != "", F.get(parts, F.lit(0)).try_cast("double") + F.get(parts, F.lit(1)).try_cast("double") + F.get(parts, F.lit(2)).try_cast("double"))
        .when(hours > 0, 24 / hours)
        .when(times.isNotNull(), times)
        .when(low.rlike("\\bqid\\b"), 4.0).when(low.rlike("\\b(tid|tds)\\b"), 3.0).when(low.rlike("\\b(bid|bd)\\b"), 2.0).when(low.rlike("\\b(od|daily|hs)\\b"), 1.0)
    )


def duration_days(c: Column) -> Column:
    """Days of an interval text."""
    n = F.regexp_extract(F.lower(c), "([0-9]{1,3}) ?(day|week|month|year)", 1).try_cast("long")
    unit = F.regexp_extract(F.lower(c), "([0-9]{1,3}) ?(day|week|month|year)", 2)
    return n * F.when(unit == "day", 1).when(unit == "week", 7).when(unit == "month", 30).when(unit == "year", 365)


def written_date(c: Column) -> tuple[Column, Column]:
    """A written date in one of four forms, and its precision (day, month, year)."""
    day = F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")), F.try_to_timestamp(c, F.lit("dd/MM/yyyy")), F.try_to_timestamp(c, F.lit("dd-MM-yyyy"))).cast("date")
    month = F.try_to_timestamp(c, F.lit("MM/yyyy")).cast("date")
    year = F.when(c.rlike("^(19|20)[0-9]{2}$"), F.make_date(c.try_cast("int"), F.lit(1), F.lit(1)))
    return F.coalesce(day, month, year), F.when(day.isNotNull(), "day").when(month.isNotNull(), "month").when(year.isNotNull(), "year")


def celsius(c: Column) -> Column:
    """Temperatures over 45 are taken as Fahrenheit."""
    return F.round(F.when(c > 45, (c - 32) * 5 / 9).otherwise(c), 2)


def phone(c: Column) -> Column:
    """Last ten digits of a number with ten or more."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(digits) >= 10, F.right(digits, F.lit(10)))


def classify_documents(docs: DataFrame, key: str, text: str, signals: dict[str, Sequence[tuple[str, int]]], least: int = 5, margin: int = 3) -> DataFrame:
    """Weighted patterns per class; a class is accepted with a high score and a clear margin, otherwise ``unknown``."""
    low = F.lower(F.col(text))
    scores = [F.struct(sum((F.when(low.rlike(p), w).otherwise(0) for p, w in ps), F.lit(0)).alias("score"), F.lit(c).alias("class")) for c, ps in sorted(signals.items())]
    ranked = docs.select(key, F.sort_array(F.array(*scores), asc=False).alias("s"))
    best, second = F.get("s", F.lit(0)), F.get("s", F.lit(1))
    ok = (best["score"] >= least) & (best["score"] - F.coalesce(second["score"], F.lit(0)) >= margin)
    return ranked.select(key, F.when(ok, best["class"]).otherwise("unknown").alias("class"), best["score"].cast("long").alias("score"))


def first_match(lines: DataFrame, key: str, order: str, text: str, patterns: Sequence[str]) -> DataFrame:
    """First hit of ordered patterns over ordered lines of each key: (key, value, rank)."""
    hits = F.array(*[F.struct(F.lit(i).alias("rank"), F.regexp_extract(text, p, 1).alias("value")) for i, p in enumerate(patterns)])
    rows = lines.select(key, order, F.inline(hits)).where("value != ''")
    return rows.groupBy(key).agg(F.min_by("value", F.struct("rank", order)).alias("value"), F.min("rank").cast("long").alias("rank"))


def repeated_entries(df: DataFrame, key: str, entries: str) -> DataFrame:
    """Entries of each key's list by folded text, the first kept: (key, entry, copies)."""
    rows = df.select(key, F.posexplode(entries).alias("pos", "entry")).withColumn("fold", F.lower(F.trim("entry"))).where("fold != ''")
    w = Window.partitionBy(key, "fold")
    return rows.withColumn("rn", F.row_number().over(w.orderBy("pos"))).withColumn("copies", F.count("*").over(w)).where("rn = 1 and copies > 1").select(key, "entry", "copies")


def snap_words(df: DataFrame, group: str, key: str, text: str, edits: int = 2) -> DataFrame:
    """(group, word, snapped): words of one document that are at most ``edits`` (1 or 2) edits from exactly one of the words that
    more documents of their group hold. Words meet by their deletions, so that no length and no first letter is left out; long words, which
    have many, by unchanged segments. Keys are hashes, the edits decide."""
    words = df.select(group, key, F.explode_outer(F.array_distinct(F.split(F.lower(text), "[^a-z]+"))).alias("w")).where("w != ''")
    # a word of one document has the same first and last one
    v = stored(words.groupBy(group, "w").agg((F.min(key) == F.max(key)).alias("one")))
    rare, common = v.where("one").select(group, F.col("w").alias("word")), v.where("not one").select(group, F.col("w").alias("common"))
    keys = lambda df, w, by: df.select(group, w, F.explode_outer(by).alias("_k")).where("_k is not null").select(F.col(group).alias(f"_{w}"), w, F.xxhash64(group, "_k").alias("_k"))

    def told(rare: DataFrame, k: int) -> DataFrame:
        """(group, word, snapped, _last): the smallest and the largest common word that a rare one has at ``k`` edits at most, however often they meet."""
        asked, held = edit_keys(k, F.col("word"), F.col("common"))
        # a pair is of two words up to ``LONG`` letters, or of two that have more or lack at most ``k`` of it
        short = lambda df, w: keys(df.where(F.length(w) <= LONG), w, deletion_keys(F.col(w), k))
        long = lambda df, w, by: keys(df.where(F.length(w) > LONG - k), w, by)
        # a word is many rows here, which Spark's estimate does not see: neither side may be sent to all tasks
        met = short(rare, "word").join(short(common, "common").hint("merge"), "_k")
        met = met.unionByName(long(rare, "word", asked).join(long(common, "common", held).hint("merge"), "_k"))
        near = met.where((F.col("_word") == F.col("_common")) & F.levenshtein("word", "common", k).between(0, k))
        return near.groupBy(F.col("_word").alias(group), "word").agg(F.min("common").alias("snapped"), F.max("common").alias("_last"))

    # a word that has two partners at one edit needs no more of them; the few keys of one edit leave fewer words for the many of two
    for k in range(1, edits):
        rare = stored(rare.join(told(rare, k).where("snapped < _last").hint("merge"), [group, "word"], "left_anti"))
    return told(rare, edits).where("snapped = _last").select(group, "word", "snapped")
