"""Fan-out of nested answers into fact rows, routing of misfiled lines, evidence roll-ups, nearest lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.reading import SENT
from factloom.operators.consensus import led


def fan_out(df: DataFrame, key: str, lists: dict[str, str]) -> DataFrame:
    """(key, fact_type, seq, value): one row per entry of each list column; empty lists give no row."""
    out = None
    for fact_type, column in lists.items():
        rows = df.select(key, F.lit(fact_type).alias("fact_type"), F.posexplode(column).alias("pos", "value")).select(key, "fact_type", (F.col("pos") + 1).cast("long").alias("seq"), "value")
        out = rows if out is None else out.unionByName(rows)
    return out


def pressure_pair(c: Column) -> Column:
    """``120/80`` as two rows (name, value)."""
    high, low = F.regexp_extract(c, "^([0-9]{2,3})/([0-9]{2,3})$", 1).try_cast("double"), F.regexp_extract(c, "^([0-9]{2,3})/([0-9]{2,3})$", 2).try_cast("double")
    return F.array(F.struct(F.lit("systolic").alias("name"), high.alias("value")), F.struct(F.lit("diastolic").alias("name"), low.alias("value")))


def first_per_name(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first value of each name wins."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def routed(text: Column, listed_as: Column) -> Column:
    """The fact type a line belongs to: advice among medicines, medicines among tests, test lists among medicines."""
    low = F.lower(text)
    advice = low.rlike("\\b(drink|avoid|rest|walk|diet)\\b")
    medicine = low.rlike("\\b(tab|cap|syp|inj)\\b|[0-9] ?(mg|ml|mcg)\\b")
    tests = F.size(F.split(low, ",")) >= 3
    return F.when((listed_as == "medication") & advice, "advice").when((listed_as == "test") & medicine, "medication").when((listed_as == "medication") & tests & ~medicine, "test").otherwise(listed_as)


def evidence_rollup(facts: DataFrame, blocks: DataFrame, key: str, ids: str, default: float = 0.5) -> DataFrame:
    """Mean confidence and union box of each fact's evidence blocks (block_id, conf, x0, y0, x1, y1).

    Only named blocks are looked up: facts without any would all meet in one task, under the id null. They come in by their keys, beside
    the blocks that were found."""
    named = facts.select(key, F.explode(ids).alias("block_id")).where("block_id is not null")
    used = named.join(blocks, "block_id").drop("block_id").unionByName(facts.select(key), allowMissingColumns=True)
    return used.groupBy(key).agg(F.round(F.coalesce(F.avg("conf"), F.lit(default)), 4).alias("conf"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def nearest_following(lines: DataFrame, group: str, key: str, y: str, x: str, height: int, band: int = 2) -> DataFrame:
    """The nearest line to the right on the same row or just below: candidates meet in bands of rows."""
    a = lines.select(group, F.col(key).alias("a"), F.col(y).alias("ay"), F.col(x).alias("ax"), F.explode(F.sequence(F.floor((F.col(y) - height) / (height * band)), F.floor((F.col(y) + 2 * height) / (height * band)))).alias("_b"))
    b = lines.select(group, F.col(key).alias("b"), F.col(y).alias("by"), F.col(x).alias("bx"), F.floor(F.col(y) / (height * band)).alias("_b"))
    dy, dx = F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")
    right = (F.abs(dy) * 2 <= height) & (dx > 0)
    below = (dy * 2 > height) & (dy <= 2 * height)
    near = a.join(b, [group, "_b"]).where((F.col("a") != F.col("b")) & (right | below)).withColumn("d", F.abs(dy) * 10 + F.abs(dx))
    return near.groupBy(group, "a").agg(F.min(F.struct("d", "b")).alias("m")).select(group, "a", F.col("m.b").alias("following"), F.col("m.d").alias("distance"))


def keyword_groups(docs: DataFrame, key: str, text: str, keywords: DataFrame, longest: int = 2) -> DataFrame:
    """(key, group): documents whose text holds a keyword of a group as whole words; n-grams meet keywords by equi join."""
    words = docs.select(key, F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "").alias("w"))
    # keywords of a bounded number go to all tasks, so that not every n-gram is moved; more of them are joined
    known = F.broadcast(keywords) if keywords.limit(SENT + 1).count() <= SENT else keywords
    found = None
    for n in range(1, longest + 1):
        gram = lambda i: F.concat_ws(" ", *[F.get("w", i + k) for k in range(n)])  # noqa: E731, B023
        each = F.col("w") if n == 1 else F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(0), F.size("w") - n), gram))
        # an outer list, as Spark would make it twice to leave out empty ones
        rows = words.select(key, F.explode_outer(F.array_distinct(each)).alias("keyword")).join(known, "keyword").select(key, "group")
        found = rows if found is None else found.union(rows)
    return found.distinct()


def clusters_within_key(df: DataFrame, key: str, value: str, floor: float = 0.78) -> DataFrame:
    """Greedy merge of alike values inside each key, most frequent first: (key, value, shown, n).

    Values are counted before they are shuffled; the distinct spellings of a key stream past the shown ones, which alone are held.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    rows = counts.select(key, F.col(value).cast("string").alias("value"), "n")
    return led(rows, key, [F.desc("n"), "value"], floor).select(key, F.col("value").alias(value), F.col("leader").alias("shown"), "n")


def numbers_supported(df: DataFrame, key: str, value: str, reading: str) -> DataFrame:
    """Whether each number of ``value`` occurs in ``reading`` at least as often."""
    numbers = lambda c: F.regexp_extract_all(F.col(c), F.lit("([0-9]+(?:[.][0-9]+)?)"), F.lit(1))
    need = F.array_distinct(numbers(value))
    times = lambda c, x: F.size(F.filter(numbers(c), lambda y: y == x))
    return df.select(key, F.coalesce(F.forall(need, lambda x: times(reading, x) >= times(value, x)), F.lit(False)).alias("supported"))


def missing_ids(df: DataFrame, known: DataFrame, ids: str, key: str) -> DataFrame:
    """(key, id) of array entries that no known row has."""
    return df.select(key, F.explode(ids).alias("id")).distinct().join(known, "id", "left_anti")
