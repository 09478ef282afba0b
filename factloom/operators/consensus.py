"""What several readings agree on, and vocabularies that leave a reading's own words out."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.similarity import edit_keys, ratcliff


def led(rows: DataFrame, key: str, order: list, floor: float) -> DataFrame:
    """``rows`` (key, value, ...) with ``leader``: in the given order, a value of a key joins the first leader that is at least ``floor`` alike by matching
    blocks, or becomes one. A key's values stream through one task in their order; only its leaders are held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, leaders = None, []
        match = difflib.SequenceMatcher(autojunk=False)
        for batch in batches:
            found = []
            for k, v in zip(batch[key], batch["value"]):
                if k != now:
                    now, leaders = k, []
                match.set_seq2(v)  # what is worked out for the second text serves all leaders
                for leader in leaders:
                    match.set_seq1(leader)
                    if leader == v or match.real_quick_ratio() >= floor and match.quick_ratio() >= floor and match.ratio() >= floor:
                        found.append(leader)
                        break
                else:
                    leaders.append(v)
                    found.append(v)
            yield batch.assign(leader=found)

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, f"{schema}, leader string")


def leader_groups(df: DataFrame, key: str, value: str, order: str, floor: float = 0.85) -> DataFrame:
    """(key, value, n, first, leader) of the distinct values of each key, led in the order of their first reading. Values are counted before they
    are shuffled."""
    each = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return led(each.select(key, F.col(value).cast("string").alias("value"), "n", "first"), key, ["first", "value"], floor)


def group_consensus(df: DataFrame, key: str, value: str, order: str, floor: float = 0.85) -> DataFrame:
    """(key, value, agree, readings) of each key: the value closest to the others of its largest group (ties: the earlier group, the earlier
    value), how many readings are in that group, and how many there are.

    Only the values of the largest group meet in pairs; those of all other groups never do.
    """
    groups = leader_groups(df, key, value, order, floor)
    sizes = groups.groupBy(key, "leader").agg(F.sum("n").alias("agree"), F.min("first").alias("_f"))
    best = sizes.groupBy(key).agg(F.max(F.struct("agree", F.lit(0).alias("_"))).alias("_b"), F.sum("agree").alias("readings")).select(key, F.col("_b.agree").alias("agree"), "readings")
    first = sizes.join(best, [key, "agree"]).groupBy(key, "agree", "readings").agg(F.min(F.struct("_f", "leader"))["leader"].alias("leader"))
    members = groups.join(first, [key, "leader"])
    x = members.select(key, F.col("value").alias("a"), F.col("first").alias("_fa"), "agree", "readings")
    y = members.select(key, F.col("value").alias("b"), F.col("n").alias("_n"))
    near = x.join(y, key).withColumn("_s", ratcliff("a", "b") * F.col("_n")).groupBy(key, "a", "_fa", "agree", "readings").agg(F.round(F.sum("_s"), 6).alias("_s"))
    last = Window.partitionBy(key).orderBy(F.desc("_s"), "_fa", "a")
    return near.withColumn("_r", F.row_number().over(last)).where("_r = 1").select(key, F.col("a").alias(value), "agree", "readings")


def left_out_words(df: DataFrame, group: str, row: str, text: str, pattern: str = "[a-z][a-z0-9]*", least: int = 3) -> DataFrame:
    """(group, row, word, snapped): words of a row that none of its group's other rows has, and that are near exactly one word of these rows
    (one edit, two from six letters on).

    A row's vocabulary is its group's without what only the row itself says: a word is of one row or of several. Words meet by segments
    that they share unchanged, at most three keys a known word; keys are hashes, the edits decide.
    """
    words = df.select(group, row, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), F.lit(1)))).alias("word")).where(F.length("word") >= least)
    counted = words.groupBy(group, "word").agg(F.min(row).alias(row), F.max(row).alias("_to")).where(F.col(row).isNotNull())
    # a word of one row only is unknown to that row, and known to all others
    one = F.col(row) == F.col("_to")
    short, long = (edit_keys(k, F.col("a"), F.col("b"), least) for k in (1, 2))
    asked = counted.where(one).select(group, row, F.col("word").alias("a"), F.when(F.length("word") < 6, 1).otherwise(2).alias("_k"))
    asked = asked.select(group, row, "a", "_k", F.explode_outer(F.when(F.col("_k") == 1, short[0]).otherwise(long[0])).alias("_g")).where("_g is not null")
    known = counted.select(group, F.col("word").alias("b"), F.when(one, F.col(row)).alias("_own"))
    # partners of words under six letters have six at most, partners of longer ones four at least
    n, none = F.length("b"), F.array().cast("array<bigint>")
    known = known.select(group, "b", "_own", F.explode_outer(F.concat(F.when(n <= 6, short[1]).otherwise(none), F.when(n >= 4, long[1]).otherwise(none))).alias("_g"))
    # keys are made once (a plain explode looks at its array beforehand); each word is many rows here, which Spark's estimate does not see: neither side may be sent to all tasks
    near = asked.join(known.hint("merge"), [group, "_g"]).where((F.col("a") != F.col("b")) & ~F.col("_own").eqNullSafe(F.col(row)))
    near = near.where(F.levenshtein("a", "b", 2).between(0, F.col("_k"))).select(group, row, "a", "b").distinct()
    return near.groupBy(group, row, F.col("a").alias("word")).agg(F.min("b").alias("snapped"), F.count("*").alias("_c")).where("_c = 1").select(group, row, "word", "snapped")
