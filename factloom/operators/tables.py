"""Table primitives: latest rows, supersession, upserts, snapshots, contracts, diffs.

All are keyed joins, windows or aggregates; none collects. A key that holds a large share of the rows is no problem for
the aggregates (summed before the shuffle) and is left to adaptive skew handling in the joins.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key under a total ``order`` (Spark limits each task's groups before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key, numbered."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w).cast("long")).where(F.col(name) <= k)


def current_rows(df: DataFrame, id_col: str, supersedes: str) -> DataFrame:
    """Rows that no other row names in its ``supersedes`` array; naming oneself is ignored."""
    named = df.select(F.col(id_col).alias("_by"), F.explode(supersedes).alias("_id")).where("_id != _by").select("_id").distinct()
    return df.join(named, df[id_col] == named["_id"], "left_anti")


def supersede(new: DataFrame, current: DataFrame, keys: Sequence[str], id_col: str, order: Sequence[Column]) -> DataFrame:
    """``new`` with a ``supersedes`` array: the first row of a key names all current rows of that key."""
    old = current.groupBy(*keys).agg(F.array_sort(F.collect_set(id_col)).alias("_old"))
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = new.withColumn("_rn", F.row_number().over(w)).join(old, list(keys), "left")
    empty = F.array().cast(new.schema[id_col].dataType.simpleString().join(["array<", ">"]))
    return rows.withColumn("supersedes", F.when(F.col("_rn") == 1, F.coalesce("_old", empty)).otherwise(empty)).drop("_rn", "_old")


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last write wins: rows of ``batch`` replace rows of ``target`` with the same key."""
    return target.join(batch.select(*keys).distinct(), list(keys), "left_anti").unionByName(batch)


def replace_by_key(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delete all rows of the batch's keys, then insert the batch (a key may have many rows)."""
    return upsert(target, batch, keys)


def upsert_keep(target: DataFrame, batch: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Upsert that never overwrites a value with null; ``keys`` are named key expressions over both tables."""
    names, cols = list(keys), target.columns
    old = target.select(*[c.alias(n) for n, c in keys.items()], F.struct(*cols).alias("_o"))
    new = batch.select(*[c.alias(n) for n, c in keys.items()], F.struct(*cols).alias("_n"))
    both = old.join(new, names, "full_outer")
    return both.select(*[F.coalesce(F.col("_n")[c], F.col("_o")[c]).alias(c) for c in cols])


def insert_absent(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``target`` and those rows of ``batch`` whose key is new."""
    return target.unionByName(batch.join(target.select(*keys).distinct(), list(keys), "left_anti"))


def row_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of several columns; missing values and separators inside values stay apart (each value stands with its length)."""
    text = lambda c: F.col(c).cast("string")
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in columns]), 256)


def dedupe_documents(df: DataFrame, content: str, scope: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per content hash and scope, with the hash and the number of copies."""
    hashed = df.withColumn("content_hash", row_hash([content, *scope]))
    w = Window.partitionBy("content_hash")
    first = F.row_number().over(w.orderBy(*order))
    copies = hashed.groupBy("content_hash").agg(F.count("*").alias("copies"))
    return hashed.withColumn("_rn", first).where("_rn = 1").drop("_rn").join(copies, "content_hash")


def admit_documents(new: DataFrame, known: DataFrame, hold: str = "quality_hold") -> DataFrame:
    """Route of each new content hash: ``new``, ``known``, or ``reprocess`` for content on hold."""
    states = known.groupBy("content_hash").agg(F.bool_or(F.col("state") == hold).alias("_held"))
    route = F.when(F.col("_held").isNull(), "new").when(F.col("_held"), "reprocess").otherwise("known")
    return new.join(states, "content_hash", "left").withColumn("route", route).drop("_held")


def snapshot_versions(df: DataFrame, keys: Sequence[str], order: Sequence[Column], payload: Sequence[str]) -> DataFrame:
    """Versions of a key by content hash: a row like its predecessor makes no new version."""
    w = Window.partitionBy(*keys).orderBy(*order)
    hashed = df.withColumn("payload_hash", row_hash(payload))
    changed = hashed.withColumn("_p", F.lag("payload_hash").over(w)).where("not (_p <=> payload_hash)").drop("_p")
    return changed.withColumn("version", F.row_number().over(w).cast("long"))


def contract_violations(df: DataFrame, key: str, required: Sequence[str] = (), allowed: dict[str, Sequence] | None = None) -> DataFrame:
    """Rows (key, field, reason): required fields that are missing, values outside the allowed ones."""
    checks = [F.when(F.col(c).isNull(), F.struct(F.lit(c).alias("field"), F.lit("missing").alias("reason"))) for c in required]
    for c, values in (allowed or {}).items():
        checks.append(F.when(F.col(c).isNotNull() & ~F.col(c).isin(list(values)), F.struct(F.lit(c).alias("field"), F.lit("not allowed").alias("reason"))))
    found = F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("v")
    return df.select(key, found).select(key, "v.field", "v.reason")


def table_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(keys, change): added, removed or changed; equal rows are left out."""
    o = old.select(*keys, F.struct(*values).alias("_o"))
    n = new.select(*keys, F.struct(*values).alias("_n"))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(~F.col("_o").eqNullSafe(F.col("_n")), "changed")
    return o.join(n, list(keys), "full_outer").select(*keys, change.alias("change")).where("change is not null")


def lookup_cascade(left: DataFrame, right: DataFrame, steps: Sequence[tuple[str, str]], key: str, result: str) -> DataFrame:
    """First hit over several lookup keys in order of priority: a union of equi joins instead of an OR join."""
    hits = [
        left.where(F.col(a).isNotNull()).join(right.select(F.col(b).alias(a), result), a).select(key, F.lit(i).alias("_p"), result)
        for i, (a, b) in enumerate(steps)
    ]
    best = reduce(DataFrame.unionByName, hits).groupBy(key).agg(F.min(F.struct("_p", result)).alias("_b"))
    return left.join(best, key, "left").select(left["*"], F.col(f"_b.{result}").alias(result), F.col("_b._p").cast("long").alias("matched_by"))


def mode_with_tie(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Most frequent value of each key; ties go to the longer, then the smaller value. With its agreement score."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    rank = F.struct(F.col("_n"), F.length(F.col(value).cast("string")).alias("_l"))
    best = counts.groupBy(*keys).agg(F.max(rank).alias("_r"), F.sum("_n").alias("total"))
    same = counts.join(best, list(keys)).where((F.col("_n") == F.col("_r._n")) & (F.length(F.col(value).cast("string")) == F.col("_r._l")))
    out = same.groupBy(*keys).agg(F.min(value).alias(value), F.first("_n").alias("votes"), F.first("total").alias("total"))
    return out.withColumn("agreement", F.round(F.least(F.lit(0.99), 0.5 + 0.25 * (F.col("votes") / F.col("total"))), 4))


def newest_of_another(df: DataFrame, same: Sequence[str], owner: str, order: Sequence[Column], key: str, other: str) -> DataFrame:
    """(key, other): for each row the newest row with equal ``same`` columns and another owner. Only the newest rows of the
    two newest owners of a group can be that, so a group of any size is two candidates."""
    when = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)])
    per_owner = df.groupBy(*same, owner).agg(F.max(F.struct(when.alias("w"), F.col(key).alias("k"))).alias("_best"))
    two = top_k(per_owner, same, [F.desc("_best")], 2, "_rn")
    groups = two.groupBy(*same).agg(*[F.max(F.when(F.col("_rn") == n, F.struct(F.col(owner).alias("who"), F.col("_best.k").alias("k")))).alias(f"_c{n}") for n in (1, 2)]).where("_c2 is not null")
    found = F.when(F.col("_c1.who") != F.col(owner), F.col("_c1.k")).otherwise(F.col("_c2.k"))
    return df.join(groups, list(same)).select(key, found.alias(other))


def reading_order(lines: DataFrame, page: str, centre: str, left: str, height: str, ties: Sequence[Column], share: float = 0.7) -> DataFrame:
    """``place`` of each line of a page: bands of ``share`` of the page's median line height, then the left edge."""
    band = lines.groupBy(page).agg((share * F.median(height)).alias("_band"))
    rows = lines.join(band, page).withColumn("_row", F.floor(F.col(centre) / F.col("_band")))
    w = Window.partitionBy(page).orderBy("_row", left, *ties)
    return rows.withColumn("place", F.row_number().over(w).cast("long")).drop("_row", "_band")
