"""Lines of a page: what covers them, and names that need company."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def swept(asked: DataFrame, boxes: DataFrame, within: list[str], key: str) -> DataFrame:
    """(within, key, covered, n, conf) of the intervals ``asked`` (within, key, x0, x1): how much of each the ``boxes`` (within, x0, x1, conf) cover
    together, how many overlap it, and the sum of their confidence.

    One sweep over all ends in order, without a join: covered length, boxes begun and boxes ended are running sums, of which an
    interval takes the difference of its two ends. Overlapping boxes count once.
    """
    at = lambda df, x, kind, **more: df.select(*within, F.col(x).cast("double").alias("x"), F.lit(kind).alias("kind"), *[v.alias(k) for k, v in more.items()])
    real = boxes.where("x1 > x0").withColumn("conf", F.col("conf").cast("double"))
    none, kind_of_key = F.lit(None), dict(asked.dtypes)[key]
    # of equal ends: boxes end, intervals end, intervals begin, boxes begin
    points = at(real, "x1", 0, key=none.cast(kind_of_key), conf=F.col("conf")).unionByName(at(real, "x0", 3, key=none.cast(kind_of_key), conf=F.col("conf")))
    points = points.unionByName(at(asked, "x1", 1, key=F.col(key), conf=none.cast("double"))).unionByName(at(asked, "x0", 2, key=F.col(key), conf=none.cast("double")))
    order = Window.partitionBy(*within).orderBy("x", "kind", "key")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    begun, ended = F.col("kind") == 3, F.col("kind") == 0
    running = points.select(
        "*", F.sum(begun.cast("long")).over(so_far).alias("b"), F.sum(ended.cast("long")).over(so_far).alias("e"),
        F.sum(F.when(begun, F.col("conf")).otherwise(0.0)).over(so_far).alias("bc"), F.sum(F.when(ended, F.col("conf")).otherwise(0.0)).over(so_far).alias("ec"), F.lag("x").over(order).alias("_x"),
    )
    running = running.withColumn("_open", F.lag(F.col("b") - F.col("e"), 1, 0).over(order))
    running = running.withColumn("c", F.sum(F.when(F.col("_open") > 0, F.col("x") - F.col("_x")).otherwise(0.0)).over(so_far))
    low, high = F.col("kind") == 2, F.col("kind") == 1
    pick = lambda when, c: F.max(F.when(when, F.col(c)))
    ends = running.where("kind in (1, 2)").groupBy(*within, F.col("key").alias(key))
    return ends.agg((pick(high, "c") - pick(low, "c")).alias("covered"), (pick(high, "b") - pick(low, "e")).alias("n"), F.round(pick(high, "bc") - pick(low, "ec"), 9).alias("conf"))


def line_labels(lines: DataFrame, ocr: DataFrame, page: str, key: str) -> DataFrame:
    """(page, key, coverage, label) of lines (page, key, band, x0, x1) by the boxes (page, key, band, x0, x1, conf) read on them: printed from a
    coverage of 0.6 and a mean confidence of 0.85 on, handwritten under 0.3, else mixed or uncertain. A box on no line is a line of its own,
    printed: nothing that was read is lost."""
    within = [page, "band"]
    found = lines.select(*within, key, "x0", "x1").join(swept(lines, ocr, within, key), [*within, key])
    cover = F.least(F.lit(1.0), F.col("covered") / (F.col("x1") - F.col("x0")))
    mean = F.when(F.col("n") > 0, F.col("conf") / F.col("n"))
    label = F.when((cover >= 0.6) & (mean >= 0.85), "printed").when(cover < 0.3, "handwritten").when(mean >= 0.85, "mixed").otherwise("uncertain")
    alone = swept(ocr, lines.withColumn("conf", F.lit(0.0)), within, key).where("n = 0")
    own = found.select(page, key, F.round(cover, 4).alias("coverage"), label.alias("label"))
    return own.unionByName(alone.select(page, key, F.lit(1.0).alias("coverage"), F.lit("printed").alias("label")))


def supported_names(hits: DataFrame, within: str, line: str, name: str, strong: str, reach: int = 2) -> DataFrame:
    """(within, line, name, island, kept): names found in lines. Lines whose names lie at most ``reach`` lines apart form an island; a weak
    name stays only if its island has a strong one, which every line of it passes on."""
    order = Window.partitionBy(within).orderBy(line)
    starts = F.coalesce((F.col(line) - F.lag(line).over(order) > reach).cast("long"), F.lit(1))
    # lines first, so that a line with many names is one row of the walk
    lines = hits.groupBy(within, line).agg(F.bool_or(strong).alias("_s")).withColumn("island", F.sum(starts).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    support = F.max(F.col("_s").cast("int")).over(Window.partitionBy(within, "island")) == 1
    lines = lines.select(within, line, "island", support.alias("_s"))
    return hits.select(within, line, name, F.col(strong).alias("_own")).join(lines, [within, line]).select(within, line, name, "island", (F.col("_own") | F.col("_s")).alias("kept"))
