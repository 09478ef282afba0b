"""Scoring against answer keys, drift, error rates, percentiles and release gates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.similarity import edit_distances, wilson_lower


def tally(df: DataFrame, by: Sequence[str], expected: str, got: str) -> DataFrame:
    """Right, wrong, missed and spurious values of each group, with precision, its lower bound, and recall."""
    e, g = F.col(expected), F.col(got)
    n = df.groupBy(*by).agg(
        F.count_if(e.isNotNull()).alias("expected"), F.count_if(g.isNotNull()).alias("accepted"), F.count_if(e == g).alias("right"),
        F.count_if(e.isNotNull() & g.isNotNull() & (e != g)).alias("wrong"), F.count_if(e.isNotNull() & g.isNull()).alias("missed"), F.count_if(e.isNull() & g.isNotNull()).alias("spurious"),
    )
    ratio = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)), 4)
    return n.withColumns({"precision": ratio("right", "accepted"), "precision_low": F.round(wilson_lower(F.col("right"), F.col("accepted")), 4), "recall": ratio("right", "expected")})


def scoreboard(df: DataFrame, slices: Sequence[str], expected: str, got: str) -> DataFrame:
    """The tally overall and once per value of each slice: (slice, value, …)."""
    cells = F.explode(F.array(F.struct(F.lit("all").alias("slice"), F.lit("all").alias("value")), *[F.struct(F.lit(s).alias("slice"), F.col(s).cast("string").alias("value")) for s in slices])).alias("_s")
    return tally(df.select("*", cells).select("*", "_s.slice", "_s.value").drop(*slices), ["slice", "value"], expected, got)


def release_gate(board: DataFrame, thresholds: Sequence[tuple[str, float]]) -> DataFrame:
    """Reasons per slice why a board may not be released: metrics that are missing or under their threshold."""
    reasons = [F.when(F.col(m).isNull() | (F.col(m) < t), F.lit(f"{m} < {t}")) for m, t in thresholds]
    return board.withColumn("reasons", F.array_join(F.array_compact(F.array(*reasons)), "; ")).withColumn("released", F.col("reasons") == "")


def drift_alarm(df: DataFrame, order: Sequence[str], value: str, n: int, least: int = 20, sigma: float = 3.0, tolerance: float = 0.15, by: Sequence[str] = ()) -> DataFrame:
    """Each run against the mean of the ``n`` before it; silent under ``least`` runs."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-n, -1)
    out = df.withColumns({"runs": F.count(value).over(w), "mean": F.avg(value).over(w), "sd": F.stddev_pop(value).over(w)})
    band = F.greatest(sigma * F.col("sd"), F.lit(tolerance))
    return out.withColumn("alarm", (F.col("runs") >= least) & (F.abs(F.col(value) - F.col("mean")) > band))


def auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the curve by average ranks over ties (no pairs); ranks follow from counts per distinct score."""
    n = df.groupBy(*by, score).agg(F.count("*").alias("n"), F.sum(label).alias("p"))
    w = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranked = n.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    s = ranked.groupBy(*by).agg(F.sum(F.col("p") * (F.col("before") + (F.col("n") + 1) / 2)).alias("r"), F.sum("p").alias("pos"), F.sum(F.col("n") - F.col("p")).alias("neg"))
    area = (F.col("r") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * F.col("neg"))
    return s.select(*by, "pos", "neg", F.round(F.when((F.col("pos") > 0) & (F.col("neg") > 0), area), 6).alias("auc"))


def error_rates(df: DataFrame, by: Sequence[str], truth: str, pred: str) -> DataFrame:
    """Character error rate and exact matches: edits over reference length."""
    edits, size = F.levenshtein(truth, pred), F.length(truth)
    n = df.groupBy(*by).agg(F.count("*").alias("lines"), F.sum(edits).alias("edits"), F.sum(size).alias("length"), F.count_if(F.col(truth) == F.col(pred)).alias("exact"))
    return n.withColumn("cer", F.round(F.when(F.col("length") > 0, F.col("edits") / F.col("length")), 6))


def set_scores(expected: DataFrame, got: DataFrame, group: str, item: str) -> DataFrame:
    """Precision and recall of a list field per group."""
    e = expected.select(group, item).distinct().withColumn("_e", F.lit(1))
    g = got.select(group, item).distinct().withColumn("_g", F.lit(1))
    n = e.join(g, [group, item], "full_outer").groupBy(group).agg(F.count("_e").alias("expected"), F.count("_g").alias("got"), F.count(F.col("_e") + F.col("_g")).alias("hits"))
    return n.withColumns({"precision": F.round(F.when(F.col("got") > 0, F.col("hits") / F.col("got")), 4), "recall": F.round(F.when(F.col("expected") > 0, F.col("hits") / F.col("expected")), 4)})


def compare_boards(champion: DataFrame, candidate: DataFrame, keys: Sequence[str], metric: str, margin: float = 0.0) -> DataFrame:
    """win, tie or loss of the candidate per slice."""
    c = champion.select(*keys, F.col(metric).alias("old")).join(candidate.select(*keys, F.col(metric).alias("new")), list(keys), "full_outer")
    d = F.coalesce("new", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))
    return c.withColumn("verdict", F.when(d > margin, "win").when(d < -margin, "loss").otherwise("tie"))


def false_rates(df: DataFrame, by: Column | str, truth: str, got: str) -> DataFrame:
    """False accepts and rejects of each group."""
    return df.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if((F.col(truth) == 0) & F.col(got)).alias("false_accept"), F.count_if((F.col(truth) == 1) & ~F.col(got)).alias("false_reject")
    )


#: Pairs of names that are held against each other at once.
PAIRS = 1 << 18


def _paired(want: pa.Array, have: pa.Array) -> pa.Array:
    """``paired_edits`` of lists of names."""

    def names(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
        said = lists.flatten()
        row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())[said.is_valid().to_numpy(zero_copy_only=False)]
        return said.drop_null().cast(pa.string()), row

    (x, row_x), (y, row_y) = names(want), names(have)
    coded = pa.concat_arrays([x, y]).dictionary_encode()
    words = coded.dictionary.to_pylist()
    code, length = coded.indices.to_numpy(), np.array([len(w) for w in words], dtype=np.int64)
    code_x, code_y = code[: len(x)], code[len(x) :]
    n, m = (np.bincount(r, minlength=len(want)) for r in (row_x, row_y))
    begin_x, begin_y, size = np.cumsum(n) - n, np.cumsum(m) - m, np.cumsum(n * m)
    free_x, free_y, edits, row = np.ones(len(x), dtype=bool), np.ones(len(y), dtype=bool), np.zeros(len(want), dtype=np.int64), 0
    first_x, first_y = np.zeros(len(x), dtype=np.int64), np.zeros(len(y), dtype=np.int64)
    while row < len(want):
        end = max(row + 1, int(np.searchsorted(size, (size[row - 1] if row else 0) + PAIRS, side="right")))
        own = np.repeat(np.arange(row, end), (n * m)[row:end])
        k = np.arange(len(own)) - (size - n * m - (size[row - 1] if row else 0))[own]
        i, j, row = begin_x[own] + k // m[own], begin_y[own] + k % m[own], end
        pairs, at = np.unique(code_x[i].astype(np.int64) * len(words) + code_y[j], return_inverse=True)
        u, v = np.divmod(pairs, len(words))
        cost, longer = edit_distances([words[c] for c in u], [words[c] for c in v]), np.maximum(length[u], length[v])
        ratio = (cost / np.maximum(1, longer))[at]
        order = np.argsort(ratio, kind="stable")
        order = order[(cost < longer)[at[order]]]
        while len(order):
            # a pair that comes first for both its names is one that is taken in order, whatever the others are
            a, b, place = i[order], j[order], np.arange(len(order))
            first_x[a[::-1]], first_y[b[::-1]] = place[::-1], place[::-1]
            best = (first_x[a] == place) & (first_y[b] == place)
            free_x[a[best]], free_y[b[best]] = False, False
            np.add.at(edits, own[order[best]], cost[at[order[best]]])
            order = order[free_x[a] & free_y[b]]

    def total(r: np.ndarray, some: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return np.bincount(r[some], weights=weights[some], minlength=len(want)).astype(np.int64)

    edits += total(row_x, free_x, length[code_x]) + total(row_y, free_y, length[code_y])
    written, missed, extra = total(row_x, np.ones(len(x), dtype=bool), length[code_x]), total(row_x, free_x, free_x), total(row_y, free_y, free_y)
    return pa.StructArray.from_arrays([pa.array(c) for c in (edits, written, missed, extra)], names=["edits", "length", "missed", "extra"])


def paired_edits(df: DataFrame, expected: str, got: str) -> DataFrame:
    """``edits``, ``length``, ``missed`` and ``extra`` of two lists of names: the most alike names are paired first (ties: in order of
    the lists), unpaired expected names count as deletions, unpaired given ones as insertions; null is no name. Lists are those of one
    document; those of a batch are paired together."""

    def batch(x: pa.Array, y: pa.Array) -> pa.Array:
        return _paired(x, y)

    batch.__annotations__ = {"x": pa.Array, "y": pa.Array, "return": pa.Array}
    return df.withColumn("_p", F.arrow_udf(batch, "edits long, length long, missed long, extra long")(expected, got)).select(*[c for c in df.columns if c not in (expected, got)], "_p.*")


def disagreement_rates(runs: DataFrame, run: str, states: str, bad: str, counted: Sequence[str]) -> DataFrame:
    """(run, rate): the share of ``bad`` among the counted states of a run's state map; null where none was counted."""
    total = F.aggregate(F.map_entries(F.map_filter(states, lambda k, v: k.isin(list(counted)))), F.lit(0).cast("long"), lambda s, e: s + e["value"])
    return runs.select(run, F.round(F.when(total > 0, F.coalesce(F.try_element_at(states, F.lit(bad)), F.lit(0)) / total), 6).alias("rate"))
