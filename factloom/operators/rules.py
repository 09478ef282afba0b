"""Findings, confidence calibration, the acceptance gate, policies, conflicts and review tasks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the bands and penalties of the gate
AUTO_ACCEPT, AUDIT_ACCEPT, REVIEW_FLOOR = 0.985, 0.95, 0.85
PARTIAL_PENALTY, BLOCKER_CAP, WARNING_CAP = 0.30, 0.5, 0.9
NUMERIC_TOLERANCE = 1e-6


def findings(df: DataFrame, key: str, rules: Sequence[tuple[Column, str, str]]) -> DataFrame:
    """(key, severity, code): one row per rule that a row breaks. Rules are (condition, severity, code)."""
    each = [F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(k).alias("code"))) for c, s, k in rules]
    found = F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("f")
    return df.select(key, found).select(key, "f.severity", "f.code")


def range_findings(df: DataFrame, key: str, kind: str, value: str, ranges: DataFrame) -> DataFrame:
    """Values outside [lo, hi] of their kind; ``ranges`` (kind, lo, hi) has one row a kind."""
    joined = df.join(ranges.withColumnRenamed("kind", kind), kind)
    return findings(joined, key, [(F.col(value) < F.col("lo"), "warning", "below_range"), (F.col(value) > F.col("hi"), "warning", "above_range"), (F.col(value).isNull(), "info", "no_value")])


def finding_counts(found: DataFrame, key: str) -> DataFrame:
    return found.groupBy(key).agg(F.count_if(F.col("severity") == "blocker").alias("n_block"), F.count_if(F.col("severity") == "warning").alias("n_warn"))


def calibrated(conf: Column, partial: Column, n_warn: Column, n_block: Column) -> Column:
    """Confidence less the penalty for partial readings, capped by the worst finding, within 0 and 1; a missing one is 0."""
    base = F.coalesce(conf, F.lit(0.0)) - F.when(partial, PARTIAL_PENALTY).otherwise(0.0)
    cap = F.when(n_block > 0, BLOCKER_CAP).when(n_warn > 0, WARNING_CAP).otherwise(1.0)
    return F.round(F.greatest(F.lit(0.0), F.least(base, cap)), 3)


def gate_state(conf: Column, partial: Column, n_findings: Column, n_block: Column, policy: Column, min_conf: Column | None = None, medication: Column | None = None) -> Column:
    """Order matters: blockers, partial readings, policy (an action ``review`` or a confidence under ``min_conf``), the floor
    and ``medication`` (a medicine with a finding of its own) come before the automatic bands. Missing confidence is reviewed."""
    held = (n_block > 0) | F.coalesce(partial, F.lit(True)) | F.coalesce(policy == "review", F.lit(False)) | F.coalesce(conf < REVIEW_FLOOR, F.lit(True))
    if min_conf is not None:
        held = held | F.coalesce(conf < min_conf, F.lit(False))
    if medication is not None:
        held = held | F.coalesce(medication, F.lit(False))
    return F.when(held, "review").when((conf >= AUTO_ACCEPT) & (n_findings == 0), "auto_accepted").when(conf >= AUDIT_ACCEPT, "auto_accepted").otherwise("review")


def with_policy(df: DataFrame, policy: DataFrame, kind: str, state: str) -> DataFrame:
    """``action`` and ``min_conf`` of (kind, state); a null state in the policy is the kind's default row."""
    special = policy.where(F.col("state").isNotNull()).select(F.col("kind").alias(kind), F.col("state").alias(state), F.col("action").alias("_a"), F.col("min_conf").alias("_m"))
    default = policy.where(F.col("state").isNull()).select(F.col("kind").alias(kind), F.col("action").alias("_da"), F.col("min_conf").alias("_dm"))
    out = df.join(special, [kind, state], "left").join(default, kind, "left")  # Spark broadcasts what it knows to be small
    return out.withColumn("action", F.coalesce("_a", "_da", F.lit("review"))).withColumn("min_conf", F.coalesce("_m", "_dm")).drop("_a", "_da", "_m", "_dm")


def audit_sample(df: DataFrame, key: str, per_mille: int = 100) -> DataFrame:
    """A repeatable sample of accepted rows: the same rows in every run, for keys of any type and size."""
    digits = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    return df.where(digits % 1000 < per_mille)


def value_conflicts(facts: DataFrame, key: str, same: Sequence[str], value: str) -> DataFrame:
    """One row per distinct value of a group that states more than one fact: (same, value, keep_id, n, kind).

    Groups have equal ``same`` columns (nulls equal). ``keep_id`` is the smallest key of the value, ``n`` its facts and ``kind``
    is ``value_mismatch`` where the group holds another value (further than the tolerance, or missing beside given), else
    ``duplicate``. Values are summed before they are shuffled and no pairs are formed: members follow by a join on ``same``
    and ``value``, and a group of any size is one row per value.
    """
    step = F.round(F.col(value) / NUMERIC_TOLERANCE)
    each = facts.groupBy(*same, step.alias("_step")).agg(F.min(value).alias(value), F.min(key).alias("keep_id"), F.count("*").alias("n"))
    group = each.groupBy(*same).agg(F.sum("n").alias("_all"), F.min("_step").alias("_lo"), F.max("_step").alias("_hi"), F.count_if(F.col("_step").isNull()).alias("_none"))
    group = group.where("_all > 1").select(*[F.col(c).alias(f"_g_{c}") for c in same], "_lo", "_hi", "_none")
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in same])
    mixed = (F.col("_lo") != F.col("_hi")) | (F.col("_none") > 0) & F.col("_lo").isNotNull()
    return each.join(group, on).select(*same, value, "keep_id", "n", F.when(F.coalesce(mixed, F.lit(False)), "value_mismatch").otherwise("duplicate").alias("kind"))


def review_tasks(df: DataFrame, document: str, fact: str, state: str, kinds: str) -> DataFrame:
    """One task per document with held facts: their number, and the first kind of finding by name."""
    held = df.where(F.col(state) == "review")
    return held.groupBy(document).agg(F.count("*").alias("n_held"), F.min(fact).alias("first_fact"), F.min(kinds).alias("kind"))


def closed_tasks(members: DataFrame, task: str, pending: Column) -> DataFrame:
    """Tasks none of whose members is pending."""
    return members.groupBy(task).agg(F.bool_and(~pending).alias("closed"), F.count_if(pending).alias("n_pending"))


def worst_state(df: DataFrame, key: str, state: str, order: Sequence[str]) -> DataFrame:
    """The worst state of each key by a fixed order, worst first; states outside the order rank last and keep their name
    (the smallest, if a key has only such), missing ones rank behind them."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(state))
    place = F.struct(F.when(rank > 0, rank).when(F.col(state).isNotNull(), len(order) + 1).otherwise(len(order) + 2).alias("r"), F.col(state).alias("s"))
    return df.groupBy(key).agg(F.min(place).alias("_r")).select(key, F.col("_r.s").alias(state))


def capped_confidence(conf: Column, state: Column, caps: dict[str, float]) -> Column:
    """Confidence under the cap of its evidence state; unknown states and missing confidence give 0."""
    cap = F.lit(0.0)
    for s, c in caps.items():
        cap = F.when(state == s, c).otherwise(cap)
    return F.least(F.coalesce(conf, F.lit(0.0)), cap)


def dominant_kind(found: DataFrame, document: str, code: str, kinds: dict[str, Sequence[str]], default: str = "low_confidence") -> DataFrame:
    """(document, kind): the first kind, in the order of ``kinds``, that a finding of the document belongs to by prefix."""
    rank = F.lit(len(kinds))
    for i, prefixes in reversed(list(enumerate(kinds.values()))):
        rank = F.when(reduce(lambda x, y: x | y, [F.col(code).startswith(p) for p in prefixes]), i).otherwise(rank)
    names = F.array(*map(F.lit, [*kinds, default]))
    return found.groupBy(document).agg(F.element_at(names, (F.min(rank) + 1).cast("int")).alias("kind"))


#: Actions from the loosest to the strictest.
STRICTNESS = ["auto", "gate", "review", "reject"]


def merged_policy(rows: DataFrame, kind: str, state: str, layers: Sequence[tuple[str, DataFrame]], floors: DataFrame) -> DataFrame:
    """``rows`` with ``action``, ``min_conf``, ``rule`` and ``tightened``: the policy of each row under rules that an override can only tighten.

    ``layers`` (name, table of kind, state, action, min_conf) go from the base to the last override. Of each layer the rule of (kind, state)
    counts, else the one of the state alone (kind null); the last layer that has one for the kind decides, else the last that has one
    for the state. ``floors`` (kind, state, action, min_conf; null is any) are structural: the result is the upper bound of the
    chosen rule and of all floors that fit, in the lattice of actions by strictness and of confidences by size, so no layer
    can fall below a floor. Without any rule the action is the strictest before ``reject``. Tables are rules, a few rows each.
    """
    rank = lambda c: F.array_position(F.array(*map(F.lit, STRICTNESS)), c)
    found = rows
    specific, general = [], []
    for i, (name, rules) in enumerate(layers):
        rule = F.struct(F.col("action"), F.col("min_conf"), F.lit(name).alias("layer"))
        # of equal rules in one layer the stricter holds
        one = lambda df, *by: df.groupBy(*by).agg(F.max(F.struct(rank(F.col("action")).alias("r"), F.coalesce("min_conf", F.lit(0.0)).alias("m"), rule.alias("rule")))["rule"].alias("_rule"))
        own = one(rules.where("kind is not null"), "kind", "state").select(F.col("kind").alias(kind), F.col("state").alias(state), F.col("_rule").alias(f"_s{i}"))
        any_kind = one(rules.where("kind is null"), "state").select(F.col("state").alias(state), F.col("_rule").alias(f"_g{i}"))
        found = found.join(own, [kind, state], "left").join(any_kind, state, "left")
        specific.insert(0, F.struct(F.col(f"_s{i}.action"), F.col(f"_s{i}.min_conf"), F.concat(F.lit(f"{name}:"), F.col(kind), F.lit(":"), F.col(state)).alias("rule")))
        general.insert(0, F.struct(F.col(f"_g{i}.action"), F.col(f"_g{i}.min_conf"), F.concat(F.lit(f"{name}:any:"), F.col(state)).alias("rule")))
    chosen = F.coalesce(*[F.when(s["action"].isNotNull(), s) for s in [*specific, *general]])
    found = found.withColumn("_rule", chosen).select(*[F.col(c) for c in rows.columns], "_rule")
    # the least upper bound of all floors that fit, for each pair that occurs
    pairs = found.select(F.col(kind).alias("_k"), F.col(state).alias("_t")).distinct()
    fits = (F.col("kind").isNull() | (F.col("kind") == F.col("_k"))) & (F.col("state").isNull() | (F.col("state") == F.col("_t")))
    bound = pairs.join(F.broadcast(floors), fits).groupBy("_k", "_t").agg(F.max(rank(F.col("action"))).alias("_a"), F.max("min_conf").alias("_m"))
    found = found.join(bound, F.col(kind).eqNullSafe(F.col("_k")) & F.col(state).eqNullSafe(F.col("_t")), "left")
    own = F.coalesce(rank(F.col("_rule.action")), F.lit(STRICTNESS.index("reject")))
    final = F.greatest(own, F.col("_a"))
    confidence = F.greatest(F.col("_rule.min_conf"), F.col("_m"))
    tightened = (final > own) | (F.coalesce(confidence, F.lit(-1.0)) > F.coalesce("_rule.min_conf", F.lit(-1.0)))
    return found.select(*[F.col(c) for c in rows.columns], F.element_at(F.array(*map(F.lit, STRICTNESS)), final.cast("int")).alias("action"), confidence.alias("min_conf"), F.coalesce("_rule.rule", F.lit("none")).alias("rule"), tightened.alias("tightened"))
