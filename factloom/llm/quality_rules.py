"""Quality rules as a bitmask ledger (operator 3); DataFrame functions only.

Every rule is evaluated once per document. The ledger keeps the measurements and one long with a bit per failed rule;
policies are versioned masks over these bits, and ablations are bitwise aggregates of the ledger (first
summed per distinct mask), so neither reads a text again.

Words are runs of ``[^\\x20\\x09-\\x0D]``. A 5-word window counts as repeated if it is found twice or more in its
text; ``n_repeat_words`` counts the words inside such windows, the first included. Windows are compared by 64-bit
hashes. Defined results: null text has no words; an empty or null text fails the base rules; repeated rows, and rows
with equal or missing ids, are each judged; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import common as C

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5

#: Rules in bit order: name and failing condition over the measurements (all integers, no divisions).
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "5 * n_symbols > n_words"),
    ("repeated_lines", "n_lines > 3 and 10 * n_dup_lines > 3 * n_lines"),
    ("shouting", "n_words > 0 and 2 * n_capitals > word_chars"),
    ("short_words", "2 * word_chars < 4 * n_words"),
    ("long_words", "word_chars > 25 * n_words"),
    ("many_words", "n_words > 10000000"),
]
BASE = 0b11
#: Policies by version: the bits that reject.
POLICIES: dict[int, int] = {1: BASE, 2: 0b1111_1111}
CURRENT = 2


def _removed(chars: str) -> Column:
    """Code points of ``text`` that are in ``chars``."""
    return (F.length("text") - F.length(F.translate(F.col("text"), chars, ""))).cast("long")


def ledger(docs: DataFrame) -> DataFrame:
    """``doc_id``, the measurements, and ``failed``: bit k is set if rule k fails."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    space = "[ \\t\\n\\x0B\\f\\r]"
    # trimmed first: a split of a trimmed text that is not empty has no empty words
    rows = rows.withColumn("words", F.split(F.trim(F.col("text"), F.lit(SPACE)), f"{space}+"))
    rows = rows.withColumn("n_words", F.when(F.element_at("words", 1) == "", 0).otherwise(F.size("words")).cast("long"))
    windows = F.transform(
        F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int")),
        lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)]),
    )
    rows = rows.withColumn("windows", F.when(F.col("n_words") >= WINDOW, windows))
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, SPACE, "") != "")
    rows = rows.select(
        "doc_id",
        "n_words",
        (F.length("text") - F.length(F.translate(F.col("text"), SPACE, ""))).alias("spaces"),
        F.length("text").cast("long").alias("chars"),
        _removed(SYMBOLS).alias("n_symbols"),
        _removed(CAPITALS).alias("n_capitals"),
        F.when(F.contains("text", F.lit("\n")), lines).alias("lines"),
        # only texts with a repeated window go on: windows with their places, equal ones side by side
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))).alias("sorted"),
    )
    near = F.expr("filter(sorted, (x, k) -> get(sorted, k - 1).w <=> x.w or get(sorted, k + 1).w <=> x.w)")
    rows = rows.withColumn("places", F.sort_array(F.transform(near, lambda x: x["i"])))
    covered = F.expr(
        f"aggregate(places, named_struct('upto', 0, 'n', 0), (a, p) -> named_struct('upto', p + {WINDOW}, 'n', a.n + p + {WINDOW} - greatest(p, a.upto)), a -> a.n)"
    )
    rows = rows.select(
        "doc_id",
        "n_words",
        (F.col("chars") - F.col("spaces")).alias("word_chars"),
        "n_symbols",
        F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        "n_capitals",
        F.when(F.col("lines").isNull(), (F.col("n_words") > 0).cast("long")).otherwise(F.size("lines")).cast("long").alias("n_lines"),
    )
    failed = F.lit(0).cast("long")
    for k, (_, condition) in enumerate(RULES):
        failed = failed.bitwiseOR(F.when(F.expr(condition), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return rows.withColumn("failed", failed)


def apply_policy(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy."""
    mask = F.lit(POLICIES[version] | BASE).cast("long")
    return rows.withColumn("base_failed", F.col("failed").bitwiseAND(F.lit(BASE).cast("long")) != 0).withColumn("kept", F.col("failed").bitwiseAND(mask) == 0)


def ablations(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail nothing else, and that stay without it."""
    policy = POLICIES[version]
    masks = rows.groupBy("failed").agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(k).alias("bit"), F.lit(name).alias("rule")) for k, (name, _) in enumerate(RULES) if policy >> k & 1])).alias("r")
    bit = F.expr("shiftleft(1L, r.bit)")
    own = F.col("failed").bitwiseAND(F.lit(policy).cast("long"))
    rest = own.bitwiseAND(F.bitwise_not(bit))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).alias
    return masks.select("failed", "n", rules).groupBy(F.col("r.rule").alias("rule")).agg(
        total(own.bitwiseAND(bit) != 0)("n_failed"), total((own.bitwiseAND(bit) != 0) & (rest == 0))("n_only"), total(rest == 0)("n_kept_without")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(C.documents_of(spark, sf_dir)))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def ablation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part of operator 3: what each rule of the current policy does alone."""
    return ablations(ledger(C.documents_of(spark, sf_dir)))
