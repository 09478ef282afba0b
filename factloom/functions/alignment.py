"""Where a text stands in a longer one: semi-global alignment in bit vectors, over the pairs of value and line that may be near.

A value is held against every stretch of a line at once: edits are counted for the best stretch, its place is returned. Candidates
come from unchanged segments, so no pair at the floor is missed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.sources.scratch import stored

#: Letters of a value that one machine word holds; pairs of value and line that are aligned side by side.
WORD, SIDE_BY_SIDE = 64, 2048
#: Starts of segments that are looked for in a line one by one.
FEW = 100


def _ends(values: list[str], lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edits between each value (1 to 64 letters) and a stretch of its line, and where the first such stretch ends.

    The columns of the edit table are kept as differences in bits (Myers 1999), one word a pair; all pairs take a step together.
    """
    n, size = len(values), np.array([len(v) for v in values])
    codes = np.unique(np.frombuffer("".join(values).encode("utf-32-le"), dtype="<u4"))
    code = lambda t: np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    masks = np.zeros((n, len(codes) + 1), dtype=np.uint64)
    for i, v in enumerate(values):
        np.bitwise_or.at(masks[i], np.searchsorted(codes, code(v)), np.uint64(1) << np.arange(len(v), dtype=np.uint64))
    longest = max(map(len, lines), default=0)
    text = np.full((longest, n), len(codes), dtype=np.int64)
    for i, t in enumerate(lines):
        c = code(t)
        at = np.minimum(np.searchsorted(codes, c), len(codes) - 1)
        text[: len(c), i] = np.where(codes[at] == c, at, len(codes))
    length, every, one = np.array([len(t) for t in lines]), np.arange(n), np.uint64(1)
    top = one << (size - 1).astype(np.uint64)
    plus, minus, score = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64), np.zeros(n, dtype=np.uint64), size.copy()
    best, end = size.copy(), np.zeros(n, dtype=np.int64)
    for j in range(longest):
        equal = masks[every, text[j]]
        down = equal | minus
        across = (((equal & plus) + plus) ^ plus) | equal
        grows, falls = minus | ~(across | plus), plus & across
        score += ((grows & top) != 0).astype(np.int64) - ((falls & top) != 0)
        grows, falls = grows << one, falls << one
        plus, minus = falls | ~(down | grows), grows & down
        better = (score < best) & (j < length)
        best[better], end[better] = score[better], j + 1
    return best, end


def _long_end(value: str, line: str) -> tuple[int, int]:
    """The same for one value of any length, in one long integer."""
    masks: dict[str, int] = {}
    for i, c in enumerate(value):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(value)) - 1, 1 << len(value) - 1
    plus, minus, score, best = full, 0, len(value), (len(value), 0)
    for j, c in enumerate(line):
        equal = masks.get(c, 0)
        down = equal | minus
        across = (((equal & plus) + plus) ^ plus) | equal
        grows, falls = minus | ~(across | plus) & full, plus & across
        score += bool(grows & top) - bool(falls & top)
        grows, falls = grows << 1 & full, falls << 1 & full
        plus, minus = (falls | ~(down | grows)) & full, grows & down & full
        best = min(best, (score, j + 1))
    return best


def align(values: list[str], lines: list[str]) -> list[tuple[int, int, int]]:
    """(edits, begin, end) of the stretch of each line that is nearest to its value: fewest edits, then the one that ends first, then the shortest.
    An empty value is nearest to nothing, at 0."""

    def ends(vs: list[str], ts: list[str]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = [(0, 0)] * len(vs)
        short = sorted((i for i, v in enumerate(vs) if 0 < len(v) <= WORD), key=lambda i: len(ts[i]))
        for k in range(0, len(short), SIDE_BY_SIDE):
            part = short[k : k + SIDE_BY_SIDE]
            for i, e, p in zip(part, *_ends([vs[i] for i in part], [ts[i] for i in part])):
                out[i] = (int(e), int(p))
        for i, v in enumerate(vs):
            if len(v) > WORD:
                out[i] = _long_end(v, ts[i])
        return out

    forward = ends(values, lines)
    # from the end back: the begin of the shortest stretch with as few edits
    back = ends([v[::-1] for v in values], [t[max(0, p - len(v) - e) : p][::-1] for v, t, (e, p) in zip(values, lines, forward)])
    return [(e, p - q, p) for (e, p), (_, q) in zip(forward, back)]


def aligned(value: Column, line: Column) -> Column:
    """``align`` of two columns as a struct (edits, begin, end); null where one is null."""

    def run(v: pd.Series, t: pd.Series) -> pd.DataFrame:
        known = v.notna() & t.notna()
        out = pd.DataFrame({c: pd.array([None] * len(v), dtype="Int32") for c in ("edits", "begin", "end")}, index=v.index)
        if known.any():
            out.loc[known, ["edits", "begin", "end"]] = pd.DataFrame(align(v[known].tolist(), t[known].tolist()), columns=["edits", "begin", "end"], index=v.index[known]).astype("Int32")
        return out

    return F.pandas_udf(run, "edits int, begin int, end int")(value, line)


def folded(c: Column) -> Column:
    """Lower case; everything but letters, digits and points is one blank."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9.]+", " "))


def near_lines(values: DataFrame, lines: DataFrame, within: str, key: str, value: str, line: str, text: str, floor: float) -> DataFrame:
    """(within, key, value, line, text, edits, begin, end) of the values and the lines of their document that hold a stretch at least ``floor`` alike.

    A value of ``m`` letters may have ``k = (1 - floor) * m`` edits, so one of ``k + 1`` segments of it stands in the line unchanged (pigeonhole).
    The first letters of a document's segments travel with its lines; those that a line holds find their values again, and a line that
    holds a whole segment is aligned.
    """
    edits = f"cast(floor({1 - floor} * length(value) + 1e-9) as int)"
    begin, end = f"cast(floor(i * length(value) / ({edits} + 1)) as int)", f"cast(floor((i + 1) * length(value) / ({edits} + 1)) as int)"
    size = f"least(3, cast(floor(length(value) / ({edits} + 1)) as int))"
    v = values.select(within, key, F.col(value).alias("value")).where("length(value) > 0").distinct()
    probes = v.select("*", F.explode(F.array_distinct(F.expr(f"transform(sequence(0, {edits}), i -> substring(value, {begin} + 1, least({size}, {end} - {begin})))"))).alias("_g"))
    of_page = probes.groupBy(within).agg(F.collect_set("_g").alias("_p"))
    whole = F.expr(f"exists(sequence(0, {edits}), i -> contains(text, substring(value, {begin} + 1, {end} - {begin})))")
    own = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text") - n + 1)), lambda i: F.substring("text", i, n))))
    page = lines.select(within, line, F.col(text).alias("text")).join(of_page, within)
    # a few letters are looked for one by one, many among all that a line holds; an outer list, as Spark would make it twice to leave out empty ones
    there = F.when(F.size("_p") <= FEW, F.filter("_p", lambda p: F.contains("text", p))).otherwise(F.array_intersect("_p", own))
    held = page.select(within, line, "text", F.explode_outer(there).alias("_g"))
    pairs = held.join(probes, [within, "_g"]).where(whole).select(within, key, "value", line, "text").distinct()
    found = pairs.withColumn("_a", aligned(F.col("value"), F.col("text")))
    return found.where(F.col("_a.edits") <= F.expr(edits)).select(within, key, "value", line, "text", "_a.edits", "_a.begin", "_a.end")


def literal_numbers(c: Column) -> Column:
    """Numbers as they are written, in order, with repeats."""
    return F.regexp_extract_all(c, F.lit("([0-9]+(?:[.][0-9]+)?)"), F.lit(1))


def grounded_notes(values: DataFrame, lines: DataFrame, within: str, key: str, value: str, line: str, text: str, kind: Column, floor: float = 0.8) -> DataFrame:
    """(within, key, status, reason, kind, line, stretch, similarity): what becomes of each value.

    A value that no line of its document holds to ``floor`` is made up and ``retracted``. One that stands there is ``checked`` if its
    ``kind`` (a column over ``value``, the folded text) is known and each of its numbers is literally in the stretch, as often; else it ``needs check``.
    Of several lines that hold it, one with its numbers comes first, then the fewest edits, then the first line. A stretch reaches to the
    ends of its words. Values without a letter or digit are left out.
    """
    v = stored(values.select(within, key, folded(F.col(value)).alias("value")).where("value != ''").distinct())
    # only lines of documents with a value are folded
    lines = lines.join(v.select(within).distinct(), within, "left_semi")
    found = near_lines(v, lines.select(within, line, folded(F.col(text)).alias("text")), within, key, "value", line, "text", floor)
    before, after = F.expr("substring(text, 1, begin)"), F.expr("substring(text, `end` + 1)")
    stretch = F.concat(F.regexp_extract(before, "([^ ]*)$", 1), F.expr("substring(text, begin + 1, `end` - begin)"), F.regexp_extract(after, "^([^ ]*)", 1))
    times = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    wanted, there = literal_numbers(F.col("value")), literal_numbers(F.col("stretch"))
    sure = F.forall(F.array_distinct(wanted), lambda x: times(there, x) >= times(wanted, x))
    found = found.withColumn("stretch", stretch).withColumn("_ok", sure)
    best = found.groupBy(within, key).agg(F.min(F.struct((~F.col("_ok")).alias("wrong"), "edits", line, "stretch")).alias("_b"))
    out = v.join(best, [within, key], "left")
    there, numbers = F.col("_b").isNotNull(), ~F.col("_b.wrong")
    reasons = F.concat_ws("; ", F.when(kind.isNull(), "kind not recognised"), F.when(~numbers, "number not on the page"))
    return out.select(
        within, key,
        F.when(~there, "retracted").when(kind.isNotNull() & numbers, "checked").otherwise("needs check").alias("status"),
        F.when(~there, "not on the page").when(reasons != "", reasons).alias("reason"),
        kind.alias("kind"), F.col(f"_b.{line}").alias(line), F.col("_b.stretch").alias("stretch"),
        F.when(there, F.round(1 - F.col("_b.edits") / F.length("value"), 4)).alias("similarity"),
    )


# fixed values: kinds of preparation; a text is of the first kind of whose groups it has a word each
PREPARATION = [
    ("timing", "after post", "meal meals food breakfast lunch dinner eating"),
    ("fasting", "fasting overnight empty npo"),
    ("medicine_hold", "stop hold avoid skip withhold", "medicine medicines tablet tablets insulin drug drugs aspirin metformin biotin"),
    ("sample_collection", "midstream collect urine first"),
    ("bring_documents", "bring carry"),
    ("timing", "morning afternoon evening"),
    ("diet", "diet alcohol salt"),
]


def kind_of(c: Column, rules: Sequence[tuple[str, ...]] = PREPARATION) -> Column:
    """The kind of a folded text by the words it holds, null if no rule fits."""
    words = F.split(c, " ")
    one = lambda group: F.arrays_overlap(words, F.array(*map(F.lit, group.split())))
    return F.coalesce(*[F.when(reduce(lambda x, y: x & y, map(one, groups)), F.lit(kind)) for kind, *groups in rules])
