"""Person names as read and as known: parts, initials, and how well two names agree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.similarity import Marks, by_pairs, jaro_winkler_block, jaro_winkler_bound, jaro_winkler_ratios, jaro_winkler_rows, similarity_join, text_rows
from factloom.sources.scratch import stored

# fixed values: titles, degrees that end a name, words of organisations
TITLES = "dr doctor prof mr mrs ms"
DEGREES = "mbbs md ms dnb frcs mrcp dm mch dgo dch do bds mds"
ORGANISATIONS = "hospital clinic laboratory lab labs diagnostics centre center pharmacy limited ltd pvt trust foundation"
# fixed values: surnames at least so alike; weight of the surname; likeness of a given name that is missing, and of one that is an initial
SURNAME, SURNAME_WEIGHT, NO_GIVEN, INITIAL = 0.85, 0.6, 0.8, 0.9
# fixed values: confidence of a registration number, of one whose name disagrees (below NAME_AGREES), of a name without its specialty
BY_NUMBER, BY_NUMBER_ONLY, NAME_AGREES, NO_SPECIALTY, MARGIN, AMBIGUOUS = 0.99, 0.9, 0.75, 0.97, 0.03, 0.92


def _any(words: str) -> str:
    return "(?:" + "|".join(words.split()) + ")"


def plain_name(c: Column) -> Column:
    """Lower-case letters of a name: without what stands in brackets, degrees and what follows them, titles (also glued ones: ``Dr.Rao``), age and sex."""
    low = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[(][^)]*[)]", " ")
    low = F.regexp_replace(low, f"[ ,]+{_any(DEGREES)}\\b.*$", "")
    low = F.regexp_replace(low, "[ ,/]+[0-9]{1,3} ?(?:y|yrs?|years?)?[ /,]*(?:m|f|male|female)?\\b.*$", "")
    low = F.regexp_replace(low, f"\\b{_any(TITLES)}(?:[.]|\\b)", " ")
    return F.trim(F.regexp_replace(low, "[^a-z]+", " "))


def parsed_name(c: Column) -> Column:
    """Struct (given, family, initials, refused) of a written name: ``refused`` says why it is none (organisation, sentence, empty)."""
    plain = plain_name(c)
    words = F.filter(F.split(plain, " "), lambda w: w != "")
    n = F.size(words)
    refused = F.when(n == 0, "empty").when(F.arrays_overlap(words, F.array(*map(F.lit, ORGANISATIONS.split()))), "organisation").when(n > 6, "sentence")
    given = F.when(n > 1, F.array_join(F.slice(words, 1, n - 1), " "))
    return F.struct(
        F.when(refused.isNull(), F.initcap(given)).alias("given"),
        F.when(refused.isNull(), F.initcap(F.element_at(words, -1))).alias("family"),
        F.when(refused.isNull(), F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, 1, 1))), "")).alias("initials"),
        refused.alias("refused"),
    )


def name_ratios(read: list[str], known: list[str]) -> np.ndarray:
    """How well read names agree with known ones (plain names), by parts: the surnames decide whether parts are compared at all; a given name that
    is only an initial agrees with what begins with it, but never fully."""
    a, b = [r.split() for r in read], [k.split() for k in known]
    full = jaro_winkler_ratios(read, known)
    last = jaro_winkler_ratios([x[-1] if x else "" for x in a], [y[-1] if y else "" for y in b])
    first_a, first_b = ([x[0] if len(x) > 1 else "" for x in names] for names in (a, b))
    given = jaro_winkler_ratios(first_a, first_b)
    none = np.array([not u or not v for u, v in zip(first_a, first_b)], dtype=bool)
    initial = np.array([len(u) == 1 or len(v) == 1 for u, v in zip(first_a, first_b)], dtype=bool)
    fits = np.array([u[:1] == v[:1] for u, v in zip(first_a, first_b)], dtype=bool)
    given = np.where(none, NO_GIVEN, np.where(initial, np.where(fits, INITIAL, np.minimum(given, INITIAL)), given))
    parts = np.maximum(full, SURNAME_WEIGHT * last + (1 - SURNAME_WEIGHT) * given)
    empty = np.array([not x or not y for x, y in zip(a, b)], dtype=bool)
    return np.where(empty, 0.0, np.round(np.where(last >= SURNAME, parts, 0.8 * full), 4))


def name_score(read: Column | str, known: Column | str) -> Column:
    """``name_ratios`` of two columns of plain names."""
    return F.pandas_udf(lambda x, y: by_pairs(name_ratios, x, y), "double")(read, known)


#: Names of one block, and pairs of names that are looked at together.
BLOCK, PAIRS = 8192, 1 << 17


class _Parts:
    """Plain names in the order of their surnames, with distinct surnames and first words."""

    def __init__(self, names: list[str], pad: int):
        words = sorted(((w[-1], w[0] if len(w) > 1 else "", n) for n in names if (w := n.split())), key=lambda p: p[0])
        self.names = [n for _, _, n in words]
        self.last, self.n = np.unique(np.array([w for w, _, _ in words], dtype=object), return_counts=True) if words else (np.zeros(0, dtype=object), np.zeros(0, dtype=np.int64))
        self.begin = np.cumsum(self.n) - self.n
        first, self.first = np.unique(np.array([w for _, w, _ in words], dtype=object), return_inverse=True) if words else ([], np.zeros(0, dtype=np.int64))
        self.given, self.given_length = list(first), np.array([len(w) for w in first], dtype=np.int64)
        self.letter = np.array([ord(w[0]) if w else 0 for w in first], dtype=np.int64)
        self.full_marks, self.given_marks = Marks(self.names), Marks(self.given)
        self.full_rows, self.given_rows, self.last_rows = (text_rows(v, pad) for v in (self.names, self.given, list(self.last)))


def _ratios(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray, at_once: int = 1 << 13) -> np.ndarray:
    """Likeness of texts ``i`` of ``a`` and ``j`` of ``b`` (rows of letters and lengths), a bounded number of them at once, those of like length together."""
    out, (x, lx), (y, ly) = np.zeros(len(i)), a, b
    order = np.argsort(np.maximum(lx[i], ly[j]), kind="stable")
    for k in range(0, len(i), at_once):
        part = order[k : k + at_once]
        u, v = i[part], j[part]
        out[part] = jaro_winkler_rows(x[u, : max(1, lx[u].max())], lx[u], y[v, : max(1, ly[v].max())], ly[v])
    return out


def name_pairs(read: list[str], known: list[str], floor: float) -> Iterator[tuple[list[str], list[str], np.ndarray]]:
    """The pairs of two lists of distinct plain names whose ``name_ratios`` reach ``floor`` (above 0.8), with these, in pieces.

    Surnames must be alike, so distinct surnames are compared first. Of names with alike surnames, those go on whose likeness as a whole or by parts may
    reach the floor by their common letters; given names are compared once a pair of words.
    """
    x, y, low = _Parts(read, -1), _Parts(known, -2), floor - 1e-4  # scores are rounded
    p, q = jaro_winkler_block(list(x.last), list(y.last), SURNAME)
    alike = _ratios(x.last_rows, y.last_rows, p, q)
    p, q, alike = (v[alike >= SURNAME] for v in (p, q, alike))
    size = x.n[p] * y.n[q]
    ends = np.cumsum(size)
    for k in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
        end = min(k + PAIRS, int(ends[-1]))
        some = np.arange(np.searchsorted(ends, k, side="right"), np.searchsorted(ends, end - 1, side="right") + 1)
        r = np.repeat(some, np.minimum(ends[some], end) - np.maximum(ends[some] - size[some], k))
        at = np.arange(k, end) - (ends - size)[r]
        i, j, last = x.begin[p[r]] + at // y.n[q[r]], y.begin[q[r]] + at % y.n[q[r]], alike[r]
        u, v = x.first[i], y.first[j]
        lu, lv = x.given_length[u], y.given_length[v]
        initial, none = (lu == 1) | (lv == 1), (lu == 0) | (lv == 0)
        known_given = np.where(none, NO_GIVEN, np.where(initial & (x.letter[u] == y.letter[v]), INITIAL, np.nan))
        given = np.where(np.isnan(known_given), np.minimum(jaro_winkler_bound(x.given_marks, y.given_marks, u, v), np.where(initial, INITIAL, 1.0)), known_given)
        by_parts = SURNAME_WEIGHT * last + (1 - SURNAME_WEIGHT) * given >= low
        whole = jaro_winkler_bound(x.full_marks, y.full_marks, i, j)
        keep = np.flatnonzero(by_parts | (whole >= low))
        i, j, u, v, last, whole, initial, given = (w[keep] for w in (i, j, u, v, last, whole, initial, known_given))
        open_ = np.flatnonzero(np.isnan(given))
        words, back = np.unique(u[open_] * len(y.given) + v[open_], return_inverse=True)
        said = _ratios(x.given_rows, y.given_rows, words // max(1, len(y.given)), words % max(1, len(y.given)))[back]
        given[open_] = np.where(initial[open_], np.minimum(said, INITIAL), said)
        score = SURNAME_WEIGHT * last + (1 - SURNAME_WEIGHT) * given
        # the whole names count where they may say more than the parts
        more = np.flatnonzero((whole >= low) & (whole >= score))
        score[more] = np.maximum(_ratios(x.full_rows, y.full_rows, i[more], j[more]), score[more])
        score = np.round(score, 4)
        found = score >= floor
        yield [x.names[n] for n in i[found]], [y.names[n] for n in j[found]], score[found]


def name_join(left: DataFrame, right: DataFrame, a: str, b: str, floor: float) -> DataFrame:
    """(a, b, score) of all distinct plain names that score ``floor`` (above 0.8) or more.

    Names whose surnames are not alike score 0.8 at most, so all others meet by their surnames: blocks of names are held against each other, and only pairs
    at the floor become rows.
    """
    if floor <= 0.8:
        raise ValueError("a floor of 0.8 or less is reached without a common surname")

    def blocks(df: DataFrame, c: str, t: str) -> tuple[DataFrame, int]:
        names = stored(df.select(F.col(c).alias("name")).where("name != ''").distinct()).withColumn("last", F.element_at(F.split(F.trim("name"), " "), -1))
        n = max(1, names.count() // BLOCK)
        # names of a surname stand in one block, or in several of their own if they are many
        names = names.withColumn("_n", F.count("*").over(Window.partitionBy("last")))
        piece = F.when(F.col("_n") > BLOCK, F.struct(F.col("last"), F.pmod(F.xxhash64("name"), F.ceil(F.col("_n") / BLOCK)).alias("piece")))
        block = F.when(piece.isNull(), F.pmod(F.xxhash64("last"), F.lit(n)))
        return names.groupBy(block.alias("_k"), piece.alias("_p")).agg(F.collect_list("name").alias(t)).select(t), n  # names of one block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for u, v in zip(batch.column("_a"), batch.column("_b")):
                for read, known, score in name_pairs(u.as_py(), v.as_py(), floor):
                    yield pa.RecordBatch.from_arrays([pa.array(read, pa.string()), pa.array(known, pa.string()), pa.array(score)], names=["a", "b", "score"])

    (x, n), (y, m) = blocks(left, a, "_a"), blocks(right, b, "_b")
    # blocks differ in work: few of them a task
    met = x.crossJoin(y).repartition(max(left.sparkSession.sparkContext.defaultParallelism * 4, n * m // 4))
    return met.mapInArrow(run, "a string, b string, score double")


def _best_masters(asked: DataFrame, alike: DataFrame, masters: DataFrame, mine: Column, n: int) -> DataFrame:
    """(name, field, best) with the best ``n`` masters (master, score) of each distinct (name, field), equal scores (``mine``) by master.

    A name that scores less than ``n`` masters do even where their fields differ is left out; for that, a name counts as one master if it has one that is
    not known by other names. Masters of one name and field score the same, so the first ``n`` of them will do. Of a written name's masters, the best ``n`` in
    each field serve those who ask for that field. Others see the best by their lower score: ``n`` at most of the field asked for and twice each of less
    than ``n`` others may stand before one that counts, so ``3 * n`` are enough.
    """
    first = lambda by, *order: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    less = lambda c: F.round(F.col(c) * NO_SPECIALTY, 4)
    one = masters.groupBy("master").agg((F.min("m_name") == F.max("m_name")).alias("_one"))
    odd = masters.join(one, "master", "left").groupBy("m_name").agg(F.max(F.coalesce("_one", F.lit(False))).alias("_one")).where("not _one").select("m_name", F.lit(True).alias("_odd"))
    near = alike.join(odd, "m_name", "left").withColumn("_k", first(["name"], F.asc_nulls_first("_odd"), F.desc("score")))
    near = near.withColumn("_s", F.max(F.when((F.col("_k") == n) & F.col("_odd").isNull(), F.col("score"))).over(Window.partitionBy("name")))
    near = near.where(F.col("_s").isNull() | (F.col("score") >= less("_s"))).select("name", "m_name", "score")
    some = masters.distinct().withColumn("_k", first(["m_name", "m_field"], "master")).where(F.col("_k") <= n).drop("_k")
    # all that follows is done name by name, where the rows have moved to
    rows = near.join(some, "m_name").select("name", "m_field", "master", "score").repartition("name")
    rows = rows.groupBy("name", "m_field", "master").agg(F.max("score").alias("score")).withColumn("_less", less("score"))
    rows = rows.withColumns({"_k": first(["name", "m_field"], F.desc("score"), "master"), "_u": first(["name", "m_field"], F.desc("_less"), "master")})
    rows = rows.withColumn("_two", first(["name", "master"], F.col("_u") > n, F.desc("score"), "m_field")).withColumn("_two", (F.col("_u") <= n) & (F.col("_two") <= 2))
    rows = rows.withColumn("_any", first(["name"], ~F.col("_two"), F.desc("_less"), "master", "m_field")).withColumn("_any", F.col("_two") & (F.col("_any") <= 3 * n))
    found = asked.join(rows.where(F.col("_any") | (F.col("_k") <= n)), "name").where(F.col("_any") | ((F.col("_k") <= n) & (F.col("field") == F.col("m_field"))))
    found = found.groupBy("name", "field", "master").agg(F.max(mine).alias("score"))
    found = found.withColumn("_k", first(["name", "field"], F.desc("score"), "master")).where(F.col("_k") <= n)
    return found.groupBy("name", "field").agg(F.collect_list(F.struct("master", "score")).alias("best"))  # n at most


def practitioner_matches(written: DataFrame, masters: DataFrame, floor: float = 0.9, top: int = 5) -> DataFrame:
    """(key, linked, method, confidence, n, why) of written practitioners (key, name, reg_no, field) against masters (master, name, reg_no, field).

    An equal registration number counts ``BY_NUMBER``, or ``BY_NUMBER_ONLY`` if the names disagree. Else the name's score counts, less a
    little if the field differs. A link needs ``floor``; by name alone also a gap of ``MARGIN`` to the runner-up, and an initial that fits
    no second master of an alike surname. ``n`` counts the candidates kept, ``top`` at most.
    """
    w = stored(written.select("key", plain_name(F.col("name")).alias("name"), "reg_no", "field"))
    m = stored(masters.select("master", plain_name(F.col("name")).alias("m_name"), F.col("reg_no").alias("m_reg"), F.col("field").alias("m_field")))
    keyed = w.where("key is not null")
    number = lambda c: F.upper(F.regexp_replace(c, "[^0-9A-Za-z]", ""))
    numbered = keyed.withColumn("_r", number("reg_no")).join(m.withColumn("_r", number("m_reg")), "_r").where("_r != ''")
    agrees = (F.col("name") == "") | (name_score("name", "m_name") >= NAME_AGREES)
    numbered = numbered.select("key", "master", F.when(agrees, BY_NUMBER).otherwise(BY_NUMBER_ONLY).alias("score"))
    # the runner-up counts as far as it can spoil the gap
    low = max(0.81, floor - MARGIN)
    alike = stored(name_join(keyed, m, "name", "m_name", low).select(F.col("a").alias("name"), F.col("b").alias("m_name"), "score"))
    fits = F.col("field").isNotNull() & (F.col("field") == F.col("m_field"))
    mine = F.round(F.col("score") * F.when(fits, 1.0).otherwise(NO_SPECIALTY), 4)
    # a key's list is as long as its masters by number may leave gaps in it; keys with more of those see all masters of their names
    gaps = top
    numbered = numbered.groupBy("key", "master").agg(F.max("score").alias("score")).withColumn("by_number", F.lit(True))
    many = numbered.groupBy("key").agg(F.count("*").alias("_c")).where(F.col("_c") > gaps).select("key")
    named = keyed.join(many, "key", "left_semi").join(alike, "name").join(m, "m_name").select("key", "master", mine.alias("score"))
    listed = _best_masters(keyed.select("name", "field").distinct(), alike, m.select("m_name", "m_field", "master"), mine, top + gaps)
    same = F.col("w.name").eqNullSafe(F.col("l.name")) & F.col("w.field").eqNullSafe(F.col("l.field"))
    named = named.unionByName(keyed.alias("w").join(listed.alias("l"), same).select("key", F.inline("best"))).withColumn("by_number", F.lit(False))
    found = numbered.unionByName(named).repartition("key").groupBy("key", "master").agg(F.max(F.struct("by_number", "score")).alias("b")).select("key", "master", F.round("b.score", 4).alias("score"), "b.by_number")
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.desc("by_number"), "master")
    ranked = found.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= top)
    best = ranked.groupBy("key").agg(F.max(F.when(F.col("rn") == 1, F.struct("score", "master", "by_number"))).alias("b"), F.max(F.when(F.col("rn") == 2, F.col("score"))).alias("second"), F.count("*").alias("n"))
    # masters of an alike surname whose name begins with a written initial: whether there are two shows in the least and the greatest
    last = lambda c: F.element_at(F.split(c, " "), -1)
    short = w.where(F.col("name").rlike("^[a-z] ")).select(F.substring("name", 1, 1).alias("i"), last("name").alias("s")).distinct()
    known = m.where("contains(m_name, ' ')").select("master", F.substring("m_name", 1, 1).alias("i"), last("m_name").alias("b"))
    known = known.groupBy("i", "b").agg(F.min("master").alias("_lo"), F.max("master").alias("_hi"))
    same = similarity_join(short, known, "s", "b", AMBIGUOUS, "jaro_winkler").select(F.col("a").alias("s"), "b")
    two = short.join(same, "s").join(known, ["i", "b"]).groupBy("i", "s").agg((F.min("_lo") < F.max("_hi")).alias("ambiguous")).where("ambiguous")
    out = w.withColumns({"i": F.when(F.col("name").rlike("^[a-z] "), F.substring("name", 1, 1)), "s": last("name")}).join(two, ["i", "s"], "left").join(best, "key", "left")
    score, sure = F.col("b.score"), F.coalesce("b.by_number", F.lit(False))
    why = F.when(score.isNull() | (score < floor), "too low").when(~sure & (score - F.col("second") < MARGIN - 1e-9), "near tie").when(~sure & F.col("ambiguous"), "ambiguous initial")
    method = F.when(score.isNull(), "unknown").when(sure, "registration_no").otherwise("printed_name")
    return out.select("key", F.when(why.isNull(), F.col("b.master")).alias("linked"), method.alias("method"), score.alias("confidence"), F.coalesce("n", F.lit(0)).alias("n"), why.alias("why"))
