"""Binding texts to code lists and people to people: cascades, ambiguity, overlap joins, clusters."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from factloom.functions.reading import SENT
from factloom.functions.similarity import lev_ratio, whole_join
from factloom.sources.scratch import stored

# fixed values: scores of the levels, floor of the fuzzy level, margin of a tie
EXACT, NORMALISED, FUZZY_FLOOR, FUZZY_WEIGHT, MARGIN = 1.0, 0.97, 0.82, 0.95, 0.03


def alias_key(c: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def alias_cascade(readings: DataFrame, aliases: DataFrame, floor: float = FUZZY_FLOOR, limit: int = 5) -> DataFrame:
    """(reading, concept, level, score, rank): exact, else normalised, else fuzzy candidates of distinct readings.

    The fuzzy level sees only readings without an exact or normalised hit, and only aliases with the same digits; the best
    alias counts per concept. All keys at the floor are found, whichever letter is wrong.
    """
    r = readings.select("reading").where("reading is not null").distinct().withColumn("key", alias_key(F.col("reading")))
    a = aliases.select("alias", "concept").where("alias is not null").distinct().withColumn("akey", alias_key(F.col("alias")))
    exact = r.join(a, F.col("reading") == F.col("alias")).select("reading", "concept", F.lit(1).alias("level"), F.lit(EXACT).alias("score"))
    norm = r.join(a, (F.col("key") == F.col("akey")) & (F.col("reading") != F.col("alias"))).select("reading", "concept", F.lit(2).alias("level"), F.lit(NORMALISED).alias("score"))
    sure = exact.unionByName(norm)
    rest = r.join(sure.select("reading").distinct(), "reading", "left_anti")
    alike = whole_join(rest, a, "key", "akey", floor).select(F.col("a").alias("key"), F.col("b").alias("akey"), "score")
    digits = lambda c: F.regexp_replace(c, "[^0-9]+", "")
    near = rest.join(alike, "key").join(a, "akey").where(digits(F.col("key")) == digits(F.col("akey")))
    near = near.select("reading", "concept", F.lit(3).alias("level"), (F.col("score") * FUZZY_WEIGHT).alias("score"))
    best = sure.unionByName(near).groupBy("reading", "concept").agg(F.max("score").alias("score"), F.min("level").alias("level"))
    w = Window.partitionBy("reading").orderBy(F.desc("score"), "concept")
    return best.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= limit)


def mark_collisions(candidates: DataFrame, key: str, margin: float = MARGIN) -> DataFrame:
    """``collision`` where two candidates are within ``margin`` of the top: none is selected then."""
    top = candidates.groupBy(key).agg(F.max("score").alias("_top"))
    near = candidates.join(top, key)
    n = near.groupBy(key).agg(F.count_if(F.col("score") >= F.col("_top") - margin).alias("n_near"))
    return candidates.join(n, key).withColumn("collision", F.col("n_near") > 1).withColumn("selected", (F.col("rank") == 1) & ~F.col("collision")).drop("n_near")


def token_overlap_join(left: DataFrame, right: DataFrame, lkey: str, ltokens: str, rkey: str, rtokens: str, within: Sequence[str] = (), floor: float = 0.6, k: int | None = 4) -> DataFrame:
    """Rows of ``right`` that hold at least ``floor`` of a left row's distinct tokens; the ``k`` best, or all.

    A row that holds that many of ``n`` tokens holds one of any ``n - ceil(floor * n) + 1`` of them, so only a left row's
    rarest tokens look for partners (within the given columns): a word that every document holds pairs nothing. Candidates
    are then checked by their whole token sets. Left rows of up to ``SENT`` tokens in all go to all tasks instead, and no token of
    ``right`` moves.
    """
    a = left.select(lkey, *within, F.array_distinct(ltokens).alias("_t")).withColumn("_n", F.size("_t")).where("_n > 0")
    b = right.select(rkey, *within, F.array_distinct(rtokens).alias("_u"))
    kind, other = a.schema["_t"].dataType.elementType, b.schema["_u"].dataType.elementType
    if not within and kind == other and isinstance(kind, (Y.StringType, Y.IntegralType)) and a.select(F.explode("_t")).limit(SENT + 1).count() <= SENT:
        return _best_overlaps(_overlaps(a, b, lkey, rkey, floor), lkey, rkey, k)
    each, words = a.select(lkey, *within, "_n", F.explode("_t").alias("_w")), b.select(rkey, *within, F.explode("_u").alias("_w"))
    held = words.join(each.select(*within, "_w").distinct(), [*within, "_w"], "left_semi")
    often = held.groupBy(*within, "_w").agg(F.count("*").alias("_f"))
    rare = Window.partitionBy(lkey, *within).orderBy(F.coalesce("_f", F.lit(0)), "_w")
    probe = each.join(often, [*within, "_w"], "left").withColumn("_r", F.row_number().over(rare)).where(F.col("_r") <= F.col("_n") - F.ceil(floor * F.col("_n") - 1e-9) + 1)
    pairs = probe.where("_f is not null").select(lkey, *within, "_w").join(held, [*within, "_w"]).select(lkey, *within, rkey).distinct()
    hit = pairs.join(a, [lkey, *within]).join(b, [rkey, *within]).withColumn("shared", F.size(F.array_intersect("_t", "_u")).cast("long"))
    hit = hit.where(F.col("shared") >= floor * F.col("_n") - 1e-9)
    return _best_overlaps(hit.select(lkey, *within, rkey, "shared", F.col("_n").alias("n_left"), F.size("_u").alias("n_right")), lkey, rkey, k)


def _best_overlaps(hit: DataFrame, lkey: str, rkey: str, k: int | None) -> DataFrame:
    if k is None:
        return hit
    hit = hit.select(lkey, rkey, "shared", F.round(F.col("shared") / F.col("n_left"), 4).alias("share"))
    w = Window.partitionBy(lkey).orderBy(F.desc("share"), rkey)
    return hit.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def _overlaps(a: DataFrame, b: DataFrame, lkey: str, rkey: str, floor: float) -> DataFrame:
    """The pairs of few left rows (lkey, _t, _n) with ``b`` (rkey, _u): each task counts what its rows share with every left row."""
    few = a.select(lkey, "_n", "_t").where(F.col(lkey).isNotNull()).toArrow().combine_chunks()
    keys, sizes, sets = (few.column(i).combine_chunks() for i in range(3))
    tokens = pc.list_flatten(sets)
    known = tokens.unique()
    # the left rows of each token, one after another
    order = pc.sort_indices(at := pc.index_in(tokens, value_set=known))
    owners, starts = pc.list_parent_indices(sets).take(order).to_numpy(), np.searchsorted(at.take(order).to_numpy(), np.arange(len(known) + 1))
    least = floor * sizes.to_numpy() - 1e-9
    step, n = max(1, 1_000_000 // max(1, len(tokens))), len(keys)

    def count(batches):
        for batch in batches:
            for i in range(0, len(batch), step):
                right, said = (batch.column(c).slice(i, step) for c in range(2))
                place = pc.index_in(pc.list_flatten(said), value_set=known)
                found, row = place.drop_null().to_numpy(), pc.list_parent_indices(said).filter(place.is_valid()).to_numpy()
                times = starts[found + 1] - starts[found]
                owner = owners[np.arange(times.sum()) - np.repeat(times.cumsum() - times - starts[found], times)]
                shared = np.bincount(np.repeat(row, times) * n + owner, minlength=len(right) * n).reshape(len(right), n)
                r, o = np.nonzero((shared > 0) & (shared >= least))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(o)), right.take(pa.array(r)), pa.array(shared[r, o], pa.int64()), sizes.take(pa.array(o)), pc.list_value_length(said).take(pa.array(r)).cast(pa.int32())], ["_l", "_r", "shared", "n_left", "n_right"])

    kinds = Y.StructType([Y.StructField("_l", a.schema[lkey].dataType), Y.StructField("_r", b.schema[rkey].dataType), Y.StructField("shared", Y.LongType()), Y.StructField("n_left", Y.IntegerType()), Y.StructField("n_right", Y.IntegerType())])
    return b.select(rkey, "_u").where(F.col(rkey).isNotNull()).mapInArrow(count, kinds).select(F.col("_l").alias(lkey), F.col("_r").alias(rkey), "shared", "n_left", "n_right")


def consensus(df: DataFrame, key: str, value: str) -> DataFrame:
    """Medoid of each key: the distinct value closest to the key's others (ties: more frequent, then smaller)."""
    v = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    a = v.select(key, F.col(value).alias("a"), F.col("n").alias("na"))
    b = v.select(key, F.col(value).alias("b"), F.col("n").alias("nb"))
    near = a.join(b, key).groupBy(key, "a", "na").agg(F.round(F.sum(F.col("nb") * lev_ratio(F.col("a"), F.col("b"))), 6).alias("s"))
    w = Window.partitionBy(key).orderBy(F.desc("s"), F.desc("na"), "a")
    return near.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(key, F.col("a").alias(value), F.col("na").alias("votes"))


def votes(df: DataFrame, key: str, value: str, least: int = 2) -> DataFrame:
    """A value that at least ``least`` readings of its key agree on; the most frequent one."""
    n = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    w = Window.partitionBy(key).orderBy(F.desc("n"), value)
    return n.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def box_overlap_join(a: DataFrame, b: DataFrame, page: str, bin_size: int = 100, share: float = 0.5, same: bool = False) -> DataFrame:
    """(page, a_id, n, first_id): each box (id, page, x0, y0, x1, y1) of ``a`` that boxes of ``b`` cover to ``share``, how many do, and
    the smallest of them. Boxes meet in cells of a grid, each pair in the cell of its common corner only; ``same`` leaves
    out a box beside itself."""
    cells = [F.explode(F.sequence(F.floor(F.col(f"{c}0") / bin_size), F.floor(F.col(f"{c}1") / bin_size))).alias(f"_{c}") for c in ("x", "y")]
    corners = ("x0", "y0", "x1", "y1")

    def spread(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(page, F.col("id").alias(f"{name}_id"), *[F.col(c).alias(f"{name}_{c}") for c in corners], *[F.col(c) for c in corners])
        return rows.select("*", cells[0]).select("*", cells[1]).drop(*corners)

    left, top = F.greatest("a_x0", "b_x0"), F.greatest("a_y0", "b_y0")
    wide, high = F.greatest(F.lit(0), F.least("a_x1", "b_x1") - left), F.greatest(F.lit(0), F.least("a_y1", "b_y1") - top)
    area = (F.col("a_x1") - F.col("a_x0")) * (F.col("a_y1") - F.col("a_y0"))
    once = (F.floor(left / bin_size) == F.col("_x")) & (F.floor(top / bin_size) == F.col("_y"))
    met = spread(a, "a").join(spread(b, "b"), [page, "_x", "_y"]).where(once & (area > 0) & (wide * high >= share * area))
    if same:
        met = met.where("a_id != b_id")
    return met.groupBy(page, "a_id").agg(F.count("*").alias("n"), F.min("b_id").alias("first_id"))


def resolve_entities(candidates: DataFrame, known: DataFrame, floor: float = 0.9, penalty: float = 0.3) -> DataFrame:
    """(key, matched, method, score, new_id) of candidates (key, id, name, year) against known persons (person, id, name, year).

    An equal ``id`` decides; else the most alike name does, less ``penalty`` where the years differ by more than one, if that
    reaches ``floor`` (ties: the smaller person). The rest get a new id that follows from name and year, so that a repeated run and
    two readings of one new person agree.
    """
    person = known.where("id is not null").groupBy("id").agg(F.min("person").alias("_by_id"))
    named = candidates.join(person, "id", "left")
    rest = named.where("_by_id is null and name is not null")
    alike = whole_join(rest, known, "name", "name", floor)
    # people of one name and year are as alike to anyone, so each name and year meets once, with its smallest person
    k = known.groupBy(F.col("name").alias("b"), F.col("year").alias("_year")).agg(F.min("person").alias("person"))
    far = F.coalesce(F.abs(F.col("year") - F.col("_year")) > 1, F.lit(False))
    asked = rest.select(F.col("name").alias("a"), "year").distinct()
    scored = asked.join(alike.hint("merge"), "a").join(k.hint("merge"), "b").withColumn("s", F.col("score") - F.when(far, penalty).otherwise(0.0)).where(F.col("s") >= floor)
    best = scored.groupBy(F.col("a").alias("_a"), F.col("year").alias("_y")).agg(F.max(F.struct("s", (-F.col("person")).alias("p"))).alias("_b"))
    out = named.join(best.hint("merge"), (F.col("name") == F.col("_a")) & F.col("year").eqNullSafe(F.col("_y")), "left")
    matched = F.coalesce("_by_id", -F.col("_b.p"))
    fresh = F.concat(F.lit("N"), F.substring(F.sha2(F.concat_ws("|", F.coalesce("name", F.lit("")), F.coalesce(F.col("year").cast("string"), F.lit("-"))), 256), 1, 12))
    return out.select("key", matched.alias("matched"), F.when(F.col("_by_id").isNotNull(), "id").when(F.col("_b").isNotNull(), "name").otherwise("new").alias("method"),
                      F.round(F.when(F.col("_by_id").isNotNull(), 1.0).otherwise(F.col("_b.s")), 4).alias("score"), F.when(matched.isNull(), fresh).alias("new_id"))


def practitioner_links(written: DataFrame, masters: DataFrame, floor: float = 0.9, margin: float = MARGIN, top: int = 5) -> DataFrame:
    """(key, linked, score, n) of written practitioners (key, name, reg_no, field) against masters (master, name, reg_no, field).

    A registration number scores 0.99, or 0.9 if the names are not alike; else the likeness of the name times 1.0 if the field agrees
    and 0.97 if not. No link below ``floor``, nor within ``margin`` of another master; ``n`` counts the candidates, ``top`` at most.
    """
    m = masters.select("master", F.col("name").alias("m_name"), F.col("reg_no").alias("m_reg"), F.col("field").alias("m_field"))
    by_number = written.where("reg_no is not null").join(m, F.col("reg_no") == F.col("m_reg"))
    numbered = by_number.select("key", "master", F.when(lev_ratio(F.col("name"), F.col("m_name")) >= 0.8, 0.99).otherwise(0.9).alias("score"))
    alike = whole_join(written, m, "name", "m_name", floor).select(F.col("a").alias("name"), F.col("b").alias("m_name"), F.col("score").alias("_s"))
    named = written.join(alike, "name").join(m, "m_name").select("key", "master", (F.col("_s") * F.when(F.col("field") == F.col("m_field"), 1.0).otherwise(0.97)).alias("score"))
    found = numbered.unionByName(named).groupBy("key", "master").agg(F.max("score").alias("score"))
    w = Window.partitionBy("key").orderBy(F.desc("score"), "master")
    ranked = found.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top)
    best = ranked.groupBy("key").agg(F.max(F.when(F.col("rn") == 1, F.struct("score", "master"))).alias("b"), F.max(F.when(F.col("rn") == 2, F.col("score"))).alias("second"), F.count("*").alias("n"))
    clear = (F.col("b.score") >= floor) & (F.col("second").isNull() | (F.col("b.score") - F.col("second") >= margin - 1e-9))
    out = written.select("key").join(best, "key", "left")
    return out.select("key", F.when(clear, F.col("b.master")).alias("linked"), F.round("b.score", 4).alias("score"), F.coalesce("n", F.lit(0)).alias("n"))


def bind_codes(df: DataFrame, column: str, codes: DataFrame, licensed: Sequence[str]) -> DataFrame:
    """Distinct spellings to codes (key, code, system) by exact then normalised key; unlicensed systems keep only the text."""
    spelt = df.select(F.col(column).alias("_s")).where("_s is not null").distinct()
    exact = codes.select(F.col("key").alias("_s"), F.col("code").alias("c1"), F.col("system").alias("s1"))
    norm = codes.groupBy(alias_key(F.col("key")).alias("_k")).agg(F.min(F.struct("code", "system")).alias("_b"), F.countDistinct("code").alias("_n"))
    bound = spelt.join(exact, "_s", "left").withColumn("_k", alias_key(F.col("_s"))).join(norm, "_k", "left")
    one = F.col("_n") == 1
    code = F.coalesce("c1", F.when(one, F.col("_b.code")))
    system = F.coalesce("s1", F.when(one, F.col("_b.system")))
    ok = system.isin(list(licensed))
    status = F.when(code.isNull(), F.when(F.col("_n") > 1, "candidate").otherwise("unbound")).when(ok, "bound").otherwise("local_only")
    result = bound.select(F.col("_s").alias(column), F.when(ok, code).alias("code"), status.alias("code_status"))
    return df.join(result, column, "left").withColumn("code_status", F.coalesce("code_status", F.lit("unbound")))


def meeting_entries(entries: Column, size: int, floor: float) -> Column:
    """Of a document's distinct entries those that share a word shingle with another one; none where no entry shares ``floor`` of its own.
    An entry of fewer words is one shingle."""

    def one(texts: list[str]) -> list[str]:
        words = [re.findall("[a-z0-9]+", t) for t in texts]
        sets = [{tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} for w in words]
        once, twice = set(), set()
        for s in sets:
            twice |= once & s
            once |= s
        shared = [len(s & twice) for s in sets] if twice else []
        if not any(k and k >= floor * len(s) - 1e-9 for k, s in zip(shared, sets)):
            return []
        return [t for t, k in zip(texts, shared) if k]

    return F.pandas_udf(lambda x: x.map(lambda t: one(list(t))), "array<string>")(entries)


def covered_entries(entries: DataFrame, document: str, entry: str, size: int = 5, floor: float = 0.8) -> DataFrame:
    """(document, entry, by): entries of a document whose word shingles another of its entries holds to ``floor``: the fuller one
    stands (ties: the smaller text). Entries of a document meet by their rarest shingles.

    The entries of one document are brought together once; shingles are spread only for those that share one."""
    e = entries.select(document, F.lower(F.trim(entry)).alias("entry")).where(F.col(document).isNotNull() & (F.col("entry") != ""))
    e = e.groupBy(document).agg(F.collect_set("entry").alias("_l")).select(document, F.explode(meeting_entries(F.col("_l"), size, floor)).alias("entry"))
    words = F.filter(F.split("entry", "[^a-z0-9]+"), lambda w: w != "")
    shingles = F.when(F.size("_w") < size, F.array(F.array_join("_w", " "))).otherwise(F.transform(F.sequence(F.lit(0), F.size("_w") - size), lambda i: F.array_join(F.slice("_w", i + 1, size), " ")))
    # entries go by a hash while their shingles are spread, so that long entries are not repeated with each; shingles are made once, not
    # anew on each branch of the join
    s = stored(e.withColumn("_w", words).select(document, "entry", F.xxhash64("entry").alias("_e"), F.transform(F.array_distinct(shingles), lambda x: F.xxhash64(x)).alias("_s")))
    other = s.select(document, F.col("_e").alias("_b"), "_s")
    met = token_overlap_join(s, other, "_e", "_s", "_b", "_s", [document], floor, None).where("_e != _b").select(document, "_e", "_b", "n_left", "n_right")
    texts = s.select(document, "_e", "entry")
    met = met.join(texts, [document, "_e"]).join(texts.select(document, F.col("_e").alias("_b"), F.col("entry").alias("by")), [document, "_b"])
    fuller = (F.col("n_right") > F.col("n_left")) | ((F.col("n_right") == F.col("n_left")) & (F.col("by") < F.col("entry")))
    return met.where(fuller).groupBy(document, "entry").agg(F.min("by").alias("by"))


def specific_entries(entries: DataFrame, document: str, entry: str, generic: Sequence[str]) -> DataFrame:
    """(document, entry, kept): an entry of generic words only (a kind of examination without its place) goes if another entry of the document
    holds all of its words and more."""
    e = entries.select(document, F.lower(F.trim(entry)).alias("entry")).where("entry != ''").distinct()
    words = F.array_distinct(F.filter(F.split("entry", "[^a-z0-9]+"), lambda w: w != ""))
    e = e.withColumn("_w", words)
    plain = (F.size("_w") > 0) & F.forall("_w", lambda w: w.isin(list(generic)))
    # only documents with a generic entry are looked at further, and of their entries only the words that are generic
    vague = e.where(plain).select(document, F.col("entry").alias("_g"), F.col("_w").alias("_v"))
    held = e.select(document, "entry", F.size("_w").alias("_n"), F.explode(F.filter("_w", lambda w: w.isin(list(generic)))).alias("_x"))
    met = vague.select(document, "_g", F.size("_v").alias("_k"), F.explode("_v").alias("_x")).join(held, [document, "_x"])
    gone = met.groupBy(document, "_g", "entry").agg(F.count("*").alias("_c"), F.first("_k").alias("_k"), F.first("_n").alias("_n")).where("_c = _k and _n > _k")
    gone = gone.select(document, F.col("_g").alias("entry"), F.lit(True).alias("_gone")).distinct()
    return e.select(document, "entry").join(gone, [document, "entry"], "left").select(document, "entry", F.col("_gone").isNull().alias("kept"))
