"""Rules on written values and lines: numbers, ages, list splitting, reasons, grounding, two readers, lookups.

Native expressions; where texts are compared, only distinct spellings or the words of one document meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.similarity import lev_ratio, whole_join

# fixed values: letters read for digits, and the digits they stand for
LOOK_ALIKE, DIGITS = "OoDQlI|iSsBZz", "0000111155822"
#: Names of a dictionary that is sent to all tasks.
SENT = 20_000
#: What a number is made of beside digits; what may follow it in one token.
SIGNS, UNIT = ".,/-", "[a-zA-Z%µ/]*"
_RUN = "[0-9]+"
#: A whole or decimal number, a fraction, or a half.
NUMBER = f"({_RUN}(?:[.]{_RUN})?(?:/{_RUN})?|½)"


def repaired_numbers(c: Column) -> Column:
    """Letters read for digits are put right in the number part of a token if half of it or more is digits; lower case, single blanks.

    The number part of a token is as far as it can be read as digits and signs; a unit may follow.
    """

    # each step is worked out once a token
    words = F.filter(F.split(c, "\\s+"), lambda t: t != "")
    read = F.transform(words, lambda t: F.struct(t.alias("t"), F.length(F.regexp_extract(F.translate(t, LOOK_ALIKE, DIGITS), f"^[0-9½{SIGNS}]*", 0)).alias("n")))
    numbers = F.transform(read, lambda s: F.struct(s["t"].alias("t"), s["n"].alias("n"), F.translate(F.substring(s["t"], F.lit(1), s["n"]), SIGNS, "").alias("number")))

    def token(s: Column) -> Column:
        t, n, number = s["t"], s["n"], s["number"]
        rest = F.substring(t, n + 1, F.length(t))
        digits = F.length(number) - F.length(F.translate(number, "0123456789", ""))
        sure = (digits > 0) & (2 * digits >= F.length(number)) & rest.rlike(f"^{UNIT}$")
        return F.when(sure, F.concat(F.translate(F.substring(t, F.lit(1), n), LOOK_ALIKE, DIGITS), rest)).otherwise(t)

    return F.lower(F.array_join(F.transform(numbers, token), " "))


def numbers_in(c: Column) -> Column:
    """Numbers of a text in their order, with repeats."""
    return _numbers(repaired_numbers(c))


def _numbers(repaired: Column) -> Column:
    return F.regexp_extract_all(repaired, F.lit(NUMBER), F.lit(1))


def age_years(c: Column) -> Column:
    """Years of an age text (years, months or days; a bare number is years); beyond 120 none."""
    n = F.regexp_extract(F.lower(c), "([0-9]{1,3}) ?(years?|yrs?|y|months?|m|days?|d)?\\b", 1).try_cast("int")
    unit = F.substring(F.regexp_extract(F.lower(c), "([0-9]{1,3}) ?(years?|yrs?|y|months?|m|days?|d)?\\b", 2), 1, 1)
    years = F.when(unit == "m", F.floor(n / 12)).when(unit == "d", F.floor(n / 365)).otherwise(n)
    return F.when(years <= 120, years.cast("long"))


def sex(c: Column) -> Column:
    """male or female of its written forms."""
    low = F.lower(F.trim(c))
    return F.when(low.isin("m", "male", "man", "boy"), "male").when(low.isin("f", "female", "woman", "girl"), "female")


def split_list(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys, seq, item): one row per entry of a written list, in order, without repeats.

    Entries are cut at commas, semicolons, bars, slashes, plus signs and `` and ``, but not where a piece would have fewer than two
    letters ("A/G", "R/E" are one name); list numbers and trailing results are taken off.
    """
    clean = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "^\\s*(?:[(]?[0-9]{1,2}[.)])\\s*", ""), "\\s*[-:=]\\s*[0-9]+(?:[.][0-9]+)?\\s*$", ""))
    letters = lambda x: F.length(F.regexp_replace(x, "[^A-Za-z]", ""))

    def pieces(part: Column) -> Column:
        bits = F.filter(F.transform(F.split(part, "[/\\\\|+]"), lambda x: F.trim(x)), lambda x: x != "")
        return F.when(F.forall(bits, lambda x: letters(x) >= 2), bits).otherwise(F.array(F.trim(part)))

    parts = F.split(F.col(text), "[,;]| and ")
    items = F.filter(F.transform(F.flatten(F.transform(parts, pieces)), clean), lambda x: letters(x) >= 2)
    rows = df.select(*keys, F.posexplode(items).alias("_p", "item"))
    first = rows.groupBy(*keys, F.lower("item").alias("_f")).agg(F.min(F.struct("_p", "item")).alias("_m")).select(*keys, "_m._p", "_m.item")
    return first.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("_p")).cast("long").alias("seq"), "item")


def first_reason(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The reason of the first rule (reason, pattern) that fits, in order of priority; null if none does."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(r)) for r, p in rules])


def two_signals(text: Column, patterns: Sequence[str]) -> Column:
    """Whether two or more of the patterns stand in a text."""
    return sum((text.rlike(p).cast("int") for p in patterns), F.lit(0)) >= 2


def compared_readers(df: DataFrame, a: str, b: str, floor: float = 0.85) -> DataFrame:
    """``state`` of two readings of one line: agree if numbers are equal and texts alike, else disagree; single, none. A reading is
    repaired once."""
    given = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    fold = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9%/.\\- ]", " "), " +", " "))
    rows = df.withColumns({"_ra": repaired_numbers(F.col(a)), "_rb": repaired_numbers(F.col(b))})
    rows = rows.withColumns({"_fa": fold(F.col("_ra")), "_fb": fold(F.col("_rb"))})
    same = (_numbers(F.col("_ra")) == _numbers(F.col("_rb"))) & (lev_ratio(F.col("_fa"), F.col("_fb")) >= floor)
    state = F.when(~given(a) & ~given(b), "none").when(~given(a) | ~given(b), "single").when(same, "agree").otherwise("disagree")
    return rows.withColumn("state", state).drop("_ra", "_rb", "_fa", "_fb")


def grounded(values: DataFrame, readings: DataFrame, within: str, key: str, value: str, reading: str, floor: float = 0.72) -> DataFrame:
    """(within, key, grounded, similarity, numbers_ok): a value against windows of as many words of the readings of its document, one
    word more or less. The best reading is the one that has all numbers (as often), then the most alike."""
    v = values.select(within, key, F.filter(F.split(repaired_numbers(F.lower(value)), " +"), lambda w: w != "").alias("_v"), numbers_in(F.col(value)).alias("_n"))
    r = readings.where(F.col(reading).isNotNull()).select(within, F.filter(F.split(repaired_numbers(F.lower(reading)), " +"), lambda w: w != "").alias("_r"), numbers_in(F.col(reading)).alias("_m"))
    k = F.size("_v")
    windows = F.flatten(F.transform(F.array(k - 1, k, k + 1), lambda n: F.when(n >= 1, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("_r") - n)), lambda i: F.array_join(F.slice("_r", i + 1, n), " "))).otherwise(F.array().cast("array<string>"))))
    target = F.array_join("_v", " ")
    best = F.array_max(F.transform(windows, lambda w: lev_ratio(target, w)))
    times = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    have = F.forall(F.array_distinct("_n"), lambda x: times(F.col("_m"), x) >= times(F.col("_n"), x))
    scored = v.join(r, within).where(F.size("_r") > 0).select(within, key, F.struct(have.alias("ok"), F.coalesce(best, F.lit(0.0)).alias("s")).alias("_b"))
    top = scored.groupBy(within, key).agg(F.max("_b").alias("_b"))
    out = v.select(within, key, (F.size("_v") == 0).alias("_none")).join(top, [within, key], "left")
    ok = F.col("_none") | F.coalesce(F.col("_b.ok") & (F.col("_b.s") >= floor), F.lit(False))
    return out.select(within, key, ok.alias("grounded"), F.round(F.coalesce("_b.s", F.lit(0.0)), 3).alias("similarity"), F.coalesce("_b.ok", F.lit(False)).alias("numbers_ok"))


def drug_lookup(texts: DataFrame, text: str, names: DataFrame, floor: float = 0.86) -> DataFrame:
    """(text, kind, name, fuzzy): the medicine that a text names, of ``names`` (kind, name): its first three words, then two, as a
    brand; else its first word as a brand, a generic or a substance; else, from six letters on, the most alike single name."""
    t = texts.select(F.col(text).alias("text")).where("text is not null").distinct()
    words = F.regexp_extract_all(F.regexp_replace(F.lower("text"), "^\\s*(tab|cap|inj|syp)[.\\s]+", ""), F.lit("([a-z0-9]+)"), F.lit(1))
    w = t.withColumn("_w", words).where("size(_w) > 0")
    order = F.when(F.col("kind") == "brand", 0).when(F.col("kind") == "generic", 1).otherwise(2)
    n = names.select("kind", F.lower("name").alias("name")).distinct().withColumn("_o", order)
    first = F.element_at("_w", 1)
    tries = F.array(*[F.struct(F.lit(3 - k).alias("_p"), F.array_join(F.slice("_w", 1, k), " ").alias("name")) for k in (3, 2)], F.struct(F.lit(2).alias("_p"), F.when(F.length(first) >= 3, first).alias("name")))
    probes = w.select("text", F.inline(tries)).where("name is not null")
    brand = ((F.col("_p") == 2) & (F.length("name") > 3)) | (F.col("kind") == "brand")
    hit = probes.join(n, "name").where(brand).groupBy("text").agg(F.min(F.struct("_p", "_o", "name", "kind")).alias("_b")).select("text", "_b.kind", "_b.name", F.lit(False).alias("fuzzy"))
    rest = w.join(hit, "text", "left_anti").select("text", first.alias("_w1")).where("length(_w1) >= 6")
    single = n.where("length(name) >= 6 and not contains(name, ' ')")
    alike = whole_join(rest, single, "_w1", "name", floor).where("substring(a, 1, 1) = substring(b, 1, 1) and abs(length(a) - length(b)) <= 1")
    near = rest.join(alike, F.col("_w1") == F.col("a")).join(single, F.col("b") == F.col("name"))
    near = near.groupBy("text").agg(F.max(F.struct("score", (-F.col("_o")).alias("o"), "name", "kind")).alias("_b")).select("text", "_b.kind", "_b.name", F.lit(True).alias("fuzzy"))
    return hit.unionByName(near)


def lexicon_members(words: DataFrame, word: str, lexicon: DataFrame, floor: float = 0.86) -> DataFrame:
    """(word, member, exact): words of four letters or more that the lexicon has, and those of six or more that are alike one of its words
    with the same first letter and a length of one more or less."""
    w = words.select(F.lower(word).alias("word")).where("length(word) >= 4").distinct()
    exact = w.join(lexicon.select(F.lower("word").alias("word")).distinct(), "word", "left_semi").select("word", F.col("word").alias("member"), F.lit(True).alias("exact"))
    rest = w.join(exact, "word", "left_anti").where("length(word) >= 6")
    near = whole_join(rest, lexicon, "word", "word", floor).where("substring(a, 1, 1) = substring(b, 1, 1) and abs(length(a) - length(b)) <= 1")
    best = near.groupBy("a").agg(F.max("score").alias("s"), F.min_by("b", F.struct((-F.col("score")).alias("m"), "b")).alias("member"))
    return exact.unionByName(best.select(F.col("a").alias("word"), "member", F.lit(False).alias("exact")))


def suggestions(texts: DataFrame, text: str, names: DataFrame, name: str, k: int = 3, floor: float = 0.7) -> DataFrame:
    """(text, name, score, rank): the ``k`` most alike names above a floor."""
    near = whole_join(texts, names, text, name, floor).select(F.col("a").alias("text"), F.col("b").alias("name"), "score")
    w = Window.partitionBy("text").orderBy(F.desc("score"), "name")
    return near.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def one_letter_slips(tokens: DataFrame, token: str, known: DataFrame, name: str) -> DataFrame:
    """(token, name): tokens that differ in one letter, at one place, from exactly one known name of their length."""
    masks = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.struct(i.alias("i"), F.concat(F.substring(c, F.lit(1), i - 1), F.lit("?"), F.substring(c, i + 1, F.length(c))).alias("m")))).alias("_k")
    t = tokens.select(F.lower(token).alias("token")).where("length(token) > 1").distinct()
    n = known.select(F.lower(name).alias("name")).where("length(name) > 1").distinct()
    rest = t.join(n, F.col("token") == F.col("name"), "left_anti")
    pairs = rest.select("token", masks(F.col("token"))).join(n.select("name", masks(F.col("name"))), "_k").select("token", "name").distinct()
    return pairs.groupBy("token").agg(F.min("name").alias("name"), F.count("*").alias("_n")).where("_n = 1").select("token", "name")


def dictionary_scan(lines: DataFrame, keys: Sequence[str], text: str, names: DataFrame, name: str, longest: int = 3) -> DataFrame:
    """(keys, at, words, name): dictionary names in lines; of overlapping ones the longest, then the first, stands.

    n-grams meet the dictionary by equi join; a name is covered where a longer one of its line reaches over it.
    """
    w = lines.select(*keys, F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "").alias("_w"))
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.when(F.size("_w") >= n, F.transform(F.sequence(F.lit(0), F.size("_w") - n), lambda i: F.struct(i.alias("at"), n.alias("words"), F.array_join(F.slice("_w", i + 1, n), " ").alias("name")))).otherwise(F.array().cast("array<struct<at:int,words:int,name:string>>"))))
    known = names.select(F.lower(name).alias("name")).distinct()
    # a dictionary of a bounded size goes to all tasks, so that not every n-gram is moved; a larger one is joined
    known = F.broadcast(known) if known.limit(SENT + 1).count() <= SENT else known
    found = w.select(*keys, F.inline(spans)).join(known, "name")
    every = found.groupBy(*keys).agg(F.collect_list(F.struct("at", "words", "name")).alias("_l"))  # names of one line
    over = lambda x, y: (y["at"] < x["at"] + x["words"]) & (x["at"] < y["at"] + y["words"]) & ((y["words"] > x["words"]) | ((y["words"] == x["words"]) & (y["at"] < x["at"])))
    kept = F.filter("_l", lambda x: ~F.exists("_l", lambda y: over(x, y)))
    return every.select(*keys, F.inline(kept))


def follow_up(c: Column) -> tuple[Column, Column, Column, Column]:
    """(kind, from, to, unit) of a follow-up text: as needed, a range or interval, a date, or unclear."""
    low = F.lower(c)
    pattern = "(?:after|in|within|review|r/v)[^0-9]{0,12}([0-9]+)(?: ?(?:-|to) ?([0-9]+))? ?(day|week|month|year)"
    n, m, unit = (F.regexp_extract(low, pattern, i) for i in (1, 2, 3))
    date = F.regexp_extract(c, "([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})", 1)
    kind = F.when(low.rlike("\\b(sos|as needed|if needed|prn)\\b"), "as_needed").when(n != "", "interval").when(date != "", "date").when(F.trim(c) != "", "unclear")
    span = kind == "interval"
    return kind, F.when(span, n.try_cast("long")), F.when(span & (m != ""), m.try_cast("long")), F.when(span, unit)


def reroute(kind: Column, counts: dict[str, Column], least: int = 2) -> Column:
    """The document type that a text's own signals name at least ``least`` times and more than any other, else the given one."""
    scores = F.array_sort(F.array(*[F.struct((-n).alias("n"), F.lit(k).alias("k")) for k, n in sorted(counts.items())]))
    best, second = F.get(scores, F.lit(0)), F.get(scores, F.lit(1))
    return F.when((-best["n"] >= least) & (best["n"] < second["n"]), best["k"]).otherwise(kind)


def near_cue_or_foot(lines: DataFrame, document: str, order: str, unreadable: Column, cue: Column, reach: int = 2, foot: int = 2) -> DataFrame:
    """(document, order, why): unreadable lines within ``reach`` lines of a cue, or among the last ``foot`` of their document."""
    w = Window.partitionBy(document).orderBy(order)
    near = F.max(cue.cast("int")).over(w.rowsBetween(-reach, reach)) == 1
    place = F.row_number().over(Window.partitionBy(document).orderBy(F.desc(order)))
    rows = lines.select(document, order, unreadable.alias("_u"), near.alias("_n"), place.alias("_p"))
    return rows.where("_u").select(document, order, F.when(F.col("_n"), "near a cue").when(F.col("_p") <= foot, "at the foot").alias("why")).where("why is not null")


def by_priority(texts: DataFrame, key: str, text: str, rules: DataFrame) -> DataFrame:
    """(key, name): the name of the first rule (keyword, name, priority) whose keyword stands in the text as a word."""
    words = texts.select(key, F.explode(F.array_distinct(F.split(F.lower(text), "[^a-z0-9]+"))).alias("keyword"))
    return words.join(rules, "keyword").groupBy(key).agg(F.min_by("name", F.struct("priority", "name")).alias("name"))


def wildcard_options(readings: DataFrame, reading: str, names: DataFrame, name: str, k: int = 7, floor: float = 0.7) -> DataFrame:
    """(reading, name, rank): names that fit a reading whose ``?`` stands for one letter, then the most alike ones, ``k`` in all."""
    r = readings.select(F.col(reading).alias("reading")).where("reading is not null").distinct()
    n = names.select(F.col(name).alias("name")).where("name is not null").distinct()
    masks = F.explode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.concat(F.substring("name", F.lit(1), i - 1), F.lit("?"), F.substring("name", i + 1, F.length("name"))))).alias("reading")
    fits = r.join(n.where("length(name) > 0").select("name", masks), "reading").select("reading", "name", F.lit(0).alias("_o"), F.lit(1.0).alias("_s")).distinct()
    near = whole_join(r, n, "reading", "name", floor).select(F.col("a").alias("reading"), F.col("b").alias("name"), F.lit(1).alias("_o"), F.col("score").alias("_s"))
    best = fits.unionByName(near).groupBy("reading", "name").agg(F.min(F.struct("_o", (-F.col("_s")).alias("_s"))).alias("_b"))
    w = Window.partitionBy("reading").orderBy("_b", "name")
    return best.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("reading", "name", "rank")


def snap_scores(best: DataFrame, truth: str, reading: str, name: str, score: str, cutoffs: Sequence[float]) -> DataFrame:
    """(cutoff, changed, fixed, harmed, exact, cer): what snapping a reading to its best name does from each cutoff on."""
    rows = best.withColumn("cutoff", F.explode(F.array(*map(F.lit, cutoffs)))).withColumn("_to", F.when(F.col(score) >= F.col("cutoff"), F.col(name)).otherwise(F.col(reading)))
    was, now = F.col(reading) == F.col(truth), F.col("_to") == F.col(truth)
    return rows.groupBy("cutoff").agg(
        F.count_if(F.col("_to") != F.col(reading)).alias("changed"), F.count_if(~was & now).alias("fixed"), F.count_if(was & ~now).alias("harmed"), F.count_if(now).alias("exact"),
        F.round(F.sum(F.levenshtein(truth, "_to")) / F.sum(F.length(truth)), 6).alias("cer"),
    )


def assessed(rows: DataFrame, tiers: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """``trace`` and ``verdict`` of facts over ordered tiers (name, outcome text, whether it passes): every tier leaves its outcome, the
    first that does not pass decides."""
    trace = F.array_join(F.array(*[F.concat(F.lit(f"{n}:"), F.coalesce(o, F.lit("-"))) for n, o, _ in tiers]), ">")
    failed = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, _, ok in tiers])
    return rows.withColumns({"trace": trace, "verdict": F.coalesce(F.concat(F.lit("held: "), failed), F.lit("supported"))})
