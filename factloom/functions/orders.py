"""Written orders: lists of tests taken apart, what is no test and why, and the grammar of doses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.results import names_on_lines
from factloom.sources.scratch import stored

# fixed values: specimens before a test; words for sugar; letters for fasting and after a meal
SPECIMEN, SUGAR, SUGAR_LETTERS = "s sr serum plasma", "sugar suger sugr glucose bs", "f fs fbs fbg pp pps ppbs pp2bs"
# fixed values: labels before a list, marks before its entries, numbers of its entries, results behind them
_LABEL, _MARKS = "^\\s*(?:blood|serum|urine|adv(?:ice|ised)?|inv(?:estigations?)?|ix)\\s*[:-]\\s*", "[✓✔☑√•·●◦▪→*]"
_NUMBERED, _RESULT = "^\\s*(?:[(\\[]\\s*[0-9]{1,2}\\s*[)\\]]|[0-9]{1,2}[.)])\\s*", "\\s*[-–:=]\\s*(?:[0-9]{3,}(?:[.][0-9]+)?|[0-9]+[.][0-9]+)\\s*$"
# fixed values: where a list is cut into parts, a part into names, and names apart where all are known
_PARTS, _STRONG = "\\s*[,;+]\\s*(?=[A-Za-z0-9(\\[{])|\\s+and\\s+", "\\s*[/\\\\|&]\\s*"
_WEAK = "\\s+-\\s+|(?<=[A-Za-z0-9])-(?=[A-Za-z0-9])|[.](?=\\s*[A-Za-z0-9])"


def _in(c: Column, words: str) -> Column:
    return c.isin(words.split())


def sugar_items(c: Column) -> Column:
    """``Blood sugar F, PP`` and its kin as one entry a letter group; null if the text is not of that shape (sugar once, then only such letters)."""
    words = F.regexp_extract_all(c, F.lit("([A-Za-z0-9]+)"), F.lit(1))
    low = F.transform(words, F.lower)
    first = F.get(low, F.lit(0))
    skip = F.when(_in(first, SUGAR), 1).when((first == "blood") & _in(F.get(low, F.lit(1)), SUGAR), 2)
    tail = F.slice(words, skip + 1, F.greatest(F.size(words) - skip, F.lit(0)))
    fits = skip.isNotNull() & (F.size(words) > skip) & F.forall(tail, lambda w: _in(F.lower(w), SUGAR_LETTERS))
    return F.when(fits, F.transform(tail, lambda w: F.concat(F.lit("Blood sugar "), w)))


def glued(words: DataFrame, word: str, names: DataFrame, name: str, longest: int = 12) -> DataFrame:
    """(word, parts) of the words that are nothing but two or more known names run together: the fewest parts, then the shortest first ones.

    Stretches meet the names by equi join; the parts are found from left to right over the stretches of one word.
    """
    w = words.select(F.lower(word).alias("word")).where("length(word) >= 4").distinct()
    known = names.select(F.lower(name).alias("_p")).where("length(_p) >= 2 and not contains(_p, ' ')").distinct()
    cuts = F.flatten(F.transform(F.sequence(F.lit(2), F.length("word")), lambda i: F.transform(F.sequence(F.greatest(F.lit(0), i - longest), i - 2), lambda j: F.struct(i.alias("i"), j.alias("j"), F.substring(F.col("word"), j + 1, i - j).alias("_p")))))
    spans = w.select("word", F.inline(cuts)).join(known, "_p").groupBy("word").agg(F.sort_array(F.collect_list(F.struct("i", "j", "_p"))).alias("_s"))  # stretches of one word
    kind = "array<struct<n:int,parts:array<string>>>"

    def step(state: Column, i: Column) -> Column:
        ends = F.filter("_s", lambda s: (s["i"] == i) & F.element_at(state, s["j"] + 1)["parts"].isNotNull())
        made = F.transform(ends, lambda s: F.struct((F.element_at(state, s["j"] + 1)["n"] + 1).alias("n"), F.concat(F.element_at(state, s["j"] + 1)["parts"], F.array(s["_p"])).alias("parts")))
        return F.concat(state, F.array(F.coalesce(F.array_min(made), F.struct(F.lit(None).cast("int").alias("n"), F.lit(None).cast("array<string>").alias("parts")))))

    start = F.array(F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("parts"))).cast(kind)
    best = F.element_at(F.aggregate(F.sequence(F.lit(1), F.length("word")), start, step), -1)
    return spans.select("word", best["parts"].alias("parts")).where("size(parts) >= 2")


def split_orders(df: DataFrame, keys: Sequence[str], text: str, names: DataFrame, name: str) -> DataFrame:
    """(keys, seq, item): one row per test of a written list, in order, without repeats.

    A part that the names know as a whole is never cut (``A/G ratio``). Others are cut at slashes and bars unless a piece has a single letter
    (``R/E``), at ``-`` and ``.`` only into known names (``CK-MB`` stays), and a run of known names, with specimens before them
    (``S LIPASE FT4``), a stuck tick (``vTSH``) or without blanks (``TSHLFT``), into these. Sugar written once for several letters is one row
    a letter. List numbers, brackets and results are taken off.
    """
    keys = list(keys)
    known = names.select(F.lower(F.trim(name)).alias("_k")).where("_k != ''").distinct().withColumn("_known", F.lit(True))
    base = F.regexp_replace(F.trim(F.col(text)), f"(?i){_LABEL}", "")
    clean = lambda p: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(p, _NUMBERED, ""), "[{}\\[\\]]", ""), _RESULT, ""), "^[ .]+|[ .]+$", "")
    whole = sugar_items(F.regexp_replace(F.regexp_replace(base, _MARKS, " "), "[/\\\\|,;+&-]", " "))
    parts = F.transform(F.split(F.regexp_replace(base, _MARKS, ","), _PARTS), clean)
    rows = df.select(*keys, F.posexplode(F.coalesce(whole, parts)).alias("_a", "_t")).where("_t != ''")
    # what several steps read is made once: each step would make all before it anew for each of its readers
    rows = stored(rows.withColumn("_s", sugar_items(F.col("_t"))))

    def told(rows: DataFrame, c: str) -> DataFrame:
        return rows.withColumn("_k", F.lower(c)).join(known, "_k", "left").withColumn("_known", F.coalesce("_known", F.lit(False)))

    item = lambda rows, c, *at: rows.select(*keys, F.array(*[F.col(a).cast("int") if isinstance(a, str) else a for a in at]).alias("_at"), F.col(c).alias("item"))
    zero = F.lit(0)
    sugar = rows
    out = item(sugar.where("_s is not null").select(*keys, "_a", F.posexplode("_s").alias("_b", "_x")), "_x", "_a", "_b", zero, zero)
    rows = stored(told(sugar.where("_s is null").drop("_s"), "_t"))
    out = out.union(item(rows.where("_known"), "_t", "_a", zero, zero, zero))
    bits = F.filter(F.transform(F.split("_t", _STRONG), lambda b: clean(b)), lambda b: b != "")
    cut = F.forall(bits, lambda b: F.length(F.regexp_replace(b, "[^A-Za-z]", "")) >= 2)
    bits = stored(told(rows.where("not _known").select(*keys, "_a", F.posexplode(F.when(cut, bits).otherwise(F.array("_t"))).alias("_b", "_t")), "_t"))
    out = out.union(item(bits.where("_known"), "_t", "_a", "_b", zero, zero))
    # weak cuts: all pieces must be known
    rest = bits.where("not _known").select(*keys, "_a", "_b", "_t")
    weak = F.filter(F.transform(F.split("_t", _WEAK), lambda b: F.trim(b)), lambda b: b != "")
    at = [*keys, "_a", "_b"]
    pieces = told(rest.select(*at, F.posexplode(weak).alias("_c", "_x")), "_x")
    sure = pieces.groupBy(*at).agg(F.bool_and("_known").alias("_all"), F.count("*").alias("_n")).where("_all and _n > 1").select(*at, F.lit(True).alias("_weak"))
    out = out.union(item(pieces.join(sure, at), "_x", "_a", "_b", "_c", zero))
    rest = stored(rest.join(sure, at, "left").where("_weak is null").drop("_weak"))
    # runs: every word is a specimen, a known name, one behind a stuck tick, or known names without blanks
    words = rest.select(*at, F.posexplode(F.filter(F.split("_t", "\\s+"), lambda w: w != "")).alias("_c", "_w"))
    words = told(words.withColumn("_bare", F.regexp_replace("_w", "^[.]+|[.]+$", "")), "_bare").withColumnRenamed("_known", "_whole")
    words = told(words.withColumn("_tick", F.when(F.col("_bare").rlike("^[vV][A-Z].{2,}"), F.expr("substring(_bare, 2)"))).drop("_k"), "_tick").withColumnRenamed("_known", "_ticked")
    words = stored(words.drop("_k").withColumn("_low", F.lower("_bare")))
    words = words.join(glued(words.where("not _whole and not _ticked"), "_bare", names, name).select(F.col("word").alias("_low"), "parts"), "_low", "left")
    specimen = _in(F.col("_low"), SPECIMEN) & ~F.col("_whole")
    # a cut of the word as it is written: the parts' lengths from its start
    lengths = F.transform("parts", lambda p: F.length(p))
    spelt = F.transform("parts", lambda p, i: F.substring(F.col("_bare"), F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(1), lambda a, b: a + b), F.length(p)))
    got = F.when(specimen, F.array().cast("array<string>")).when(F.col("_whole"), F.array("_bare")).when(F.col("_ticked"), F.array("_tick")).otherwise(spelt)
    words = stored(words.withColumns({"_got": got, "_spec": specimen}))
    run = Window.partitionBy(*at).orderBy("_c")
    # specimens go to the word behind them
    before = F.collect_list(F.struct("_c", F.when(F.col("_spec"), F.col("_w")).alias("w"))).over(run.rowsBetween(Window.unboundedPreceding, -1))
    stop = F.aggregate(before, F.lit(-1), lambda a, s: F.when(s["w"].isNull(), s["_c"]).otherwise(a))
    lead = F.array_join(F.transform(F.filter(before, lambda s: (s["_c"] > stop) & s["w"].isNotNull()), lambda s: s["w"]), " ")
    words = words.withColumn("_lead", lead)
    last = F.max(F.struct("_c", "_spec"))["_spec"]
    good = words.groupBy(*at).agg(F.bool_and(F.col("_got").isNotNull()).alias("_all"), F.sum(F.size("_got")).alias("_n"), last.alias("_last")).where("_all and _n >= 1 and not _last").select(*at, F.lit(True).alias("_run"))
    named = F.transform("_got", lambda g, i: F.when((i == 0) & (F.col("_lead") != ""), F.concat("_lead", F.lit(" "), g)).otherwise(g))
    out = out.union(item(words.join(good, at).select(*at, "_c", F.posexplode(named).alias("_d", "_x")), "_x", "_a", "_b", "_c", "_d"))
    out = out.union(item(rest.join(good, at, "left").where("_run is null"), "_t", "_a", "_b", zero, zero))
    first = out.groupBy(*keys, F.lower("item").alias("_f")).agg(F.min(F.struct("_at", "item")).alias("_m")).select(*keys, "_m._at", "_m.item")
    return first.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("_at")).cast("long").alias("seq"), "item")


# fixed values: words of orders that are no laboratory test, and of lines that list a clinic's services
IMAGING = "mri xray cxr usg ultrasound ultrasonography sonography opg dexa mammogram mammography doppler angiography echo ncv endoscopy colonoscopy ecg ekg eeg emg tmt holter spirometry pft"
PHYSIO = "physio physiotherapy ust ift tens kegel exercise exercises"
SERVICES = "clinic centre center pharmacy consultation dental laser eye ent pathology microbiology biopsy endoscopy physiotherapy doppler"
PHONE, FORMS = "ph tel phone mob mobile fax cell", "tab tabs tablet tablets cap caps capsule capsules syp syr inj drops oint cream gel susp"
# fixed values: signs of a dose; two of them make a medicine order
DOSE_SIGNS = ["\\bx ?[0-9]+ ?(d|days?|wks?|weeks?|mos?|months?)\\b", "(^|[^0-9])[0-9] ?[-–] ?[0-9] ?[-–] ?[0-9]($|[^0-9])", "\\b(bd|b[.]d|tds|bid|od|qid|hs|sos)\\b", "[0-9] ?(mg|mcg|ml|gm|iu)\\b", "\\b(once|twice|thrice)\\b"]


def _words(c: Column) -> Column:
    """Words of letters, ``x-ray`` and ``ct scan`` as one."""
    low = F.regexp_replace(F.regexp_replace(F.lower(c), "x[ .-]*rays?\\b", "xray"), "\\bct[ -]*(scan|abdomen|chest|brain|head|spine)\\b", "ctscan")
    return F.split(F.trim(F.regexp_replace(low, "[^a-z0-9]+", " ")), " ")


def _some(words: Column, group: str) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, group.split())))


def entry_reason(c: Column, placed: Column, words: Column | None = None) -> Column:
    """Why a written entry is no laboratory test, by its own words; null if it may be one. Imaging that the lists place is none of these.
    ``words`` is the column of its words, if there is one already."""
    words = _words(c) if words is None else words
    doses = sum((F.lower(c).rlike(p).cast("int") for p in DOSE_SIGNS), F.lit(0))
    label = F.forall(words, lambda w: w.isin(PHONE.split()) | w.rlike("^[0-9]+$")) & _some(words, PHONE)
    return F.when(label, "phone label").when(_some(words, PHYSIO), "physiotherapy").when(_some(words, f"{IMAGING} ctscan") & ~placed, "imaging").when(doses >= 2, "medicine order")


def line_reason(c: Column, words: Column | None = None) -> Column:
    """Why a printed line orders no test: a list of services (two marks or three such words), a medicine line, or its own words."""
    words = _words(c) if words is None else words
    services = F.size(F.array_intersect(words, F.array(*map(F.lit, SERVICES.split()))))
    marks = F.length(c) - F.length(F.regexp_replace(c, "[●•·▪■|]", ""))
    return F.when((marks >= 2) | (services >= 3), "list of services").when(_some(words, FORMS), "medicine line").otherwise(entry_reason(c, F.lit(False), words))


def not_ordered(names: DataFrame, name: str, lines: DataFrame, within: str, line: str, text: str, placed: DataFrame, longest: int = 3) -> DataFrame:
    """(within, name, reason) of the names of a document that are no test to be done: by their own words, else because *every* line that holds
    the name is one that orders none (the reason of the first). A name that stands in one plain line is left alone."""
    own = names.select(within, F.lower(F.trim(name)).alias("name")).distinct()
    there = placed.select(F.lower(F.trim(placed.columns[0])).alias("name")).distinct().withColumn("_p", F.lit(True))
    own = own.join(there, "name", "left").withColumn("_own", entry_reason(F.col("name"), F.coalesce("_p", F.lit(False))))
    # documents without a name have nothing to be looked at
    lines = lines.join(own.select(within).distinct(), within, "left_semi")
    held = names_on_lines(lines, within, line, text, own.select("name").distinct(), "name", longest)
    told = lines.withColumn("_w", _words(F.col(text))).select(within, line, line_reason(F.col(text), F.col("_w")).alias("_r"))
    reasons = held.join(told, [within, line])
    every = reasons.groupBy(within, "name").agg(F.bool_and(F.col("_r").isNotNull()).alias("_all"), F.min(F.struct(line, "_r"))["_r"].alias("_r")).where("_all")
    out = own.join(every, [within, "name"], "left")
    return out.select(within, "name", F.coalesce("_own", F.concat(F.lit("in a line: "), "_r")).alias("reason")).where("reason is not null")


# fixed values: units of a strength, and doses a day of written frequencies
STRENGTH_UNITS = "mg/5ml mg/ml mcg mg gm g ug µg ml iu units u %"
FREQUENCIES = {"od": 1.0, "qd": 1.0, "hs": 1.0, "qhs": 1.0, "bd": 2.0, "bid": 2.0, "tds": 3.0, "tid": 3.0, "qid": 4.0, "sos": 0.0, "prn": 0.0, "stat": 0.0}


def strength(c: Column) -> Column:
    """Struct (amount, unit) of ``<number><unit>`` and nothing else, else null."""
    t = F.regexp_replace(F.lower(c), "\\s+", "")
    unit = "|".join(STRENGTH_UNITS.split())
    hit = t.rlike(f"^[0-9]+(?:[.][0-9]+)?(?:{unit})$")
    return F.when(hit, F.struct(F.regexp_extract(t, "^([0-9.]+)", 1).cast("double").alias("amount"), F.regexp_extract(t, "^[0-9.]+(.*)$", 1).alias("unit")))


def dose_pattern(c: Column) -> Column:
    """Three or four slots of a day (``1-0-1``, ``½-0-½``), each at most four; null for another shape."""
    slots = F.split(F.regexp_replace(F.regexp_replace(c, "\\s+", ""), "[–—]", "-"), "-")
    value = F.transform(slots, lambda s: F.when(s.isin("½", "1/2"), 0.5).when(s.rlike("^[0-9]$"), s.try_cast("double")))
    return F.when(F.size(slots).isin(3, 4) & F.forall(value, lambda v: v.isNotNull() & (v <= 4)), value)


def times_a_day(c: Column) -> Column:
    """Doses a day of a written frequency or slots; null for others."""
    word = F.regexp_replace(F.lower(c), "[^a-z]", "")
    named = F.element_at(F.create_map(*[F.lit(x) for pair in FREQUENCIES.items() for x in pair]), word)
    return F.coalesce(named, F.size(F.filter(dose_pattern(c), lambda v: v > 0)).cast("double"))


def duration_days(c: Column) -> Column:
    """Days of ``x 5 d``, ``2 wks``, ``1/52`` (weeks), ``1 month``; null beyond ten years and for other texts."""
    low = F.lower(c)
    weeks = F.regexp_extract(low, "([0-9]+) ?/ ?52", 1).try_cast("long") * 7
    n, unit = (F.regexp_extract(low, "([0-9]+) ?(days?|d|weeks?|wks?|wk|w|months?|mo|m)\\b", i) for i in (1, 2))
    days = F.coalesce(weeks, n.try_cast("long") * F.when(F.substring(unit, 1, 1) == "w", 7).when(F.substring(unit, 1, 1) == "m", 30).otherwise(1))
    return F.when(days <= 3650, days)


def medicine_grammar(df: DataFrame, key: str, **columns: str) -> DataFrame:
    """(key, field, value, problem): each given field of a medicine with what its grammar reads, or the reason why it breaks it. ``columns`` name the
    columns of ``strength``, ``frequency`` and ``duration``; missing values are no fault here."""
    rules = {"strength": (lambda c: F.concat_ws(" ", strength(c)["amount"].cast("string"), strength(c)["unit"]), "not a number with a unit"), "frequency": (lambda c: times_a_day(c).cast("string"), "not a known frequency"), "duration": (lambda c: duration_days(c).cast("string"), "not a plausible duration")}

    def checked(field: str, column: str) -> Column:
        read, problem = rules[field]
        value = F.nullif(read(F.col(column)), F.lit(""))
        given = F.coalesce(F.trim(F.col(column)) != "", F.lit(False))
        return F.when(given, F.struct(F.lit(field).alias("field"), value.alias("value"), F.when(value.isNull(), problem).alias("problem")))

    found = F.filter(F.array(*[checked(f, c) for f, c in columns.items()]), lambda x: x.isNotNull())
    return df.select(key, F.inline(found))
