"""Results written beside names: what stands on a page with its value is no order any more."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.sources.scratch import stored

#: Names that are sent to all tasks.
SENT = 200_000
#: Tokens behind a name that are looked at: the names that share its value, and the value.
REACH = 40
# fixed values: words that are results, and units of time and dose that make a number something else
RESULT_WORDS = "positive negative reactive nonreactive detected normal nil nad wnl"
NO_RESULT_UNITS = "h hr hrs hour hours min mins minute minutes day days d week weeks wk wks month months mo cap caps tab tabs ml mcg unit units drops od bd tds sos"
#: A value at the start of the tokens behind a name, after joined names and signs; ``mg`` alone is a dose, ``mg / dl`` is none.
_NUMBER = "[<>]?[0-9]+(?:[.][0-9]+)?%?"
_NAMES, _SIGNS = "(?:[/,&+] [a-z][a-z0-9.]* )*", "(?:[:=(.-] )*"
_OTHER = f"^{_NAMES}{_SIGNS}{_NUMBER} (?:(?:{'|'.join(NO_RESULT_UNITS.split())})(?: |$)|mg(?: [^/]|$))"
_VALUE = f"^{_NAMES}{_SIGNS}(?:{_NUMBER}|(?:non |not )?(?:{'|'.join(RESULT_WORDS.split())}))(?: |$)"
#: How a value, or what may stand before it, begins.
_FIRST = f"^(?:[/,&+:=(.<>0-9-]|non|not|{'|'.join(RESULT_WORDS.split())})"


def tokens(c: Column) -> Column:
    """Words, numbers and signs of a text in lower case."""
    apart = F.regexp_replace(F.lower(c), "([/,&+:=();|-]|[.](?![0-9]))", " $1 ")
    return F.array_remove(F.split(apart, "[ \\t\\n\\r]+"), "")


def valued(behind: Column) -> Column:
    """Whether the tokens behind a name, joined by blanks, begin with a value."""
    return behind.rlike(_VALUE) & ~behind.rlike(_OTHER)


def _places(rows: DataFrame, within: str, line: str, known: DataFrame, longest: int, beside: Callable[[Column], Column] | None = None, late: bool = False) -> DataFrame:
    """(within, line, place, n_words, name) of lines as tokens ``_t``, and ``valued`` by what is ``beside`` the token behind it: every place of a ``known``
    name; of overlapping ones the longest stands. ``late``: only the places of known names are looked at; tokens must not move, so names are sent to all tasks."""
    word = lambda n, i: F.get("_t", i) if n == 1 else F.array_join(F.slice("_t", i + 1, n), " ")
    place = lambda n, i: F.struct(i.alias("place"), F.lit(n).alias("n_words"), word(n, i).alias("name"), *([] if beside is None or late else [beside(i + n).alias("valued")]))
    spans = [F.when(F.size("_t") >= n, F.transform(F.sequence(F.lit(0), F.size("_t") - n), lambda i: place(n, i))) for n in range(1, longest + 1)]
    # lines without tokens meet no name: an outer list, as Spark would make each list twice to leave out empty ones
    found = rows.select(within, line, *(["_t", "_n"] if late else []), F.inline_outer(F.flatten(F.array_compact(F.array(*spans))) if longest > 1 else spans[0]))
    found = found.join(F.broadcast(known) if late else known, "name")
    if late:
        found = found.withColumn("valued", beside(F.col("place") + F.col("n_words")))
    found = found.select(within, line, "place", "n_words", "name", *([] if beside is None else ["valued"]))
    if longest == 1:
        return found
    # a longer name covers those inside it: the furthest end of the longer ones that begin no later
    own = Window.partitionBy(within, line).orderBy("place", F.desc("n_words"))
    reach = F.max(F.col("place") + F.col("n_words")).over(own.rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("_e", reach).where(F.col("_e").isNull() | (F.col("place") + F.col("n_words") > F.col("_e"))).drop("_e")


def _known(names: DataFrame, name: str) -> DataFrame:
    return names.select(F.array_join(tokens(F.col(name)), " ").alias("name")).where("name != ''").distinct()


def names_on_lines(lines: DataFrame, within: str, line: str, text: str, names: DataFrame, name: str, longest: int = 3) -> DataFrame:
    """(within, line, name): the names that stand in a line, as ``occurrences`` finds them, whatever their values."""
    return _places(lines.select(within, line, tokens(F.col(text)).alias("_t")), within, line, _known(names, name), longest).select(within, line, "name").distinct()


def occurrences(lines: DataFrame, within: str, line: str, text: str, names: DataFrame, name: str, longest: int = 3) -> DataFrame:
    """(within, line, place, n_words, name, valued): every place of a name of one to ``longest`` words; of overlapping ones the longest stands.

    A value may be written once for joined names (``a / b / c : negative``) and at the start of the next line. Lines move once, as they are written, to
    meet the next ones; up to ``SENT`` names go to all tasks, so that no word of a line moves.
    """
    # the first ``REACH`` words hold as many tokens or more
    start = F.regexp_extract("_n", f"^[ \\t\\n\\r]*+(?:[^ \\t\\n\\r]++[ \\t\\n\\r]*+){{0,{REACH}}}", 0)
    following = F.lead(text).over(Window.partitionBy(within).orderBy(line))
    rows = lines.select(within, line, text, following.alias("_n")).select(within, line, tokens(F.col(text)).alias("_t"), tokens(start).alias("_n"))

    def beside(end: Column) -> Column:
        more = F.when(end + REACH > F.size("_t"), F.coalesce(F.slice("_n", 1, REACH), F.array())).otherwise(F.array().cast("array<string>"))
        behind = F.array_join(F.concat(F.slice("_t", end + 1, REACH), more), " ")
        # most names are followed by a word that begins no value: what is behind them is not joined
        first = F.coalesce(F.get("_t", end), F.get("_n", F.lit(0)), F.lit(""))
        return F.when(first.rlike(_FIRST), valued(behind)).otherwise(False)

    known = stored(_known(names, name))
    return _places(rows, within, line, known, longest, beside, known.count() <= SENT)


def results_on_page(places: DataFrame, within: str) -> DataFrame:
    """(within, name, seen, valued, result): a name is a result of its document if *every* place of it has a value (division)."""
    return places.groupBy(within, "name").agg(F.count("*").alias("seen"), F.count_if("valued").alias("valued"), F.bool_and("valued").alias("result"))


def ordered_entries(entries: DataFrame, key: str, within: str, entry: str, names: DataFrame, name: str, lines: DataFrame, line: str, text: str) -> DataFrame:
    """(key, within, rest, status) of written entries: ``rest`` is the entry without the names that have their value beside them; status
    ``result`` if nothing but such is left, ``on the page`` if all names left have a value at every place of the document, else ``order``."""
    own = occurrences(entries.withColumn("_one", F.lit(0)), key, "_one", entry, names, name)
    drop = own.groupBy(key).agg(F.collect_list(F.when(F.col("valued"), F.struct("place", "n_words"))).alias("_d"), F.collect_set(F.when(~F.col("valued"), F.col("name"))).alias("_k"))  # names of one entry
    page = results_on_page(occurrences(lines, within, line, text, names, name), within).where("result").groupBy(within).agg(F.collect_set("name").alias("_r"))  # names of one document
    rows = entries.select(key, within, tokens(F.col(entry)).alias("_t")).join(drop, key, "left").join(page, within, "left")
    gone = F.coalesce("_d", F.array())
    # a place goes with what follows it up to the next sign between entries
    stop = lambda at, n: F.coalesce(F.get(F.filter(F.transform("_t", lambda w, i: F.when(w.isin(",", ";", "|") & (i >= at + n), i)), lambda i: i.isNotNull()), F.lit(0)), F.size("_t"))
    left = F.filter(F.transform("_t", lambda w, i: F.when(~F.exists(gone, lambda d: (i >= d["place"]) & (i < stop(d["place"], d["n_words"]))), w)), lambda w: w.isNotNull())
    rest = F.regexp_replace(F.array_join(left, " "), "^[ ,;|]+|[ ,;|]+$|([,;|])( [,;|])+", "$1")
    rows = rows.withColumn("rest", F.trim(rest))
    known = F.coalesce("_k", F.array())
    status = F.when((F.size(gone) > 0) & ~F.col("rest").rlike("[a-z]{2}"), "result").when((F.size(known) > 0) & (F.size(F.array_except(known, F.coalesce("_r", F.array()))) == 0), "on the page").otherwise("order")
    return rows.select(key, within, "rest", status.alias("status"))
