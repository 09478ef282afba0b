"""Nested answers: parse with a schema, the latest per document, fan out by document type, and flatten to a table of tests."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import normalise as N
from factloom.operators import tables as T

#: A value that may carry its review status.
CHECKED = "struct<value:string,status:string>"
ANSWER = (
    f"patient struct<name:{CHECKED},sex:string>, medications array<struct<text:string,frequency:string,duration:string>>, investigations array<string>, advice array<string>, "
    f"results array<struct<name:{CHECKED},value:double,unit:string,recognised:boolean>>, vitals array<struct<name:string,value:string>>"
)
# fixed values: written names of vital signs, by the name they stand for
VITAL_NAMES = {"bp": "blood_pressure", "blood pressure": "blood_pressure", "p": "pulse", "pr": "pulse", "pulse": "pulse", "hr": "pulse", "temp": "temperature", "temperature": "temperature", "wt": "weight", "weight": "weight", "spo2": "spo2"}
_FACT = ("document_id", "fact_type", "seq", "name", "value_num", "value_text", "unit")


def latest_answers(rows: DataFrame, document: str, payload: str, order: Sequence[Column], schema: str = ANSWER) -> DataFrame:
    """The latest answer of each document, parsed; ``answer`` is null where the text is no JSON object of the schema."""
    last = T.latest_per_key(rows, [document], order)
    return last.withColumn("answer", F.from_json(payload, schema)).withColumn("answer", F.when(F.trim(F.col(payload)).startswith("{"), F.col("answer")))


def _fact(kind: str, seq: Column, name: Column, num: Column | None = None, text: Column | None = None, unit: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(F.lit(kind).alias("fact_type"), seq.cast("long").alias("seq"), name.alias("name"), (none if num is None else num).cast("double").alias("value_num"), (none if text is None else text).cast("string").alias("value_text"), (none if unit is None else unit).cast("string").alias("unit"))


def _medicine_name(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, "(?i)[0-9]+(?:[.][0-9]+)? ?(mg|mcg|g|ml|iu)\\b.*$", ""), "(?i)^(tab|cap|inj|syp)[. ]+", ""))


def medications(answers: DataFrame) -> DataFrame:
    """Medicine rows: strength and unit from the text, doses a day and days from their own fields."""
    m = answers.select("document_id", F.posexplode("answer.medications").alias("p", "m"))
    strength, unit = N.dose(F.col("m.text"))
    return m.select("document_id", (F.col("p") + 1).cast("long").alias("seq"), _medicine_name(F.col("m.text")).alias("name"), strength.alias("strength"), unit.alias("unit"), N.per_day(F.col("m.frequency")).alias("per_day"), N.duration_days(F.col("m.duration")).alias("days"))


def vital_values(listed: Column) -> Column:
    """Vital signs (name, value) by their proper names, a pressure as two; the first value of a name wins."""
    names = F.create_map(*[F.lit(x) for kv in VITAL_NAMES.items() for x in kv])

    def values(v: Column) -> Column:
        name, value = F.try_element_at(names, F.lower(F.trim(v["name"]))), F.trim(v["value"])
        high, low = (F.regexp_extract(value, "^([0-9]{2,3}) ?/ ?([0-9]{2,3})", i).try_cast("double") for i in (1, 2))
        plain = F.regexp_extract(value, "^([0-9]+(?:[.][0-9]+)?)", 1).try_cast("double")
        one = lambda n, x: F.struct(n.alias("n"), x.alias("x"))
        return F.when(name == "blood_pressure", F.array(one(F.lit("systolic"), high), one(F.lit("diastolic"), low))).otherwise(F.array(one(name, plain)))

    read = F.filter(F.flatten(F.transform(listed, values)), lambda r: r["n"].isNotNull() & r["x"].isNotNull())
    # from the last to the first, so that the first value of a name stays
    put = lambda kept, r: F.concat(F.array(r), F.filter(kept, lambda k: k["n"] != r["n"]))
    return F.aggregate(F.reverse(read), F.array().cast("array<struct<n:string,x:double>>"), put)


def _prescription(answer: Column) -> Column:
    def medicine(m: Column) -> Column:
        number, unit = N.written_dose(m["text"])
        return F.struct(_medicine_name(m["text"]).alias("name"), number.alias("number"), unit.alias("unit"))

    def fact(m: Column, p: Column) -> Column:
        strength, unit = N.in_mg(m["number"], m["unit"])
        return _fact("medication", p + 1, m["name"], strength, None, unit)

    # a text is taken apart once, as Spark would look for the unit wherever it is compared
    medicines = F.transform(F.transform(answer["medications"], medicine), fact)
    tests = F.transform(answer["investigations"], lambda x, p: _fact("order", p + 1, x))
    advice = F.transform(answer["advice"], lambda x, p: _fact("advice", p + 1, F.lit("advice"), None, x))
    return F.flatten(F.array_compact(F.array(medicines, tests, advice)))


def _lab_report(answer: Column) -> Column:
    rows = F.transform(answer["results"], lambda r, p: F.struct(r["name"]["status"].alias("s"), _fact("observation", p + 1, r["name"]["value"], r["value"], None, r["unit"]).alias("f")))
    return F.filter(rows, lambda r: ~r["s"].eqNullSafe("rejected"))["f"]


def _vitals(answer: Column) -> Column:
    return F.transform(vital_values(answer["vitals"]), lambda v: _fact("vital", F.lit(1), v["n"], v["x"]))


HANDLERS: dict[str, Callable[[Column], Column]] = {"prescription": _prescription, "lab_report": _lab_report, "vitals": _vitals}


def fan_out_answers(answers: DataFrame) -> DataFrame:
    """Fact rows (document_id, fact_type, seq, name, value_num, value_text, unit), by the handler of each document's schema.

    Each answer is read once: its handler makes a list of facts, which then becomes rows."""
    found = F.lit(None)
    for schema, handler in HANDLERS.items():
        found = F.when(F.col("schema_name") == schema, handler(F.col("answer"))).otherwise(found)
    # an outer list, as Spark would make it twice to leave out empty ones
    return answers.select("document_id", F.inline_outer(found)).where("fact_type is not null").select(*_FACT)


def flat_tests(answers: DataFrame) -> DataFrame:
    """One row per recognised test that is not rejected, numbered inside its document, else one ``no_lab_test`` row; the patient's name
    and its status are unwrapped onto every row."""
    kept = F.filter("answer.results", lambda r: (F.coalesce(r["name"]["status"], F.lit("")) != "rejected") & F.coalesce(r["recognised"], F.lit(False)))
    rows = answers.select("document_id", "answer.patient.name", F.posexplode_outer(F.when(F.size(kept) > 0, kept)).alias("p", "r"))
    name = F.nullif("name.value", F.lit(""))
    return rows.select(
        "document_id", name.alias("patient_name"), F.col("name.status").alias("patient_name_status"), F.when(F.col("p").isNull(), "no_lab_test").otherwise("lab_test").alias("row_kind"),
        (F.col("p") + 1).cast("long").alias("seq"), F.col("r.name.value").alias("test"), F.col("r.name.status").alias("test_status"), F.col("r.value").alias("value"),
    )


def document_states(answers: DataFrame) -> DataFrame:
    """(document_id, n_tests, n_medications, status): buckets of an answer, and the document's state by priority."""
    tests, meds = F.coalesce(F.size("answer.results"), F.lit(0)), F.coalesce(F.size("answer.medications"), F.lit(0))
    waiting = F.coalesce(F.exists("answer.results", lambda r: F.coalesce(r["name"]["status"], F.lit("needs_check")) == "needs_check"), F.lit(False))
    status = F.when(F.col("answer").isNull(), "failed").when(waiting, "needs_check").when((tests + meds) == 0, "empty").otherwise("complete")
    return answers.select("document_id", F.greatest(tests, F.lit(0)).cast("long").alias("n_tests"), F.greatest(meds, F.lit(0)).cast("long").alias("n_medications"), status.alias("status"))


def patient_identity(visits: DataFrame, document: str, order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """(document, columns): each value from the first visit, in order, that has it."""
    w = Window.partitionBy(document).orderBy(*order)
    rows = visits.withColumn("_rn", F.row_number().over(w))
    return rows.groupBy(document).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_rn"))).alias(c) for c in columns])
