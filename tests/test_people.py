"""Ages and birth dates, the guard against a wrong person, promotion."""

import datetime as dt

from pyspark.sql import functions as F

from factloom.operators import people as P

def now():
    return F.to_date(F.lit("2024-07-01"))


def test_written_dates_and_ages(spark):
    rows = ["1960-02-03", "3/2/1960", "03.02.60", "3-2-24", "3-2-25", "31/02/1999", "2/1999", "", None, "soon"]
    got = [r.d for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(P.dated(F.col("t"), now()).alias("d")).collect()]
    day = dt.date(1960, 2, 3)
    assert got == [day, day, day, dt.date(2024, 2, 3), dt.date(1925, 2, 3), None, None, None, None, None]
    ages = [("45 Y", "1979-05-05"), ("73/F", None), ("6 months", "2024-01-01"), ("130", None), ("old", "soon"), (None, "1979-05-05"), ("40", "1979-05-05"), ("20", "2030-01-01"), ("44", "1979-08-01"), ("", "")]
    out = P.checked_age(spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(ages)], "i int, a string, b string"), "i", "a", "b", now())
    got = {r.i: (r.years, str(r.birth_date) if r.birth_date else None, r.age_status, r.born_status, r.reason) for r in out.collect()}
    apart = "age and date of birth do not agree"
    assert got == {
        0: (45, "1979-05-05", "checked", "checked", None), 1: (73, "1951-01-01", "checked", "absent", None), 2: (0, "2024-01-01", "checked", "checked", None),
        3: (None, None, "needs check", "absent", "age not plausible"), 4: (None, None, "needs check", "needs check", "not a readable date"), 5: (None, "1979-05-05", "absent", "checked", None),
        6: (40, "1979-05-05", "needs check", "needs check", apart), 7: (20, "2004-01-01", "checked", "needs check", "date of birth not plausible"), 8: (44, "1979-08-01", "checked", "checked", None), 9: (None, None, "absent", "absent", None),
    }


def test_a_wrong_persons_facts_are_withdrawn(spark):
    day = dt.date(1980, 1, 1)
    docs = [(1, 1, "Mr Tomas Lindgren", day), (2, 1, "Tomos Lindgrem", None), (3, 1, "Someone Else", day), (4, 1, "Tomas", dt.date(1990, 1, 1)), (5, 1, None, dt.date(1981, 1, 1)), (6, 9, "Nobody", day), (7, 1, "Someone", dt.date(1990, 1, 1))]
    d = spark.createDataFrame(docs, "doc int, person int, name string, birth_date date")
    r = spark.createDataFrame([(1, "Tomas Lindgren", day)], "person int, name string, birth_date date")
    checked, facts = P.guarded(d, r, spark.createDataFrame([(i, 10 * i) for i in range(1, 8)], "doc int, fact int"), "doc", "person")
    assert {x.doc: x.outcome for x in checked.collect()} == {1: "fits", 2: "fits", 3: "another name", 4: "another birth date", 5: "fits", 6: "fits", 7: "another person"}
    assert sorted(x.fact for x in facts.collect()) == [10, 20, 50, 60]


def test_promotion_writes_once(spark):
    rows = [(1, 7, "observation", "accept", 5.0, None), (2, 7, "observation", "correct", 5.0, 6.0), (3, 7, "medication", "correct", 1.0, 1.0), (4, 7, "medication", "reject", 2.0, None), (5, 8, "note", "accept", 3.0, None), (6, 8, "observation", "correct", 4.0, None)]
    e = spark.createDataFrame(rows, "id int, doc int, kind string, decision string, value double, corrected double")
    targets = {"observation": {"result": F.col("final")}, "medication": {"dose": F.col("final")}}
    out = P.promoted(e, e.limit(0), "id", "doc", targets, "me")
    assert sorted(map(tuple, out["observation"].collect())) == [(1, 7, 5.0), (2, 7, 6.0), (6, 8, 4.0)] and [tuple(r) for r in out["medication"].collect()] == [(3, 7, 1.0)]
    assert sorted((r.id, r.agent, r.target) for r in out["provenance"].collect()) == [(1, "me", "observation"), (2, "me", "observation"), (3, "me", "medication"), (6, "me", "observation")]
    assert {r.id: r.outcome for r in out["verification"].collect()} == {1: "confirmed", 2: "changed", 3: "confirmed", 6: "confirmed"}
    assert {r.doc: (r.results, r.n) for r in out["report"].collect()} == {7: ([1, 2], 2), 8: ([6], 1)}
    again = P.promoted(e, out["provenance"].select("id"), "id", "doc", targets, "me")
    assert all(t.count() == 0 for t in again.values())
