"""Lists of tests taken apart, what is no test, the grammar of doses."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import orders as O

NAMES = ["CBC", "KFT", "LFT", "HbA1c", "FBS", "PPBS", "TSH", "FT4", "Lipase", "CRP", "Urea", "A/G ratio", "Urine R/E", "CK-MB", "D-dimer", "Blood urea nitrogen", "OPG", "Vitamin D", "S. Lipase"]
LISTS = {
    "TSH/LFT/KFT": ["TSH", "LFT", "KFT"],
    "CRP/Urea/S LIPASE FT4/PPBS": ["CRP", "Urea", "S LIPASE", "FT4", "PPBS"],
    "Serum: Urea, CRP, KFT": ["Urea", "CRP", "KFT"],
    "A/G ratio, Urine R/E": ["A/G ratio", "Urine R/E"],
    "new R/E and CBC": ["new R/E", "CBC"],
    "CK-MB; HbA1c-FBS": ["CK-MB", "HbA1c", "FBS"],
    "X-ray left knee": ["X-ray left knee"],
    "vTSH vLFT": ["TSH", "LFT"],
    "TSHLFT": ["TSH", "LFT"],
    "TSHLFTxyz": ["TSHLFTxyz"],
    "Blood urea nitrogen": ["Blood urea nitrogen"],
    "Blood Sugar F/PP": ["Blood sugar F", "Blood sugar PP"],
    "CBC, Sugar F PP + TSH": ["CBC", "Blood sugar F", "Blood sugar PP", "TSH"],
    "(1) CBC 2. LFT": ["CBC 2. LFT"],
    "1) {HbA1c - 7.8}, 2) TSH": ["HbA1c", "TSH"],
    "✓CBC ✓ KFT": ["CBC", "KFT"],
    "cbc, CBC, Cbc": ["cbc"],
    "serum": ["serum"],
    "": [],
}


def test_lists_are_taken_apart(spark):
    names = spark.createDataFrame([(n,) for n in NAMES], "n string")
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(LISTS)] + [(99, None)], "i int, t string")
    got = {}
    for r in sorted(O.split_orders(rows, ["i"], "t", names, "n").collect(), key=lambda r: (r.i, r.seq)):
        got.setdefault(r.i, []).append(r.item)
    assert {t: got.get(i, []) for i, t in enumerate(LISTS)} == LISTS and 99 not in got


def glue_brute(word, names):
    best = {0: []}
    for i in range(1, len(word) + 1):
        found = [best[j] + [word[j:i]] for j in range(max(0, i - 12), i - 1) if j in best and word[j:i] in names]
        if found:
            best[i] = min(found, key=lambda p: (len(p), p))
    return best.get(len(word))


def test_glued_words_against_a_loop(spark):
    import random

    rnd = random.Random(6)
    names = {"".join(rnd.choice("ab") for _ in range(rnd.randint(2, 4))) for _ in range(9)}
    words = sorted({"".join(rnd.choice(sorted(names)) for _ in range(rnd.randint(1, 4))) + rnd.choice(["", "", "a"]) for _ in range(80)})
    got = {r.word: r.parts for r in O.glued(spark.createDataFrame([(w,) for w in words], "w string"), "w", spark.createDataFrame([(n,) for n in names], "n string"), "n").collect()}
    want = {w: glue_brute(w, names) for w in words if len(w) >= 4}
    assert {w: len(p) for w, p in got.items()} == {w: len(p) for w, p in want.items() if p and len(p) >= 2}
    assert all("".join(p) == w and set(p) <= names for w, p in got.items())


def test_what_is_no_test(spark):
    lines = [
        (1, 0, "MRI brain, CBC"), (1, 1, "Eye clinic ● Dental ● Zinc ● MRI"), (1, 2, "Tab Zincovit, Zinc 1-0-1 x 5d"), (1, 3, "Ph. 98765"), (1, 4, "OPG"),
        (2, 0, "Tab Zinc 20 mg od"), (2, 1, "Zinc level"), (2, 2, "physiotherapy, TENS"),
    ]
    names = [(1, "MRI brain"), (1, "CBC"), (1, "Zinc"), (1, "Ph."), (1, "OPG"), (2, "Zinc"), (2, "TENS"), (2, "1-0-1 x 5d")]
    out = O.not_ordered(spark.createDataFrame(names, "doc int, n string"), "n", spark.createDataFrame(lines, "doc int, at int, t string"), "doc", "at", "t", spark.createDataFrame([("OPG",)], "p string"))
    assert {(r.doc, r.name): r.reason for r in out.collect()} == {
        (1, "mri brain"): "imaging", (1, "ph."): "phone label", (1, "cbc"): "in a line: imaging", (1, "zinc"): "in a line: list of services", (1, "opg"): "in a line: imaging", (2, "tens"): "physiotherapy", (2, "1-0-1 x 5d"): "medicine order",
    }


@pytest.mark.parametrize(
    ("kind", "text", "want"),
    [
        ("strength", "40 mg", (40.0, "mg")), ("strength", "0.5MG", (0.5, "mg")), ("strength", "5 mg/5ml", (5.0, "mg/5ml")), ("strength", "40", None), ("strength", "mg 40", None), ("strength", None, None),
        ("pattern", "1-0-1", [1.0, 0.0, 1.0]), ("pattern", "½ - 0 – 1/2", [0.5, 0.0, 0.5]), ("pattern", "1-1-1-1", [1.0] * 4), ("pattern", "1-0", None), ("pattern", "9-0-1", None),
        ("times", "B.D.", 2.0), ("times", "1-0-1", 2.0), ("times", "often", None), ("times", "sos", 0.0),
        ("days", "x 5d", 5), ("days", "2 wks", 14), ("days", "x 1/52", 7), ("days", "1 month", 30), ("days", "9999 days", None), ("days", "long", None),
    ],
)
def test_grammar(spark, kind, text, want):
    read = {"strength": O.strength, "pattern": O.dose_pattern, "times": O.times_a_day, "days": O.duration_days}[kind]
    got = spark.createDataFrame([(text,)], "t string").select(read(F.col("t")).alias("r")).first().r
    assert (tuple(got) if kind == "strength" and got else got) == want


def test_medicine_grammar(spark):
    df = spark.createDataFrame([(1, "40 mg", "bd", "5 days"), (2, "forty", "1-0-1", ""), (3, None, "daily?", "x 900 weeks")], "k int, s string, f string, d string")
    got = {(r.k, r.field): (r.value, r.problem) for r in O.medicine_grammar(df, "k", strength="s", frequency="f", duration="d").collect()}
    assert got == {
        (1, "strength"): ("40.0 mg", None), (1, "frequency"): ("2.0", None), (1, "duration"): ("5", None), (2, "strength"): (None, "not a number with a unit"), (2, "frequency"): ("2.0", None),
        (3, "frequency"): (None, "not a known frequency"), (3, "duration"): (None, "not a plausible duration"),
    }
