"""Joins without a block, alignment, names and results beside names, held against all pairs and plain definitions."""

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from factloom.functions import alignment as A
from factloom.functions import names as N
from factloom.functions.similarity import jaro_winkler_ratios, similarity_join
from factloom.operators import results as W


def spellings(seed, n=130):
    rnd = random.Random(seed)
    out = ["", "a", "b", "ab", "ba", "abc", "aab", "éa", "éaé", "  "]
    for _ in range(n // 3):
        word = [rnd.choice("abcdeé ") for _ in range(rnd.randint(1, 18))]
        out.append("".join(word))
        for _ in range(2):
            near = list(word)
            for _ in range(rnd.randint(1, 4)):
                k = rnd.randrange(len(near) + 1)
                near[k : k + rnd.randint(0, 1)] = rnd.choice("abcdeé ") * rnd.randint(0, 2)
            out.append("".join(near))
    return sorted(set(out))


def test_ratcliff_join_finds_all_pairs(spark):
    x, y = spellings(1), spellings(2) + spellings(1)[::3]
    a, b = spark.createDataFrame([(t,) for t in [*x, None]], "s string"), spark.createDataFrame([(t,) for t in y], "t string")
    ratio = {(u, v): difflib.SequenceMatcher(None, u, v, autojunk=False).ratio() for u in x for v in y}
    for floor in (0.5, 0.72, 0.8, 0.9, 1.0):
        got = {(r.a, r.b): r.score for r in similarity_join(a, b, "s", "t", floor, "ratcliff").collect()}
        assert got == {k: s for k, s in ratio.items() if s >= floor}, floor
    with pytest.raises(ValueError):
        similarity_join(a, b, "s", "t", 0.0, "ratcliff")


def jaro_winkler_brute(u, v):
    if u == v:
        return 1.0
    reach, used, left = max(len(u), len(v)) // 2 - 1, set(), []
    for i, c in enumerate(u):
        for j in range(max(0, i - reach), min(len(v), i + reach + 1)):
            if j not in used and v[j] == c:
                used.add(j)
                left.append(c)
                break
    if not left:
        return 0.0
    moved = sum(c != v[j] for c, j in zip(left, sorted(used))) / 2
    plain = (len(left) / len(u) + len(left) / len(v) + (len(left) - moved) / len(left)) / 3
    start = next((k for k in range(4) if u[k : k + 1] != v[k : k + 1] or k >= len(u)), 4)
    return plain + 0.1 * start * (1 - plain)


def test_jaro_winkler_join_finds_all_pairs(spark):
    x, y = spellings(3), spellings(4) + spellings(3)[::3]
    every = [(u, v) for u in x for v in y]
    ratio = dict(zip(every, jaro_winkler_ratios(*map(list, zip(*every)))))
    for (u, v), s in ratio.items():
        assert s == pytest.approx(jaro_winkler_brute(u, v)), (u, v)
    a, b = spark.createDataFrame([(t,) for t in x], "s string"), spark.createDataFrame([(t,) for t in y], "t string")
    for floor in (0.7, 0.85, 0.95):
        got = {(r.a, r.b) for r in similarity_join(a, b, "s", "t", floor, "jaro_winkler").collect()}
        assert got == {k for k, s in ratio.items() if s >= floor}, floor


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def nearest(value, line):
    """Fewest edits, first end, shortest stretch, by all stretches."""
    return min((edits(value, line[i:j]), j, j - i) for i in range(len(line) + 1) for j in range(i, len(line) + 1))


def test_alignment_against_all_stretches():
    rnd = random.Random(9)
    say = lambda n: "".join(rnd.choice("abcé ") for _ in range(n))
    values = [say(rnd.randint(1, 9)) for _ in range(60)] + ["x", "aaaa", say(70), say(64), say(65)]
    lines = [say(rnd.randint(0, 20)) for _ in range(60)] + ["", "aaa", say(30), say(20), say(25)]
    for v, t, (e, begin, end) in zip(values, lines, A.align(values, lines)):
        assert (e, end, end - begin) == nearest(v, t), (v, t)
    long = "the quick brown fox jumps over the lazy dog and runs on and on to the far hills"
    assert A.align([long[:70], ""], ["xx" + long[:69] + "zz", "abc"]) == [(1, 2, 71), (0, 0, 0)]


def notes_brute(values, lines, kind, floor):
    fold = lambda s: re.sub("[^a-z0-9.]+", " ", (s or "").lower()).strip()
    numbers = lambda s: re.findall("[0-9]+(?:[.][0-9]+)?", s)
    out = {}
    for doc, key, value in values:
        v = fold(value)
        if not v:
            continue
        found = []
        for d, at, text in lines:
            t = fold(text)
            if d == doc and t:
                e, end, size = nearest(v, t)
                if e <= int((1 - floor) * len(v) + 1e-9):
                    begin = end - size
                    stretch = re.search("[^ ]*$", t[:begin])[0] + t[begin:end] + re.match("[^ ]*", t[end:])[0]
                    there, wanted = numbers(stretch), numbers(v)
                    found.append((any(there.count(x) < wanted.count(x) for x in wanted), e, at, stretch))
        if not found:
            out[doc, key] = ("retracted", "not on the page")
            continue
        wrong, _, at, stretch = min(found)
        why = "; ".join(["kind not recognised"] * (kind(v) is None) + ["number not on the page"] * wrong)
        out[doc, key] = ("needs check" if why else "checked", why or None, at, stretch)
    return out


def test_notes_are_checked_or_retracted(spark):
    values = [
        (1, "a", "Fasting 12 hrs"), (1, "b", "fastin 12 hrs"), (1, "c", "Fasting 10 hrs"), (1, "d", "Stop all medicines"), (1, "e", "come 8 at 8 morning"), (1, "f", "..!"), (1, "g", None),
        (2, "a", "Fasting 12 hrs"), (2, "b", "bring it"), (2, "c", "walk daily"), (3, "a", "fasting"),
    ]
    lines = [(1, 0, "HbA1c, FBS - fasting 12 hrs"), (1, 1, "Fasting 10hrs, then 8"), (1, 2, "come 8 at the morning"), (1, 3, None), (2, 0, "sugar 112"), (2, 1, "Bring it."), (2, 2, "walk daily 30 min"), (2, 3, "")]
    v, p = spark.createDataFrame(values, "doc int, k string, v string"), spark.createDataFrame(lines, "doc int, at int, t string")
    got = A.grounded_notes(v, p, "doc", "k", "v", "at", "t", A.kind_of(F.col("value")), 0.8).collect()
    want = notes_brute(values, lines, lambda s: "known" if re.search("fasting|bring|morning", s) else None, 0.8)
    assert {(r.doc, r.k): (r.status, r.reason) for r in got} == {k: w[:2] for k, w in want.items()}
    assert {(r.doc, r.k): (r["at"], r.stretch) for r in got if r.status != "retracted"} == {k: w[2:] for k, w in want.items() if len(w) > 2}
    kinds = {(r.doc, r.k): r.kind for r in got}
    assert kinds[1, "a"] == "fasting" and kinds[1, "d"] == "medicine_hold" and kinds[1, "e"] == "timing" and kinds[2, "b"] == "bring_documents" and kinds[2, "c"] is None


def test_notes_at_random(spark):
    rnd = random.Random(4)
    word = lambda: rnd.choice(["walk", "12", "fasting", "food", "3.5", "night", "12.5", "after"])
    lines = [(d, i, " ".join(word() for _ in range(rnd.randint(0, 6)))) for d in range(6) for i in range(4)]
    values = []
    for k in range(60):
        text = list(" ".join(word() for _ in range(rnd.randint(1, 3))))
        if rnd.random() < 0.6:
            text[rnd.randrange(len(text))] = rnd.choice("ax1 ")
        values.append((rnd.randrange(6), k, "".join(text)))
    v, p = spark.createDataFrame(values, "doc int, k int, v string"), spark.createDataFrame(lines, "doc int, at int, t string")
    for floor in (0.6, 0.8):
        got = {(r.doc, r.k): (r.status, r.reason, r["at"], r.stretch) for r in A.grounded_notes(v, p, "doc", "k", "v", "at", "t", F.lit("known"), floor).collect()}
        assert {k: w if w[0] != "retracted" else w[:2] for k, w in got.items()} == notes_brute(values, lines, lambda s: "known", floor)


def test_plain_and_parsed_names(spark):
    rows = ["Dr. Marek Voss, MBBS, MD (Cal)", "Dr.Rao", "Mrs Lena Maria Roy 45 yrs / F", "City Hospital", "", None, "Prof. Dr. A K Das", "one two three four five six seven"]
    got = [r.p for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(N.parsed_name(F.col("t")).alias("p")).collect()]
    assert [(p.given, p.family, p.initials, p.refused) for p in got] == [
        ("Marek", "Voss", "MV", None), (None, "Rao", "R", None), ("Lena Maria", "Roy", "LMR", None), (None, None, None, "organisation"),
        (None, None, None, "empty"), (None, None, None, "empty"), ("A K", "Das", "AKD", None), (None, None, None, "sentence"),
    ]


def score_brute(read, known):
    a, b = read.split(), known.split()
    if not a or not b:
        return 0.0
    full, last = jaro_winkler_brute(read, known), jaro_winkler_brute(a[-1], b[-1])
    if len(a) > 1 and len(b) > 1:
        u, v = a[0], b[0]
        given = jaro_winkler_brute(u, v)
        if 1 in (len(u), len(v)):
            given = min(0.9, 1.0 if u[0] == v[0] else given)
    else:
        given = 0.8
    return round(max(full, 0.6 * last + 0.4 * given) if last >= 0.85 else 0.8 * full, 4)


def people(seed, n=60):
    rnd = random.Random(seed)
    part = lambda: "".join(rnd.choice("abdeinrs") for _ in range(rnd.randint(2, 7)))
    given, last = [part() for _ in range(12)], [part() for _ in range(15)]
    out = []
    for _ in range(n):
        g, s = rnd.choice(given), list(rnd.choice(last))
        if rnd.random() < 0.4:
            s[rnd.randrange(len(s))] = rnd.choice("abdeinrs")
        out.append(" ".join(([g[0] if rnd.random() < 0.3 else g] if rnd.random() < 0.8 else []) + ["".join(s)]))
    return out


def test_name_join_finds_all_pairs(spark):
    x, y = people(1), people(1, 30) + people(2)
    got = {(r.a, r.b): r.score for r in N.name_join(spark.createDataFrame([(t,) for t in x], "s string"), spark.createDataFrame([(t,) for t in y], "t string"), "s", "t", 0.85).collect()}
    assert got == {(u, v): score_brute(u, v) for u in x for v in y if score_brute(u, v) >= 0.85}


def test_practitioners_against_their_rules(spark):
    masters = [(i, "Dr. " + n.title(), f"R-{i}" if i % 3 else None, i % 4) for i, n in enumerate(people(5, 50))] + [(90, "Marek Voss", "WB 9", 1), (91, "Mirja Voss", None, 2), (92, "Zorba Quist", None, 1)]
    written = [(i, n.title(), f"r{i}" if i % 5 == 0 else None, i % 3) for i, n in enumerate(people(6, 40))] + [(90, "Dr M. Voss", None, 1), (91, "Dr M. Voss", "wb-9", 1), (92, "Z Quist", None, 1), (93, "Zorba Quist", None, None), (94, "", None, None), (95, "Nobody Else", "WB9", None)]

    def plain(name):
        return re.sub("[^a-z]+", " ", re.sub(r"\bdr\b", " ", name.lower())).strip()

    want = {}
    number = lambda r: re.sub("[^0-9A-Za-z]", "", r or "").upper()
    for key, name, reg, field in written:
        found = []
        for master, full, m_reg, m_field in masters:
            s = score_brute(plain(name), plain(full))
            if number(reg) and number(reg) == number(m_reg):
                found.append((0.99 if s >= 0.75 or not plain(name) else 0.9, True, master))
            elif s >= 0.87:
                found.append((round(s * (1 if field == m_field else 0.97), 4), False, master))
        found.sort(key=lambda c: (-c[0], -c[1], c[2]))
        words = plain(name).split()
        fits = sum(len(m) > 1 and jaro_winkler_brute(m[-1], words[-1]) >= 0.92 and m[0][0] == words[0] for m in (plain(full).split() for _, full, _, _ in masters)) if len(words) > 1 and len(words[0]) == 1 else 0
        why = "too low" if not found or found[0][0] < 0.9 else None
        if why is None and not found[0][1]:
            why = "near tie" if len(found) > 1 and found[0][0] - found[1][0] < 0.03 - 1e-9 else "ambiguous initial" if fits > 1 else None
        want[key] = (found[0][2] if why is None else None, found[0][0] if found else None, min(5, len(found)), why)
    w, m = spark.createDataFrame(written, "key int, name string, reg_no string, field int"), spark.createDataFrame(masters, "master int, name string, reg_no string, field int")
    got = {r.key: (r.linked, r.confidence, r.n, r.why) for r in N.practitioner_matches(w, m).collect()}
    assert got == want
    assert {"near tie", "too low", None} <= {w[3] for w in want.values()} and want[91][0] == 90 and want[92][0] == 92


def test_results_beside_names(spark):
    names = spark.createDataFrame([(n,) for n in ("LDL", "CBC", "HIV", "HBsAg", "HCV", "Vitamin D", "OH Vitamin D", "TSH", "FBS")], "name string")
    lines = [
        (1, 0, "LDL 88, CBC"), (1, 1, "HIV / HCV / HBsAg : non reactive"), (1, 2, "25 OH vitamin D 31.2 TSH"), (1, 3, "2.5 and FBS 12 hrs"),
        (2, 0, "LDL"), (2, 1, "1 cap daily, LDL 90"), (2, 2, "CBC 5 tabs, TSH 500 mg, FBS 90 mg / dl"),
    ]
    places = W.occurrences(spark.createDataFrame(lines, "doc int, at int, t string"), "doc", "at", "t", names, "name").collect()
    got = {}
    for p in places:
        got.setdefault((p.doc, p.name), []).append(p.valued)
    assert {k: sorted(v) for k, v in got.items()} == {
        (1, "ldl"): [True], (1, "cbc"): [False], (1, "hbsag"): [True], (1, "hcv"): [True], (1, "hiv"): [True], (1, "oh vitamin d"): [True], (1, "tsh"): [True], (1, "fbs"): [False],
        (2, "ldl"): [False, True], (2, "cbc"): [False], (2, "tsh"): [False], (2, "fbs"): [True],
    }
    page = {(r.doc, r.name): r.result for r in W.results_on_page(spark.createDataFrame([(p.doc, p.name, p.valued) for p in places], "doc int, name string, valued boolean"), "doc").collect()}
    assert page[1, "ldl"] and not page[2, "ldl"] and not page[1, "cbc"]
    entries = [(1, 1, "LDL 88, CBC, TSH"), (2, 1, "HIV negative"), (3, 1, "TSH"), (4, 2, "LDL; FBS 90"), (5, 2, "walk"), (6, 1, "HBsAg / HCV / HIV : negative | CBC")]
    out = W.ordered_entries(spark.createDataFrame(entries, "e int, doc int, t string"), "e", "doc", "t", names, "name", spark.createDataFrame(lines, "doc int, at int, l string"), "at", "l")
    assert {r.e: (r.rest, r.status) for r in out.collect()} == {1: ("cbc , tsh", "order"), 2: ("", "result"), 3: ("tsh", "on the page"), 4: ("ldl", "order"), 5: ("walk", "order"), 6: ("cbc", "order")}
