"""Operators on small literal tables: nulls, ties, repeated keys, empty inputs."""

import random
import re

from pyspark.sql import functions as F

from factloom.functions import normalise as N
from factloom.functions import reading as R2
from factloom.functions import similarity as S
from factloom.operators import answers as A
from factloom.operators import evaluation as E
from factloom.operators import matching as M
from factloom.operators import rules as R
from factloom.operators import tables as T
from factloom.operators import views as V


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_current_rows_ignore_self_and_unknown(spark):
    df = spark.createDataFrame([("a", []), ("b", ["a"]), ("c", ["c"]), ("d", ["zz"])], "id string, s array<string>")
    assert rows(T.current_rows(df, "id", "s").select("id")) == [("b",), ("c",), ("d",)]


def test_supersede_names_current_rows_once(spark):
    new = spark.createDataFrame([("n1", "p", 1), ("n2", "p", 2), ("n3", "q", 1)], "id string, page string, k int")
    old = spark.createDataFrame([("o2", "p"), ("o1", "p")], "id string, page string")
    got = {r.id: r.supersedes for r in T.supersede(new, old, ["page"], "id", [F.col("k")]).collect()}
    assert got == {"n1": ["o1", "o2"], "n2": [], "n3": []}


def test_upsert_keep_does_not_overwrite_with_null(spark):
    old = spark.createDataFrame([(1, "x", 2.0), (2, "y", 3.0)], "k int, a string, b double")
    new = spark.createDataFrame([(1, None, 9.0), (3, "z", None)], "k int, a string, b double")
    got = {r.k: (r.a, r.b) for r in T.upsert_keep(old, new, {"kk": F.col("k")}).collect()}
    assert got == {1: ("x", 9.0), 2: ("y", 3.0), 3: ("z", None)}


def test_snapshot_keeps_changes_only(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, "a")], "k int, t int, v string")
    assert [(r.t, r.version) for r in T.snapshot_versions(df, ["k"], [F.col("t")], ["v"]).orderBy("t").collect()] == [(1, 1), (3, 2), (4, 3)]
    # a missing value and a separator inside a value are content, too
    df = spark.createDataFrame([(1, 1, None, "a"), (1, 2, "a", None), (1, 3, "a|", "b"), (1, 4, "a", "|b"), (1, 5, "a", "|b")], "k int, t int, v string, w string")
    assert [r.t for r in T.snapshot_versions(df, ["k"], [F.col("t")], ["v", "w"]).orderBy("t").collect()] == [1, 2, 3, 4]
    assert T.dedupe_documents(df, "v", ["w"], [F.col("t")]).count() == 4


def test_contract_and_diff(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "k int, v string")
    assert rows(T.contract_violations(df, "k", ["v"], {"v": ["a"]})) == [(2, "v", "missing"), (3, "v", "not allowed")]
    new = spark.createDataFrame([(1, "b"), (2, None), (4, "q")], "k int, v string")
    assert rows(T.table_diff(df, new, ["k"], ["v"])) == [(1, "changed"), (3, "removed"), (4, "added")]


def test_admission_routes(spark):
    known = spark.createDataFrame([("h1", "done"), ("h2", "quality_hold")], "content_hash string, state string")
    new = spark.createDataFrame([("h1",), ("h2",), ("h3",)], "content_hash string")
    assert rows(T.admit_documents(new, known).select("content_hash", "route")) == [("h1", "known"), ("h2", "reprocess"), ("h3", "new")]


def test_gate_order_and_calibration(spark):
    df = spark.createDataFrame([(0.99, False, 0, 0), (0.99, True, 0, 0), (0.96, False, 1, 0), (0.9, False, 0, 0), (0.99, False, 0, 1), (0.2, False, 0, 0)], "c double, p boolean, w long, b long")
    args = [F.col(c) for c in ("c", "p", "w", "b")]
    states = [r[0] for r in df.select(R.gate_state(*args, F.lit("auto"))).collect()]
    assert states == ["auto_accepted", "review", "auto_accepted", "review", "review", "review"]
    assert [r[0] for r in df.select(R.calibrated(*args)).collect()] == [0.99, 0.69, 0.9, 0.9, 0.5, 0.2]


def test_gate_missing_confidence_policy_and_medication(spark):
    df = spark.createDataFrame([(None, False, None, False), (0.99, False, None, False), (0.99, False, 0.995, False), (0.99, False, None, True), (0.99, None, None, None), (0.9876, False, None, False)], "c double, p boolean, m double, med boolean")
    none = F.lit(0)
    conf = R.calibrated(F.col("c"), F.col("p"), none, none)
    assert [r[0] for r in df.select(conf).collect()] == [0.0, 0.99, 0.99, 0.99, 0.99, 0.988]
    states = [r[0] for r in df.select(R.gate_state(conf, F.col("p"), none, none, F.lit("auto"), F.col("m"), F.col("med"))).collect()]
    assert states == ["review", "auto_accepted", "review", "review", "review", "auto_accepted"]
    assert [r[0] for r in df.select(R.gate_state(conf, F.col("p"), none, none, F.lit("review"))).collect()] == ["review"] * 6
    assert df.select(R.capped_confidence(F.col("c"), F.lit("agree"), {"agree": 0.98})).first()[0] == 0.0


def test_audit_sample_of_large_and_text_keys(spark):
    df = spark.range(2000).select((F.col("id") + (1 << 62)).alias("k"))
    n = R.audit_sample(df, "k").count()
    assert 140 < n < 260 and n == R.audit_sample(df, "k").count()
    assert 140 < R.audit_sample(df.withColumn("k", F.concat(F.lit("f-"), F.col("k").cast("string"))), "k").count() < 260


def test_worst_state_keeps_unknown_states(spark):
    df = spark.createDataFrame([(1, "agree"), (1, "none"), (2, "odd"), (2, "agree"), (3, "odd"), (3, "more"), (4, None), (5, None), (5, "odd")], "k int, s string")
    assert rows(R.worst_state(df, "k", "s", ["none", "agree"]).fillna("-")) == [(1, "none"), (2, "agree"), (3, "more"), (4, "-"), (5, "odd")]


def test_conflicts_by_value_and_nulls(spark):
    df = spark.createDataFrame([(1, "x", None, 5.0), (2, "x", None, 5.0 + 1e-9), (3, "x", None, 6.0), (4, "y", "c", None), (5, "y", "c", None), (6, "z", "c", 1.0), (7, "w", "c", None), (8, "w", "c", 2.0)], "id long, p string, code string, v double")
    got = sorted(((r.p, r.keep_id, r.n, r.kind) for r in R.value_conflicts(df, "id", ["p", "code"], "v").collect()))
    assert got == [("w", 7, 1, "value_mismatch"), ("w", 8, 1, "value_mismatch"), ("x", 1, 2, "value_mismatch"), ("x", 3, 1, "value_mismatch"), ("y", 4, 2, "duplicate")]


def test_newest_of_another(spark):
    df = spark.createDataFrame([(1, "a", 1, "u"), (2, "a", 2, "v"), (3, "a", 3, "v"), (4, "b", 9, "u"), (5, "b", 8, "u"), (6, None, 1, "u"), (7, None, 2, "v")], "id int, g string, t int, who string")
    assert rows(T.newest_of_another(df, ["g"], "who", [F.col("t")], "id", "other")) == [(1, 3), (2, 1), (3, 1)]


def test_token_overlap_against_all_pairs(spark):
    rnd = random.Random(6)
    words = [f"w{k}" for k in range(30)]
    left = [(k, rnd.sample(words, rnd.randint(1, 9)) + ["the"]) for k in range(25)] + [(99, []), (98, ["absent"])]
    right = [(k, rnd.sample(words, rnd.randint(3, 25)) + ["the"] * rnd.randint(0, 2)) for k in range(60)]
    a, b = spark.createDataFrame(left, "l int, t array<string>"), spark.createDataFrame(right, "r int, t array<string>")
    got = rows(M.token_overlap_join(a, b, "l", "t", "r", "t", floor=0.6, k=1000).select("l", "r", "shared"))
    assert got == sorted((i, j, len(set(x) & set(y))) for i, x in left for j, y in right if x and len(set(x) & set(y)) >= 0.6 * len(set(x)) - 1e-9)


def test_box_overlap_against_all_pairs(spark):
    rnd = random.Random(8)
    boxes = [(k, k % 3, x := rnd.randint(-50, 300), y := rnd.randint(-50, 300), x + rnd.randint(0, 250), y + rnd.randint(0, 120)) for k in range(80)]
    df = spark.createDataFrame(boxes, "id int, page int, x0 int, y0 int, x1 int, y1 int")

    def share(a, b):
        size = (a[4] - a[2]) * (a[5] - a[3])
        both = max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))
        return both / size if size else 0

    want = {}
    for a in boxes:
        near = [b[0] for b in boxes if b[0] != a[0] and b[1] == a[1] and share(a, b) >= 0.5]
        if near:
            want[a[0]] = (a[1], len(near), min(near))
    got = {r.a_id: (r.page, r.n, r.first_id) for r in M.box_overlap_join(df, df, "page", same=True).collect()}
    assert got == want


def test_entities(spark):
    known = spark.createDataFrame([(1, "A1", "maria lopez", 1980), (2, "A2", "mario lopez", 1950), (3, None, "john smith", None)], "person int, id string, name string, year int")
    cands = spark.createDataFrame([(10, "A2", "other", 1900), (11, None, "maria lopes", 1981), (12, None, "mario lopes", 1981), (13, None, "new person", 2000), (14, None, "john smith", 1970), (15, None, None, None)], "key int, id string, name string, year int")
    got = {r.key: (r.matched, r.method, r.score) for r in M.resolve_entities(cands, known, floor=0.8).collect()}
    assert got[10] == (2, "id", 1.0) and got[11] == (1, "name", 0.9091) and got[14] == (3, "name", 1.0)
    assert got[12] == (1, "name", 0.8182)  # the nearer name belongs to another birth year
    assert got[13] == got[15] == (None, "new", None)


def test_practitioners(spark):
    masters = spark.createDataFrame([(1, "anita rao", "R1", "cardiology"), (2, "anita rac", "R2", "eye"), (3, "victor hugo", "R3", None)], "master int, name string, reg_no string, field string")
    written = spark.createDataFrame([(10, "anita rao", None, "cardiology"), (11, "somebody", "R3", None), (12, "victor hug", None, None), (13, "anita rad", None, "eye"), (14, None, None, None), (15, "victor hugo", "R3", None)], "key int, name string, reg_no string, field string")
    got = {r.key: (r.linked, r.score) for r in M.practitioner_links(written, masters, floor=0.85).collect()}
    assert got[10] == (1, 1.0) and got[11] == (3, 0.9) and got[14] == (None, None)
    assert got[12] == (3, round((1 - 1 / 11) * 0.97, 4)) and got[13] == (None, round(1 - 1 / 9, 4)) and got[15] == (3, 0.99)


def test_alias_cascade_and_collisions(spark):
    aliases = spark.createDataFrame([("Vitamin D", "c1"), ("Vitamin B", "c2"), ("Glucose", "c3")], "alias string, concept string")
    readings = spark.createDataFrame([("Vitamin D",), ("vitamin-d",), ("Vitamin C",), ("Glucoze",), (None,)], "reading string")
    got = M.mark_collisions(M.alias_cascade(readings, aliases), "reading")
    best = {r.reading: (r.concept, r.level, r.collision) for r in got.where("rank = 1").collect()}
    assert best == {"Vitamin D": ("c1", 1, False), "vitamin-d": ("c1", 2, False), "Vitamin C": ("c1", 3, True), "Glucoze": ("c3", 3, False)}


def test_similarities(spark):
    df = spark.createDataFrame([("telma 40", "telma 4o"), ("MARTHA", "MARHTA"), ("same", "same"), (None, "x")], "a string, b string")
    got = [tuple(None if v is None else round(v, 4) for v in r) for r in df.select(S.lev_ratio(F.col("a"), F.col("b")), S.ratcliff("a", "b"), S.jaro_winkler("a", "b")).collect()]
    assert got[0][:2] == (0.875, 0.875) and got[1][2] == 0.9611 and got[2] == (1.0, 1.0, 1.0) and got[3][1:] == (None, None)
    low = spark.range(1).select(S.wilson_lower(F.lit(95), F.lit(100))).first()[0]
    assert round(low, 4) == 0.8882
    words = spark.createDataFrame([(["a", "b", "c"], ["a", "x"]), ([], ["q"])], "a array<string>, b array<string>")
    assert [r[0] for r in words.select(S.word_distance("a", "b")).collect()] == [2, 1]


def test_similarity_join_floor(spark):
    a = spark.createDataFrame([("anna",), ("bob",), (None,)], "a string")
    b = spark.createDataFrame([("anne",), ("bobby",), ("zed",)], "b string")
    assert rows(S.similarity_join(a, b, "a", "b", 0.7).select("a", "b")) == [("anna", "anne")]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, u in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, v in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (u != v))
    return row[-1]


def alike(a, b):
    longest = max(len(a), len(b))
    return 1.0 if longest == 0 else 1.0 - levenshtein(a, b) / longest


def test_whole_join_against_all_pairs(spark):
    rnd = random.Random(2)
    names = ["", "a", "mall ring"] + ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 14))) for _ in range(120)] + ["xyz" * 12, "yz" + "xyz" * 11]
    x, y = spark.createDataFrame([(n,) for n in names[::2]] + [(None,)], "a string"), spark.createDataFrame([(n,) for n in names[1::2]], "b string")
    for floor in (0.7, 0.82, 0.94):
        want = sorted((a, b) for a in set(names[::2]) for b in set(names[1::2]) if alike(a, b) >= floor)
        assert rows(S.whole_join(x, y, "a", "b", floor).select("a", "b")) == want


def test_alias_cascade_finds_a_missing_first_letter(spark):
    aliases = spark.createDataFrame([("small ring", "c1"), ("large ring", "c2")], "alias string, concept string")
    readings = spark.createDataFrame([("mall ring",), ("sall ring",)], "reading string")
    got = {r.reading: (r.concept, r.level) for r in M.alias_cascade(readings, aliases).where("rank = 1").collect()}
    assert got == {"mall ring": ("c1", 3), "sall ring": ("c1", 3)}


def test_snap_words_against_all_pairs(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 14))) for _ in range(150)] + ["antibiotics", "ntibiotics"]
    docs = [(g, d, " ".join(rnd.choice(words[:-2]) for _ in range(90))) for g in "pq" for d in range(4)] + [("p", 10, "Antibiotics x1 "), ("p", 11, "antibiotics"), ("p", 12, "ntibiotics"), ("p", 13, None)]
    want = []
    for g in "pq":
        held = {}
        for _, d, t in (r for r in docs if r[0] == g and r[2]):
            for w in re.findall("[a-z]+", t.lower()):
                held.setdefault(w, set()).add(d)
        for w in (w for w in held if len(held[w]) == 1):
            near = [c for c in held if len(held[c]) > 1 and levenshtein(w, c) <= 2]
            if len(near) == 1:
                want.append((g, w, near[0]))
    assert ("p", "ntibiotics", "antibiotics") in want and len({len(w) for _, w, _ in want}) > 2
    assert rows(N.snap_words(spark.createDataFrame(docs, "source string, doc_id long, text string"), "source", "doc_id", "text")) == sorted(want)


def test_resolve_names_meets_all_customers(spark, sf):
    from factloom.plans import matching as Q

    found = {tuple(r)[:2] for r in Q.resolve_names(spark, sf).collect()}
    c = spark.read.parquet(f"{sf}/customer.parquet").collect()
    made = [(r.c_name[: r.c_custkey % len(r.c_name)] + r.c_name[r.c_custkey % len(r.c_name) + 1 :], r.c_name) for r in c]
    assert found == {(a, b) for a, _ in made for _, b in made if alike(a, b) >= 0.94}
    assert set(made) <= found


def test_word_distance_and_jaro_winkler(spark):
    rnd = random.Random(12)
    pairs = [([rnd.choice("abcde") * rnd.randint(1, 2) for _ in range(rnd.randint(0, 8))] for _ in range(2)) for _ in range(60)]
    pairs = [(x, y) for x, y in pairs] + [(["same"], ["same"]), ([], ["a"])]
    df = spark.createDataFrame(pairs, "x array<string>, y array<string>")
    assert [r[0] for r in df.select(S.word_distance("x", "y")).collect()] == [levenshtein(x, y) for x, y in pairs]
    known = [("DIXON", "DICKSONX", 0.8133), ("DWAYNE", "DUANE", 0.84), ("", "a", 0.0), ("", "", 1.0), ("abc", "xyz", 0.0)]
    df = spark.createDataFrame(known, "x string, y string, s double")
    assert [round(r[0], 4) for r in df.select(S.jaro_winkler("x", "y")).collect()] == [k[2] for k in known]

def test_consensus_votes_mode(spark):
    df = spark.createDataFrame([(1, "abcd"), (1, "abce"), (1, "abcd"), (1, "zzzz"), (2, None)], "k int, v string")
    assert rows(M.consensus(df, "k", "v")) == [(1, "abcd", 2)]
    assert rows(M.votes(df, "k", "v")) == [(1, "abcd", 2)]
    assert [r.v for r in T.mode_with_tie(df, ["k"], "v").collect()] == ["abcd"]


def test_evaluation(spark):
    df = spark.createDataFrame([("s", "a", "a"), ("s", "b", "c"), ("s", "d", None), ("s", None, "e")], "g string, e string, r string")
    t = E.tally(df, ["g"], "e", "r").first()
    assert (t.expected, t.accepted, t.right, t.wrong, t.missed, t.spurious, t.precision, t.recall) == (3, 3, 1, 1, 1, 1, 0.3333, 0.3333)
    scores = spark.createDataFrame([(1.0, 0), (2.0, 0), (2.0, 1), (3.0, 1)], "s double, y int")
    assert E.auc(scores, "s", "y").first().auc == 0.875
    runs = spark.createDataFrame([(i, 0.1) for i in range(25)] + [(25, 0.9)], "t int, v double")
    alarms = E.drift_alarm(runs.withColumn("k", F.lit(1)), ["t"], "v", 200, by=["k"])
    assert [r.t for r in alarms.where("alarm").collect()] == [25]


def test_normalisation(spark):
    df = spark.createDataFrame([("Dr. Mr ANNA  lee-9", "Telma 0.5 g tds for 2 weeks", "05/03/2021", 101.3)], "n string, d string, w string, t double")
    strength, unit = N.dose(F.col("d"))
    day, precision = N.written_date(F.col("w"))
    r = df.select(N.person_name(F.col("n")), strength, unit, N.per_day(F.col("d")), N.duration_days(F.col("d")), day.cast("string"), precision, N.celsius(F.col("t"))).first()
    assert tuple(r) == ("Anna Lee", 500.0, "mg", 3.0, 14, "2021-03-05", "day", 38.5)


def test_empty_tables(spark):
    e = spark.createDataFrame([], "k int, v string")
    assert T.upsert(e, e, ["k"]).count() == 0 and T.table_diff(e, e, ["k"], ["v"]).count() == 0 and M.consensus(e, "k", "v").count() == 0


def test_file_lifecycle(spark, tmp_path):
    from datetime import datetime, timedelta

    from factloom.streaming import jobs as J

    t0 = datetime(2024, 1, 1)
    polls = [("a", "v1", False, 0), ("a", "v1", False, 60), ("b", "v1", True, 0), ("b", "v1", False, 30), ("c", "v1", False, 0), ("c", "v2", False, 60)]
    polls += [("d", "v1", True, 1000 * k) for k in range(4)]
    df = spark.createDataFrame([(f, v, x, t0 + timedelta(seconds=s)) for f, v, x, s in polls], "file string, version string, failed boolean, ts timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = {r.file: (r.version, r.state) for r in J.run_updates(J.file_lifecycle(stream), ["file"], "ts").collect()}
    assert got == {"a": ("v1", "ready"), "b": ("v1", "waiting"), "c": ("v2", "seen"), "d": ("v1", "quarantine")}


def test_batch_release_against_a_loop(spark, sf):
    from factloom.plans import streams as Q

    events = sorted(spark.read.parquet(f"{sf}/events.parquet").collect(), key=lambda r: (r.ts, r.event_id))
    want, held, number = [], {}, {}
    for r in events:
        t, s = r.ts.timestamp(), r.event_type
        n, first = held.get(s, (0, 0.0))
        if n and t - first >= 3 * 3600:
            number[s] = number.get(s, 0) + 1
            want.append((s, number[s], n, "waited"))
            n = 0
        n, first = n + 1, first if n else t
        if n == 5:
            number[s] = number.get(s, 0) + 1
            want.append((s, number[s], n, "full"))
            n = 0
        held[s] = (n, first)
    assert rows(Q.batch_release(spark, sf)) == sorted(want) and {w[3] for w in want} == {"waited", "full"}


def test_drug_lookup_order(spark):
    names = spark.createDataFrame([("brand", "pan"), ("brand", "telma am plus"), ("brand", "telma am"), ("generic", "telmisartan"), ("substance", "amlodipine"), ("brand", "cardiloc")], "kind string, name string")
    texts = spark.createDataFrame([("Tab Telma AM plus 40",), ("telma am 5",), ("pan 40",), ("telmisartan 20",), ("Inj. cardilok",), ("amlodipin 5",), ("xyz",), ("pa",), ("",), (None,)], "t string")
    got = {r.text: (r.kind, r.name, r.fuzzy) for r in R2.drug_lookup(texts, "t", names).collect()}
    assert got == {
        "Tab Telma AM plus 40": ("brand", "telma am plus", False), "telma am 5": ("brand", "telma am", False), "pan 40": ("brand", "pan", False), "telmisartan 20": ("generic", "telmisartan", False),
        "Inj. cardilok": ("brand", "cardiloc", True), "amlodipin 5": ("substance", "amlodipine", True),
    }


def test_list_splitting(spark):
    cases = {"CBC/KFT/LFT": ["CBC", "KFT", "LFT"], "Urine R/E, A/G ratio": ["Urine R/E", "A/G ratio"], "(1) CBC; 2. lft and TSH": ["CBC", "lft", "TSH"], "S. Lipase - 916, cbc, CBC": ["S. Lipase", "cbc"], "": [], None: []}
    df = spark.createDataFrame(list(enumerate(cases)), "k int, t string")
    got = {k: [] for k in range(len(cases))}
    for r in sorted(R2.split_list(df, ["k"], "t").collect(), key=lambda r: (r.k, r.seq)):
        got[r.k].append(r.item)
    assert list(got.values()) == list(cases.values())


def test_numbers_readers_and_ages(spark):
    df = spark.createDataFrame([("1O mg OD", "10 mg OD"), ("Telma 40", "telma 4O"), ("a 40", "a 50"), ("a", ""), (None, ""), ("half 0.5", "half 0.5")], "a string, b string")
    assert [r.state for r in R2.compared_readers(df, "a", "b").collect()] == ["agree", "agree", "disagree", "single", "none", "agree"]
    assert [r[0] for r in df.select(R2.numbers_in(F.col("a"))).limit(2).collect()] == [["10"], ["40"]]
    ages = spark.createDataFrame([("34 yrs",), ("18 months",), ("400",), ("none",), ("7",), (None,)], "t string")
    assert [r[0] for r in ages.select(R2.age_years(F.col("t"))).collect()] == [34, 1, None, None, 7, None]


def test_grounding(spark):
    values = spark.createDataFrame([(1, 1, "Telma 40"), (1, 2, "Telma 80"), (1, 3, "other words here"), (2, 4, "x"), (1, 5, "")], "d int, k int, v string")
    readings = spark.createDataFrame([(1, "Tab Telma 40 1-0-1"), (1, "tab telna 4O once"), (1, None)], "d int, r string")
    got = {r.k: (r.grounded, r.numbers_ok) for r in R2.grounded(values, readings, "d", "k", "v", "r").collect()}
    assert got == {1: (True, True), 2: (False, False), 3: (False, True), 4: (False, False), 5: (True, True)}


def test_dictionary_scan_prefers_longer_names(spark):
    lines = spark.createDataFrame([(1, "Liver function test, CBC and liver"), (2, ""), (3, None)], "k int, t string")
    names = spark.createDataFrame([("liver",), ("liver function",), ("function test",), ("cbc",)], "n string")
    assert rows(R2.dictionary_scan(lines, ["k"], "t", names, "n")) == [(1, 0, 2, "liver function"), (1, 3, 1, "cbc"), (1, 5, 1, "liver")]


def test_one_letter_slips_and_covered_entries(spark):
    known = spark.createDataFrame([("cbc",), ("lft",), ("kft",)], "n string")
    tokens = spark.createDataFrame([("cbo",), ("xft",), ("cbc",), ("c",), ("lfts",)], "t string")
    assert rows(R2.one_letter_slips(tokens, "t", known, "n")) == [("cbo", "cbc")]
    lines = spark.createDataFrame([(1, "one two three four five six"), (1, "zero one two three four five six seven"), (1, "One two three four five six"), (2, "one two three four five six"), (1, "a b"), (1, None)], "d int, e string")
    assert rows(M.covered_entries(lines, "d", "e")) == [(1, "one two three four five six", "zero one two three four five six seven")]


def test_nested_answers(spark):
    good = '{"patient":{"name":{"value":"","status":"x"}},"results":[{"name":{"value":"CBC","status":"rejected"},"value":1,"recognised":true},{"name":{"value":"LFT"},"value":2,"recognised":true},{"name":{"value":"odd"},"recognised":false}],"vitals":[{"name":"BP","value":"120/80"},{"name":"pulse","value":"70/min"},{"name":"HR","value":"71"},{"name":"mood","value":"5"}]}'
    raw = spark.createDataFrame([(1, "lab_report", "{}", 1), (1, "lab_report", good, 2), (2, "vitals", good, 1), (3, "prescription", "no json", 1), (4, "prescription", '{"medications":[{"text":"Tab. Telma 0.5 g","frequency":"1-0-1","duration":"2 weeks"}],"investigations":[],"results":null}', 1), (5, "unknown", "{}", 1)], "document_id long, schema_name string, payload string, created int")
    a = A.latest_answers(raw, "document_id", "payload", [F.desc("created")])
    assert rows(A.flat_tests(a).select("document_id", "row_kind", F.coalesce("seq", F.lit(0)), F.coalesce("test", F.lit("-")))) == [(1, "lab_test", 1, "LFT"), (2, "lab_test", 1, "LFT"), (3, "no_lab_test", 0, "-"), (4, "no_lab_test", 0, "-"), (5, "no_lab_test", 0, "-")]
    facts = rows(A.fan_out_answers(a).select("document_id", "fact_type", "name", F.coalesce("value_num", F.lit(-1.0))))
    assert facts == [(1, "observation", "LFT", 2.0), (1, "observation", "odd", -1.0), (2, "vital", "diastolic", 80.0), (2, "vital", "pulse", 70.0), (2, "vital", "systolic", 120.0), (4, "medication", "Telma", 500.0)]
    assert rows(A.medications(a).select("name", "strength", "unit", "per_day", "days")) == [("Telma", 500.0, "mg", 2.0, 14)]
    assert rows(A.document_states(a).select("document_id", "status")) == [(1, "needs_check"), (2, "needs_check"), (3, "failed"), (4, "complete"), (5, "empty")]


def test_views_on_small_tables(spark):
    log = spark.createDataFrame([(1, "accept", None, 1), (1, "correct", 9.0, 2), (2, "reject", 5.0, 1), (3, "correct", None, 1)], "k int, decision string, new_v double, t int")
    base = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, None)], "k int, v double")
    got = {r.k: (r.v, r.state, r.is_current) for r in V.decisions_applied(base, log, "k", [F.desc("t")], ["v"]).collect()}
    assert got == {1: (9.0, "corrected", True), 2: (2.0, "rejected", False), 3: (3.0, "corrected", True), 4: (None, "pending", True)}
    names = spark.createDataFrame([("Anna Maria Lee", "anna lee", True), ("Anna", "Bob", False), ("a b c", "a b d", True), ("", "x", False), ("smith", "smyth", True)], "a string, b string, fit boolean")
    assert all(r[0] == r[1] for r in names.select(V.name_fit(F.col("a"), F.col("b"), S.lev_ratio(F.col("a"), F.col("b"))), "fit").collect())
    before = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, v string")
    assert rows(V.immutable_violations(before, before)) == [] and rows(V.immutable_violations(before, before.where("k = 1"))) == [(2, None)]


def test_paired_edits(spark):
    cases = [(["cbc", "lft"], ["lft", "cbo"], (1, 6, 0, 0)), (["cbc"], [], (3, 3, 1, 0)), ([], ["x"], (1, 0, 0, 1)), (None, None, (0, 0, 0, 0)), (["aa", "aa"], ["aa"], (2, 4, 1, 0)), (["abc"], ["xyz"], (6, 3, 1, 1))]
    df = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "k int, want array<string>, have array<string>")
    got = {r.k: tuple(r)[1:] for r in E.paired_edits(df, "want", "have").collect()}
    assert [got[k] for k in range(len(cases))] == [c[2] for c in cases]
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(0, 7))) for _ in range(80)]
    df = spark.createDataFrame([(k, [a], [b]) for k, (a, b) in enumerate(zip(words[::2], words[1::2]))], "k int, want array<string>, have array<string>")
    for r in E.paired_edits(df, "want", "have").collect():
        a, b = words[2 * r.k], words[2 * r.k + 1]
        d = levenshtein(a, b)
        assert r.edits == (d if d < max(len(a), len(b)) else len(a) + len(b))


def test_wildcards_priorities_and_feet(spark):
    names = spark.createDataFrame([("smith",), ("smyth",), ("smythe",), ("jones",)], "n string")
    readings = spark.createDataFrame([("sm?th",), ("?ones",), ("zzz",), (None,)], "r string")
    assert rows(R2.wildcard_options(readings, "r", names, "n")) == [("?ones", "jones", 1), ("sm?th", "smith", 1), ("sm?th", "smyth", 2)]
    assert rows(R2.wildcard_options(readings, "r", names, "n", floor=0.6)) == [("?ones", "jones", 1), ("sm?th", "smith", 1), ("sm?th", "smyth", 2), ("sm?th", "smythe", 3)]
    rules = spark.createDataFrame([("heart", "cardiology", 2), ("eye", "eye", 1)], "keyword string, name string, priority int")
    texts = spark.createDataFrame([(1, "Heart and eye"), (1, "x"), (2, "hearts"), (3, None)], "k int, t string")
    assert rows(R2.by_priority(texts, "k", "t", rules)) == [(1, "eye")]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(["cue", "ok", "??", "??", "ok", "??"])], "d int, p int, t string")
    assert rows(R2.near_cue_or_foot(lines, "d", "p", F.col("t") == "??", F.col("t") == "cue")) == [(1, 2, "near a cue"), (1, 5, "at the foot")]
