"""What a job moves or holds grows with its input: sizes of intermediate tables and the joins that a plan uses."""

import contextlib
import io

import numpy as np
from pyspark.sql import functions as F

from factloom.operators import matching as M


def plan_of(df):
    """The physical plan as text, before it runs."""
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        df.explain()
    return said.getvalue()


def test_covered_entries_spread_only_entries_that_meet(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(M, "stored", lambda df: kept.append(df) or df)
    rows = [(d, f"{d} one {i} two {i} three {i} four {i} five") for d in range(20) for i in range(10)]
    rows += [(1, "red green blue black white grey"), (1, "a red green blue black white grey"), (None, "x y"), (None, "x y z"), (2, "..."), (2, "--"), (3, "b c"), (3, "b, c"), (3, "c b")]
    got = M.covered_entries(spark.createDataFrame(rows, "d int, e string"), "d", "e").collect()
    assert sorted((r.d, r.entry, r.by) for r in got) == [(1, "red green blue black white grey", "a red green blue black white grey"), (2, "...", "--"), (3, "b, c", "b c")]
    assert kept[0].count() == 6


def test_left_out_words_send_no_exploded_side_to_all_tasks(spark, sf):
    from factloom.operators.consensus import left_out_words

    df = spark.read.parquet(f"{sf}/conversations.parquet")
    assert "Broadcast" not in plan_of(left_out_words(df, "conv_id", "turn", "text"))


def test_left_out_words_against_all_pairs(spark):
    from random import Random

    from factloom.operators.consensus import left_out_words

    random, rows = Random(5), []
    for g in range(6):
        rows += [(g, t, " ".join("".join(random.choice("ab") for _ in range(random.randint(3, 9))) for _ in range(4))) for t in range(4)]
    rows.append((1, None, "aaa bbb aab"))  # a row without a number says nothing

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            row = [prev := i] + [prev := min(row[j] + (c != d), row[j + 1] + 1, prev + 1) for j, d in enumerate(b)]
        return row[-1]

    said = {}
    for g, t, text in rows:
        for w in text.split() if t is not None else ():
            said.setdefault((g, w), set()).add(t)
    want = {}
    for (g, w), turns in said.items():
        if len(turns) == 1:
            near = [v for (h, v), others in said.items() if h == g and v != w and others - turns and edits(w, v) <= (1 if len(w) < 6 else 2)]
            if len(near) == 1:
                want[g, min(turns), w] = near[0]
    got = left_out_words(spark.createDataFrame(rows, "g int, t int, x string"), "g", "t", "x").collect()
    assert want and {(r.g, r.t, r.word): r.snapped for r in got} == want


def test_similarity_joins_send_no_exploded_side_to_all_tasks(spark, sf):
    from factloom.plans.matching import resolve_names

    assert "Broadcast" not in plan_of(resolve_names(spark, sf))


def test_resolve_entities_meet_once_a_name_and_year(spark):
    known = spark.createDataFrame([(i, i, "ann miller", 1950) for i in range(1, 301)] + [(900, None, "bob miller", None)], "person int, id int, name string, year int")
    asked = spark.createDataFrame([(i, None, "ann miler", 1951) for i in range(300)] + [(500, None, "ann miller", 1990), (501, 7, "x", None), (502, None, None, 1950), (503, None, "bob miller", None)], "key int, id int, name string, year int")
    out = M.resolve_entities(asked, known, floor=0.65)
    got = {r.key: (r.matched, r.method, r.score) for r in out.collect()}
    assert {got[i] for i in range(300)} == {(1, "name", 0.9)}
    assert got[500] == (1, "name", 0.7) and got[501] == (7, "id", 1.0) and got[502][:2] == (None, "new") and got[503] == (900, "name", 1.0)




def test_jaro_winkler_joins_look_at_blocks(spark, sf):
    from factloom.functions.similarity import jaro_winkler_block, jaro_winkler_ratios, similarity_join

    texts = ["", "a", "ab", "ba", "martha", "marhta", "dixon", "dicksonx", "ñez", "ñze", "\U0001f600a", "z" * 300, "z" * 299 + "y", "the", "teh"]
    for floor in (0.65, 0.85, 0.95):
        ratios = {(a, b): jaro_winkler_ratios([a], [b])[0] for a in texts for b in texts}
        i, j = jaro_winkler_block(texts, texts, floor)
        assert {p for p, r in ratios.items() if r >= floor} <= {(texts[u], texts[v]) for u, v in zip(i, j)}
    x = spark.createDataFrame([(t,) for t in texts], "t string")
    found = {(r.a, r.b) for r in similarity_join(x, x, "t", "t", 0.85, "jaro_winkler").collect()}
    assert found == {p for p, r in ratios.items() if r >= 0.85}
    plan = plan_of(similarity_join(x, x, "t", "t", 0.85, "jaro_winkler"))
    assert "MapInArrow" in plan and "SortMergeJoin" not in plan


def test_dictionary_scan_moves_no_word_of_the_text(spark):
    from factloom.functions.reading import dictionary_scan

    lines = spark.createDataFrame([(1, "the token of the day")], "k int, t string")
    names = spark.createDataFrame([("the token",), ("day",)], "n string")
    out = dictionary_scan(lines, ["k"], "t", names, "n")
    assert "SortMergeJoin" not in plan_of(out)
    assert sorted(r.name for r in out.collect()) == ["day", "the token"]


def test_bundles_are_read_once(spark, sf):
    from factloom.plans.pages import bundle_findings

    plan = plan_of(bundle_findings(spark, sf))
    assert plan.count("collect_list") == 2 and "Union" not in plan  # one aggregate in two steps


def test_findings_of_repeated_references_and_ids(spark):
    from factloom.operators import resources as S

    refs = '"r":[{"reference":"P/1"},{"reference":"P/1"},{"reference":"P/2"},{"reference":"Q/9"},{"reference":"A/1"}]'
    entries = ['{"resourceType":"A","id":"1",%s}' % refs, '{"resourceType":"A","id":"1","v":3}', '{"resourceType":"A","id":"1","v":4}', '{"resourceType":"B","v":null}', '{"id":"2"}', '{"resourceType":"P","id":"2"}']
    rows = [(1, '{"entry":[%s]}' % ",".join(entries)), (2, '{"entry":[]}'), (3, None), (4, '{"entry":["text",{"resourceType":"A","id":"1","v":1}]}')]
    out = S.conformance(spark.createDataFrame(rows, "d int, bundle string"), "d", ["A", "C"], {"A": ["v"], "B": ["v", "w.x"]})
    want = {(1, "missing type", "C", 1), (1, "no id", "B", 1), (1, "same id", "A", 1), (1, "dangling reference", "P", 2), (1, "dangling reference", "Q", 1), (1, "no value", "A.v", 1), (1, "no value", "B.v", 1), (1, "no value", "B.w.x", 1)}
    assert {tuple(r) for r in out.collect()} == want | {(4, "missing type", "C", 1), (4, "no id", None, 1)}


def test_bundles_move_no_resource(spark, sf):
    from factloom.plans.pages import document_bundles

    assert plan_of(document_bundles(spark, sf)).count("Exchange hashpartitioning") == 1


def test_not_ordered_looks_for_no_values(spark, sf):
    from factloom.plans.people import not_ordered

    plan = plan_of(not_ordered(spark, sf))
    assert "Window" not in plan and "valued" not in plan


def test_results_on_page_put_places_in_no_order(spark, sf):
    from factloom.operators import results as W
    from factloom.plans.grounding import results_on_page

    assert plan_of(results_on_page(spark, sf)).count("Window [") == 1  # the next line
    lines = spark.createDataFrame([(1, 0, "a b (c"), (1, 1, "12 a / b : positive a positively"), (1, 2, ""), (1, 3, None), (2, 5, "a = - 3.5 % b c")], "d int, l int, t string")
    names = spark.createDataFrame([("a",), ("b",), ("c",), ("b c",)], "n string")
    for longest, places in ((1, 9), (2, 8)):
        got = sorted(tuple(r) for r in W.occurrences(lines, "d", "l", "t", names, "n", longest).collect())
        assert len(got) == places
        assert [(r[1], r[4]) for r in got if r[5]] == [(0, "c"), (1, "a"), (1, "b"), (5, "a")]


def test_notes_are_made_once_and_only_their_pages_are_read_for_them(spark, sf):
    from factloom.plans.grounding import grounded_notes

    plan = plan_of(grounded_notes(spark, sf))
    assert plan.count("documents.parquet") == 1 and "LeftSemi" in plan


def test_few_and_many_starts_of_segments_find_the_same_lines(spark, monkeypatch):
    from factloom.functions import alignment as A

    values = spark.createDataFrame([(1, i, f"word {i} and {i * 7}") for i in range(60)] + [(2, 0, "fasting 12 hrs")], "d int, k int, v string")
    lines = spark.createDataFrame([(1, i, f"a word {i} an {i * 7} b") for i in range(0, 60, 3)] + [(2, 0, "fastng 12 hrs"), (2, 1, ""), (2, 2, None), (3, 0, "fasting 12 hrs")], "d int, at int, t string")
    found = []
    for few in (0, 1000):
        monkeypatch.setattr(A, "FEW", few)
        found.append(sorted(tuple(r) for r in A.near_lines(values, lines, "d", "k", "v", "at", "t", 0.8).collect()))
    assert found[0] == found[1] and len({r[1] for r in found[0] if r[0] == 1}) >= 20 and [r[:2] for r in found[0] if r[0] == 2] == [(2, 0)]


def test_deletion_keys_meet_where_edits_allow():
    from itertools import combinations

    import pyarrow as pa

    from factloom.functions.similarity import _deletion_hashes

    def left(t, k):
        return {"".join(c for x, c in enumerate(t) if x not in gone) for n in range(k + 1) for gone in combinations(range(len(t)), min(n, len(t)))}

    texts = ["", "a", "aa", "ab", "ba", "abc", "cabba", "abbac", "ñez", "\U0001f600a", None, "conditions"]
    for edits in (1, 2):
        keys = [set(k) for k in _deletion_hashes(pa.array(texts), edits).to_pylist()]
        words = [left(t or "", edits) for t in texts]
        assert [len(k) for k in keys] == [len(w) for w in words]
        assert all(bool(keys[i] & keys[j]) == bool(words[i] & words[j]) for i, j in combinations(range(len(texts)), 2))


def test_snapped_words_carry_numbers_and_are_told_apart_once(spark, monkeypatch):
    from factloom.functions import normalise as N

    base = "abcdefghijklmnopqrstuvwxyzabcdefgh"
    docs = [("s", 1, f"{base} word {base[2:]}x"), ("s", 2, f"{base} word wird {base[:-3]}"), ("s", 3, "wo words sword "), (None, 4, "word wort"), ("s", None, "wordy word")]
    df = spark.createDataFrame(docs, "g string, k long, t string")
    found = []
    for long in (0, 5, 32):
        monkeypatch.setattr(N, "LONG", long)
        found.append(sorted(tuple(r) for r in N.snap_words(df, "g", "k", "t").collect()))
    assert found[0] == found[1] == found[2] == [("s", w, "word") for w in ("sword", "wird", "wo", "words")]
    plan = plan_of(N.snap_words(df, "g", "k", "t"))
    assert "ArrowEvalPython" in plan and "Broadcast" not in plan


def test_readings_of_one_small_file_are_dealt_over_all_tasks(spark, sf):
    from factloom.plans.reading import compared_readers

    out = compared_readers(spark, sf)
    assert "RoundRobinPartitioning" in plan_of(out) and out.columns == ["p_partkey", "state"]


def test_keyword_groups_move_no_n_gram(spark, sf):
    from factloom.operators.facts import keyword_groups
    from factloom.plans.facts import keyword_groups as query

    assert "SortMergeJoin" not in plan_of(query(spark, sf)) and "BroadcastHashJoin" in plan_of(query(spark, sf))
    docs = spark.createDataFrame([(1, "An MIT license"), (2, "license-MIT, the"), (3, ""), (4, None), (5, "a b c"), (6, "c")], "d int, t string")
    known = spark.createDataFrame([("mit license", "x"), ("the", "y"), ("a b c", "z"), ("c", "z"), ("c", "w")], "keyword string, group string")
    got = {n: {tuple(r) for r in keyword_groups(docs, "d", "t", known, n).collect()} for n in (1, 2, 3)}
    assert got[1] == {(2, "y"), (5, "z"), (5, "w"), (6, "z"), (6, "w")} and got[2] == got[3] == got[1] | {(1, "x")}


def test_split_orders_make_no_step_twice(spark, sf):
    from factloom.plans.people import split_orders

    plan = plan_of(split_orders(spark, sf)).lower()
    assert "sugar" not in plan  # lists are taken apart before, once


def test_facts_without_evidence_meet_in_no_task(spark):
    from factloom.operators.facts import evidence_rollup

    facts = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None), (4, [None]), (5, ["absent"]), (6, ["b", None]), (7, ["c"]), (None, ["b"]), (2, ["a"])], "k int, ids array<string>")
    blocks = spark.createDataFrame([("a", 0.9, 1, 2, 3, 4), ("b", 0.6, 0, 5, 9, 6), ("c", None, 7, 7, 8, 8), (None, 0.1, 0, 0, 99, 99)], "block_id string, conf double, x0 int, y0 int, x1 int, y1 int")
    out = evidence_rollup(facts, blocks, "k", "ids")
    assert "LeftOuter" not in plan_of(out) and "], true, [block_id" not in plan_of(out)  # no fact is looked up under the id null
    none = (0.5, None, None, None, None)
    want = {1: (0.8, 0, 2, 9, 6), 2: (0.9, 1, 2, 3, 4), 3: none, 4: none, 5: none, 6: (0.6, 0, 5, 9, 6), 7: (0.5, 7, 7, 8, 8), None: (0.6, 0, 5, 9, 6)}
    assert {r.k: tuple(r)[1:] for r in out.collect()} == want and out.count() == len(want)


def test_names_of_documents_are_not_sorted_beside_them(spark):
    from factloom.operators.views import facts_of_documents

    facts = spark.createDataFrame([("f", [1, 2, 2, 9]), ("f", [2, 3]), ("g", []), ("h", None), ("i", [None, 1]), (None, [3])], "fact string, ids array<int>")
    documents = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y"), (3, "x"), (4, "x"), (None, "x")], "d int, t string")
    out = facts_of_documents(facts, documents, "fact", "ids", "d")
    plan = plan_of(out)
    assert "ShuffledHashJoin" in plan and "LeftSemi" in plan and "Sort [" not in plan and out.columns == ["d", "fact"]
    assert sorted((r.d, r.fact or "") for r in out.collect()) == [(1, "f"), (1, "i"), (2, "f"), (3, ""), (3, "f")]


def test_answers_are_made_and_read_once(spark, sf):
    from factloom.operators import answers as A
    from factloom.plans.answers import answer_facts

    plan = plan_of(answer_facts(spark, sf))
    assert plan.count("from_json") == 1 and plan.count("FileScan") == 3
    listed = '[{"name":"mood","value":"5"},{"name":"pulse"},{"name":"BP","value":"n/a"},null,{"name":" Pr ","value":"70/min"},{"name":"HR","value":"71"},{"name":"bp","value":"120 / 80"},{"name":"blood pressure","value":"90/60"},{"value":"3"}]'
    medicines = '[null,{"text":"Inj. X 2 g daily"},{"text":"Cap y 500 MCG"},{"text":"z"},{}]'
    raw = [(1, "vitals", '{"vitals":%s}' % listed), (2, "prescription", '{"medications":%s,"advice":["a",null]}' % medicines), (3, "prescription", '{"investigations":[null,"T"]}'), (4, "lab_report", '{"results":[{"name":{"value":"A","status":"rejected"},"value":1},null,{"name":{"value":"B"},"value":2,"unit":"u"}],"vitals":%s}' % listed), (5, "other", "{}"), (6, None, "{}"), (7, "vitals", None), (8, "prescription", "{}"), (9, "lab_report", "[]")]
    out = A.fan_out_answers(A.latest_answers(spark.createDataFrame(raw, "document_id long, schema_name string, payload string"), "document_id", "payload", [F.lit(1)]))
    assert out.dtypes == [("document_id", "bigint"), ("fact_type", "string"), ("seq", "bigint"), ("name", "string"), ("value_num", "double"), ("value_text", "string"), ("unit", "string")]
    want = {(1, "vital", 1, "pulse", 70.0, None, None), (1, "vital", 1, "systolic", 120.0, None, None), (1, "vital", 1, "diastolic", 80.0, None, None)}
    want |= {(2, "medication", 1, None, None, None, None), (2, "medication", 2, "X", 2000.0, None, "mg"), (2, "medication", 3, "y", 0.5, None, "mg"), (2, "medication", 4, "z", None, None, None), (2, "medication", 5, None, None, None, None)}
    want |= {(2, "advice", 1, "advice", None, "a", None), (2, "advice", 2, "advice", None, None, None), (3, "order", 1, None, None, None, None), (3, "order", 2, "T", None, None, None)}
    want |= {(4, "observation", 2, None, None, None, None), (4, "observation", 3, "B", 2.0, None, "u")}
    got = [tuple(r) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)


def test_few_left_rows_are_sent_to_all_tasks(spark, sf, monkeypatch):
    from random import Random

    from factloom.plans.matching import evidence_overlap

    plan = plan_of(evidence_overlap(spark, sf))
    assert "MapInArrow" in plan and "SortMergeJoin" not in plan and plan.count("documents.parquet") == 1
    random, words = Random(8), [f"w{i}" for i in range(40)]
    left = [(f"l{i}", random.sample(words, random.randint(1, 12)) * random.randint(1, 2)) for i in range(30)] + [("none", []), ("null", None), ("absent", ["zz"]), (None, words)]
    right = [(i, random.choices(words, k=random.randint(1, 60))) for i in range(300)] + [(900, None), (901, []), (902, ["x"]), (903, words), (903, words[:20]), (None, words)]
    a, b = spark.createDataFrame(left, "l string, t array<string>"), spark.createDataFrame(right, "r long, t array<string>")
    found = {}
    for k in (None, 3):
        for sent in (M.SENT, 40, 0):
            monkeypatch.setattr(M, "SENT", sent)
            out = M.token_overlap_join(a, b, "l", "t", "r", "t", floor=0.6, k=k)
            assert ("MapInArrow" in plan_of(out)) == (sent > 40)
            got = (out.dtypes, sorted(tuple(r) for r in out.collect()))
            assert found.setdefault(k, got) == got
        monkeypatch.undo()
    assert len(found[None][1]) > 1000
    empty = a.where("l = 'none'")
    assert M.token_overlap_join(empty, b, "l", "t", "r", "t").count() == 0


def test_lists_of_a_batch_are_paired_together(spark, monkeypatch):
    from random import Random

    import pyarrow as pa

    from factloom.operators import evaluation as E

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            row = [prev := i] + [prev := min(row[j] + (c != d), row[j + 1] + 1, prev + 1) for j, d in enumerate(b)]
        return row[-1]

    def greedy(want, have):
        want, have = ([n for n in v or [] if n is not None] for v in (want, have))
        cost = {(i, j): edits(a, b) for i, a in enumerate(want) for j, b in enumerate(have)}
        left, right, total = set(range(len(want))), set(range(len(have))), 0
        for i, j in sorted(cost, key=lambda p: (cost[p] / max(1, len(want[p[0]]), len(have[p[1]])), p)):
            if i in left and j in right and cost[i, j] < max(len(want[i]), len(have[j])):
                left.remove(i)
                right.remove(j)
                total += cost[i, j]
        return total + sum(len(want[i]) for i in left) + sum(len(have[j]) for j in right), sum(map(len, want)), len(left), len(right)

    random = Random(4)
    names = lambda: None if random.random() < 0.05 else [None if random.random() < 0.05 else "".join(random.choice("abñ\U0001f600") for _ in range(random.randint(0, 7))) for _ in range(random.randint(0, 9))]
    cases = [(k, names(), names()) for k in range(400)]
    out = E.paired_edits(spark.createDataFrame(cases, "k int, want array<string>, have array<string>"), "want", "have")
    assert out.dtypes == [("k", "int")] + [(c, "bigint") for c in ("edits", "length", "missed", "extra")]
    want = [greedy(a, b) for _, a, b in cases]
    assert {r.k: tuple(r)[1:] for r in out.collect()} == dict(enumerate(want))
    asked, whole = [], E.edit_distances
    monkeypatch.setattr(E, "edit_distances", lambda a, b: asked.append(len(a)) or whole(a, b))
    lists = [pa.array([c[k] for c in cases], pa.list_(pa.string())) for k in (1, 2)]
    assert [tuple(r.values()) for r in E._paired(*lists).to_pylist()] == want and len(asked) == 1  # one call for all lists
    monkeypatch.setattr(E, "PAIRS", 20)
    assert [tuple(r.values()) for r in E._paired(*lists).to_pylist()] == want and max(asked[1:]) <= 81


def test_names_are_held_against_each_other_in_blocks(spark, monkeypatch):
    from random import Random

    from factloom.functions import names as N
    from factloom.functions import similarity as S

    random = Random(9)
    word = lambda: "".join(random.choice("abdein") for _ in range(random.randint(1, 7)))
    given, last = [word() for _ in range(25)], [word() for _ in range(12)]
    some = lambda n: sorted({" ".join([random.choice(given) for _ in range(random.choice([0, 1, 1, 1, 2]))] + [random.choice(last)]) for _ in range(n)})
    read, known = some(150), some(150)
    read += [f"{n} " for n in read[:20]]  # what a lost letter may leave
    ratios = N.name_ratios([u for u in read for _ in known], [v for _ in read for v in known])
    all_pairs = dict(zip(((u, v) for u in read for v in known), ratios.tolist()))
    for floor in (0.81, 0.9):
        want = {p: r for p, r in all_pairs.items() if r >= floor}
        for pairs in (101, 1 << 17):
            monkeypatch.setattr(N, "PAIRS", pairs)
            got = {}
            for u, v, score in N.name_pairs(read, known, floor):
                assert len(u) <= pairs
                got.update(zip(zip(u, v), score.tolist()))
            assert want and got == want
    monkeypatch.setattr(N, "BLOCK", 20)  # surnames of more names are cut into pieces
    out = N.name_join(spark.createDataFrame([(n,) for n in read + read[:9] + ["", None]], "r string"), spark.createDataFrame([(n,) for n in known + ["", None]], "k string"), "r", "k", 0.9)
    plan = plan_of(out)
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan and "SortMergeJoin" not in plan  # no pair is a row before its score is known
    found = [tuple(r) for r in out.collect()]
    assert len(found) == len(want) and {(u, v): s for u, v, s in found} == want
    texts = ["", "a", "aaaa", "aaab", "ñoño", "\U0001f600a", "z" * 300, "z" * 299 + "y", *last]
    x = S.Marks(texts)
    i, j = (v.ravel() for v in np.meshgrid(range(len(texts)), range(len(texts))))
    assert (S.jaro_winkler_bound(x, x, i, j) >= S.jaro_winkler_ratios([texts[k] for k in i], [texts[k] for k in j])).all()


def test_masters_of_common_names_do_not_multiply(spark, monkeypatch):
    from random import Random

    from factloom.functions import names as N

    random, seen = Random(2), []
    names = ["ann voss", "a voss", "ana voss", "ann vos", "bob quist", "rob quist", "quist", "zoe", ""]
    masters = [(i if random.random() < 0.8 else random.choice([None, *range(30)]), random.choice(names), random.choice([None, "", f"R-{random.randrange(9)}", f"R-{random.randrange(200)}"]), random.choice([None, 1, 2, 3])) for i in range(300)]
    written = [(i if random.random() < 0.8 else random.choice([None, *range(30)]), random.choice(names), random.choice([None, "-", f"r {random.randrange(9)}", f"r{random.randrange(200)}"]), random.choice([None, 1, 2])) for i in range(200)]
    best = N._best_masters
    monkeypatch.setattr(N, "_best_masters", lambda *a: seen.append((best(*a), a[-1])) or seen[0][0])
    w, m = spark.createDataFrame(written, "key int, name string, reg_no string, field int"), spark.createDataFrame(masters, "master int, name string, reg_no string, field int")
    got = sorted(map(str, (tuple(r) for r in N.practitioner_matches(w, m).collect())))
    listed, n = seen[0]
    classes = {(name, field) for key, name, _, field in written if key is not None and name}
    assert 0 < listed.count() <= n * len(classes)  # however many masters have the name
    number = lambda r: "".join(c for c in r or "" if c.isalnum()).upper()
    pairs = [(u, v) for u in names for v in names]
    scores = dict(zip(pairs, N.name_ratios([u for u, _ in pairs], [v for _, v in pairs]).tolist()))
    found = {}
    for key, name, reg, field in written:
        for master, full, m_reg, m_field in masters if key is not None else ():
            s = scores[name, full]
            if number(reg) and number(reg) == number(m_reg):
                c = (True, 0.99 if s >= 0.75 or not name else 0.9)
            elif s >= 0.87:
                c = (False, round(s * (1 if field is not None and field == m_field else 0.97) + 1e-12, 4))
            else:
                continue
            found.setdefault(key, {})[master] = max(c, found.get(key, {}).get(master, c))
    want = []
    for key, name, _, _ in written:
        top = sorted(((-s, not by, -1 if master is None else master) for master, (by, s) in found.get(key, {}).items()))[:5]
        words, why = name.split(), "too low" if not top or -top[0][0] < 0.9 else None
        if why is None and top[0][1]:
            fits = {master for master, full, _, _ in masters if master is not None and " " in full and N.jaro_winkler_ratios([full.split()[-1]], [words[-1]])[0] >= 0.92 and full[0] == words[0][0]} if words and len(words) > 1 and len(words[0]) == 1 else set()
            why = "near tie" if len(top) > 1 and top[1][0] - top[0][0] < 0.03 - 1e-9 else "ambiguous initial" if len(fits) > 1 else None
        linked = None if why is not None or top[0][2] == -1 else top[0][2]
        want.append((key, linked, "unknown" if not top else "printed_name" if top[0][1] else "registration_no", -top[0][0] if top else None, len(top), why))
    assert got == sorted(map(str, want))


def test_results_on_page_move_lines_once_as_written(spark, sf, monkeypatch):
    import re
    from collections import Counter
    from random import Random

    from factloom.operators import results as W
    from factloom.plans.grounding import results_on_page

    plan = plan_of(results_on_page(spark, sf))
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    random = Random(6)
    parts = ["tsh", "ldl", "oh", "vitamin", "d", "hiv", "12", "3.5", "<7%", "mg", "/", "dl", ":", "negative", "non", "reactive", "a.", ".5", "(", "-", "days", "x,y", "Σας.", "ñ;", " "]
    text = lambda: random.choice([" ", "  ", "\t"]).join(random.choices(parts, k=random.randint(0, 12))) + random.choice(["", " ", "."])
    lines = [(d, i, text()) for d in (1, 2, None) for i in range(40)] + [(3, 0, "ldl"), (3, 1, None), (3, 2, "ldl"), (3, 3, " " + " , " * 45 + "9"), (3, 4, ""), (4, 0, "/ a " * 19 + "tsh / "), (4, 1, "a / " * 30 + "12")]
    names = ["TSH", "LDL", "HIV", "vitamin d", "oh vitamin d", "d", "", None]

    def told(t):
        return [w for w in re.split("[ \t\n\r]+", re.sub("[.](?![0-9])", " . ", re.sub("([/,&+:=();|-])", r" \1 ", t.lower()))) if w]

    known = {" ".join(told(n)) for n in names if n}
    for longest in (1, 3):
        want = Counter()
        for k, (d, i, t) in enumerate(lines):
            own, after = told(t or ""), told(lines[k + 1][2] or "") if k + 1 < len(lines) and lines[k + 1][0] == d else []
            reach = 0
            for at in range(len(own)):
                for n in range(longest, 0, -1):
                    if at + n <= len(own) and at + n > reach and " ".join(own[at : at + n]) in known:
                        behind = " ".join(own[at + n : at + n + W.REACH] + (after[: W.REACH] if at + n + W.REACH > len(own) else []))
                        want[d, i, at, n, " ".join(own[at : at + n]), bool(re.search(W._VALUE, behind)) and not re.search(W._OTHER, behind)] += 1
                        reach = at + n
        assert sum(p[5] for p in want) > 10
        for sent in (W.SENT, 0):
            monkeypatch.setattr(W, "SENT", sent)
            out = W.occurrences(spark.createDataFrame(lines, "d int, l int, t string"), "d", "l", "t", spark.createDataFrame([(n,) for n in names], "n string"), "n", longest)
            assert out.columns == ["d", "l", "place", "n_words", "name", "valued"]
            assert Counter(tuple(r) for r in out.collect()) == want
        monkeypatch.undo()
