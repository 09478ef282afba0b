"""Ranked search, conversation repair and SimHash classes against brute force; nulls, ties, copies, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from oracle import connect, rows_of, sql_rows

from factloom.llm import conversation_repair, oracles, ranked_search, registry, simhash

SCHEMA = "doc_id long, text string, n long, fp long, first string, item string, terms string, row long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "x", "y", "z", 3) for i, t in rows], SCHEMA).repartition(3)


# ---------------------------------------------------------------- ranked search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def search_brute(docs, items, k):
    own = [(i, terms(t)) for i, t in docs]
    own = [(i, Counter(t), len(t)) for i, t in own if t]
    total = sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, c, n in own:
            m = 100 - 75 + 75 * n * len(own) // total
            s = sum(q * math.floor(1000 * math.log((2 * len(own) + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, q in Counter(terms(text)).items() if c[t])
            scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if gone else i, -s) for r, (s, gone, i) in enumerate(sorted(x for x in scored if x[0] < 0)[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("abcdeé0") for _ in range(rnd.randint(1, 3))) for _ in range(60)]
    out = [None, "", " \n", "...", "One,two;THREE", "one two three", "éa-éa É"]
    out += [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 40))) for _ in range(250)]
    return out + out[20:40] * 3 + [" ".join(rnd.choice(vocab) for _ in range(20_000))]


@pytest.mark.parametrize("shard", [64, 1 << 20])
def test_search_against_brute_force(spark, texts, monkeypatch, shard):
    monkeypatch.setattr(ranked_search, "SHARD", shard)
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, texts[30]), (7, texts[31]), (7, texts[31])]
    items = [(str(k), t) for k, t in enumerate(texts[:60])] + [("0", "one"), ("5", texts[5]), (None, "two a")]
    queries = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id string, text string, score string")
    got = sorted((tuple(r) for r in ranked_search.search(frame(spark, docs), queries, 10).collect()), key=str)
    assert got == search_brute(docs, [x for x in items if x[1]], 10)


def test_search_stops_early_and_keeps_ties():
    """An item of one rare and one frequent term reads a part of the frequent list only; equal scores go by id."""
    rnd = np.random.default_rng(1)
    n = 20_000
    per_doc = np.ones(n, dtype=np.int64)
    per_doc[:30] = 2
    terms_ = np.concatenate([[0, 1] * 30, np.zeros(n - 30, dtype=np.int64)]).astype(np.int64)
    impact = rnd.integers(1, 1000, len(terms_))
    impact[: 2 * 30] = 1000
    lists = ranked_search.Lists(terms_, impact, per_doc, 2)
    ids = np.arange(n)[::-1].copy()
    scores, _, found = lists.best(np.array([1, 50]), ids, np.zeros(n, dtype=bool), ranked_search.NOTHING, 10)
    assert scores.tolist() == [51_000] * 10 and found.tolist() == sorted(ids[:30].tolist())[:10]
    assert (lists.scored == lists.now).sum() < n / 10


def test_search_in_blocks_and_empty(spark, texts, monkeypatch):
    docs = frame(spark, list(enumerate(texts[:80])))
    items = spark.createDataFrame([(k, t) for k, t in enumerate(texts[7:30])], "item_id int, text string")
    whole = sorted(tuple(r) for r in ranked_search.search(docs, items).collect())
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", 400)
    assert sorted(tuple(r) for r in ranked_search.search(docs, items).collect()) == whole
    assert ranked_search.search(docs.limit(0), items).count() == 0 == ranked_search.search(docs, items.limit(0)).count()
    assert ranked_search.search(docs, items).dtypes == [("item_id", "int"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


# ---------------------------------------------------------------- conversation repair

CONVERSATIONS = "conv_id long, turn long, role string, text string, kind string, copies int, part string"


def damage_brute(rows):
    out = []
    for conv, turn, role, text in rows:
        space = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def repair_brute(rows):
    """All edits of each row and all places of inserted messages, tried out; rows are (turn, role, text) of one conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    best = []

    def go(i, shape, cost, audit, lines, inserted):
        if not re.fullmatch("s?(ua)*u?", shape) or (best and cost > best[0][0]):
            return
        if inserted < 2:
            for name in ("user", "assistant"):
                go(i, shape + name[0], cost + 5, audit + "I", [*lines, f"{name}:"], inserted + 1)
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", shape):
                best[:] = [min([*best, (cost, audit, "\n".join(lines))])]
            return
        _, role, text = rows[i]
        go(i + 1, shape, cost + 2, audit + "D", lines, 0)
        if faults[i] not in ("blank", "duplicate"):
            extra = 5 if faults[i] else 0
            if role[:1] in ("s", "u", "a"):
                go(i + 1, shape + role[0], cost + extra, audit + "K", [*lines, f"{role}:{text}"], 0)
            for name in ("user", "assistant"):
                go(i + 1, shape + name[0], cost + 1 + extra, audit + "R", [*lines, f"{name}:{text}"], 0)

    go(0, "", 0, "", [], 0)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit, text = best[0]
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def some_conversations():
    rnd = random.Random(11)
    rows = []
    for conv in range(120):
        for turn in range(rnd.randint(1, 6)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rnd.choice(["Hi.", "What now?", "cut of", "Yes! ", " \n", "", None, f"own {turn}.", "Same.", "Same."])
            rows.append((None if conv == 9 else conv, None if rnd.random() < 0.1 else turn * rnd.choice([1, 1, 2]), role, text))
    return rows + rows[40:50]


def repaired_of(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], CONVERSATIONS).repartition(3)
    return df, {r[0]: tuple(r)[1:] for r in conversation_repair.repaired(conversation_repair.damaged(df)).collect()}


def whole_brute(rows):
    return {c: repair_brute([r[1:] for r in damage_brute(rows) if r[0] == c]) for c in {r[0] for r in rows}}


@pytest.mark.parametrize("segment", [1, 2, 512])
def test_repair_against_all_edits(spark, monkeypatch, segment):
    monkeypatch.setattr(conversation_repair, "SEGMENT", segment)
    rows = some_conversations()
    assert repaired_of(spark, rows)[1] == whole_brute(rows)


def test_a_long_conversation_spreads_and_stays_whole(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "SEGMENT", 40)
    rnd = random.Random(3)
    rows = [(1, t, rnd.choice(["user", "assistant"]), rnd.choice(["Yes.", f"words {t}.", f"words {t}"])) for t in range(3000)]
    rows += [(c, 0, "user", "Alone.") for c in (0, 2)]
    own = [r for r in damage_brute(rows) if r[0] == 1]
    df, got = repaired_of(spark, rows)
    assert conversation_repair.repaired(conversation_repair.damaged(df)).columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    # one agenda over all rows
    seen, messages = set(), []
    for _, turn, role, text in sorted(own, key=lambda r: r[1:]):
        first = text.strip() != "" and (role, text) not in seen
        seen.add((role, text))
        messages.append(conversation_repair.Message(turn, role, text, 1, first, not text.strip(), text.strip()[-1:] not in (".", "!", "?")))
    cost, audit = conversation_repair.repair(messages)
    assert got[1][5:7] == (cost, audit)
    assert got[1][7] == hashlib.sha256("\n".join(conversation_repair.written(messages, audit, 0)).encode()).hexdigest()


def test_repair_of_an_empty_table_and_many_copies(spark):
    rows = [(5, 0, "user", "Hello there.")] * 5000
    n = len(damage_brute(rows))
    df, got = repaired_of(spark, rows)
    assert got == {5: (0, 0, n - 1, 0, n - 1, 2 * n, "D" * n, hashlib.sha256(b"").hexdigest())}
    assert conversation_repair.repaired(conversation_repair.damaged(df.limit(0))).count() == 0


def test_lightest_uses_several_antecedents():
    """A deduction from two final items waits for both: the cheapest bracketing of a product of matrices."""
    dims = [10, 30, 5, 60, 8]

    def extend(item, weight, final):
        for (a, b), (other, _) in list(final.items()):
            if b == item[0]:
                yield (a, item[1]), (other[0] + weight[0] + dims[a] * dims[b] * dims[item[1]], "")
            if a == item[1]:
                yield (item[0], b), (other[0] + weight[0] + dims[item[0]] * dims[a] * dims[b], "")

    goal, final = conversation_repair.lightest({(i, i + 1): (0, "") for i in range(4)}, extend, lambda item: item == (0, 4))
    assert final[goal][0][0] == 10 * 30 * 5 + 5 * 60 * 8 + 10 * 5 * 8


# ---------------------------------------------------------------- SimHash


def fingerprint_brute(text, n=3):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_brute(prints, bits):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[:i] ^ prints[i]) <= bits):
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def near_fingerprints(n, rnd):
    """Random fingerprints, some of them a few bits from another, and one dense cluster."""
    out = rnd.integers(0, 1 << 63, n, dtype=np.uint64)
    for k in range(n // 3):
        out[k] = out[rnd.integers(n)] ^ np.bitwise_or.reduce(np.uint64(1) << rnd.integers(0, 64, rnd.integers(1, 5), dtype=np.uint64))
    dense = out[-1] ^ (np.uint64(1) << rnd.integers(0, 12, n // 4, dtype=np.uint64)) ^ (np.uint64(1) << rnd.integers(0, 12, n // 4, dtype=np.uint64))
    return np.unique(np.concatenate([out, dense]))


@pytest.mark.parametrize("leaf", [2, 16, 256])
def test_vantage_point_shards_lose_no_link(monkeypatch, leaf):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    prints = near_fingerprints(1500, np.random.default_rng(leaf))
    want = classes_brute(prints, 2)
    for depth in (0, 1, 5):
        tree = simhash.grow(prints[::7], depth, 2)
        at, node, own = simhash.routes(prints, *tree, 2)
        assert sorted(at[own]) == list(range(len(prints)))  # each is at home in one shard
        a, b = [], []
        for shard in np.unique(node):
            rows = at[node == shard]
            mine = own[node == shard]
            for x, y in simhash.meet(prints[rows], np.flatnonzero(mine), np.flatnonzero(~mine), 2):
                a.append(rows[x])
                b.append(rows[y])
        label = simhash.forest(np.concatenate(a), np.concatenate(b), len(prints))
        assert label.tolist() == want


def test_simhash_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 16)
    monkeypatch.setattr(simhash, "LEAF", 8)
    monkeypatch.setattr(simhash, "PIECE", 50)
    rnd = random.Random(2)
    vocab = ["".join(rnd.choice("abcdeÉ") for _ in range(4)) for _ in range(200)]
    texts = [None, "", " \t", "a", "A b", "a B c", "a  b\nc", "x y z w"]
    for _ in range(25):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(30, 300))]
        texts.append(" ".join(words))
        for k in range(4):
            near = list(words)
            near[rnd.randrange(len(near))] = "changed"
            texts.append(" ".join(near if k else words))
    texts.append(" ".join(rnd.choice(vocab) for _ in range(5000)))
    rows = list(enumerate(texts)) + [(3, "a"), (4, texts[9]), (None, texts[9]), (None, "nobody else says this")]
    got = sorted((tuple(r) for r in simhash.simhash_components(frame(spark, rows)).collect()), key=str)
    prints = np.array([fingerprint_brute(t) for _, t in rows], dtype=np.uint64)
    roots = classes_brute(prints, 2)
    least = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    assert got == sorted(((i, f"{p:016x}", least.get(r)) for (i, _), p, r in zip(rows, prints.tolist(), roots)), key=str)
    assert simhash.simhash_components(frame(spark, rows).limit(0)).count() == 0


def test_queries_match_their_sql(spark, sf):
    con = connect(sf)
    for name in ("op11_ranked_search", "op12_conversation_repair"):
        assert rows_of(registry.QUERIES[name](spark, sf)) == sql_rows(con, oracles.ORACLES[name])
