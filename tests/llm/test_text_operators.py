"""The ten text operators on small tables: brute force, round trips, nulls, empty and long texts, ties, copies."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import (
    bit_packing,
    bpe,
    decontamination,
    html_extraction,
    language_id,
    ngram_join,
    quality_rules,
    registry,
    substring_dedup,
    token_counts,
    url_filters,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep string, token string, open long"


def texts_of_a_small_corpus():
    """Copies, near copies, shared passages, short and empty texts, one long text."""
    rnd = random.Random(7)
    vocab = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    say = lambda n: [rnd.choice(vocab) for _ in range(n)]
    texts = [None, "", "   \n ", "one", "One two", "one two", "a b c", "A  b\tc"]
    for _ in range(25):
        texts.append(" ".join(say(rnd.randint(5, 200))))
    for _ in range(6):
        words = say(160)
        texts.append(" ".join(words))
        for k in range(9):
            near = list(words)
            for _ in range(k):
                near[rnd.randrange(len(near))] = rnd.choice(vocab)
            texts.append(" ".join(near))
        texts.append(" ".join(words))
    passage = say(60)
    for _ in range(12):
        texts.append(" ".join(say(rnd.randint(0, 90)) + passage[rnd.randint(0, 12) :] + say(rnd.randint(0, 40))))
    texts.append("\n".join(" ".join(say(40)) for _ in range(120)))
    return texts


def frame(spark, texts):
    return spark.createDataFrame([(i, t, ["en", "fr"][i % 2], "s", None, "x", "y", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def corpus():
    return texts_of_a_small_corpus()


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return frame(spark, corpus)


def by_id(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def shingles(text, n):
    w = text.encode().lower().split() if text else []
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(texts, n, percent):
    sets = [shingles(t, n) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * len(a | sets[j]):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_ngram_join_against_all_pairs(docs, corpus, n, percent):
    assert by_id(ngram_join.ngram_components(docs, n, percent).select("doc_id", "n_shingles", "component_id")) == components(corpus, n, percent)


def test_ngram_join_links_small_sets(spark):
    # near copies of 8 and 9 words (4 and 5 shingles, similarity 0.8), each pair in words of its own
    texts = []
    for k in range(3000):
        words = [f"w{k}x{i}" for i in range(9)]
        texts += [" ".join(words[:8]), " ".join(words)]
    got = by_id(ngram_join.ngram_components(frame(spark, texts), 5, 80).select("doc_id", "n_shingles", "component_id"))
    assert got == {i: (4 + i % 2, i - i % 2) for i in range(len(texts))}


def test_ngram_join_repeated_rows_and_empty(spark):
    twice = frame(spark, ["a b c d", "a b c d", None])
    got = sorted(tuple(r) for r in ngram_join.ngram_components(twice.union(twice)).select("doc_id", "n_shingles", "component_id").collect())
    assert got == [(0, 2, 0), (0, 2, 0), (1, 2, 0), (1, 2, 0), (2, 0, 2), (2, 0, 2)]
    assert ngram_join.ngram_components(twice.limit(0)).count() == 0
    assert ngram_join.near_duplicates_removed(twice).columns == twice.columns


def test_ngram_join_missing_and_equal_ids(spark):
    a, b = [" ".join(f"{c}{k}" for k in range(60)) for c in "ab"]
    rows = [(5, a), (2, a + " more"), (2, b), (None, b), (None, "a lone text of its own"), (None, None), (9, ""), (7, "x y z"), (7, "x y z"), (None, "u v w"), (None, "U  v w")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("row", F.lit(2))
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in ngram_join.ngram_components(df).collect())
    want = [(5, 58, 2), (2, 59, 2), (2, 58, 2), (-1, 58, 2), (-1, 4, -1), (-1, 0, -1), (9, 0, 9), (7, 1, 7), (7, 1, 7), (-1, 1, -1), (-1, 1, -1)]
    assert got == sorted(want)
    out = ngram_join.near_duplicates_removed(df)
    assert out.columns == df.columns
    kept = sorted((r.doc_id or -1, r.text or "") for r in out.collect())
    assert [k for k in kept if k[0] != -1] == [(2, a + " more"), (2, b), (7, "x y z"), (7, "x y z"), (9, "")]
    assert sorted(t.lower().split() for i, t in kept if i == -1) == [[], "a lone text of its own".split(), ["u", "v", "w"]]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)]
    got = by_id(ngram_join.components(spark.createDataFrame(edges, "a long, b long")))
    assert set(got.values()) == {(0,), (100,)} and len(got) == 99  # the smallest nodes are left out


def substring_brute(texts):
    seen, out = {}, {}
    own = {i: (t.encode().split() if t else []) for i, t in enumerate(texts)}
    for i, w in own.items():
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k : k + 50]), i)
    for i, w in own.items():
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if seen[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_substring_dedup_against_all_windows(docs, corpus):
    want = substring_brute(corpus)
    assert by_id(substring_dedup.substring_dedup(docs)) == want
    assert sum(w[1] for w in want.values()) > 1000


def test_substring_dedup_missing_and_equal_ids(spark):
    a, b = [" ".join(f"{c}{k}" for k in range(80)) for c in "ab"]
    none = hashlib.sha256(b"").hexdigest()
    rows = [(1, a), (2, "x " + a), (2, "other text"), (2, b), (3, b), (None, a), (None, b + " tail"), (None, "z " * 3), (None, None), (4, None), (3, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("h", F.lit("clash"))
    got = sorted(tuple(r)[1:3] + (r.doc_id or -1,) for r in substring_dedup.substring_dedup(df).collect())
    want = [(80, 0, 1), (81, 80, 2), (2, 0, 2), (80, 0, 2), (80, 80, 3), (80, 80, 3), (80, 80, -1), (81, 80, -1), (3, 0, -1), (0, 0, -1), (0, 0, 4)]
    assert got == sorted(want)
    assert {r.kept_sha256 for r in substring_dedup.substring_dedup(df).where("n_words = n_removed and n_words > 0").collect()} == {none}
    out = substring_dedup.repeats_removed(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in out.collect()) == sorted([(1, a), (2, "x"), (2, "other text"), (2, b), (-1, "tail"), (-1, "z " * 3), (-1, ""), (4, "")])


def test_difference_cover_covers_every_shift():
    cover = set(substring_dedup.COVER)
    for i in range(31):
        for j in range(31):
            assert any((i + h) % 31 in cover and (j + h) % 31 in cover for h in range(31))


def test_substring_dedup_removes_from_texts(docs):
    out = substring_dedup.repeats_removed(docs)
    assert out.columns == docs.columns
    assert sum(v[1] for v in by_id(substring_dedup.substring_dedup(out.limit(0))).values()) == 0
    assert substring_dedup.substring_dedup(docs.limit(0)).count() == 0


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def decontamination_brute(texts, items):
    words = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for name, t in items:
        w = words(t)
        if w:
            n = min(13, len(w))
            for k in range(len(w) - n + 1):
                windows[tuple(w[k : k + n])].add(str(name))
    out = {}
    for i, t in enumerate(texts):
        w, found = words(t), set()
        hit = [0] * len(w)
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if names := windows.get(tuple(w[k : k + n])):
                    found |= names
                    hit[k : k + n] = [1] * n
        h = sum(hit)
        out[i] = (len(w), h, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), h > 0 and 20 * h >= len(w))
    return out


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_decontamination_against_all_windows(spark, monkeypatch, corpus, block):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    rnd = random.Random(3)
    long = [t for t in corpus if t and len(t.split()) > 30]
    items = [(i, " ".join(rnd.choice(long).split()[5:25])) for i in range(8)] + [(9, "Zed's  42 éa"), (10, None), (11, ""), (12, "zed"), (9, "Zed's  42 éa")]
    texts = [*corpus, "x zed S 42 éa y", "Zed!", "q " * 60 + "zed"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.decontaminate(frame(spark, texts), bench)
    assert by_id(got.drop("clean_text")) == decontamination_brute(texts, items)
    clean = {r.doc_id: r.clean_text for r in got.collect()}
    assert clean[len(texts) - 2] == "!" and clean[0] is None
    kept = decontamination.contaminated_removed(frame(spark, texts), bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, v in decontamination_brute(texts, items).items() if not v[4]}
    assert decontamination.contaminated_removed(frame(spark, texts), bench.limit(0)).count() == len(texts)


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_decontamination_missing_equal_and_repeated_rows(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    bench = spark.createDataFrame([(1, "one two three four"), (2, "five six"), (3, "seven eight nine"), (4, None)], "item_id long, text string")
    rows = [(None, "a one two three four"), (None, "clean"), (7, "x five six"), (7, "clean too"), (7, "x five six"), (8, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("spans", F.lit(2)).withColumn("row", F.lit(3))
    got = sorted((r.doc_id or -1, r.n_words, r.n_hit, r.contaminated) for r in decontamination.decontaminate(df, bench).collect())
    assert got == [(-1, 1, 0, False), (-1, 5, 4, True), (7, 2, 0, False), (7, 3, 2, True), (7, 3, 2, True), (8, 0, 0, False), (9, 0, 0, False)]
    out = decontamination.contaminated_removed(df, bench)
    assert out.columns == df.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in out.collect()) == [(-1, "clean"), (7, "clean too"), (8, ""), (9, "")]
    assert decontamination.decontaminate(df.limit(0), bench).count() == 0


def test_language_id(spark):
    rnd = random.Random(1)
    words = {"aa": ["lorn", "plint", "strom", "gleth"], "bb": ["vuma", "zaki", "wuju", "keza"]}
    rows = [(i, " ".join(rnd.choice(words[g]) for _ in range(rnd.randint(4, 30))), g) for i in range(300) for g in [["aa", "bb"][i % 2]]]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 34 !!", "aa"), (1003, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    assert len(got) == len(rows)
    held = [r for r in rows[:300] if got[r[0]].held_out]
    assert len(held) > 30 and all(got[i].lang_pred == g for i, _, g in held)
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in held)
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred in words
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    # without a letter, and the letter that no language knows
    assert language_id.undetermined_removed(df).count() == len(rows) - 4 == language_id.undetermined_removed(df, 0.0).count() - 1


def test_language_id_learns_from_little_text(spark):
    rows = [(1, "plint strom gleth", "aa"), (3, "vuma zaki wuju", "bb"), (4, "vuma zaki wuju", "bb"), (5, "quor dree", "cc"), (5, "quor dree", "cc"), (6, "quor dree" * 5000, "cc"), (None, "zaki", "aa"), (None, None, None)]
    rows = [r for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 4 != 2]
    assert {r[2] for r in rows} >= {"aa", "bb", "cc"}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("h", F.lit("clash")).withColumn("k", F.lit(1))
    got = sorted(((r.doc_id or 0), r.lang_pred, r.held_out) for r in language_id.identify(df).collect())
    want = sorted(((i or 0), "und" if t is None else "bb" if t == "zaki" else g, False) for i, t, g in rows)
    assert got == want
    assert language_id.identify(df.limit(0)).count() == 0


def test_language_id_against_brute_force(spark):
    """Counts per language from plain sets of n-grams decide alike wherever the filters' false positives are no tie."""
    rnd, letters = random.Random(4), "abcdefghijklmnop"
    vocab = {g: ["".join(rnd.choice(letters) for _ in range(rnd.randint(3, 7))) for _ in range(60)] for g in ("aa", "bb", "cc")}
    rows = [(i, " ".join(rnd.choice(vocab[g]) for _ in range(rnd.randint(1, 40))), g) for i in range(240) for g in [("aa", "bb", "cc")[i % 3]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    grams = lambda t: [p for p in (f" {t}   ".encode()[k : k + 4] for k in range(len(t) + 1)) if p[1:3] != b"  " and p[:2] != b"  " and p[2:] != b"  "]
    sets = {g: {x for i, t, h in rows if h == g and zlib.crc32(str(i).encode()) % 4 != 2 for x in grams(t)} for g in vocab}
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    for i, t, _ in rows:
        share = {g: sum(x in s for x in grams(t)) / max(1, len(grams(t))) for g, s in sets.items()}
        first, second = sorted(share.values(), reverse=True)[:2]
        if first - second > 0.05:
            assert got[i].lang_pred == max(share, key=share.get), t
            assert abs(got[i].score - first) < 0.05


def test_language_id_held_out_accuracy(spark, sf):
    rows = language_id.identify(spark.read.parquet(f"{sf}/documents.parquet")).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred != 'und'").collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_language_filters_hold_more_than_eight_languages():
    grams = {f"l{k:02d}": np.arange(k * 1000, k * 1000 + 500, dtype=np.uint32) for k in range(11)}
    f = language_id.Filters.of_grams(grams)
    assert f.planes.shape[0] == 2 and f.false.max() < 0.2


ODD = ["", None, "a", " ", "  x", "x  ", "a\nb", "a \n b", "don't we'll", "é漢🙂 x", "<|endoftext|> a<|endoftext|>", "aaa" * 50, "\xa0z", "x\x1cy", "²Ⅷ", "-...", "A B" * 100, "w" * 5000]


@pytest.fixture(scope="module")
def libraries():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary()), Tokenizer.from_file(token_counts.default_vocabulary())


def test_bpe_equals_library(spark, corpus, libraries):
    texts = [*ODD, *corpus]
    want = {}
    for i, t in enumerate(texts):
        ids = libraries[0].encode(t or "", add_special_tokens=False).ids
        text = libraries[0].decode(ids, skip_special_tokens=False)
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids, text)
    assert by_id(bpe.encode_decode(frame(spark, texts))) == want
    assert bpe.encode_decode(frame(spark, texts).limit(0)).count() == 0


def test_bpe_random_texts_equal_library(libraries):
    rnd = random.Random(5)
    parts = ["a", "b", "th", "e", " ", "  ", "\n", "é", "漢", "1", "'s", "!", "...", "-", "_", " the", "ing", "\r\n", "\t", "<|endoftext|>"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.choice([3, 9, 190, 210, 3000]))) for _ in range(300)]
    ids, at = bpe.Encoder(bpe.default_vocabulary()).encode(texts)
    for t, a, b, w in zip(texts, at, at[1:], libraries[0].encode_batch(texts, add_special_tokens=False)):
        assert ids[a:b].tolist() == w.ids, t


def test_bpe_automaton_arcs_are_the_pairs_that_stand(libraries):
    """An arc is in the tables exactly if the library keeps the two tokens of its text apart as they are."""
    auto, rnd = bpe.automaton(bpe.default_vocabulary()), random.Random(9)
    letters = [t for t, i in libraries[0].get_vocab().items() if t.isascii() and t.isalpha() and len(t) < 6]
    vocab = libraries[0].get_vocab()
    pairs = [(rnd.choice(letters), rnd.choice(letters)) for _ in range(4000)]
    pairs += [(a[:k], a[k:]) for a in rnd.sample(letters, 2000) for k in range(1, len(a)) if a[:k] in vocab and a[k:] in vocab]
    want = [libraries[0].encode(a + b, add_special_tokens=False).ids == [vocab[a], vocab[b]] for a, b in pairs]
    got = auto.arcs(np.array([vocab[a] for a, _ in pairs]), np.array([vocab[b] for _, b in pairs]))
    assert got.tolist() == want and 0 < sum(want) < len(want)


def test_bpe_pattern_comes_from_the_vocabulary():
    byte_level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
    split = {"type": "Split", "pattern": {"Regex": "[a-z]+|."}, "behavior": "Isolated", "invert": False}
    assert bpe.split_pattern({"pre_tokenizer": byte_level | {"use_regex": True}}) == bpe.BYTE_LEVEL
    assert bpe.split_pattern({"pre_tokenizer": {"type": "Sequence", "pretokenizers": [split, byte_level]}}) == "[a-z]+|."
    for bad in ({"pre_tokenizer": {"type": "Whitespace"}}, {"normalizer": {"type": "NFC"}, "pre_tokenizer": byte_level}):
        with pytest.raises(ValueError):
            bpe.split_pattern(bad)


@pytest.mark.parametrize("chunk", [16384, 300])
def test_token_counts_equal_library(spark, corpus, libraries, chunk):
    texts = [*ODD, *corpus, ("b" * 900 + " ") * 20, "x y " * 2000, "<|startoftext|>" * 500]
    got = by_id(token_counts.token_counts(frame(spark, texts), chunk=chunk))
    for i, t in enumerate(texts):
        n = len(libraries[1].encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 2048), repr(t)[:60]


def test_token_counts_repeated_rows_and_missing_ids(spark):
    df = frame(spark, ["x y " * 200, "z"])
    assert token_counts.token_counts(df.union(df), chunk=100).count() == 4
    rows = [(None, "x y " * 200), (None, "x y " * 200), (None, None), (7, "a b " * 300), (7, "c " * 300), (7, "")]
    got = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)), chunk=100)
    want = [(None, 800, 400), (None, 800, 400), (None, 0, 0), (7, 1200, 600), (7, 600, 300), (7, 0, 0)]
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got.collect()) == sorted((i or -1, b, n) for i, b, n in want)
    assert token_counts.token_counts(df.limit(0)).count() == 0


@pytest.mark.parametrize("vocabulary", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_counts_splice_anywhere(spark, vocabulary):
    """Random texts in chunks of 300 characters, also without white space, against the library."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path, rnd = public_tokenizers.path(vocabulary), random.Random(11)
    common = ["the", " the", "ing", " ", "  ", "\n", "\n\n", "é", "漢字", "か", "1", "234", "'s", "n't", "!", "...", "--", "_", "e\u0301", "🙂", "\xa0", "<|endoftext|>", "abc", "Q", "ß", "\t"]
    texts = []
    for i in range(3000):
        parts = rnd.sample(common, rnd.choice([1, 2, 3, 8, 20]))
        texts.append("".join(rnd.choice(parts) for _ in range(rnd.randint(150, 900))))
    texts += ["漢" * 40_000, "b" * 40_000, "ab" * 3_000 + " " + "1" * 5_000, " " * 9_000 + "x", "".join(rnd.choice("etaoinshr") for _ in range(40_000))]
    got = by_id(token_counts.token_counts(frame(spark, texts), vocabulary=path, chunk=300).select("doc_id", "n_tokens"))
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert [i for i, e in enumerate(want) if got[i][0] != len(e.ids)] == []


def test_token_counts_cut_without_white_space(spark):
    """A text without white space is spread over many chunks, and most seams are proven at the first overlap."""
    import public_tokenizers

    path, rnd = public_tokenizers.path("word_bpe_49k.json"), random.Random(2)
    text = "".join(rnd.choice("etaoinshrdlu漢字かな") for _ in range(40_000))
    assert len(token_counts.chunks(len(text), 1000, 250)) == 40
    e = [(c, token_counts.P.library(path).encode(text[c[0] : c[3]], add_special_tokens=False)) for c in token_counts.chunks(len(text), 1000, 250)]
    names = ["key", "seam", "side", "before", "ids", "starts", "ends", "heads", "spans"]
    found = []
    for (left, x), (right, y) in zip(e, e[1:]):
        lo, hi = right[1] - 250, right[1] + 250
        found.append(token_counts.splice(*(dict(zip(names, token_counts._side("k", 1, s, t, c[0], lo, hi))) for s, c, t in ((0, left, x), (1, right, y)))))
    assert sum(n is not None for n in found) >= 38


def test_bit_packing_round_trip(spark, corpus, libraries, tmp_path, monkeypatch):
    monkeypatch.setattr(bit_packing, "BLOCK_IDS", 500)
    texts = [*ODD, *corpus]
    bit_packing.write_packed(frame(spark, texts), str(tmp_path / "p"))
    got, start = by_id(bit_packing.read_packed(spark, str(tmp_path / "p"))), 0
    for i, t in enumerate(texts):
        ids = np.array([*libraries[1].encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        assert got[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    bit_packing.write_packed(frame(spark, texts).limit(0), str(tmp_path / "e"))
    assert bit_packing.read_packed(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 15, 16, 17, 20, 31, 32])
def test_packing_any_width_and_slice(bits):
    v = np.random.default_rng(bits).integers(0, 2**bits, 70_001, dtype=np.uint64).astype(np.uint32)
    p = bit_packing.pack(v, bits)
    assert len(p) == -(-len(v) * bits // 8)
    assert (bit_packing.unpack(p, bits, 0, len(v)) == v).all() and (bit_packing.unpack(p, bits, 65_530, 99) == v[65_530:65_629]).all()


def quality_brute(t):
    w = re.findall("[^\x20\x09-\x0d]+", t or "")
    lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\f\r")]
    n = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    f = [0] * len(w)
    for k in range(len(w) - 4):
        if n[tuple(w[k : k + 5])] > 1:
            f[k : k + 5] = [1] * 5
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), sum(f), len(w) < 10 or 100 * sum(f) > 20 * len(w))


def test_quality_rules(spark, corpus):
    texts = [*ODD, *corpus, "a b c d e " * 6, "x y\nx y\n\n \nx y", "q r s t u v q r s t u"]
    rows = quality_rules.ledger(frame(spark, texts))
    kept = quality_rules.apply_policy(rows)
    got = by_id(kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    for i, t in enumerate(texts):
        assert got[i] == quality_brute(t), repr(t)[:60]
    table = {r.rule: r for r in quality_rules.ablations(rows).collect()}
    failed = [r.failed for r in kept.collect()]
    for k, (name, _) in enumerate(quality_rules.RULES):
        assert table[name].n_failed == sum(f >> k & 1 for f in failed)
        assert table[name].n_kept_without == sum(f & ~(1 << k) == 0 for f in failed)
    assert quality_rules.ledger(frame(spark, texts).limit(0)).count() == 0


def test_quality_rules_repeated_rows_and_clashing_names(spark):
    rows = [(1, "a b c d e f g h i j k"), (1, "a b c d e f g h i j k"), (None, "SHOUT " * 40), (2, None), (2, "x " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("failed", F.lit("x")).withColumn("n_words", F.lit(-1))
    got = sorted((r.doc_id or 0, r.n_words, r.base_failed, r.kept) for r in quality_rules.apply_policy(quality_rules.ledger(df)).collect())
    assert got == [(0, 40, True, False), (1, 11, False, False), (1, 11, False, False), (2, 0, True, False), (2, 30_000, True, False)]


def test_packing_equal_and_missing_ids(spark, tmp_path):
    rows = [(2, "b"), (1, "z z"), (2, "a"), (2, "a"), (None, "q"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit(9)).withColumn("n", F.lit(9))
    bit_packing.write_packed(df, str(tmp_path / "p"))
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in bit_packing.read_packed(spark, str(tmp_path / "p")).collect())
    assert [g[1] for g in got] == [None, None, 1, 2, 2, 2] and [g[2] for g in got] == [1, 2, 3, 2, 2, 2] and [g[0] for g in got] == [0, 1, 3, 6, 8, 10]
    assert got[3][0] == 6 and bit_packing.read_packed(spark, str(tmp_path / "p")).where("doc_id = 2").select("ids_crc32").distinct().count() == 2


def test_url_filters_repeated_rows_and_ties(spark):
    rows = [(1, "http://a.org/x/1"), (1, "http://a.org/x/1"), (None, "http://b.net/es/2"), (None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("l", F.lit(2)).withColumn("purity", F.lit("x"))
    got = sorted((r.page_id or 0, r.host, r.verdict) for r in url_filters.judge_urls(df).collect())
    assert got == [(0, "", "allow"), (0, "b.net", "block"), (1, "a.org", "allow"), (1, "a.org", "allow")]
    both = [("allow", "a.org/x/"), ("block", "a.org/x/")]  # of equally long rules the blocking one wins
    assert {r.verdict for r in url_filters.judge_urls(df.where("page_id = 1"), both).collect()} == {"block"}


def test_bpe_repeated_rows_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, "x" * 100_000)], "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit("x"))
    got = sorted((r.doc_id or 0, r.decoded) for r in bpe.encode_decode(df).collect())
    assert got == [(0, "c"), (1, "a b"), (1, "a b"), (2, "x" * 100_000)]


def test_pipeline_stages_take_odd_rows(spark, tmp_path, corpus):
    import corpus_pipeline

    spark.createDataFrame([(1, "no such words at all here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    rows = [(i, corpus[30 + i], ["en", "fr"][i % 2]) for i in range(8)] + [(3, corpus[33], "fr"), (3, "another text of the same number", "en"), (None, "no number", None), (None, None, None), (50, "", "en"), (51, "long " + "word " * 40_000, "en")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    odd = odd.selectExpr("doc_id", "text", "lang", "'s' as source", "cast(length(text) as long) as n_chars", "1 as key", "'x' as h", "2 as place", "3 as spans", "'r' as row")
    for docs, where in ((odd, tmp_path), (odd.limit(0), tmp_path), (odd, tmp_path / "none")):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(where))
            if name == "tokens":
                assert out.count() == n
            else:
                assert out.columns == docs.columns, name
                assert out.count() <= n
    language = corpus_pipeline.language(spark, odd, str(tmp_path))
    assert language.count() == len(rows) - 2  # the null and the empty text
    assert corpus_pipeline.benchmark(spark, odd, str(tmp_path)).count() == len(rows)


PAGE = (
    "<html><head><title>t</title></head><body><header class=top><h1>Site</h1><a href=x>Home</a></header><nav><ul><li><a href=a>one</a></ul></nav>"
    '<div class="cookie-notice">We use cookies</div><div class="content post-{0}"><h2>Head &amp; tail</h2><p>First <b>para</b>graph number {0}, with some text to be scored.'
    "<div class='ad'>Buy</div><form><p>Name</form><p>Second&nbsp;one   with <a href=z>a link</a>.<br>New line<table><tr><td>c1<td>c2</table><div id=comments><p>reader says so</div></div>"
    "<script>if(a<b)x('</div>')</script><!-- <p>no --><footer>f</footer></body></html>"
)


def test_html_extraction(spark):
    rows = [(i, f"http://h{i % 2}.org/p", PAGE.format(i)) for i in range(6)] + [(10, None, None), (11, "http://x", ""), (12, "x", "just text"), (13, "http://h0.org", "<body><p>other <p>page</body>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("paths", F.lit("clash"))
    got = {r.page_id: r for r in html_extraction.main_texts(df).collect()}
    for i in range(6):
        assert got[i].text == f"Head & tail First paragraph number {i}, with some text to be scored. Second one with a link. New line c1 c2"
        assert got[i].n_chars == len(got[i].text)
    assert [got[i].text for i in (10, 11, 12, 13)] == ["", "", "just text", "other page"]
    assert html_extraction.main_texts(df.limit(0)).count() == 0


def test_html_extraction_repeated_rows_missing_ids_and_ties(spark):
    page = "<body><div class={}><p>Some text of this page that is long enough.</p></div></body>"
    rows = [(None, "http://t.org/1", page.format("a")), (None, "http://t.org/1", page.format("a")), (3, "http://t.org/2", page.format("b")), (3, None, page.format("b")), (4, "", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("vote", F.lit(1))
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html_extraction.main_texts(df).collect())
    assert got == [(0, "Some text of this page that is long enough.", 43)] * 2 + [(3, "Some text of this page that is long enough.", 43)] * 2 + [(4, "", 0)]
    paths = {r.host: r.paths for r in html_extraction.host_paths(df.withColumn("host", html_extraction.host_of())).collect()}
    assert paths["t.org"] == [">body>div.a", ">body>div.b"]


def test_html_extraction_keeps_short_parts():
    long = "A long middle part of the page with many words in it. " * 8
    nav = "<nav><a href=a>Home</a></nav><div class=top><a href=a>One</a> <a href=b>Two</a></div>"
    read = html_extraction.extract
    # parts directly under body, without article or main
    page = f"<body>{nav}<h1>Head</h1><div class=lead><p>Short lead.</p></div><div class=text><p>{long}</p></div><section><p>The end.</p></section><footer>f</footer></body>"
    assert read(page) == f"Head Short lead. {long.strip()} The end."
    # short pieces of one path, and articles of other classes
    page = f"<body>{nav}<article><p>{long}</p></article><aside>no</aside><article><p>Short.</p></article><article class=b><p>Last.</p></article></body>"
    assert read(page) == f"{long.strip()} Short. Last."
    # a host path that holds less than the page's own container does not win
    page = f"<body><div class=page><div class=text><p>{long}</p></div><div class=more><p>{long} Other.</p></div></div></body>"
    whole = f"{long.strip()} {long.strip()} Other."
    assert read(page, [">body>div.page>div.text"]) == read(page, [">body>div.page>div.more"]) == read(page, [">body"]) == whole
    assert read(page, [">body>div.page"]) == whole
    # of two paths that cover the page's own containers, the one with more votes decides
    page = f"<body>{nav}<div class=outer><p>By the way.</p><ul><li><a href=x>Links first</a></ul><div class=inner><article><p>{long}</p></article></div></div></body>"
    inner, outer = long.strip(), f"By the way. Links first {long.strip()}"
    assert read(page, [">body>div.outer>div.inner", ">body>div.outer"]) == inner
    assert read(page, [">body>div.outer", ">body>div.outer>div.inner"]) == outer
    # references at the end of an article stay
    page = f"<body>{nav}<div class=text><p>{long}</p><ul><li><a href=x>Source</a></ul><p>End.</p></div></body>"
    assert read(page) == f"{long.strip()} Source End."


def test_html_extraction_names_are_evidence_only():
    long = "A long middle part of the page with many words in it. " * 8
    read, text = html_extraction.extract, long.strip()
    page = f"<body><article><p>{long}</p><div class=related-work>Related work section</div><div class=social-history>y</div></article></body>"
    assert read(page) == f"{text} Related work section y"
    # a name that says so goes, one that merely contains the word goes with links only, none goes with most of the text
    page = f"<body><article><p>{long}</p><div class='comment-list'><p>Reader says so.</p></div><div id=cookie-notice2>We use cookies.</div><div class=related-reading><a href=a>One</a> <a href=b>Two</a></div></article></body>"
    assert read(page) == text
    assert read(f"<body><div class='search'><p>{long}</p></div><div class=ads>Buy</div></body>") == text
    assert read(f"<body><div class='has sidebar'><div class=sidebar>Side</div><article><p>{long}</p></article></div></body>") == text
    assert read(f"<table><tr><td>menu<td><p>{long}</p><tr><td>{long}</table>") == f"menu {text} {text}"


def test_html_extraction_is_linear_in_nesting():
    import time

    start = time.process_time()
    deep = "<div>x" * 100_000
    assert html_extraction.extract(deep) == " ".join("x" * 100_000)
    assert html_extraction.extract("<div class='a b'><p>word " * 50_000 + "</section>" * 50_000).count("word") == 50_000
    assert html_extraction.extract("<article><p>some text</article>" * 50_000, [">article"]).count("text") == 50_000
    assert time.process_time() - start < 15


def test_url_filters(spark):
    urls = [None, "no url", "HTTP://A.Net/FR/x", "http://x.NET/fr/1?a", "http://www.example.com/en/a/b/c/d", "http://b.example.com/en/1#f", "http://b.example.com/de/1", "https://q.org", "http://net/es/", "http://xnet/es/", "x://q.org/p//7.html"]
    urls += [f"http://spam.net/es/{k}/x" for k in range(20)] + ["http://spam.net/es?x"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("template", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_urls(df).collect()}
    assert got[0] == got[1] == ("", "", None, "allow")
    assert got[2] == ("a.net", "/FR/x", None, "allow") and got[3] == ("x.net", "/fr/1", "net/fr/", "block")
    assert got[4][2:] == ("www.example.com/en/", "allow") and got[5][2:] == ("example.com/en/", "block") and got[6][2:] == ("com/", "allow")
    assert got[7] == ("q.org", "", None, "allow") and got[8][2:] == ("net/es/", "block") and got[9][2:] == (None, "allow")
    assert got[10][1] == "/p//7.html" and len(got) == len(urls)
    assert url_filters.judge_urls(df.limit(0)).count() == 0


@pytest.mark.parametrize("branches", [50, 51])
def test_url_filters_test_every_branch(spark, branches):
    rows = [("wide.net", f"/{'abcdefghij'[k // 10]}{'abcdefghij'[k % 10]}/x{'abcdefghij'[i]}", "block" if k < branches // 2 else "allow") for k in range(branches - 1) for i in range(9)]
    rows += [("wide.net", f"/free/x{'abcdefghij'[i]}", None) for i in range(9)]
    df = spark.createDataFrame(rows, "host string, shape string, verdict string")
    got = {r.shape: (r.template, r.purity) for r in url_filters.templates(df).collect()}
    # a branch that differs from its siblings stays out of '*'; to the unlabelled one they speak as one witness each
    n, bad = branches - 1, branches // 2
    assert {got[s] for _, s, v in rows if v is None} == {(f"/free/x{c}", (bad + 1) / (n + 2)) for c in "abcdefghi"}
    assert all((got[s][1] >= url_filters.PURITY) == (v == "block") for _, s, v in rows)


def test_url_filters_labels_that_differ_below_the_third_segment(spark):
    rows = [("deep.net", f"/a/b/c/{part}/x{c}", v) for part, v in (("good", "allow"), ("bad", "block")) for c in "abcdefghijkl"] + [("deep.net", "/a/b/c/bad", "block"), ("deep.net", "/a/b/c", None)]
    rows += [("long.net", "/s" * 9 + f"/{c}/t", v) for c, v in (("x", "allow"), ("y", "block")) for _ in range(12)]
    df = spark.createDataFrame(rows, "host string, shape string, verdict string")
    got = {r.shape: (r.template, r.purity) for r in url_filters.templates(df).collect()}
    assert got["/a/b/c/good/xa"] == ("/a/b/c/good/*", 1 / 14) and got["/a/b/c/bad/xa"] == ("/a/b/c/bad/*", 13 / 14)
    assert got["/a/b/c"] == ("/a/b/c", 0.5)
    assert got["/s" * 9 + "/x/t"] == ("/s" * 9 + "/x/t", 1 / 14) and got["/s" * 9 + "/y/t"] == ("/s" * 9 + "/y/t", 13 / 14)


def test_url_filters_evidence_of_others(spark):
    """Planted templates without labels of their own: agreement of many places blocks, of few or of mixed ones spares."""
    rows = [(f"h.d{k}.com", "/pills/#", "block") for k in range(10) for _ in range(3)]
    rows += [(f"h{k}.one.com", "/watch/#", "block") for k in range(2) for _ in range(500)]
    rows += [(f"h{k}.two.com", "/mirror/#", "block") for k in range(12)]
    rows += [(f"h.d{k}.com", "/mixed/#", "block" if k % 2 else "allow") for k in range(10)]
    rows += [("wide.org", f"/s{c}/x", "block") for c in "abcdefghijklmnop" for _ in range(2)] + [("wide.org", "/new/y", None), ("narrow.org", "/es/#", "block"), ("narrow.org", "/fr/#", "block"), ("narrow.org", "/en/#", None)]
    free = [("free.org", s, None) for s in ("/pills/#", "/watch/#", "/mirror/#", "/mixed/#", "/other/#")] + [("h99.two.com", "/mirror/#", None)]
    df = spark.createDataFrame(rows + free, "host string, shape string, verdict string")
    got = {(r.host, r.shape): r.purity for r in url_filters.templates(df).collect()}
    blocked = {k for k in [f[:2] for f in free] + [("wide.org", "/new/y"), ("narrow.org", "/en/#")] if got[k] >= url_filters.PURITY}
    assert blocked == {("free.org", "/pills/#"), ("h99.two.com", "/mirror/#"), ("wide.org", "/new/y")}
    assert got["free.org", "/other/#"] == 0.5 and got["free.org", "/pills/#"] == 11 / 12


def test_url_filters_block_a_page_without_a_rule(spark, sf):
    rules = [("block", f"d{k}.com/pills/") for k in range(10)] + [("allow", "com/")]
    urls = [f"http://h.d{k}.com/pills/{i}" for k in range(10) for i in range(3)] + ["http://shop.org/pills/7", "http://shop.org/about/7", None, "http://shop.org/pills/7"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters.judge_urls(df, rules).collect()}
    assert [got[i] for i in range(30, 34)] == [(None, "block"), (None, "allow"), (None, "allow"), (None, "block")]


def test_registered_names():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES if n.startswith("op")) == list(range(1, 11))
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_pipeline_against_brute_force(spark, tmp_path, corpus, libraries):
    import corpus_pipeline

    texts = [t for t in corpus if t is None or len(t) < 3000] + ["12 34"]
    items = [(1, " ".join(texts[20].split()[:30]))]
    frame(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    live = {i: t for i, t in enumerate(texts) if t and re.search(r"[^\W\d_]", t)}
    ids = sorted(live)
    comp = components([live[i] for i in ids], 5, 80)
    live = {i: live[i] for k, i in enumerate(ids) if comp[k][1] == k}
    ids = sorted(live)
    seen = {}
    for i in ids:
        w = live[i].split()
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k : k + 50]), i)
    cut = {}
    for i in ids:
        w = live[i].split()
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if seen[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        cut[i] = " ".join(x for x, g in zip(w, gone) if not g) if any(gone) else live[i]
    cut = {i: t for i, t in cut.items() if t}
    ids = sorted(cut)
    bad = decontamination_brute([cut[i] for i in ids], items)
    want = {i: libraries[0].encode(cut[i], add_special_tokens=False).ids for k, i in enumerate(ids) if not bad[k][4]}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want
