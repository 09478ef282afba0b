"""Pages in forms, ambiguous class names, hosts with many page types; texts that no language knows."""

import pytest
from pyspark.sql import functions as F

from factloom.llm import html_extraction, language_id

LONG = "A long middle part of the page with many words in it. " * 8
TEXT = LONG.strip()


def test_a_form_around_the_page_is_a_container():
    read = html_extraction.extract
    page = f"<body><form id='aspnetForm'><nav><a href=a>Home</a></nav><div><article><p>{LONG}</p></article></div><input name=q></form></body>"
    assert read(page) == TEXT
    # without an article: most of the text, and prose
    page = f"<body><form id='aspnetForm'><div class=top><a href=a>One</a></div><div class=text><p>{LONG}</p><p>The end.</p></div></form><footer>f</footer></body>"
    assert read(page) == f"{TEXT} The end."
    assert read("<body><form><article><p>Main story.</p></article></form></body>") == "Main story."
    # forms that are forms: beside the text, in an article, alone on the page
    page = f"<body><article><p>{LONG}</p><form><p>Your name</p><p>{LONG[:100]}</p></form></article></body>"
    assert read(page) == TEXT
    assert read("<body><form><p>Name</p><p>Password</p><button>Send</button></form></body>") == ""


def test_ambiguous_names_need_more_than_a_last_part():
    read = html_extraction.extract
    page = f"<body><article><p>{LONG}</p><div class='market-share'><p>Share section text.</p></div><section id='job-search'><p>Search section.</p></section><div class=public-notice>By law.</div></article></body>"
    assert read(page) == f"{TEXT} Share section text. Search section. By law."
    # mostly links, a name of nothing else, or a word that is never an article
    page = (
        f"<body><article><p>{LONG}</p><div class='story-share'><a href=a>Share it</a></div><div class=search-box>Find</div><div class=cookie-notice>Cookies</div>"
        "<div class='reader-comments'><p>I disagree.</p></div><div class='magazine-sidebar'>Side</div></article></body>"
    )
    assert read(page) == TEXT


def test_pages_without_an_article_keep_their_whole_text(spark):
    """Ten layouts of one host, none with an article: each page's text is that of its own container."""
    rows, want = [], {}
    for i in range(60):
        k = i % 10
        body = f"<h1>Head {i}</h1><p>{LONG}</p><ul><li>point {i}</li></ul><p>End of {i}.</p>"
        layout = f"<div class='kind{'abcdefghij'[k]}'>{body}</div>" if k < 7 else f"<table><tr><td class='c{'abcdefghij'[k]}'>{body}</td></tr></table>"
        rows.append((i, "http://one.org/p", f"<body><div class=top><a href=a>Home</a> <a href=b>More</a></div>{layout}<div class=footer>(c)</div></body>"))
        want[i] = f"Head {i} {TEXT} point {i} End of {i}."
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extraction.main_texts(df).collect()} == want


@pytest.mark.parametrize("paths", [1, 100])
def test_hosts_with_many_paths_choose_alike(spark, monkeypatch, paths):
    """The votes of a fourth and fifth page type count as those of the first, whichever way they reach the page."""
    rows = []
    for k, kind in enumerate("abcde"):
        inner = f"<div class='outer {kind}'><p>By the way.</p><div class='inner {kind}'><article><p>{LONG}</p></article></div></div>"
        rows += [(10 * k + i, "http://h.org/x", f"<body>{inner}</body>") for i in range(2)]
        # the same layout without an article: its own container is the outer one, which then gets the more votes
        rows += [(100 + 10 * k + i, "http://h.org/y", f"<body>{inner.replace('article>', 'div>')}</body>") for i in range(4)]
    rows += [(900, None, None), (901, "http://single.org", f"<body><div class=q><p>{LONG}</p></div></body>"), (0, "http://h.org/x", rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("clash")).withColumn("key", F.lit(1))
    monkeypatch.setattr(html_extraction, "PATHS", paths)
    got = {r.page_id: r.text for r in html_extraction.main_texts(df).collect()}
    assert len(got) == len(rows) - 1 and got[900] == "" and got[901] == TEXT
    outer = f"By the way. {TEXT}"
    assert {i: t for i, t in got.items() if i < 900} == {i: outer for i, _, _ in rows if i < 900}


def test_the_language_stage_rejects_what_no_language_knows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    noise = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(["привет мир и ещё немного слов", "qxzj vwkq zzxq jjqv xkcd qqqq", "漢字 漢字 漢字"])], "doc_id long, text string")
    both = docs.unionByName(noise, allowMissingColumns=True)
    kept = {r.doc_id for r in language_id.undetermined_removed(both).select("doc_id").collect()}
    assert not kept & {10**9 + i for i in range(3)}
    # no labelled document goes, the held-out ones included
    labelled = {r.doc_id for r in docs.where("lang is not null and text rlike '[a-zA-Z]'").select("doc_id").collect()}
    assert labelled <= kept
    scores = language_id.identify(both).where("held_out").join(docs.where("lang is not null").select("doc_id"), "doc_id").agg(F.min("score")).first()[0]
    assert scores > 2 * language_id.LEAST


def test_long_items_are_cut_into_blocks_of_a_bounded_size(spark, monkeypatch):
    """An item longer than a block, and documents with a passage at any of its places, also over the cuts; a very long document."""
    import random

    from factloom.llm import decontamination

    rnd = random.Random(12)
    words = [f"w{k}" for k in range(3000)]
    item = [rnd.choice(words) for _ in range(4000)]
    texts = [" ".join(["x"] * 3 + item[at : at + 13] + ["y"] * 5) for at in range(0, 3980, 17)]
    texts += [" ".join(["clean"] * 50), " ".join(item[10:22]), " ".join(["z"] * 200_000 + item[100:140]), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([("long", " ".join(item)), ("short", "x x x"), ("none", None)], "item_id string, text string").withColumn("n_hit", F.lit("clash"))
    whole = sorted(map(tuple, decontamination.decontaminate(docs, items, texts=False).collect()), key=str)
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 4000)
    sizes = [(n, sum(len(t) for _, t in sent.value)) for n, sent in decontamination._blocks(items, 13)]
    assert len(sizes) > 8 and max(size for _, size in sizes) <= 4000 + 26 * 6
    cut = sorted(map(tuple, decontamination.decontaminate(docs, items, texts=False).collect()), key=str)
    assert cut == whole and sum(r[5] for r in whole) >= 230


def test_language_id_ignores_clashing_columns(spark):
    rows = [(1, "plint strom gleth", "aa"), (3, "vuma zaki wuju", "bb"), (4, "vuma zaki", "bb"), (5, "plint", "aa"), (9, "plint gleth", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    plain = sorted(map(tuple, language_id.identify(df).collect()), key=str)
    for name in ("lang_pred", "score", "held_out", "gram", "bits", "below", "n"):
        df = df.withColumn(name, F.lit(1))
    assert sorted(map(tuple, language_id.identify(df).collect()), key=str) == plain
    assert language_id.undetermined_removed(df).columns == df.columns


def test_held_out_urls_are_judged_by_their_templates(spark):
    from oracle import connect, rows_of, sql_rows

    from factloom.llm import oracles, registry, url_filters

    sf = "/root/testdata/sf0.01"
    assert rows_of(registry.QUERIES["url_holdout"](spark, sf)) == sql_rows(connect(sf), oracles.ORACLES["url_holdout"])
    # enough of its own kind makes the tree block what it has not seen; nothing that is allowed is blocked
    rows = [(i, f"http://big.net/es/{i}/p.html" if i % 2 else f"http://big.net/en/{i}/p.html") for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("told", F.lit(1))
    rules = [("block", "net/es/"), ("allow", "big.net/en/")]
    got = {r.page_id: (r.told, r.verdict) for r in url_filters.held_out_verdicts(df, rules).collect()}
    assert got == {i: ("allow", "allow") for i in range(400) if i % 4 == 2}
    odd = spark.createDataFrame([(i, f"http://big.net/{'es' if i % 4 > 1 else 'en'}/{i}/p.html") for i in range(400)], "page_id long, url string")
    assert {(r.told, r.verdict) for r in url_filters.held_out_verdicts(odd, rules).collect()} == {("block", "block")}
    assert url_filters.held_out_verdicts(odd.limit(0), rules).count() == 0
