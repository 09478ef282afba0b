"""Read models and work lists: current rows by array membership, mapped projections, decisions applied, ordered lists, bundles.

All are joins on keys, grouped aggregates or windows inside a key. Lists that are collected hold what one document or one key has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def facts_of_documents(facts: DataFrame, documents: DataFrame, fact: str, ids: str, document: str) -> DataFrame:
    """(document, fact): facts whose array of source documents names a document; once per pair.

    A task holds the ids of its documents, not the names sorted beside them."""
    named = facts.select(fact, F.explode(ids).alias(document))
    return named.join(documents.select(document).hint("shuffle_hash"), document, "left_semi").select(document, fact).distinct()


def apply_mapping(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Columns by paths: ``a.b`` is a field, ``list[*].x`` the field of each entry, ``|join:,`` joins such a list."""

    def column(path: str) -> Column:
        path, _, how = path.partition("|")
        inside, _, field = path.partition("[*].")
        c = F.col(inside)
        if field:
            c = F.transform(c, lambda x: x[field].cast("string"))
        return F.array_join(c, how.removeprefix("join:")) if how.startswith("join:") else c

    return df.select(*[column(p).alias(name) for name, p in mapping.items()])


def decisions_applied(rows: DataFrame, log: DataFrame, key: str, order: Sequence[Column], editable: Sequence[str]) -> DataFrame:
    """``rows`` with the latest decision of ``log`` (key, decision, ``new_`` columns): accepted, rejected (no longer current) or
    corrected (only ``editable`` columns, and only to given values); undecided rows stay pending."""
    w = Window.partitionBy(key).orderBy(*order)
    last = log.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(key, F.col("decision").alias("_d"), *[F.col(f"new_{c}").alias(f"_{c}") for c in editable])
    out = rows.join(last, key, "left")
    for c in editable:
        out = out.withColumn(c, F.when(F.col("_d") == "correct", F.coalesce(f"_{c}", c)).otherwise(F.col(c)))
    state = F.when(F.col("_d") == "accept", "accepted").when(F.col("_d") == "correct", "corrected").when(F.col("_d") == "reject", "rejected").otherwise("pending")
    return out.withColumns({"state": state, "is_current": F.coalesce(F.col("_d") != "reject", F.lit(True))}).drop("_d", *[f"_{c}" for c in editable])


def listed_once(rows: DataFrame, document: str, name: Column, order: Sequence[Column]) -> DataFrame:
    """``status``: the first entry of a name in its document is listed, later ones are rejected with a reason."""
    first = F.row_number().over(Window.partitionBy(document, F.lower(name)).orderBy(*order)) == 1
    return rows.withColumns({"status": F.when(first, "listed").otherwise("rejected"), "reason": F.when(~first, "already listed in this document")})


def context_links(tests: DataFrame, reasons: DataFrame, page: str, key: str, lines: str) -> DataFrame:
    """(page, key, link): ``same_line`` if a reason of the page shares an evidence line with the test, ``same_page`` if the page
    has a reason at all, else null. Lines meet by equi join, so a page with many reasons pairs nothing."""
    t = tests.select(page, key, F.explode(lines).alias("_line"))
    r = reasons.select(page, F.explode(lines).alias("_line")).distinct()
    shared = t.join(r, [page, "_line"], "left_semi").select(page, key).distinct().withColumn("_same", F.lit(True))
    pages = reasons.select(page).distinct().withColumn("_page", F.lit(True))
    out = tests.select(page, key).join(shared, [page, key], "left").join(pages, page, "left")
    return out.select(page, key, F.when(F.col("_same"), "same_line").when(F.col("_page"), "same_page").alias("link"))


def name_fit(a: Column, b: Column, score: Column, floor: float = 0.72) -> Column:
    """Whether two written names may be one person's: equal, one's words within the other's, two common words, or alike."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != ""))
    x, y = words(a), words(b)
    within = (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)
    return (F.lower(a) == F.lower(b)) | ((F.size(x) > 0) & (F.size(y) > 0) & within) | (F.size(F.array_intersect(x, y)) >= 2) | (score >= floor)


def immutable_violations(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of an append-only table that a later state changed or lost."""
    return before.exceptAll(after)


def reranked(candidates: DataFrame, key: str, band: Column, score: str, tie: str) -> DataFrame:
    """``place`` by band (0 fits, 1 unknown, 2 does not fit), then score, then name."""
    w = Window.partitionBy(key).orderBy(band, F.desc(score), tie)
    return candidates.withColumn("place", F.row_number().over(w).cast("long"))


def page_notes(pages: DataFrame, document: str, page: str, reasons: str) -> DataFrame:
    """(document, notes, n_notes): each page's reasons behind its number, in page order; null where no page was checked."""
    each = pages.where(F.col(reasons).isNotNull()).groupBy(document).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col(reasons).alias("r")))).alias("_l"))
    flat = F.flatten(F.transform("_l", lambda x: F.transform(x["r"], lambda y: F.concat(x["p"].cast("string"), F.lit(":"), y))))
    notes = each.select(document, F.array_join(flat, ";").alias("notes"), F.size(flat).cast("long").alias("n_notes"))
    return pages.select(document).distinct().join(notes, document, "left")


def resources(rows: DataFrame, kinds: dict[str, Sequence[str]], kind: str, bundle: str, order: Column) -> DataFrame:
    """(bundle, n, kinds, digest, missing): each row becomes a JSON resource of its kind (fixed fields, an id that follows from
    its content); a bundle lists them in order. ``missing`` names kinds without a resource."""
    built = None
    for name, fields in kinds.items():
        own = rows.where(F.col(kind) == name)
        body = F.to_json(F.struct(F.lit(name).alias("resourceType"), *fields))
        r = own.select(bundle, order.alias("_o"), F.lit(name).alias("_k"), body.alias("_j"))
        built = r if built is None else built.unionByName(r)
    lists = built.groupBy(bundle).agg(F.array_sort(F.collect_list(F.struct("_o", "_j"))).alias("_l"), F.array_sort(F.collect_set("_k")).alias("_ks"))
    text = F.concat(F.lit("["), F.array_join(F.transform("_l", lambda x: x["_j"]), ","), F.lit("]"))
    wanted = F.array(*map(F.lit, sorted(kinds)))
    return lists.select(bundle, F.size("_l").cast("long").alias("n"), F.array_join("_ks", ",").alias("kinds"), F.sha2(text, 256).alias("digest"), F.array_join(F.array_except(wanted, F.col("_ks")), ",").alias("missing"))


def page_support(names: DataFrame, words: DataFrame, page: str, key: str, name: str, word: str) -> DataFrame:
    """(page, key, support): mean over a name's words of 1.0 if the page has the word, 0.9 if it stands inside a page's word, else
    the best likeness to one of the page's words. Only distinct words of a page meet."""
    each = names.select(page, key, F.posexplode(F.split(F.lower(name), " +")).alias("_i", "_w"))
    have = words.select(page, F.lower(word).alias("_v")).distinct()
    exact = each.join(have.withColumnRenamed("_v", "_w").withColumn("_hit", F.lit(1.0)), [page, "_w"], "left")
    rest = exact.where("_hit is null").select(page, "_w").distinct().join(have, page)
    alike = F.when(F.contains("_v", "_w"), 0.9).otherwise(1 - F.levenshtein("_w", "_v") / F.greatest(F.length("_w"), F.length("_v")))
    best = rest.groupBy(page, "_w").agg(F.max(alike).alias("_s"))
    scored = exact.join(best, [page, "_w"], "left").withColumn("_p", F.coalesce("_hit", "_s", F.lit(0.0)))
    return scored.groupBy(page, key).agg(F.round(F.avg("_p"), 4).alias("support"))


def field_records(values: DataFrame, lines: DataFrame, document: str, key: str, ids: str, line: str, text: str) -> DataFrame:
    """(document, key, reading, crops, n): what stands in a value's lines, in order, and the digests of these lines."""
    used = values.select(document, key, F.explode(F.array_distinct(ids)).alias(line)).join(lines, [document, line])
    g = used.groupBy(document, key).agg(F.array_sort(F.collect_list(F.struct(line, text))).alias("_l"), F.array_sort(F.collect_set(F.substring(F.sha2(text, 256), 1, 8))).alias("_c"))
    return g.select(document, key, F.array_join(F.transform("_l", lambda x: x[text]), " / ").alias("reading"), F.array_join("_c", ",").alias("crops"), F.size("_l").cast("long").alias("n"))


def note_targets(notes: DataFrame, tests: DataFrame, document: str, key: str, note: str, test: str, floor: float = 0.8) -> DataFrame:
    """(document, key, applies): a note applies to all tests, to those whose name its first word is (nearly), to those it mentions as a
    word, else it is unclear. Notes meet the tests of their own document only."""
    words = F.split(F.lower(note), "[^a-z0-9]+")
    n = notes.select(document, key, words.alias("_w"), F.get(F.filter(words, lambda w: w != ""), F.lit(0)).alias("_f"))
    t = tests.select(document, F.lower(test).alias("_t")).distinct()
    met = n.join(t, document, "left")
    alike = 1 - F.levenshtein("_f", "_t") / F.greatest(F.length("_f"), F.length("_t"))
    rank = F.when(F.array_contains("_w", "all"), 0).when(F.coalesce(alike >= floor, F.lit(False)), 1).when(F.coalesce(F.array_contains("_w", F.col("_t")), F.lit(False)), 2).otherwise(3)
    names = F.array(*map(F.lit, ("all", "named", "mentioned", "unclear")))
    return met.groupBy(document, key).agg(F.element_at(names, (F.min(rank) + 1).cast("int")).alias("applies"))
