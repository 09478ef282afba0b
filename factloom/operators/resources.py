"""Facts as nested resources: one document bundle with sections and references, and what does not conform in it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Shape = "Column | str | Mapping[str, Shape] | Sequence[Shape]"


def built(shape: Shape) -> Column:
    """A nested shape as one column: mappings are structs in their order, sequences are arrays, texts are themselves. Parts that are null
    are left out when it is written as JSON."""
    if isinstance(shape, Column):
        return shape
    if isinstance(shape, str):
        return F.lit(shape)
    if isinstance(shape, Mapping):
        return F.struct(*[built(part).alias(name) for name, part in shape.items()])
    return F.array(*map(built, shape))


def business_id(kind: str, *key: Column) -> Column:
    """An id that follows from what it names, so that a repeated run and a second document agree on it."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(kind), *[k.cast("string") for k in key]), 256), 1, 32)


def reference(kind: str, *key: Column) -> Column:
    return F.struct(F.concat(F.lit(f"{kind}/"), business_id(kind, *key)).alias("reference"))


def resources(rows: DataFrame, document: str, kind: str, key: Sequence[str], shapes: Mapping[str, tuple[str, str | None, Shape]], held: Column | None = None) -> DataFrame:
    """(document, type, section, id, held, resource) of rows: each ``kind`` has its (type, section, shape); the JSON begins with type and id. Rows of
    other kinds have no resource. A held row's resource is null: it is listed, not stated."""
    held = F.lit(False) if held is None else F.coalesce(held, F.lit(False))
    ids = [F.col(k) for k in key]
    when = lambda part: F.coalesce(*[F.when(F.col(kind) == k, part(*v)) for k, v in shapes.items()])
    own = rows.where(F.col(kind).isin(list(shapes))).withColumns({"_type": when(lambda t, s, _: F.lit(t)), "_id": when(lambda t, s, _: business_id(t, *ids))})
    body = when(lambda t, s, shape: F.to_json(built({"resourceType": t, "id": F.col("_id"), **shape})))
    return own.select(
        document, F.col("_type").alias("type"), when(lambda t, s, _: F.lit(s)).alias("section"), F.col("_id").alias("id"), held.alias("held"), F.when(~held, body).alias("resource"),
    )


def bundles(parts: DataFrame, document: str, sections: Sequence[str]) -> DataFrame:
    """(document, status, n_entries, n_held, bundle): one bundle a document, with a composition first whose sections (in the given order, without
    empty ones) refer to their resources. ``draft`` while rows are held; these are listed by id. Equal resources are one entry; entries
    and references are in the order of type and id. What is collected is one document's. Parts of rows that were dealt by document before their JSON was made are not moved again."""
    one = parts.groupBy(document, "type", "id").agg(F.min("section").alias("section"), F.bool_and("held").alias("held"), F.min("resource").alias("resource"))
    entry = F.struct("type", "id", "section", "held", "resource")
    all_of = one.groupBy(document).agg(F.sort_array(F.collect_list(entry)).alias("_e"))
    stated = F.filter("_e", lambda e: ~e["held"])
    titled = F.array(*map(F.lit, sections))
    refs = lambda s: F.transform(F.filter(stated, lambda e: e["section"] == s), lambda e: F.struct(F.concat(e["type"], F.lit("/"), e["id"]).alias("reference")))
    parts_of = F.filter(F.transform(titled, lambda s: F.struct(s.alias("title"), refs(s).alias("entry"))), lambda s: F.size(s["entry"]) > 0)
    listed = F.transform(F.filter("_e", lambda e: e["held"]), lambda e: F.concat(e["type"], F.lit("/"), e["id"]))
    status = F.when(F.size(listed) > 0, "draft").otherwise("ready")
    head = F.to_json(built({"resourceType": "Composition", "id": business_id("Composition", F.col(document)), "status": status, "section": parts_of, "held": F.when(F.size(listed) > 0, listed)}))
    bundle = F.concat(F.lit('{"resourceType":"Bundle","type":"document","entry":['), F.array_join(F.concat(F.array(head), F.transform(stated, lambda e: e["resource"])), ","), F.lit("]}"))
    return all_of.select(document, status.alias("status"), (F.size(stated) + 1).alias("n_entries"), F.size(listed).alias("n_held"), bundle.alias("bundle"))


def conformance(made: DataFrame, document: str, required: Sequence[str], values: Mapping[str, Sequence[str]]) -> DataFrame:
    """(document, problem, what, n) of bundles (document, bundle), one a document: ``missing type`` of the ``required`` ones, ``no id``, ``same id``,
    ``dangling reference`` to what the bundle does not hold, and ``no value`` at a JSON path that its type needs. A bundle is read once; only what was
    found, and the references of bundles with a dangling one, become rows."""
    told = "resourceType string, id string"
    entries = made.select(document, "bundle").withColumns({"_r": F.from_json("bundle", "entry array<string>")["entry"], "_t": F.from_json("bundle", f"entry array<struct<{told}>>")["entry"]})
    # where an entry is no object, each is read by itself
    entries = entries.withColumn("_t", F.when(F.size("_t") == F.size("_r"), F.col("_t")).otherwise(F.transform("_r", lambda r: F.from_json(r, told))))

    def read(r: Column, i: Column) -> Column:
        kind = F.get("_t", i)["resourceType"]
        needs = F.array().cast("array<string>")
        for t, paths in values.items():
            needs = F.when(kind == t, F.array_compact(F.array(*[F.when(F.get_json_object(r, f"$.{p}").isNull(), f"{t}.{p}") for p in paths]))).otherwise(needs)
        return F.struct(kind.alias("type"), F.get("_t", i)["id"].alias("id"), F.regexp_extract_all(r, F.lit('"reference":"([^"]*)"'), F.lit(1)).alias("refs"), needs.alias("absent"))

    # columns of their own: a lambda would make what it looks into anew for each element. No row is left out before the rows are made, and these
    # may be none: what a filter asks for would be moved to where the bundle is made, and make it again
    entries = entries.select(document, F.transform("_r", read).alias("_e")).withColumns({
        "_types": F.col("_e.type"), "_refs": F.flatten(F.filter(F.col("_e.refs"), lambda r: r.isNotNull())), "_absent": F.flatten("_e.absent"),
        "_keys": F.array_sort(F.transform(F.filter("_e", lambda e: e["id"].isNotNull()), lambda e: F.struct(e["type"], e["id"]))),
    })
    entries = entries.withColumn("_lost", F.array_except("_refs", F.transform("_e", lambda e: F.concat_ws("/", e["type"], e["id"]))))
    at = lambda i: F.get("_keys", i)
    same = F.filter("_keys", lambda k, i: (i > 0) & k.eqNullSafe(at(i - 1)) & ((i == 1) | ~k.eqNullSafe(at(i - 2))))
    row = lambda problem, what, ref=None, asked=1: F.struct(F.lit(problem).alias("problem"), what.alias("what"), (F.lit(None).cast("string") if ref is None else ref).alias("ref"), F.lit(asked).alias("asked"))
    dangling = lambda refs, asked: F.transform(refs, lambda r: row("dangling reference", F.split(r, "/")[0], r, asked))
    rows = F.concat(
        F.transform(F.when(F.size("_types") > 0, F.array_except(F.array(*map(F.lit, required)), "_types")).otherwise(F.array().cast("array<string>")), lambda t: row("missing type", t)),
        F.transform(F.filter("_e", lambda e: e["id"].isNull()), lambda e: row("no id", e["type"])),
        F.transform(same, lambda k: row("same id", k["type"])), F.transform("_absent", lambda p: row("no value", p)),
        F.when(F.size("_lost") > 0, F.concat(dangling(F.col("_lost"), 0), dangling(F.col("_refs"), 1))).otherwise(dangling(F.col("_lost"), 0)),
    )
    found = entries.select(document, F.inline_outer(rows)).where("problem is not null").groupBy(document, "problem", "what", "ref").agg(F.sum("asked").alias("n"), F.min("asked").alias("_l"))
    return found.where("ref is null or _l = 0").groupBy(document, "problem", "what").agg(F.sum("n").alias("n"))
