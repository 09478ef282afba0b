"""Files as tables: patterns, real types from first bytes, sidecar metadata, code sets, packed sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_files(spark: SparkSession, folder: str, keep: str = "[.](pdf|png|jpe?g|tiff?)$", ignore: Sequence[tuple[str, str]] = (("^[.~]", "hidden"), ("[.]part$", "partial"))) -> DataFrame:
    """All files with ``reason``: null for those to read, else why one is skipped (never silently)."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    reason = F.when(name.rlike(keep), None).otherwise("type")
    for pattern, why in ignore:
        reason = F.when(name.rlike(pattern), why).otherwise(reason)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.withColumn("name", name).withColumn("reason", F.when(F.col("length") == 0, "empty").otherwise(reason))


def sniffed_type(content: Column, name: Column) -> Column:
    """The type of a file from its first bytes; its name only where they say nothing."""
    head = F.hex(F.substring(content, 1, 8))
    by_name = F.when(name.endswith(".pdf"), "application/pdf").when(name.endswith(".png"), "image/png").when(name.rlike("[.]jpe?g$"), "image/jpeg")
    return F.when(head.startswith("25504446"), "application/pdf").when(head.startswith("89504E47"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("49492A00") | head.startswith("4D4D002A"), "image/tiff").when(head.startswith("504B0304"), "application/zip").when(head.startswith("50415231"), "application/parquet").when(head.startswith("3C21") | head.startswith("3C68746D"), "text/html").otherwise(by_name)


def with_sidecars(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Metadata of ``x.pdf.json``, else ``x.json``: sidecars (name, legacy_ref, captured_at as text); bad dates give null."""
    side = sidecars.select(F.regexp_replace(F.lower("name"), "[.]json$", "").alias("stem"), "legacy_ref", F.try_to_timestamp("captured_at").alias("captured_at"))
    full = side.select("stem", F.struct("legacy_ref", "captured_at").alias("_a"))
    bare = side.select(F.col("stem").alias("_short"), F.struct("legacy_ref", "captured_at").alias("_b"))
    rows = files.withColumn("_short", F.regexp_replace("name", "[.][^.]+$", ""))
    joined = rows.join(full, F.col("name") == F.col("stem"), "left").join(bare, "_short", "left")
    return joined.withColumn("meta", F.coalesce("_a", "_b")).select(*files.columns, "meta.legacy_ref", "meta.captured_at")


def alias_rows(lines: DataFrame, text: str) -> DataFrame:
    """``Name (alias; alias), Specimen`` as (name, alias, specimen), one row per alias, the name included."""
    name = F.trim(F.regexp_extract(text, "^([^(,]+)", 1))
    inside = F.regexp_extract(text, "[(]([^)]*)[)]", 1)
    specimen = F.nullif(F.trim(F.regexp_extract(text, ",\\s*([^,()]+)$", 1)), F.lit(""))
    parts = F.filter(F.transform(F.split(inside, ";"), lambda x: F.trim(x)), lambda x: x != "")
    return lines.select(name.alias("name"), F.explode(F.array_distinct(F.concat(F.array(name), parts))).alias("alias"), specimen.alias("specimen"))


def overlay(seed: DataFrame, user: DataFrame, key: str, value: str) -> DataFrame:
    """Seed rows under user rows (key, value, enabled): a disabled user row removes the seed."""
    both = seed.select(key, F.col(value).alias("_s")).join(user.select(key, F.col(value).alias("_u"), "enabled"), key, "full_outer")
    return both.where(F.coalesce("enabled", F.lit(True))).select(key, F.coalesce("_u", "_s").alias(value))


def lexicon(df: DataFrame, columns: Sequence[str], stop: DataFrame, least: int = 4) -> DataFrame:
    """Distinct words of ``least`` letters or more of several columns, without the stop words (word)."""
    words = F.explode(F.flatten(F.array(*[F.regexp_extract_all(F.lower(c), F.lit(f"([a-z]{{{least},}})"), F.lit(1)) for c in columns])))
    return df.select(words.alias("word")).distinct().join(stop, "word", "left_anti")


def master_index(lines: DataFrame, text: str) -> DataFrame:
    """(brand, generics, n) of a headerless tab-separated master (brand, generic): the generics of each brand, in order."""
    cells = F.split(F.col(text), "\t")
    rows = lines.select(F.trim(F.get(cells, F.lit(0))).alias("brand"), F.trim(F.get(cells, F.lit(1))).alias("generic")).where("brand != '' and generic != ''")
    return rows.groupBy("brand").agg(F.array_join(F.array_sort(F.collect_set("generic")), ",").alias("generics"), F.countDistinct("generic").alias("n"))


def alias_owners(aliases: DataFrame, order: Sequence[str]) -> DataFrame:
    """(alias_key, name, kind, n_claims): the owner of each folded alias of (alias, name, kind): the first kind in ``order``, then the
    smallest name."""
    key = F.regexp_replace(F.lower("alias"), "[^a-z0-9]+", "")
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("kind"))
    rows = aliases.select(key.alias("alias_key"), F.struct(F.when(rank > 0, rank).otherwise(len(order) + 1).alias("r"), "name", "kind").alias("o")).where("alias_key != ''")
    return rows.groupBy("alias_key").agg(F.min("o").alias("o"), F.countDistinct("o").alias("n_claims")).select("alias_key", "o.name", "o.kind", "n_claims")
