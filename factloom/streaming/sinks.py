"""Append-only stores: batches that can be repeated, rows that cannot be changed, erasure that must be asked for.

A store is a folder below the shared one: ``data/batch=n`` holds the rows of batch ``n``, ``refused/batch=n`` those that would have changed a
stored row, ``manifest/batch=n`` one row about the batch. A batch is written whole under its own number before its manifest, so a batch that is
run again after a failure replaces itself; what has no manifest was never appended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pieces of a store by the hash of the key: a batch is only held against the pieces that its keys fall in.
PIECES = 32


class Store:
    """Rows of ``columns`` under ``key`` (columns that name a row) below ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str]):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = spark.createDataFrame([], schema).schema
        self.columns = self.schema.names
        self.stored_schema = f"{schema}, _digest string, _piece int, batch long"

    def _exists(self, name: str) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)

    def _read(self, name: str, schema: str) -> DataFrame:
        """Rows of the batches that have a manifest."""
        if not self._exists("manifest") or not self._exists(name):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}/batch=*/*")
        return rows if name == "manifest" else rows.join(F.broadcast(self.manifest().select("batch")), "batch", "left_semi")  # a row a batch

    def manifest(self) -> DataFrame:
        return self._read("manifest", "n long, refused long, repeated long, digest long, batch long")

    def stored(self) -> DataFrame:
        return self._read("data", self.stored_schema)

    def rows(self) -> DataFrame:
        """What has been appended and not erased."""
        rows = self.stored()
        if self._exists("erased"):
            gone = self.spark.read.parquet(f"{self.path}/erased").select(*self.key)
            rows = rows.join(gone, self.key, "left_anti")
        return rows.select(*self.columns)

    def refused(self) -> DataFrame:
        return self._read("refused", self.stored_schema).select(*self.columns, "batch")

    def append(self, batch: DataFrame, number: int) -> None:
        """Append the rows of batch ``number`` whose keys are new. A row that is already there (in the store, or before it in the batch) is a
        repetition and left out; one that says something else under a stored key would be an update and is refused. Of several new rows under
        one key, the smallest digest is appended."""
        digest = F.sha2(F.to_json(F.struct(*self.columns)), 256)
        new = batch.select(*self.columns).withColumns({"_digest": digest, "_piece": F.pmod(F.xxhash64(*self.key), F.lit(PIECES)).cast("int")})
        new = new.groupBy(*self.key, "_piece", "_digest").agg(*[F.first(c).alias(c) for c in self.columns if c not in self.key], F.count("*").alias("_n"))
        pieces = [r[0] for r in new.select("_piece").distinct().collect()]  # PIECES at most
        there = self.stored().where((F.col("batch") < number) & F.col("_piece").isin(pieces)).select(*self.key, F.col("_digest").alias("_had"))
        held = new.join(there, self.key, "left")
        first = held.groupBy(*self.key).agg(F.min("_digest").alias("_least"))
        told = held.join(first, self.key).withColumn("_what", F.when(F.coalesce("_had", "_least") != F.col("_digest"), "refused").when(F.col("_had").isNotNull(), "repeated").otherwise("new"))
        for what, name in (("new", "data"), ("refused", "refused")):
            told.where(F.col("_what") == what).select(*self.columns, "_digest", "_piece").write.mode("overwrite").partitionBy("_piece").parquet(f"{self.path}/{name}/batch={number}")
        count = lambda what, c: F.coalesce(F.sum(F.when(F.col("_what") == what, c)), F.lit(0)).cast("long")
        about = told.agg(count("new", F.lit(1)).alias("n"), count("refused", F.col("_n")).alias("refused"), (count("repeated", F.col("_n")) + count("new", F.col("_n") - 1)).alias("repeated"), F.coalesce(F.bit_xor(F.when(F.col("_what") == "new", F.xxhash64("_digest"))), F.lit(0)).alias("digest"))
        about.withColumn("_piece", F.lit(0)).write.mode("overwrite").partitionBy("_piece").parquet(f"{self.path}/manifest/batch={number}")

    def erase(self, keys: DataFrame, reason: str | None, allowed: bool = False) -> None:
        """Hide the rows under ``keys`` for a stated reason. Without the explicit permission, or a reason, nothing is erased."""
        if not allowed or not reason:
            raise PermissionError("an append-only store erases only when that is allowed and a reason is given")
        keys.select(*self.key, F.lit(reason).alias("reason"), F.current_timestamp().alias("erased_at")).write.mode("append").parquet(f"{self.path}/erased")

    def violations(self) -> DataFrame:
        """(batch, problem) of batches whose rows are no longer those of their manifest: changed, lost or added behind the store's back."""
        digest = F.sha2(F.to_json(F.struct(*self.columns)), 256)
        now = self.stored().groupBy("batch").agg(F.count("*").alias("_n"), F.bit_xor(F.xxhash64(digest)).alias("_digest"))
        both = self.manifest().join(now, "batch", "left")
        problem = F.when(F.col("n") > F.coalesce("_n", F.lit(0)), "lost rows").when(F.col("n") < F.coalesce("_n", F.lit(0)), "added rows").when(F.col("digest") != F.coalesce("_digest", F.lit(0)), "changed rows")
        return both.select("batch", problem.alias("problem")).where("problem is not null")

    def write_stream(self, stream: DataFrame, checkpoint: str):
        """Append a stream's batches until what is there has been read; a batch that Spark runs again has its old number."""
        writer = stream.writeStream.foreachBatch(lambda df, n: self.append(df, n)).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()
