"""What the text operators share: shipping the package, shared-folder tables, Arrow batches, hashing.

Tables that are read more than once are written below ``spark.checkpoint.dir`` (a folder all executors
share), never to a machine-local folder, so a lost executor costs at most the tasks it held.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()

#: Bytes of text that a vectorised step looks at together.
SLICE_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per Spark application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    if root.is_dir():
        target = os.path.join(tempfile.mkdtemp(prefix="factloom-"), f"factloom-{uuid.uuid4().hex[:8]}.zip")
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(Path(root.name) / p.relative_to(root)))
        spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``. Only a local master may leave that unset: on a cluster no folder of
    one machine would do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "factloom-checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/factloom-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, path: str) -> None:
    """Write ``df`` as Parquet. The shuffle files behind it are dropped as soon as it is written, so that a job
    of many steps needs disk for its largest step, not for all of them."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEANUP, before)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    path = shared_dir(df.sparkSession)
    written(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    for made in _SCOPES:
        made.append(out)
    return out


_SCOPES: list[list[DataFrame]] = []


@contextmanager
def intermediates() -> Iterator[list[DataFrame]]:
    """Tables that are stored inside go when it ends, except those taken out of the list."""
    made: list[DataFrame] = []
    _SCOPES.append(made)
    try:
        yield made
    finally:
        _SCOPES.remove(made)
        dropped(*made)


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more: what was made from them has been stored itself."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def documents_of(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unclear_ids(rows: DataFrame) -> DataFrame | None:
    """The ids that rows (doc_id, h) of different texts (``h`` is a hash of id and text) share, stored; None without any."""
    ids = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo != hi")
    found = stored(ids.select("doc_id"))
    return None if found.isEmpty() else found


def with_key(rows: DataFrame, unclear: DataFrame | None) -> DataFrame:
    """``rows`` (doc_id, h, …) with ``key``: the id, or the hash where the id is missing or stands for several texts. So a key
    tells one text, and repeated rows have one key."""
    missing = F.col("doc_id").isNull()
    if unclear is None:
        return rows.withColumn("key", F.when(missing, F.col("h")).otherwise(F.col("doc_id")))
    known = rows.where(~missing).join(unclear.withColumn("several", F.lit(True)), "doc_id", "left")
    known = known.withColumn("key", F.when(F.col("several"), F.col("h")).otherwise(F.col("doc_id"))).drop("several")
    return known.unionByName(rows.where(missing).withColumn("key", F.col("h")))


def hashed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, h) of ``docs``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.withColumn("h", F.xxhash64("doc_id", "text"))


def keyed_rows(docs: DataFrame, unclear: DataFrame | None) -> DataFrame:
    """(doc_id, h, row, key): the rows of ``docs`` as one column, whatever their columns are called, beside their key."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return with_key(rows, unclear)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str, limit: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` over slices of at most ``limit`` bytes of data (one row at least)."""
    ship(df.sparkSession)

    def run(batches):
        forget_all_but(fn.__module__)
        for batch in batches:
            for part in slices(batch, limit):
                out = fn(part)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
            release()

    return df.mapInArrow(run, schema)


def where_texts(docs: DataFrame, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of ``docs`` whose text ``keep`` accepts, seen in slices of at most ``SLICE_BYTES``; no row is shuffled."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget_all_but(keep.__module__)
        for texts in batches:
            parts = [keep(part.column(0)) for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"]))]
            release()
            yield pa.array(np.concatenate([*parts, np.zeros(0, dtype=bool)]), type=pa.bool_())

    return docs.where(F.arrow_udf(run, "boolean")(F.col("text").cast("string")))


_CACHES: list[tuple[tuple[str, ...], Callable[[], None]]] = []


def remembers(users: tuple[str, ...], *forget: Callable[[], None]) -> None:
    """Declare what a worker keeps for the modules ``users``, and how it is forgotten."""
    _CACHES.extend((users, f) for f in forget)


def forget_all_but(module: str) -> None:
    """Workers live on between stages; each starts a partition with the memory of its own operator only."""
    for users, forget in _CACHES:
        if module not in users:
            forget()
    release()


def release() -> None:
    """Give memory that a batch needed back to the system: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    trim = _libc_trim()
    if trim is not None:
        trim(0)


@lru_cache(maxsize=1)
def _libc_trim():
    import ctypes

    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` bytes."""
    n = batch.num_rows
    if n == 0:
        return
    if batch.nbytes <= limit:
        yield batch
        return
    size = np.zeros(n, dtype=np.int64)
    for col in batch.columns:
        if pa.types.is_string(col.type) or pa.types.is_binary(col.type) or pa.types.is_large_string(col.type):
            size += np.asarray(pa.compute.binary_length(col).fill_null(0), dtype=np.int64)
    group = np.cumsum(size) // limit
    start = 0
    for cut in [*(np.flatnonzero(np.diff(group)) + 1), n]:
        if cut > start:
            yield batch.slice(start, int(cut) - start)
            start = int(cut)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """An Arrow list column from flat values and the number of values of each row."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


# ---------------------------------------------------------------- hashing

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash, remembered; the memory is bounded by forgetting all when full."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = WordHashes()
remembers(("factloom.llm.ngram_join", "factloom.llm.substring_dedup"), _HASHES.clear)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


class TwoGenerations:
    """A bounded memo: what was used since the last turn-over survives, the rest is forgotten."""

    def __init__(self, limit: int, limit_bytes: int = 1 << 26):
        self.limit, self.limit_bytes, self.bytes, self.young, self.old = limit, limit_bytes, 0, {}, {}

    def values(self, keys: list[str], compute: Callable[[list[str]], list]) -> list:
        """The value of each of the distinct ``keys``; ``compute`` gives those of the keys that are not remembered."""
        if self.young and (len(self.young) + len(keys) > self.limit or self.bytes > self.limit_bytes):
            self.old, self.young, self.bytes = self.young, {}, 0
        young, old = self.young, self.old
        out = list(map(young.get, keys))
        missing = []
        for i, v in enumerate(out):
            if v is None:
                k = keys[i]
                v = out[i] = old.get(k)
                if v is None:
                    missing.append(i)
                else:
                    young[k] = v
        if missing:
            new = [keys[i] for i in missing]
            for i, k, v in zip(missing, new, compute(new), strict=True):
                out[i] = young[k] = v
            self.bytes += sum(map(len, new))
        return out
