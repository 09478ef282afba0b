"""Token ids in fixed-width bit packing (operator 6).

Every id takes the minimum bits of its vocabulary. Ids are packed little-endian into blocks of whole documents, about
``BLOCK_IDS`` ids each; a block row holds its place (``part``, ``block``), the ids before it in its part, its
documents' ids and counts, the bit width and the payload. Documents are in ascending ``doc_id`` order over parts and
blocks (range partitioning, sorted inside). The dataset is written by Spark's own committed Parquet writer, so
a lost executor or a repeated task leaves no half-written file.

Reading unpacks with numpy: a whole block at once, or any slice of ids by its bit offset (``unpack(…, first, n)``).

Defined results: null or empty text is the end id alone; documents with an equal id stand in the order of their
texts, and a repeated row once for each; documents without an id stand first; other columns are ignored; an empty
table gives an empty dataset.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm import common as C
from factloom.llm import pieces as P
from factloom.llm import token_counts as T

END_ID = 1
#: Ids of a block, about.
BLOCK_IDS = 1 << 19
BLOCKS = "part int, block int, ids_before long, n_ids long, bits int, doc_ids array<long>, counts array<int>, payload binary"


def width(vocabulary_size: int) -> int:
    """Bits that hold every id below ``vocabulary_size``."""
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as consecutive ``bits``-wide little-endian numbers."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    out = []
    for lo in range(0, len(ids), 1 << 16):  # a multiple of 8, so that pieces end on a byte
        planes = (ids[lo : lo + (1 << 16), None].astype(np.uint32) >> np.arange(bits, dtype=np.uint32)) & 1
        out.append(np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack(payload: bytes, bits: int, first: int, n: int) -> np.ndarray:
    """``n`` ids from the id numbered ``first`` on."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, dtype=f"<u{bits // 8}", count=n, offset=first * bits // 8).astype(np.uint32)
    lo, hi = first * bits // 8, -(-(first + n) * bits // 8)
    flat = np.unpackbits(np.frombuffer(payload[lo:hi], dtype=np.uint8), bitorder="little")
    skip = first * bits - lo * 8
    planes = flat[skip : skip + n * bits].reshape(n, bits).astype(np.uint32)
    return (planes << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def _pack_partition(path: str, end_id: int, bits: int):
    end = np.array([end_id], dtype="<u4")

    def block(part: int, number: int, before: int, docs: list[int | None], ids: list[np.ndarray]) -> pa.RecordBatch:
        counts = [len(x) + 1 for x in ids]
        flat = np.concatenate([y for x in ids for y in (x, end)])
        cols = [[part], [number], [before], [len(flat)], [bits], [docs], [counts], [pack(flat, bits)]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds)], names=["part", "block", "ids_before", "n_ids", "bits", "doc_ids", "counts", "payload"])

    def run(batches):
        part = TaskContext.get().partitionId()
        number = before = held = 0
        docs: list[int | None] = []
        ids: list[np.ndarray] = []
        for batch in batches:
            for piece in C.slices(batch, P.SLICE):
                flat, at = P.encode_ids(path, piece.column(1))
                for doc, a, b in zip(piece.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    docs.append(doc)
                    ids.append(flat[a:b])
                    held += b - a + 1
                    if held >= BLOCK_IDS:
                        yield block(part, number, before, docs, ids)
                        number, before, held, docs, ids = number + 1, before + held, 0, [], []
            C.release()
        if docs:
            yield block(part, number, before, docs, ids)

    return run


def write_packed(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Encode ``docs`` (doc_id, text) and write the packed dataset to ``path``."""
    vocabulary = vocabulary or T.default_vocabulary()
    bits = width(max(P.library(vocabulary).get_vocab_size(), end_id + 1))
    C.ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    C.written(ordered.mapInArrow(_pack_partition(vocabulary, end_id, bits), BLOCKS), path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the packed files."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("part_start"))  # one row per file

    def fn(batch: pa.RecordBatch):
        for row in batch.to_pylist():
            counts = np.array(row["counts"], dtype=np.int64)
            ids = unpack(row["payload"], row["bits"], 0, row["n_ids"]).astype("<u4")
            ends = np.cumsum(counts)
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends - counts, ends)]
            start = row["part_start"] + row["ids_before"] + ends - counts
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], type=pa.int64()), pa.array(start), pa.array(counts), pa.array(crc, type=pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return C.map_arrow(blocks.join(F.broadcast(parts), "part"), fn, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = C.shared_dir(spark)
    write_packed(C.documents_of(spark, sf_dir), path)
    return read_packed(spark, path)
