"""Substring dedup by difference-cover anchors (operator 5).

Words are runs of ``[^\\x20\\x09-\\x0D]``, unchanged. A window is ``WINDOW`` consecutive words of one document; a
word is removed if a window over it has a word sequence that also starts in a document with a smaller
``doc_id``. Windows are judged on the input.

How:

1. Documents with the same word sequence are one class; only those of its smallest ``doc_id`` go on. A longer copy
   (``WINDOW`` words or more) loses all its words, a shorter one none.
2. Anchors: words ``[p, p + 20)`` are hashed only at positions ``p`` with ``p mod 31`` in a difference cover of 31.
   For any two positions ``i, j`` there is a shift ``h < 31`` with ``i + h`` and ``j + h`` both in the cover, and
   ``h + 20 <= 50``: so any two equal windows share an aligned anchor. Anchors are computed once, in the pass that reads the
   words, and stored. Per anchor hash only the smallest and largest document are aggregated (map-side first), so an
   anchor that a third of all documents hold is one row per task.
3. An anchor seen in two documents extends: in the documents that hold it, the windows that contain it are
   hashed whole, and each window hash keeps its smallest document. A window is removed where that
   document is smaller. No pairs of documents are formed.

Defined results: null or empty text has no words, ``n_removed`` 0 and the digest of the empty text; a text shorter
than a window keeps all words; repeated rows are each judged alike, and rows with an equal ``doc_id`` but other texts each by
their own text, none being smaller than the other; a missing ``doc_id`` counts as larger than all; other columns are
ignored; an empty table gives an empty result. Sequences are compared by 64-bit hashes of 20 and 128-bit
hashes of 50 words and of whole texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import common as C

WINDOW = 50
#: A perfect difference cover: every residue modulo 31 is a difference of two of these.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1

_BASE_A, _BASE_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _split(texts: list[str | None]) -> tuple[list[list[bytes]], np.ndarray]:
    words = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
    return words, np.array([len(w) for w in words], dtype=np.int64)


def _flat(words: list[list[bytes]]) -> np.ndarray:
    return C.word_hashes([w for ws in words for w in ws])


def rolled(h: np.ndarray, size: int, base: np.uint64 = _BASE_A) -> np.ndarray:
    """Hash of each run of ``size`` word hashes, by doubling (order matters)."""
    if len(h) < size:
        return np.empty(0, dtype=np.uint64)
    out, have, power, length = None, 0, C.mix(h ^ base), 1
    left = size
    while left:
        if left & 1:
            if out is None:
                out, have = power, length
            else:
                n = len(h) - (have + length) + 1
                out = C.mix(out[:n] * base + power[have : have + n])
                have += length
        left >>= 1
        if left:
            n = len(h) - 2 * length + 1
            power = C.mix(power[:n] * base + power[length : length + n])
            length *= 2
    return out


def cover_positions(n: int) -> np.ndarray:
    """Anchor positions in a text of n words."""
    p = np.arange(max(0, n - ANCHOR + 1))
    return p[np.isin(p % PERIOD, COVER)]


def _profile_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Size, digest and anchors of each text of (doc_id, h, text)."""
    words, n = _split(batch.column(2).to_pylist())
    digest = [hashlib.sha256(b" ".join(w)).digest() for w in words]
    key = np.frombuffer(b"".join(d[:16] for d in digest), dtype="<i8").reshape(-1, 2)
    h, starts = _flat(words), np.cumsum(n) - n
    run = rolled(h, ANCHOR)
    found = [np.unique(run[s + cover_positions(int(c))]) for s, c in zip(starts, n)]
    flat = np.concatenate(found) if found else np.empty(0, dtype=np.uint64)
    anchors = C.list_array(flat.view(np.int64), np.array([len(x) for x in found], dtype=np.int64))
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(1), pa.array(n), pa.array([d.hex() for d in digest], type=pa.string()), pa.array(key[:, 0].copy()), pa.array(key[:, 1].copy()), anchors],
        names=["doc_id", "h", "n_words", "sha256", "key_a", "key_b", "anchors"],
    )


def _windows_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Windows that contain one of the document's shared anchors (key, text, anchors, place): positions and 128-bit hashes."""
    words, n = _split(batch.column(1).to_pylist())
    h, starts = _flat(words), np.cumsum(n) - n
    run, whole_a, whole_b = rolled(h, ANCHOR), rolled(h, WINDOW), rolled(h, WINDOW, _BASE_B)
    at, counts = [], np.zeros(len(n), dtype=np.int64)
    flat = batch.column(2)
    for i, (s, c) in enumerate(zip(starts, n)):
        shared = np.sort(np.asarray(flat[i].values.to_numpy(zero_copy_only=False)).view(np.uint64))
        p = cover_positions(int(c))
        k = np.searchsorted(shared, run[s + p])
        k[k == len(shared)] = 0
        p = p[shared[k] == run[s + p]]
        mark = np.zeros(c + 2, dtype=np.int64)
        np.add.at(mark, np.maximum(p - (WINDOW - ANCHOR), 0), 1)
        np.add.at(mark, p + 1, -1)
        w = np.flatnonzero(np.cumsum(mark)[: max(0, c - WINDOW + 1)] > 0)
        at.append(w)
        counts[i] = len(w)
    pos = np.concatenate(at) if at else np.empty(0, dtype=np.int64)
    where = pos + np.repeat(starts, counts)
    fields = [pa.array(pos.astype(np.int32)), pa.array(whole_a[where].view(np.int64)), pa.array(whole_b[where].view(np.int64))]
    offsets = np.zeros(len(n) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    windows = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, names=["pos", "a", "b"]))
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), windows], names=["key", "place", "windows"])


def _cut_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Removed and kept words of documents with removed windows; the text keeps its white space between kept words."""
    words, n = _split(batch.column(1).to_pylist())
    removed, digests, texts = [], [], []
    for i, w in enumerate(words):
        p = np.asarray(batch.column(2)[i].values.to_numpy(zero_copy_only=False), dtype=np.int64)
        mark = np.zeros(len(w) + 1, dtype=np.int64)
        np.add.at(mark, p, 1)
        np.add.at(mark, p + WINDOW, -1)
        gone = np.cumsum(mark)[: len(w)] > 0
        kept = b" ".join([x for x, g in zip(w, gone.tolist()) if not g])
        removed.append(int(gone.sum()))
        digests.append(hashlib.sha256(kept).hexdigest())
        texts.append(kept.decode("utf-8", "replace"))
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, type=pa.int64()), pa.array(digests), pa.array(texts)], names=["key", "cut", "cut_sha256", "cut_text"])


_PROFILE = "doc_id long, h long, n_words long, sha256 string, key_a long, key_b long, anchors array<long>"


def _cuts(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Profiles of all documents with their keys, the documents that lose a part (key, cut, cut_sha256, cut_text), and the ids
    that stand for several texts. Documents are ordered by ``place``."""
    texts = C.hashed_texts(docs)
    read = C.stored(C.map_arrow(texts.select("doc_id", "h", "text"), _profile_batch, _PROFILE))
    unclear = C.unclear_ids(read)
    keyed = C.with_key(read, unclear).withColumn("place", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    profile, seq = keyed.drop("anchors"), ["n_words", "key_a", "key_b"]
    # stored, so that both sides of the joins are plain exchanges and the rows of a hot class or anchor can be split over tasks
    first = C.stored(profile.groupBy(*seq).agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first != last").drop("last"))
    profile = C.stored(profile.join(first, seq, "left").select("doc_id", "key", "n_words", "sha256", F.coalesce(F.col("place") > F.col("first"), F.lit(False)).alias("copy")))
    copies = profile.where("copy").select("key").distinct()

    rows = keyed.select("key", "place", "anchors").join(copies, "key", "left_anti").select("key", "place", F.explode("anchors").alias("anchor"))
    shared = C.stored(rows.groupBy("anchor").agg(F.min("place").alias("lo"), F.max("place").alias("hi")).where("lo != hi").select("anchor"))
    held = rows.join(shared, "anchor").groupBy("key").agg(F.collect_set("anchor").alias("anchors"))  # no more than the document has
    # texts of the documents concerned, once per key, kept for the cut
    bodies = C.with_key(texts, unclear).select("key", "text", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("place")).join(held, "key").dropDuplicates(["key"])
    bodies = C.stored(bodies.select("key", "text", "anchors", "place"))
    C.dropped(read, first, shared)
    windows = C.map_arrow(bodies, _windows_batch, "key long, place long, windows array<struct<pos:int,a:long,b:long>>")
    windows = windows.select("key", "place", F.inline("windows"))
    earliest = C.stored(windows.groupBy("a", "b").agg(F.min("place").alias("lo"), F.max("place").alias("hi")).where("lo != hi").select("a", "b", "lo"))
    gone = windows.join(earliest, ["a", "b"]).where("lo < place").groupBy("key").agg(F.collect_list("pos").alias("pos"))
    cut = C.map_arrow(bodies.select("key", "text").join(gone, "key"), _cut_batch, "key long, cut long, cut_sha256 string, cut_text string")
    cut = C.stored(cut)
    C.dropped(bodies, earliest)
    return profile, cut, unclear


def substring_dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``."""
    profile, cut, _ = _cuts(docs)
    empty = hashlib.sha256(b"").hexdigest()
    copy = F.col("copy") & (F.col("n_words") >= WINDOW)
    return profile.join(cut.drop("cut_text"), "key", "left").select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, empty).otherwise(F.coalesce("cut_sha256", "sha256")).alias("kept_sha256"),
    )


def repeats_removed(docs: DataFrame, least_words: int = 1) -> DataFrame:
    """``docs`` with the repeated words cut out of ``text``; documents left with fewer than ``least_words`` words of
    those that lost any go. The words of a cut text are joined by one blank; ``n_chars`` follows it.

    Null, empty and short texts stay as they are; of rows without an id or with an equal one, each is judged as in
    ``substring_dedup``; an empty table stays empty; other columns keep names and values.
    """
    profile, cut, unclear = _cuts(docs)
    gone = profile.where(F.col("copy") & (F.col("n_words") >= WINDOW)).select("key").distinct()
    out = C.keyed_rows(docs, unclear).join(gone, "key", "left_anti").join(cut.select("key", "cut_text"), "key", "left")
    out = out.where(F.col("cut_text").isNull() | (F.size(F.split("cut_text", " ")) >= least_words) & (F.col("cut_text") != ""))
    cols = []
    for c, t in docs.dtypes:
        own = F.col("row").getField(c)
        if c == "text":
            own = F.coalesce("cut_text", own)
        elif c == "n_chars":
            own = F.when(F.col("cut_text").isNull(), own).otherwise(F.length("cut_text")).cast(t)
        cols.append(own.alias(c))
    return out.select(*cols)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(C.documents_of(spark, sf_dir))
