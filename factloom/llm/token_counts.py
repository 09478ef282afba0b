"""Token counts with overlap resynchronisation (operator 4).

Texts longer than ``CHUNK`` characters are cut anywhere into chunks that overlap by ``OVERLAP`` characters on both
sides. Chunks of one document are spread over tasks; the library encodes each with offsets into the whole text.
What two neighbours say about their overlap meets in one place, and the splice is made at a proven common boundary:
a token of the same id and the same span in both, which

* starts a pre-split word in both: splitting runs from left to right, so from there on both go alike; or
* lies in a word that spans the whole overlap in both: a token sequence is an encoding exactly if every two neighbouring
  tokens are one, and each pair around the splice is a pair of one of the two encodings.

Tokens at a cut end prove nothing. The left neighbour's tokens count up to the splice, the right one's from it on. A
document with an unproven splice is cut again with overlaps (and chunks) ``WIDEN`` times as long, at last into one chunk.

Shorter texts are counted by their pieces between white space where the vocabulary drops white space (see
``pieces``), else as a whole.

Defined results: null text is the empty text: 0 bytes, 0 tokens; special strings inside texts count as the library
does by default; documents without an id and with equal ids are each counted by their own text, repeated rows too;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import common as C
from factloom.llm import pieces as P

#: Characters of a chunk, first overlap, growth of the overlap after a failed splice, token limit.
CHUNK, OVERLAP, WIDEN, LIMIT = 16_384, 256, 16, 2_048

_CHUNKS = "key string, number int, text string, base long, own_from long, own_to long, size long"
#: What a chunk says about a seam: ``side`` 0 is the left neighbour, 1 the right one, 2 the count of a last chunk.
_SIDES = "key string, seam int, side int, before long, ids array<int>, starts array<long>, ends array<long>, heads array<boolean>, spans boolean"
_SIDE_KINDS = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.bool_()]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def chunks(size: int, chunk: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(begin, own begin, own end, end) of each chunk of a text of ``size`` characters."""
    cuts = [*range(0, max(1, size - overlap), chunk), size]
    return [(max(0, a - overlap), a, b, min(size, b + overlap)) for a, b in zip(cuts, cuts[1:])]


def _chunks_batch(chunk: int, overlap: int):
    names = [c.split()[0] for c in _CHUNKS.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.string(), *[pa.int64()] * 4]

    def fn(batch: pa.RecordBatch):
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows = [(key, k, text[a:d], a, b, c, len(text)) for k, (a, b, c, d) in enumerate(chunks(len(text), chunk, overlap))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(kinds)], names=names)

    return fn


def _side(key: str, seam: int, side: int, e, base: int, lo: int, hi: int) -> tuple:
    """The tokens of an encoded chunk that lie in the overlap ``[lo, hi)`` around a seam."""
    spans = np.array(e.offsets, dtype=np.int64).reshape(-1, 2) + base
    words = np.array([-1 if w is None else w for w in e.word_ids], dtype=np.int64)
    head = np.concatenate([[True], (words[1:] != words[:-1]) | (words[1:] < 0)]) if len(words) else np.empty(0, dtype=bool)
    within = np.flatnonzero((spans[:, 0] >= lo) & (spans[:, 1] <= hi))
    if not len(within):
        return (key, seam, side, 0, [], [], [], [], False)
    a, b = int(within[0]), int(within[-1]) + 1
    # one word over the whole overlap: it comes in from the left, or goes on to the right, and no other starts between
    spanning = not head[a:b].any() if side == 0 else not head[a + 1 : b].any()
    return (key, seam, side, a, list(e.ids[a:b]), spans[a:b, 0].tolist(), spans[a:b, 1].tolist(), head[a:b].tolist(), bool(spanning))


def _encode_batch(path: str, overlap: int):
    names = [c.split()[0] for c in _SIDES.split(", ")]

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for key, k, text, base, a, b, size in zip(*(batch.column(k).to_pylist() for k in range(7))):
            e = P.library(path).encode(text, add_special_tokens=False)
            if k:
                rows.append(_side(key, k, 1, e, base, a - overlap, a + overlap))
            if b < size:
                rows.append(_side(key, k + 1, 0, e, base, b - overlap, b + overlap))
            else:
                rows.append((key, k + 1, 2, len(e.ids), [], [], [], [], False))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(_SIDE_KINDS)], names=names)

    return fn


def splice(left: dict, right: dict) -> int | None:
    """Tokens of the left chunk before a proven common boundary less those of the right one; None without proof."""

    def places(side: dict) -> dict[tuple[int, int, int], tuple[int, bool]]:
        found, upto = {}, -1
        for k, (i, a, b, head) in enumerate(zip(side["ids"], side["starts"], side["ends"], side["heads"])):
            if a >= upto and b > a:  # of the tokens that share one character only the first tells where it is
                found[i, a, b] = k, head
            upto = max(upto, b)
        return found

    here, there = places(left), places(right)
    last = max(left["ends"], default=0)
    middle = (left["starts"][0] + last) // 2 if left["starts"] else 0
    one_word = left["spans"] and right["spans"]
    # tokens that touch the left chunk's end or the right chunk's begin stand at a cut
    first = min(right["starts"], default=0)
    proven = [t for t in here.keys() & there.keys() if t[2] < last and t[1] > first and (here[t][1] and there[t][1] or one_word)]
    if not proven:
        return None
    t = min(proven, key=lambda t: (abs(t[1] - middle), t))
    return left["before"] + here[t][0] - right["before"] - there[t][0]


def _splice_partition(batches):
    """Pairs up the two sides of each seam; rows come sorted by key, seam and side."""
    names, kinds = ["key", "n", "proven"], [pa.string(), pa.int64(), pa.bool_()]
    held = None
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            if row["side"] == 2:
                rows.append((row["key"], row["before"], True))
            elif row["side"] == 0:
                held = row
            else:
                n = splice(held, row)
                rows.append((row["key"], n or 0, n is not None))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(kinds)], names=names)


def spliced_counts(texts: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, n_tokens) of long texts (key, text), keys being distinct."""
    pending, done = texts, None
    overlap = min(overlap, chunk // 4)
    while True:
        cut = C.map_arrow(pending, _chunks_batch(chunk, overlap), _CHUNKS)
        sides = C.map_arrow(cut.repartition("key", "number"), _encode_batch(path, overlap), _SIDES)
        parts = sides.repartition("key", "seam").sortWithinPartitions("key", "seam", "side").mapInArrow(_splice_partition, "key string, n long, proven boolean")
        found = C.stored(parts.groupBy("key").agg(F.sum("n").alias("n_tokens"), F.bool_and("proven").alias("proven")))
        good = found.where("proven").select("key", "n_tokens")
        done = good if done is None else done.union(good)
        failed = found.where("not proven").select("key")
        if failed.isEmpty():
            return done
        pending, overlap = pending.join(failed, "key", "left_semi"), overlap * WIDEN
        chunk = max(chunk, 4 * overlap)


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``."""
    path = vocabulary or default_vocabulary()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    huge = F.length("text") > chunk

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = pa.array(P.count_tokens(path, batch.column(1)), type=pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), pc.cast(pc.binary_length(batch.column(1)), pa.int64()), n], names=["doc_id", "n_bytes", "n_tokens"])

    short = C.map_arrow(texts.where(~huge), fn, "doc_id long, n_bytes long, n_tokens long", P.SLICE)
    # equal texts are encoded once, whatever their ids
    long = texts.where(huge).withColumn("key", F.sha2("text", 256))
    spliced = spliced_counts(long.select("key", "text").dropDuplicates(["key"]), path, chunk)
    sized = long.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"))
    both = short.union(sized.join(spliced, "key").select("doc_id", "n_bytes", "n_tokens"))
    return both.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(C.documents_of(spark, sf_dir))
