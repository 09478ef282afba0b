"""SimHash near duplicates by vantage-point trees (operator 13).

A document's fingerprint has a bit set where over half of its word shingles, repeats included, have it set in their XXH64 (seed 42).
Documents link when their fingerprints differ in at most ``bits`` places. Result: fingerprint and the smallest ``doc_id``
reachable over links, one row a document.

How:

1. Equal fingerprints are one class from here on; a group of thousands of copies is one row.
2. A vantage-point tree of at most ``LEAVES`` leaves is built from a sample of the classes: an inner node has a vantage fingerprint ``v`` and a
   radius ``r``, its near side is all ``x`` with ``d(x, v) <= r``. The sample only decides where the cuts lie, never what is found.
   The tree is sent to all tasks; it has 9 bytes a node, so a megabyte at most.
3. Each class goes to the shard of its leaf. By the triangle inequality two fingerprints on two sides of a cut can only be within
   ``bits`` of each other if the near one lies within ``bits`` of the cut; so near classes there also visit the far side, and
   visitors go on to every side within reach. Each linked pair thus meets in exactly one shard at least, once as member and visitor or as two members.
4. In a shard the tree grows on, by the same rule, down to ``LEAF`` members, where all distances are counted. Nothing but a spanning
   set of a shard's links leaves it, never all pairs. At most 2,080 other fingerprints lie within two bits of one.
5. Components follow by the stored rounds of ``components``; each class takes the smallest ``doc_id`` of its component.

Defined results: null, empty and wordless texts have fingerprint zero and are linked like any other; fewer words than a shingle are one
shingle; repeated rows are copies; rows of equal ids and other texts are each linked by their own text; a missing ``doc_id`` counts as
larger than all, a component of such rows alone has none; long texts are hashed in pieces; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import common as C
from factloom.llm.ngram_join import components

#: Classes of a shard, on average; leaves of the tree over all shards at most; sampled classes a leaf; members compared without a further cut.
SHARD, LEAVES, SAMPLE, LEAF = 4096, 1 << 16, 32, 256
#: Shingles hashed together.
PIECE = 1 << 16

_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: str | None, n: int = 3) -> int:
    """64 bits: those set in over half of the hashes of the text's ``n``-word shingles (A-Z lower-cased, ASCII white space between words)."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    if len(words) < n:
        return _hash(b" ".join(words))
    joined = b" ".join(words)
    ends = np.append(np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32), len(joined))
    starts = np.concatenate([[0], ends[:-1] + 1])
    total, count = np.zeros(64, dtype=np.int64), len(words) - n + 1
    for at in range(0, count, PIECE):
        upto = min(count, at + PIECE)
        hashes = np.fromiter((_hash(joined[a:b]) for a, b in zip(starts[at:upto].tolist(), ends[at + n - 1 : upto + n - 1].tolist())), dtype="<u8", count=upto - at)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > count, bitorder="little").view("<u8")[0])


def _fingerprints(n: int):
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t, n) for t in batch.column(1).to_pylist()], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return fn


def cut(points: np.ndarray, bits: int, seed: int) -> tuple[np.uint64, int] | None:
    """A vantage fingerprint and a radius that leave points on both sides, few of them within ``bits`` of the cut; None without one."""
    rnd = np.random.default_rng(seed)
    tried = points[rnd.permutation(len(points))[:16]] if len(points) > 16 else points
    seen = points[rnd.permutation(len(points))[:2048]] if len(points) > 2048 else points
    best = None
    for v in tried:
        d = np.bitwise_count(seen ^ v).astype(np.int64)
        r = min(int(np.median(d)), int(d.max()) - 1)
        near = np.count_nonzero(d <= r)
        if r >= 0 and near:
            worth = np.count_nonzero((d <= r) & (d > r - bits)) + abs(2 * near - len(d)) / 2
            if best is None or worth < best[0]:
                best = (worth, v, r)
    return best and best[1:]


def sides(d: np.ndarray, r: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of distances to the vantage: near members, members that also visit the far side; visitors that go near, that go far."""
    return d <= r, (d <= r) & (d > r - bits), d <= r + bits, d > r - bits


def grow(sample: np.ndarray, depth: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and radii of a tree of ``depth`` levels as a heap (children of i: 2i + 1 near, 2i + 2 far)."""
    size = (1 << depth) - 1
    vantage, radius = np.zeros(size, dtype=np.uint64), np.full(size, 31, dtype=np.int8)
    parts = {0: sample}
    for i in range(size):
        own = parts.pop(i, sample[:0])
        if found := cut(own, bits, i):
            vantage[i], radius[i] = found
        near = np.bitwise_count(own ^ vantage[i]) <= radius[i]
        parts[2 * i + 1], parts[2 * i + 2] = own[near], own[~near]
    return vantage, radius


def routes(points: np.ndarray, vantage: np.ndarray, radius: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, node below the tree, whether it is a member there) for each shard that a point belongs to or visits."""
    at, node, own = np.arange(len(points)), np.zeros(len(points), dtype=np.int64), np.ones(len(points), dtype=bool)
    for _ in range(len(vantage).bit_length()):
        d, r = np.bitwise_count(points[at] ^ vantage[node]).astype(np.int64), radius[node].astype(np.int64)
        near, both, go_near, go_far = sides(d, r, bits)
        left = np.where(own, near, go_near)
        right = np.where(own, ~near | both, go_far)
        at, own, node = np.concatenate([at[left], at[right]]), np.concatenate([own[left], (own & ~near)[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
    return at, node, own


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that links a[i] - b[i] join each of the nodes 0..n-1 with."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        np.minimum.at(new, label, new.copy())
        new = new[new]
        if (new == label).all():
            return label
        label = new


def meet(points: np.ndarray, members: np.ndarray, visitors: np.ndarray, bits: int, seed: int = 1):
    """Spanning links (i, j) of ``points`` between two members, or a member and a visitor, leaf by leaf."""
    found = cut(points[members], bits, seed) if len(members) > LEAF else None
    if found is None:
        both = np.concatenate([members, visitors])
        for k in range(0, len(both), 4 * LEAF):
            rows = both[k : k + 4 * LEAF]
            for m in range(0, len(members), 4 * LEAF):
                cols = members[m : m + 4 * LEAF]
                i, j = np.nonzero(np.bitwise_count(points[rows][:, None] ^ points[cols][None, :]) <= bits)
                linked, at = np.unique(np.concatenate([rows[i], cols[j]]), return_inverse=True)
                label = linked[forest(at[: len(i)], at[len(i) :], len(linked))] if len(linked) else linked
                yield label[label != linked], linked[label != linked]
        return
    v, r = found
    near, cross, _, _ = sides(np.bitwise_count(points[members] ^ v).astype(np.int64), r, bits)
    _, _, go_near, go_far = sides(np.bitwise_count(points[visitors] ^ v).astype(np.int64), r, bits)
    yield from meet(points, members[near], visitors[go_near], bits, 2 * seed)
    yield from meet(points, members[~near], np.concatenate([visitors[go_far], members[cross]]), bits, 2 * seed + 1)


def _shard(bits: int):
    """Rows (shard, fp, own) of one shard -> spanning links (a, b) of fingerprints."""

    def fn(rows: pa.Table) -> pa.Table:
        points, own = rows.column("fp").to_numpy().view(np.uint64), rows.column("own").to_numpy()
        found = list(meet(points, np.flatnonzero(own), np.flatnonzero(~own), bits))
        a, b = (np.concatenate([x[k] for x in found] or [np.zeros(0, dtype=np.int64)]) for k in (0, 1))
        label = forest(a, b, len(points))
        b = np.flatnonzero(label != np.arange(len(points)))
        return pa.table({"a": points[label[b]].view(np.int64), "b": points[b].view(np.int64)})

    return fn


def links(classes: DataFrame, bits: int) -> DataFrame:
    """Spanning links (a, b) of the distinct fingerprints ``fp`` that differ in at most ``bits`` places."""
    spark, count = classes.sparkSession, classes.count()
    depth = max(0, min(LEAVES, -(-count // SHARD)) - 1).bit_length()
    thin = max(1, count // (SAMPLE << depth))
    sample = classes.where(F.pmod(F.xxhash64("fp"), F.lit(thin)) == 0).select("fp").toArrow().column(0).to_numpy().view(np.uint64)
    tree = spark.sparkContext.broadcast(grow(np.sort(sample), depth, bits))

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        points = batch.column(0).to_numpy().view(np.uint64)
        at, node, own = routes(points, *tree.value, bits)
        return pa.RecordBatch.from_arrays([pa.array(node.astype(np.int32)), pa.array(points[at].view(np.int64)), pa.array(own)], names=["shard", "fp", "own"])

    dealt = C.map_arrow(classes.select("fp"), deal, "shard int, fp long, own boolean")
    return dealt.groupBy("shard").applyInArrow(_shard(bits), "a long, b long")


def simhash_components(docs: DataFrame, n: int = 3, bits: int = 2) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of each row of ``docs`` (doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = C.stored(C.map_arrow(texts, _fingerprints(n), "doc_id long, fp long"))
    # stored, so that both sides of the joins below are plain exchanges and a hot class can be split
    classes = C.stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = components(links(classes, bits))
    members = labels.union(labels.select(F.col("component").alias("node"), "component").distinct())
    joined = C.stored(classes.join(members, F.col("fp") == F.col("node"), "left").select("fp", "first", "component"))
    least = joined.where("component is not null").groupBy("component").agg(F.min("first").alias("least"))
    known = C.stored(joined.join(least, "component", "left").select("fp", F.coalesce("least", "first").alias("component_id")))
    return prints.join(known, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(C.documents_of(spark, sf_dir))
