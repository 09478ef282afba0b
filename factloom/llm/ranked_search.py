"""Ranked lexical search by the Best Position Algorithm (operator 11).

Every item of a query table is scored against all documents; its ``k`` best stay. Terms are runs of ASCII letters, digits and
characters beyond ASCII, A-Z lower-cased. A term's weight falls with the number of documents that hold it, its impact in a
document grows with its count there and falls with the document's length (all in whole numbers, see ``impacts``).

How:

1. Items go in blocks of about ``BLOCK_BYTES`` of text. A pass over the documents counts the terms of the block in each
   (``doc_id``, its terms with repeats, the block's terms and their counts) and stores that. Nothing is shuffled.
2. Document counts of terms, ``N`` and ``L`` are sums over the stored table, combined before they move.
3. A second pass reads the stored counts in shards of about ``SHARD`` postings. A shard's postings are sorted into one list a term, by
   falling impact. An item reads its lists from their best positions on; each document met so is looked up in all
   lists at once (direct access), which gives its whole score and marks its places as seen. A list's best position is the end of
   its run of seen places from the top, so it moves beyond what was read there. What no list has shown yet scores at most the sum of the
   first unseen impacts; the item is done in the shard once that sum lies strictly below its ``k``-th score. Ties are thus
   never lost. The ``k`` best of earlier shards of a task count, too.
4. Each task returns at most ``k`` rows an item; the ranking over all tasks drops rows before they are shuffled.

Memory is bounded by a shard and a block. A block holds one item at least, so an item's own text must fit.

Defined results: null or termless texts are no documents (they count neither in ``N`` nor in ``L``) and have no rank; null or termless items have no
rows; repeated documents are documents of their own; equal scores go by ``doc_id``, a missing one last; repeated items are one, items of
equal ids and other texts are ranked each; a missing ``item_id`` stays missing; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from factloom.llm import common as C

#: Bytes of item text that are ranked together; postings that a task holds together; places that a list is read on at first.
BLOCK_BYTES, SHARD, STEP = 4 << 20, 1 << 20, 32

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LETTERS).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, lengths: list[int], n_docs: int, n_terms: int, per_doc: np.ndarray) -> np.ndarray:
    """Impact of each posting; ``lengths`` and ``per_doc`` (postings) are a document's."""
    m = np.array([25 + 75 * n * n_docs // n_terms for n in lengths], dtype=np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, per_doc))


def _count_batch(vocabulary: dict[bytes, int]):
    """(doc_id, text) -> (doc_id, n, terms, counts): the terms of the vocabulary in each text."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, n = [], np.zeros(batch.num_rows, dtype=np.int64)
        for i, t in enumerate(batch.column(1).to_pylist()):
            w = terms_of(t)
            n[i] = len(w)
            words.extend(w)
        ids = np.fromiter(map(vocabulary.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        own = np.repeat(np.arange(len(n)), n)[ids >= 0]
        both, counts = np.unique(own * len(vocabulary) + ids[ids >= 0], return_counts=True)
        per_doc = np.bincount(both // max(1, len(vocabulary)), minlength=len(n))
        cols = [batch.column(0), pa.array(n), C.list_array((both % max(1, len(vocabulary))).astype(np.int32), per_doc, pa.int32()), C.list_array(counts, per_doc, pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "terms", "counts"])

    return fn


class Lists:
    """The impact lists of a shard, one a term, and the way from a document to its places in them."""

    def __init__(self, terms: np.ndarray, impact: np.ndarray, per_doc: np.ndarray, n_terms: int):
        docs = np.repeat(np.arange(len(per_doc)), per_doc)
        order = np.lexsort((-impact, terms))
        self.docs, self.impact = docs[order], impact[order]
        self.start = np.searchsorted(terms[order], np.arange(n_terms + 1))
        # in document order: term, impact, and the place in the lists
        self.term, self.own_impact, self.place = terms, impact, np.empty(len(order), dtype=np.int64)
        self.place[order] = np.arange(len(order))
        self.first = np.concatenate([[0], np.cumsum(per_doc)])
        self.seen, self.scored, self.now = np.zeros(len(order), dtype=np.int64), np.zeros(len(per_doc), dtype=np.int64), 0

    def look_up(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Whole scores of ``docs``; their places in the lists of the terms with a weight are seen from now on."""
        counts = self.first[docs + 1] - self.first[docs]
        begin = np.concatenate([[0], np.cumsum(counts)[:-1]])[: len(docs)].astype(np.int64)
        at = np.repeat(self.first[docs] - begin, counts) + np.arange(counts.sum())
        w = weights[self.term[at]]
        self.seen[self.place[at[w > 0]]] = self.now
        return np.add.reduceat(w * self.own_impact[at], begin) if len(docs) else w  # each has a posting at least

    def best_position(self, at: int, end: int) -> int:
        """The first unseen place from ``at`` on."""
        step = STEP
        while at < end:
            unseen = np.flatnonzero(self.seen[at : min(end, at + step)] != self.now)
            if len(unseen):
                return at + int(unseen[0])
            at, step = min(end, at + step), 2 * step
        return end

    def best(self, weights: np.ndarray, ids: np.ndarray, missing: np.ndarray, top: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
        """``top`` (scores, missing ids, ids: the best of other shards) with the documents of this one that rank before its last."""
        self.now += 1
        terms = np.flatnonzero(weights)
        at, ends, w, step = self.start[terms].copy(), self.start[terms + 1], weights[terms], STEP
        while True:
            open_lists = at < ends
            bound = int((w * np.where(open_lists, self.impact[np.minimum(at, len(self.impact) - 1)], 0)).sum()) if len(self.impact) else 0
            if not open_lists.any() or (len(top[0]) == k and bound < top[0][-1]):
                return top
            read = np.concatenate([self.docs[a : min(a + step, b)] for a, b in zip(at, ends)])
            new = np.unique(read[self.scored[read] != self.now])
            self.scored[new] = self.now
            scores = self.look_up(new, weights)
            top = ranked(tuple(np.concatenate(x) for x in zip(top, (scores, missing[new], ids[new]))), k)
            at = np.array([self.best_position(a, b) for a, b in zip(at, ends)])
            step *= 2


def ranked(rows: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` first of (scores, missing ids, ids): highest score, then smallest id, missing ones last; scores above 0."""
    scores, missing, ids = rows
    floor = max(1, np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) > k else 1
    keep = np.flatnonzero(scores >= floor)
    keep = keep[np.lexsort((ids[keep], missing[keep], -scores[keep]))][:k]
    return scores[keep], missing[keep], ids[keep]


NOTHING = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64))


def _rank_task(queries: list[tuple[object, dict[int, int]]], n_terms: int, stats: tuple[int, int], k: int, id_type: pa.DataType):
    """Shards of (doc_id, n, terms, counts) -> the task's best rows (item, item_id, doc_id, score)."""
    names = ["item", "item_id", "doc_id", "score"]

    def shards(batches):
        held, size = [], 0
        for batch in batches:
            for part in C.slices(batch, 4 * SHARD):
                held.append(part)
                size += len(part.column(2).flatten())
                if size >= SHARD:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def run(batches):
        C.forget_all_but(__name__)
        tops = [NOTHING] * len(queries)
        weights = []
        for _, terms in queries:
            w = np.zeros(n_terms, dtype=np.int64)
            w[list(terms)] = list(terms.values())
            weights.append(w)
        for held in shards(batches):
            part = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            per_doc = np.diff(part.column(2).offsets.to_numpy())
            terms, counts = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()
            lists = Lists(terms.astype(np.int64), impacts(counts, part.column(1).to_pylist(), *stats, per_doc), per_doc, n_terms)
            missing = np.asarray(part.column(0).is_null())
            ids = part.column(0).fill_null(0).to_numpy()
            for q, w in enumerate(weights):
                tops[q] = lists.best(w, ids, missing, tops[q], k)
            C.release()
        for q, (scores, missing, ids) in enumerate(tops):
            if len(scores):
                n = len(scores)
                cols = [pa.array([q] * n, type=pa.int32()), pa.array([queries[q][0]] * n, type=id_type), pa.array(ids, mask=missing), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _blocks(items: DataFrame) -> list[list[tuple[object, Counter]]]:
    """Lists of the items (item_id, counted terms), about ``BLOCK_BYTES`` of text each; null and termless ones are left out."""
    items = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
    n = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES)
    for b in range(n):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).distinct().collect()
        queries = [(r.item_id, Counter(terms_of(r.text))) for r in block]
        if queries := [q for q in queries if q[1]]:
            yield queries


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents (doc_id, text) of the highest score above 0 for each of the items (item_id, text)."""
    spark = docs.sparkSession
    id_type = items.schema["item_id"].dataType
    schema = f"item int, item_id {id_type.simpleString()}, doc_id long, score long"
    texts, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), spark.createDataFrame([], "item_id string, rank int, doc_id long, score long")
    out = out.withColumn("item_id", F.col("item_id").cast(id_type))
    C.ship(spark)
    for queries in _blocks(items):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in queries for t in terms}))}
        counted = C.stored(C.map_arrow(texts, _count_batch(vocabulary), "doc_id long, n long, terms array<int>, counts array<long>"))
        stats = counted.where("n > 0").agg(F.count("*"), F.sum("n")).first()
        if not stats[0]:
            return out
        df = {r.term: r["count"] for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}  # a row a term of the block
        weighed = []
        for item_id, terms in queries:
            own = {vocabulary[t]: n * weight(stats[0], df[vocabulary[t]]) for t, n in terms.items() if vocabulary[t] in df}
            weighed.append((item_id, own))
        found = counted.where("size(terms) > 0").mapInArrow(_rank_task(weighed, len(vocabulary), tuple(stats), k, to_arrow_type(id_type)), schema)
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        best = found.withColumn("rank", place).where(F.col("rank") <= k)
        out = out.union(best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(C.documents_of(spark, sf_dir), C.documents_of(spark, sf_dir, "benchmark"))
