"""Benchmark decontamination by a generalised suffix automaton (operator 8).

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z. A window is ``WINDOW`` consecutive
words of an item; an item of fewer words, but not none, is one window. A document word inside any occurrence
of a window is hit; a document is contaminated if ``n_hit > 0`` and ``20 * n_hit >= n_words``.

How: the items' word sequences go into one suffix automaton over word ids. A document's words stream through it
while the longest match that ends at each word is tracked; where it reaches a window's length, the state's
marks (windows and their items, found along suffix links) tell what occurs. Runs of words whose pairs the automaton has no
two-step path for can hold no window and are skipped by array lookups, so only stretches that may match
are streamed.

The items are sent to the executors only in blocks of a proven size: item texts longer than a quarter of a block are cut in Spark into pieces
that overlap by a window less one word, so that they have the same windows; pieces are dealt by hash, and each deal is filled up into
blocks by running sums. An automaton has at most two states and three arcs for each word of its
items; they lie in flat arrays and one table of arcs. With one block documents are judged in one pass; with several, each
pass gives only the spans and items that one block finds, and these are united per document before it is judged.

Defined results: null or empty text has no words, no hits, ``items_sha256`` of the empty string, not
contaminated; empty items are no windows; equal items with different ids all count; repeated document rows, and rows with
equal or missing ids, are each judged by their own text; other columns are ignored; empty tables give no hits or no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm import common as C

WINDOW = 13
#: Bytes of item texts in one automaton.
BLOCK_BYTES = 4 << 20

_TABLE = bytes(c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else (c + 32 if chr(c).isupper() else 32) for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class SuffixAutomaton:
    """A generalised suffix automaton of item word sequences, with windows marked."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        sequences = []
        for name, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text)]
            if ids:
                sequences.append((name, ids))
        self.base = len(self.vocab) + 1
        self.arcs: dict[int, int] = {}  # state * base + word -> state
        self.link, self.length = array("i", [-1]), array("i", [0])
        # the words that leave a state, as linked lists: needed for clones only
        self._head, self._word, self._more = array("i", [-1]), array("i"), array("i")
        for _, ids in sequences:
            self._add(ids)
        del self._head, self._word, self._more
        self._mark(sequences, window)
        pairs = [np.array(ids[:-1], dtype=np.int64) * len(self.vocab) + np.array(ids[1:], dtype=np.int64) for _, ids in sequences if len(ids) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, dtype=np.int64)

    def _mark(self, sequences: list[tuple[str, list[int]]], window: int) -> None:
        """Which windows, of which size and item, end in each state."""
        self.names = sorted({n for n, _ in sequences})
        number = {n: i for i, n in enumerate(self.names)}
        self.shortest = min([window, *(len(ids) for _, ids in sequences)])
        states, sizes, owners = array("i"), array("i"), array("i")
        for name, ids in sequences:
            size = min(window, len(ids))
            state, have = 0, 0
            for i, w in enumerate(ids):
                state, have = self.step(state, have, w)
                if i + 1 >= size:
                    s = state
                    while self.length[self.link[s]] >= size:
                        s = self.link[s]
                    states.append(s)
                    sizes.append(size)
                    owners.append(number[name])
        rows = np.unique(np.array([states, sizes, owners], dtype=np.int64).T, axis=0) if len(states) else np.empty((0, 3), dtype=np.int64)
        self.first_mark = np.searchsorted(rows[:, 0], np.arange(len(self.link) + 1)).astype(np.int32)
        self.mark_size, self.mark_item = rows[:, 1].astype(np.int32), rows[:, 2].astype(np.int32)
        #: nearest state with marks along suffix links, itself included
        self.marked = array("i", bytes(4 * len(self.link)))
        for s in np.argsort(np.array(self.length), kind="stable")[1:].tolist():
            self.marked[s] = s if self.first_mark[s + 1] > self.first_mark[s] else self.marked[self.link[s]]

    def _state(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self._head.append(-1)
        return len(self.length) - 1

    def _arc(self, state: int, w: int, to: int) -> None:
        self._word.append(w)
        self._more.append(self._head[state])
        self._head[state] = len(self._word) - 1
        self.arcs[state * self.base + w] = to

    def _split(self, p: int, w: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q])
        k = self._head[q]
        while k >= 0:
            self._arc(clone, self._word[k], self.arcs[q * self.base + self._word[k]])
            k = self._more[k]
        self.link[q] = clone
        while p >= 0 and self.arcs.get(p * self.base + w) == q:
            self.arcs[p * self.base + w] = clone
            p = self.link[p]
        return clone

    def _add(self, ids: list[int]) -> None:
        last = 0
        for w in ids:
            q = self.arcs.get(last * self.base + w)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
                continue
            new, p = self._state(self.length[last] + 1, 0), last
            while p >= 0 and p * self.base + w not in self.arcs:
                self._arc(p, w, new)
                p = self.link[p]
            if p >= 0:
                q = self.arcs[p * self.base + w]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
            last = new

    def step(self, state: int, have: int, w: int) -> tuple[int, int]:
        """Follow word ``w`` from a match of ``have`` words: the longest match that ends with it."""
        to = self.arcs.get(state * self.base + w)
        while to is None and state:
            state = self.link[state]
            have = self.length[state]
            to = self.arcs.get(state * self.base + w)
        return (0, 0) if to is None else (to, have + 1)

    def scan(self, ids: list[int], base: int, spans: list[int], found: set[int]) -> None:
        """Stream a stretch; append the (start, end) of occurring windows and add their items."""
        state, have = 0, 0
        for i, w in enumerate(ids):
            state, have = self.step(state, have, w)
            s = self.marked[state]
            while s:
                for k in range(self.first_mark[s], self.first_mark[s + 1]):
                    size = int(self.mark_size[k])
                    if size <= have:
                        end = base + i + 1
                        if spans and spans[-1] >= end - size >= spans[-2]:
                            spans[-1] = max(spans[-1], end)
                        else:
                            spans += (end - size, end)
                        found.add(int(self.mark_item[k]))
                s = self.marked[self.link[s]]

    def documents(self, texts: list[str | None]) -> list[tuple[int, list[int], set[int]]]:
        """(n_words, spans, items) of each text."""
        words = [words_of(t) for t in texts]
        n = np.array([len(w) for w in words], dtype=np.int64)
        out = [(int(c), [], set()) for c in n]
        if not self.vocab:
            return out
        ids = np.fromiter(map(self.vocab.get, (x for w in words for x in w), repeat(-1)), dtype=np.int64, count=int(n.sum()))
        ends = np.cumsum(n)
        known = ids >= 0
        joined = np.zeros(len(ids), dtype=bool)  # word k goes on from word k - 1
        at = np.flatnonzero(known[1:] & known[:-1])
        if len(at) and len(self.pairs):
            code = ids[at] * len(self.vocab) + ids[at + 1]
            k = np.searchsorted(self.pairs, code)
            k[k == len(self.pairs)] = 0
            joined[at[self.pairs[k] == code] + 1] = True
        joined[ends[:-1][ends[:-1] < len(ids)]] = False
        first = np.flatnonzero(known & ~joined)
        stop = np.append(first[1:], len(ids))
        unknown = np.flatnonzero(~known)
        if len(unknown):
            k = np.searchsorted(unknown, first)
            stop = np.minimum(stop, np.append(unknown, len(ids))[k])
        fits = stop - first >= self.shortest
        for a, b, d in zip(first[fits].tolist(), stop[fits].tolist(), np.searchsorted(ends, first[fits], side="right").tolist()):
            self.scan(ids[a:b].tolist(), a - int(ends[d] - n[d]), out[d][1], out[d][2])
        return out


_BUILT: dict[str, SuffixAutomaton] = {}
C.remembers((__name__,), _BUILT.clear)


def _automaton(items: Broadcast, name: str, window: int) -> SuffixAutomaton:
    """The automaton of a block, built once per worker."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = SuffixAutomaton(items.value, window)
    return _BUILT[name]


def _scan_batch(items: Broadcast, window: int):
    """(key, spans, items) of the texts (key, text) in which a block of items is found."""
    name = uuid.uuid4().hex

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        auto = _automaton(items, name, window)
        rows = [(key, spans, [auto.names[i] for i in found]) for key, (_, spans, found) in zip(batch.column(0).to_pylist(), auto.documents(batch.column(1).to_pylist())) if spans]
        kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(kinds)], names=["key", "spans", "items"])

    return fn


def _hit_positions(spans: list[int], n: int) -> np.ndarray:
    mark = np.zeros(n + 1, dtype=np.int64)
    s = np.array(spans, dtype=np.int64)
    np.add.at(mark, s[::2], 1)
    np.add.at(mark, s[1::2], -1)
    return np.cumsum(mark)[:n] > 0


_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def cut_spans(text: str, hit: np.ndarray, longest: int, share: float) -> str:
    """``text`` without its hit runs of ``longest`` words or more; all hit runs go where they cover ``share`` of it."""
    every = len(hit) > 0 and hit.sum() >= share * len(hit)
    lowered = re.sub("[A-Z]+", lambda m: m[0].lower(), text)
    places = [m.span() for m in _WORD.finditer(lowered)]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    out, at = [], 0
    for a, b in zip(edge[::2], edge[1::2]):
        if every or b - a >= longest:
            out.append(text[at : places[a][0]])
            at = places[b - 1][1]
    return "".join([*out, text[at:]])


def _judge_batch(items: Broadcast | None, window: int, texts: bool, longest: int, share: float):
    """Judge documents (doc_id, text, spans, items) by what is given, or (doc_id, text) by what the only block finds."""
    name = uuid.uuid4().hex

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = batch.column(1).to_pylist()
        if items is None:
            found = [(len(words_of(t)), spans or [], names or []) for t, spans, names in zip(own, batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        else:
            auto = _automaton(items, name, window)
            found = [(n, spans, [auto.names[i] for i in k]) for n, spans, k in auto.documents(own)]
        rows = []
        for text, (n, spans, names) in zip(own, found):
            hit = _hit_positions(spans, n)
            n_hit, names = int(hit.sum()), sorted(set(names))
            row = [n, n_hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= n]
            rows.append(row + [cut_spans(text, hit, longest, share) if n_hit else text] * texts)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()] + [pa.string()] * texts
        cols = [pa.array([r[k] for r in rows], type=kind) for k, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "clean_text"][: 6 + texts])

    return fn


def _cut_batch(window: int, limit: int):
    """Items (item_id, text) as pieces of about ``limit`` bytes that hold the same windows."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, pieces = [], []
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(text)
            at = 0
            while True:
                end, size = at, 0
                while end < len(words) and (size < limit or end - at < 2 * window):
                    size += len(words[end]) + 1
                    end += 1
                names.append(name)
                pieces.append(b" ".join(words[at:end]).decode("utf-8", "surrogatepass"))
                if end == len(words):
                    break
                at = end - window + 1
        return pa.RecordBatch.from_arrays([pa.array(names, type=pa.string()), pa.array(pieces, type=pa.string())], names=["item_id", "text"])

    return fn


def _blocks(items: DataFrame, window: int):
    """(number of blocks, broadcast) of the items (item_id, text), ``BLOCK_BYTES`` of text each at most."""
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    limit = BLOCK_BYTES // 4
    total, longest = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.max(F.octet_length("text")), F.lit(0))).first()
    if longest > limit:
        long = F.octet_length("text") > limit
        items = C.stored(items.where(~long).union(C.map_arrow(items.where(long), _cut_batch(window, limit), "item_id string, text string")))
        total = items.agg(F.sum(F.octet_length("text"))).first()[0]
    if total <= BLOCK_BYTES:
        yield 1, _sent(items)
        return
    # a block ends with the piece that reaches three quarters, and a piece has a quarter at most
    deals = -(-2 * total // BLOCK_BYTES)
    order = Window.partitionBy("deal").orderBy("item_id", "text").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.octet_length("text")).over(order), F.lit(0))
    dealt = items.withColumn("deal", F.pmod(F.xxhash64("item_id", "text"), F.lit(deals))).withColumn("fill", F.floor(before / (3 * limit)))
    dealt = C.stored(dealt)
    places = sorted(map(tuple, dealt.select("deal", "fill").distinct().collect()))  # a row a block
    for deal, fill in places:
        yield len(places), _sent(dealt.where((F.col("deal") == deal) & (F.col("fill") == fill)))


def _sent(block: DataFrame) -> Broadcast:
    rows = block.select("item_id", "text").collect()
    return block.sparkSession.sparkContext.broadcast(sorted((r.item_id, r.text) for r in rows))


_JUDGED = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _hits(docs: DataFrame, items: DataFrame, window: int) -> tuple[Broadcast | None, DataFrame | None, DataFrame | None, DataFrame | None]:
    """The broadcast of an only block; else the keyed texts, (key, spans, items) of the texts that any block is found in, and
    the ids that stand for several texts."""
    hashed, hits, keyed, unclear = C.hashed_texts(docs), None, None, None
    for n, sent in _blocks(items, window):
        if n == 1:
            return sent, None, None, None
        if keyed is None:
            unclear = C.unclear_ids(hashed.select("doc_id", "h"))
            keyed = C.with_key(hashed, unclear)
        found = C.map_arrow(keyed.select("key", "text"), _scan_batch(sent, window), "key long, spans array<int>, items array<string>")
        found = C.stored(found.dropDuplicates(["key"]))  # repeated rows have one key and equal spans
        hits = found if hits is None else hits.union(found)
    # a row a block at most
    return None, keyed, hits.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items")), unclear


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, texts: bool = True, longest: int = WINDOW, share: float = 0.05) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` and, with ``texts``, ``clean_text``: the text
    without spans of ``longest`` words or more, and without any hit span where these cover ``share`` of its words."""
    sent, keyed, hits, _ = _hits(docs, items, window)
    rows = C.hashed_texts(docs).select("doc_id", "text") if sent else keyed.join(hits, "key", "left").select("doc_id", "text", "spans", "items")
    return C.map_arrow(rows, _judge_batch(sent, window, texts, longest, share), _JUDGED + ", clean_text string" * texts)


def contaminated_removed(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated documents. With one block of items no row is shuffled.

    Null and empty texts stay; repeated rows stay or go together; rows with equal or missing ids are each judged by their
    own text; an empty table stays empty; columns keep names and values.
    """
    sent, keyed, hits, unclear = _hits(docs, items, window)
    judge = _judge_batch(sent, window, False, window, 0.0)
    if sent:

        def clean(texts: pa.Array) -> np.ndarray:
            judged = judge(pa.RecordBatch.from_arrays([pa.nulls(len(texts), type=pa.int64()), texts], names=["doc_id", "text"]))
            return ~np.array(judged.column(5).to_pylist(), dtype=bool)

        return C.where_texts(docs, clean)
    bad = C.map_arrow(keyed.join(hits, "key").select("key", "text", "spans", "items"), judge, _JUDGED).where("contaminated")
    return C.keyed_rows(docs, unclear).join(bad.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(C.documents_of(spark, sf_dir), C.documents_of(spark, sf_dir, "benchmark"), texts=False)
