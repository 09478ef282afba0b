"""N-gram Jaccard join by a token-group matrix (operator 2).

A document is its set of distinct 3-word shingles. Two documents link when
``100 * |A & B| >= 90 * |A | B|``. Result: one row per document with its set size and the smallest
``doc_id`` reachable over links.

How:

1. Equal sets are one class, represented by their smallest ``doc_id``; a group of thousands of copies is
   one representative from here on.
2. A set is dealt into ``m`` slices by shingle hash. A pair that links differs in at most ``d < m``
   shingles, so at least one slice is identical (pigeonhole); the digests of the slices are the set's
   *matrix tokens*. A shingle that is frequent on its own cannot make a token frequent. Sizes are banded;
   a set near the upper end of its band also carries the tokens of the next band.
3. Of the representatives that share a token, those stay that can still have a partner: with ``FINE`` times finer
   slices, a linked set must find all but ``d`` of its slices in the union of all others (the matrix read as one
   group). A set with too many empty slices for this count stays. An edited copy fails this once its edits are its own.
4. The rest is partitioned into groups of similar sets: by the most widely shared token, whose smallest set is the
   centre. Sets that link with their centre form groups that are one component already; the others form
   groups of their own. Groups are split by hash to about ``GROUP`` members, so none is unbounded.
5. The token-group matrix holds each group's token union. A query set meets only groups whose union has
   one of its tokens, never those of its own component; there, the group's shingle union bounds the overlap:
   fewer than ``percent`` of the query's shingles in the union and the group stays closed. In an opened group
   the query is compared exactly with every member. Groups open in passes, so that the disk needed does not grow with the
   number of groups that a set calls. Only a spanning set of the links is emitted, never
   all pairs of a group. Components follow by min-label propagation with a stored table per round.

Defined results: null text, no words -> ``n_shingles`` 0, linked with nothing (own ``doc_id``); fewer than
three words -> the whole sequence is the one shingle; repeated rows are copies of each other; rows with an equal
``doc_id`` but other texts are each linked by their own text; a missing ``doc_id`` counts as larger than all, and a
component of such rows alone has none; other columns are ignored; an empty table gives an empty result. Shingles are compared by 64-bit hashes
(two different shingles of one corpus of 10^9 collide with probability 0.03, and one collision moves one
similarity by one shingle), classes by 128 bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import common as C

#: Size bands grow by this factor.
BAND = 1.6
#: Members of a group, and queries that open it in one task; fine slices per slice; tokens of a bucket.
GROUP, QUERIES, FINE, BUCKET = 256, 512, 2, 2 << 20
#: Bytes of shingles that a pass over opened groups may shuffle in any case.
PASS_BYTES = 512 << 20


def _allowed_difference(total: int, percent: int) -> int:
    """Largest symmetric difference of two linked sets whose sizes add up to ``total``."""
    return total * (100 - percent) // (100 + percent)


def _bands(percent: int, top: int = 1 << 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band starts; per band the largest difference ``d`` of a linked pair, and the spare slices beyond ``d + 1``.

    Slices without a shingle are equal in all sets and say nothing. With ``spare`` more slices than the pigeonhole
    needs, a set with at most ``spare`` empty slices shares one that is not empty with every partner.
    """
    starts = [1]
    while starts[-1] < top:
        starts.append(max(starts[-1] + 1, int(starts[-1] * BAND)))
    d = np.array([_allowed_difference(2 * (b - 1), percent) for b in starts[1:]], dtype=np.int64)
    return np.array(starts[:-1], dtype=np.int64), d, np.where(d > 0, 2 + d // 16, 0)


def shingle_hashes(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (A-Z lower-cased, ASCII white space between words)."""
    words: list[bytes] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        if t:
            w = t.encode("utf-8", "surrogatepass").lower().split()
            counts[i] = len(w)
            words.extend(w)
    h = C.word_hashes(words)
    full = len(h) - n + 1
    if full > 0:
        rolled = np.zeros(full, dtype=np.uint64)
        for k in range(n):
            rolled = C.mix((rolled + h[k : k + full]) * C.GOLDEN + np.uint64(k))
    out, at = [], 0
    for c in counts:
        if c == 0:
            out.append(np.empty(0, dtype=np.uint64))
        elif c < n:
            x = np.uint64(1) + np.uint64(c)
            for v in h[at : at + c]:
                x = C.mix(np.array([x ^ v]) * C.GOLDEN)[0]
            out.append(np.array([x], dtype=np.uint64))
        else:
            out.append(np.unique(rolled[at : at + c - n + 1]))
        at += c
    return out


def slice_tokens(s: np.ndarray, bands: tuple[np.ndarray, np.ndarray, np.ndarray], percent: int, fine: int = 1) -> list[tuple[np.ndarray, int]]:
    """(tokens, number of them that a partner shares at least) of a sorted shingle set, for its band and, near the
    band's end, for the next. Tokens are the digests of the slices that are not empty. A set with too many empty ones for
    the bound gives those, too; of its fine tokens a partner need not share any, as the partner may leave them out."""
    starts, allowed, spare = bands
    size, out = len(s), []
    if not size:
        return out
    band = int(np.searchsorted(starts, size, side="right")) - 1
    reach = size * 100 // percent
    mixed = C.mix(s)
    for b in [band] if band + 1 >= len(starts) or reach < starts[band + 1] else [band, band + 1]:
        d = int(allowed[b])
        m = (d + 1 + int(spare[b])) * fine
        digest = np.zeros(m, dtype=np.uint64)
        where = ((mixed >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        np.add.at(digest, where, C.mix(mixed ^ C.GOLDEN))
        salt = C.mix(np.arange(m, dtype=np.uint64) + np.uint64(b) * np.uint64(1 << 40) + np.uint64(7 * fine))
        tokens = C.mix(digest ^ salt)
        full = np.bincount(where, minlength=m) > 0
        empty = m - int(full.sum())
        if m - d > empty:
            out.append((tokens[full], m - d - empty))
        else:
            out.append((tokens, m - d) if fine == 1 else (tokens[full], 0))
    return out


def _sets_batch(n: int):
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_hashes(batch.column(2).to_pylist(), n)
        a = [int(C.mix(s).sum(dtype=np.uint64)) if len(s) else 0 for s in sets]
        b = [int(C.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) if len(s) else 0 for s in sets]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], type=pa.int64()), pa.array(np.array(a, dtype=np.uint64).view(np.int64)), pa.array(np.array(b, dtype=np.uint64).view(np.int64))],
            names=["doc_id", "h", "n_shingles", "sig_a", "sig_b"],
        )

    return fn


def _tokens_of(n: int, percent: int):
    """Slice tokens of each text of a batch (key, text)."""
    bands = _bands(percent)

    def make(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
        sets = shingle_hashes(batch.column(1).to_pylist(), n)
        ids, tokens = [], []
        for i, s in zip(batch.column(0).to_pylist(), sets):
            for t, _ in slice_tokens(s, bands, percent):
                ids.append(i)
                tokens.append(t)
        return np.array(ids, dtype=np.int64), tokens

    return make


def _fine_tokens_of(percent: int):
    """Fine tokens of each set of a batch (number, shingles); the id is twice the number, plus one for the next band."""
    bands = _bands(percent)

    def make(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
        ids, tokens = [], []
        for i, s in zip(batch.column(0).to_pylist(), batch.column(1)):
            s = s.values.to_numpy(zero_copy_only=False).view(np.uint64)
            for k, (t, _) in enumerate(slice_tokens(s, bands, percent, FINE)):
                ids.append(2 * i + k)
                tokens.append(t)
        return np.array(ids, dtype=np.int64), tokens

    return make


def _shingles_batch(n: int, percent: int):
    """Shingles of each text, and how many fine tokens a partner shares at least in its band and in the next."""
    bands = _bands(percent)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_hashes(batch.column(1).to_pylist(), n)
        flat = np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)
        least = [[k for _, k in slice_tokens(s, bands, percent, FINE)] for s in sets]
        need = [pa.array([x[k] if len(x) > k else None for x in least], type=pa.int64()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([batch.column(0), C.list_array(flat.view(np.int64), np.array([len(s) for s in sets])), *need], names=["rep", "shingles", "need_0", "need_1"])

    return fn


_LOW = np.uint64((1 << 48) - 1)


def _deal_batch(make, buckets: int):
    """Deal the tokens of a batch to buckets by their upper bits, as packed arrays (8 bytes a token).

    A token that several entries of the batch hold is shared already: its rows go straight on (``direct``), and one of
    them goes to the bucket for the other batches. So a bucket gets a token once per batch, however many sets hold it.
    """

    def fn(batch: pa.RecordBatch):
        ids, tokens = make(batch)
        if not len(ids):
            return
        flat, owner = np.concatenate(tokens), np.repeat(np.arange(len(ids), dtype=np.uint16), [len(t) for t in tokens])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        same = flat[1:] == flat[:-1]
        first = np.concatenate([[True], ~same])
        again = np.concatenate([same, [False]]) | ~first
        if again.any():
            yield _blob(int(ids[0]) % buckets, True, flat[again].tobytes(), b"", ids[owner[again]].tobytes(), b"")
        flat, owner = flat[first], owner[first]
        bucket = ((flat >> np.uint64(48)) * np.uint64(buckets)) >> np.uint64(16)
        cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        low = flat & _LOW
        for b in range(buckets):
            x, y = cuts[b], cuts[b + 1]
            if y > x:
                used, short = np.unique(owner[x:y], return_inverse=True)
                part = low[x:y]
                yield _blob(b, False, part.astype(np.uint32).tobytes(), (part >> np.uint64(32)).astype(np.uint16).tobytes(), ids[used].tobytes(), short.astype(np.uint16).tobytes())

    return fn


def _blob(bucket: int, direct: bool, low: bytes, high: bytes, ids: bytes, owner: bytes) -> pa.RecordBatch:
    cols = [pa.array([bucket], type=pa.int32()), pa.array([direct]), *[pa.array([v], type=pa.binary()) for v in (low, high, ids, owner)]]
    return pa.RecordBatch.from_arrays(cols, names=["bucket", "direct", "low", "high", "ids", "owner"])


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows (token, rep) of the tokens of a bucket that come from two places or more."""
    tokens, reps = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    keys, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for direct, low, high, ids, owner in zip(pdf["direct"], pdf["low"], pdf["high"], pdf["ids"], pdf["owner"]):
        ids = np.frombuffer(ids, dtype=np.int64)
        if direct:
            tokens.append(np.frombuffer(low, dtype=np.uint64) & _LOW)
            reps.append(ids)
        else:
            keys.append(np.frombuffer(low, dtype=np.uint32).astype(np.uint64) | np.frombuffer(high, dtype=np.uint16).astype(np.uint64) << np.uint64(32))
            owners.append(ids[np.frombuffer(owner, dtype=np.uint16)])
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    if len(key):
        same = key[1:] == key[:-1]
        shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        tokens.append(key[shared])
        reps.append(owner[shared])
    return pd.DataFrame({"token": np.concatenate(tokens).view(np.int64), "rep": np.concatenate(reps)})


def shared_tokens(df: DataFrame, make, expected: int) -> DataFrame:
    """Stored rows (token, rep) of all tokens that two entries or more hold; ``make`` gives a batch's ids and tokens, about
    ``expected`` at most in all. A bucket is one task's, so their number follows the tokens."""
    buckets = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-expected // BUCKET))
    dealt = C.map_arrow(df, _deal_batch(make, buckets), "bucket int, direct boolean, low binary, high binary, ids binary, owner binary")
    return C.stored(dealt.groupBy("bucket").applyInPandas(_meet, "token long, rep long").distinct())


def _expected_tokens(sizes: DataFrame, percent: int, fine: int) -> int:
    """Tokens of sets of ``n_shingles``, about at most: the slices of the band's largest set, in two bands."""
    d = f"2.0 * {BAND} * n_shingles * {100 - percent} / {100 + percent}"
    return int(sizes.agg(F.sum(F.expr(f"2 * {fine} * (3 + 1.07 * {d})"))).first()[0] or 0)


def _open_group(percent: int):
    """Compare the queries of a group with its members; emit a spanning set of the links found."""

    def fn(members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": np.empty(0, dtype=np.int64), "b": np.empty(0, dtype=np.int64)})
        if members.empty or queries.empty:
            return none
        members = members.drop_duplicates("rep")
        ids = members["rep"].to_numpy()
        sets = [np.asarray(x).view(np.uint64) for x in members["shingles"]]
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), sizes)
        union, column = np.unique(flat, return_inverse=True)
        # rows of the members' table by union column: where each column's owners start
        order = np.argsort(column, kind="stable")
        owner, first = owner[order], np.searchsorted(column[order], np.arange(len(union) + 1))
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p]
            return x

        for q, shingles in zip(queries["rep"].to_numpy(), queries["shingles"]):
            s = np.asarray(shingles).view(np.uint64)
            at = np.searchsorted(union, s)
            at[at == len(union)] = 0
            hit = at[union[at] == s]
            if 100 * len(hit) < percent * len(s):  # the union bounds the overlap with any member
                continue
            lengths = first[hit + 1] - first[hit]
            steps = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            both = np.bincount(owner[np.repeat(first[hit], lengths) + steps], minlength=len(ids))
            for k in np.flatnonzero(100 * both >= percent * (len(s) + sizes - both)):
                if ids[k] != q:
                    x, y = root(int(q)), root(int(ids[k]))
                    if x != y:
                        parent[max(x, y)] = min(x, y)
        pairs = [(x, root(x)) for x in list(parent) if root(x) != x]
        return pd.DataFrame(pairs, columns=["a", "b"], dtype=np.int64) if pairs else none

    return fn


def components(edges: DataFrame) -> DataFrame:
    """Smallest id reachable from each node of ``edges`` (a, b) that is not itself the smallest: (node, component).

    Large-star and small-star steps alternate until no edge changes; each round is a stored table. A node with
    a third of all edges is no problem: both steps only need its smallest neighbour, a partial aggregate.
    """
    edges = C.stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour of u hangs on the smallest node around u
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: u and its smaller neighbours hang on the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m")), F.struct(F.col("v").alias("u"), F.col("m")))).alias("e"))
            .select(F.col("e.u").alias("u"), F.col("e.m").alias("v"))
            .where("u != v")
            .distinct()
        )
        last, edges = edges, C.stored(small)
        C.dropped(last)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v"))).first()
        if now == seen:
            return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
        seen = now


def _open(members: DataFrame, calls: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the sets that call a group and its members: (rep, open) and, in ``deals`` tasks a group,
    (rep, open, deals). A member goes to each of its group's deals, a call to one."""
    C.ship(calls.sparkSession)
    # stored, so that both sides of the join are plain exchanges and the callers of a hot group can be split
    load = C.stored(calls.select("open", "deals").distinct())
    queries = calls.select("rep", "open", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("deals")).cast("int").alias("deal")).join(shingles, "rep")
    members = members.join(load, "open").select("rep", "open", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal")).join(shingles, "rep")
    members = members.select(*[F.col(c).alias(c) for c in members.columns])
    return members.groupBy("open", "deal").cogroup(queries.groupBy("open", "deal")).applyInPandas(_open_group(percent), "a long, b long")


def _deals(n: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / QUERIES)).cast("int")


def _classes(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """``doc_id, key, n_shingles, component_id, first_key`` of each row of ``docs``, and the ids that stand for several texts.
    ``first_key`` is the key of the component's smallest document."""
    hashed = C.hashed_texts(docs)
    read = C.stored(C.map_arrow(hashed.select("doc_id", "h", "text"), _sets_batch(n), "doc_id long, h long, n_shingles long, sig_a long, sig_b long"))
    unclear = C.unclear_ids(read)
    sets = C.with_key(read, unclear).withColumn("place", F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("at"), "key"))
    texts = C.with_key(hashed, unclear).select("key", "text")
    sig = ["n_shingles", "sig_a", "sig_b"]
    # stored, so that both sides of the joins below are plain exchanges and a hot class or token can be split
    classes = C.stored(sets.where("n_shingles > 0").groupBy(*sig).agg(F.min("place").alias("place")).select(*sig, "place", F.col("place.key").alias("rep")))
    # copies share all their tokens; only their representative's rows stay
    every = shared_tokens(texts, _tokens_of(n, percent), _expected_tokens(read, percent, 1))
    rows = every.join(classes.select("rep"), "rep", "left_semi")
    shared = C.stored(rows.groupBy("token").agg(F.count("*").alias("n_sets")).where("n_sets > 1"))
    rows = C.stored(rows.join(shared, "token"))
    C.dropped(every, shared)

    # shingles of the sets that share a token, and those of them that may have a partner
    wanted = rows.select(F.col("rep").alias("key")).distinct()
    bodies = texts.join(wanted, "key", "left_semi").dropDuplicates(["key"])
    bodies = C.map_arrow(bodies, _shingles_batch(n, percent), "rep long, shingles array<long>, need_0 long, need_1 long")
    bodies = C.stored(bodies.withColumn("number", F.monotonically_increasing_id()))
    met = shared_tokens(bodies.select("number", "shingles"), _fine_tokens_of(percent), _expected_tokens(bodies.select(F.size("shingles").alias("n_shingles")), percent, FINE))
    fine = met.groupBy("rep").agg(F.count("*").alias("n"))
    fine = fine.select(F.shiftright("rep", 1).alias("number"), (F.col("rep") % 2 != 0).alias("next"), "n").join(bodies.select("number", "rep", "need_0", "need_1"), "number")
    free = bodies.where("need_0 = 0 or need_1 = 0").select("rep")
    alive = fine.where(F.col("n") >= F.when(F.col("next"), F.col("need_1")).otherwise(F.col("need_0"))).select("rep").union(free).distinct()
    shingles = C.stored(bodies.select("rep", "shingles").join(alive, "rep", "left_semi"))
    C.dropped(met, bodies)
    near = C.stored(rows.join(shingles.select("rep"), "rep", "left_semi"))
    C.dropped(rows)
    rows = near

    # partition: the most widely shared token of each set names its cluster, the cluster's smallest set is the centre
    top = C.stored(rows.groupBy("rep").agg(F.max(F.struct("n_sets", "token"))["token"].alias("cluster")))
    centre = C.stored(top.groupBy("cluster").agg(F.min("rep").alias("centre"), F.count("*").alias("n")))
    home = top.join(centre, "cluster")
    stars = _open(
        home.where("rep = centre").select("rep", F.col("cluster").alias("open")),
        home.where("rep != centre").select("rep", F.col("cluster").alias("open"), _deals(F.col("n")).alias("deals")),
        shingles,
        percent,
    )
    stars = C.stored(stars)
    linked = stars.select(F.col("a").alias("rep")).union(stars.select(F.col("b").alias("rep"))).distinct()
    homes = C.stored(top.join(linked.withColumn("in_star", F.lit(True)), "rep", "left").withColumn("in_star", F.coalesce("in_star", F.lit(False))))
    split = C.stored(homes.groupBy("cluster", "in_star").agg(F.ceil(F.count("*") / GROUP).alias("parts")))
    # groups of stars have negative names: of two groups the one with the larger name calls, so loose sets call stars
    name = F.xxhash64("cluster", "in_star", F.pmod(F.xxhash64("rep"), F.col("parts"))).bitwiseAND(F.lit((1 << 63) - 1))
    groups = homes.join(split, ["cluster", "in_star"]).select("rep", F.when(F.col("in_star"), F.col("cluster")).alias("star"), F.when(F.col("in_star"), -1 - name).otherwise(name).alias("grp"))
    groups = C.stored(groups)

    # the matrix, and the groups that each query may open
    mine = rows.join(groups, "rep").select("rep", "token", "star", "grp")
    matrix = mine.select("token", F.col("grp").alias("open"), F.col("star").alias("of_star")).distinct()
    other = F.col("star").isNull() | F.col("of_star").isNull() | (F.col("star") != F.col("of_star"))
    calls = C.stored(mine.join(matrix, "token").where((F.col("grp") >= F.col("open")) & other).select("rep", "open").distinct())
    load = C.stored(calls.groupBy("open").agg(F.count("*").alias("n")))
    # a set may call several groups: in as many passes as that takes, none shuffles more than all shingles once (or PASS_BYTES)
    sets_n, total = shingles.agg(F.count("*"), F.sum(F.size("shingles"))).first()
    all_bytes = 8 * (total or 0)
    passes, links = max(1, -(-calls.count() * all_bytes // max(1, sets_n) // max(all_bytes, PASS_BYTES))), None
    for k in range(passes):
        now = lambda c: F.pmod(F.xxhash64(c), F.lit(passes)) == k  # noqa: E731, B023
        due = calls.where(now("open")).join(load, "open").select("rep", "open", _deals(F.col("n")).alias("deals"))
        found = C.stored(_open(groups.where(now("grp")).select("rep", F.col("grp").alias("open")), due, shingles, percent))
        links = found if links is None else links.union(found)
    C.dropped(rows, shingles, top, centre, homes, split, groups, calls, load)
    labels = components(stars.union(links))

    # the smallest document of each component, over all of its classes
    members = labels.union(labels.select(F.col("component").alias("node"), "component").distinct())
    linked_classes = C.stored(classes.join(members, F.col("rep") == F.col("node")).select(*sig, "component", "place"))
    first = C.stored(linked_classes.groupBy("component").agg(F.min("place").alias("place")))
    known = classes.join(linked_classes.select(*sig, "component"), sig, "left").join(first.withColumnRenamed("place", "first"), "component", "left")
    known = C.stored(known.select(*sig, F.coalesce("first", "place").alias("first")))
    out = sets.join(known, sig, "left").withColumn("first", F.coalesce("first", "place"))
    missing = F.col("first.at") == (1 << 63) - 1
    return out.select("doc_id", "key", "n_shingles", F.when(~missing | F.col("doc_id").isNotNull(), F.col("first.at")).alias("component_id"), F.col("first.key").alias("first_key")), unclear


def ngram_components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, n_shingles, component_id``: the similarity classes of ``docs`` (doc_id, text)."""
    return _classes(docs, n, percent)[0].select("doc_id", "n_shingles", "component_id")


def near_duplicates_removed(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """``docs`` without the documents whose similarity class has a smaller one.

    Null and empty texts stay (they are linked with nothing); repeated rows are one document and stay or go together; rows
    without an id come after all others; an empty table stays empty; columns keep names and values.
    """
    found, unclear = _classes(docs, n, percent)
    kept = found.where("key = first_key").select("key").distinct()
    return C.keyed_rows(docs, unclear).join(kept, "key", "left_semi").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(C.documents_of(spark, sf_dir))
