"""Structured Streaming jobs: windows, sessions, dedupe, counters, and keyed state machines.

Each transformation takes a streaming (or batch) DataFrame with an event time of type timestamp and returns one;
``run_available`` drives it over the files that are there and gives the result as a table in the shared folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATENESS = "1 hour"
# fixed values: polls before a file is ready, retries, base of the back-off in seconds
STABLE_POLLS, RETRIES, BACKOFF = 2, 3, 60


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; only a local master may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "factloom-streams")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files; the wall-clock time becomes a timestamp so that it can carry a watermark."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def run_available(stream: DataFrame) -> DataFrame:
    """Run over what is there now, append to a table in the shared folder, and read it."""
    spark, base = stream.sparkSession, shared_folder(stream.sparkSession)
    query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_updates(stream: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Run an update-mode stream over what is there; each batch is appended, the last state per key is read."""
    spark, base = stream.sparkSession, shared_folder(stream.sparkSession)
    save = lambda df, n: df.withColumn("_batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{base}/out/batch={n}")
    query = stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{base}/state").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{base}/out").drop("batch")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), F.struct("_batch", order)).alias("r")).select("r.*")


def windowed_stats(stream: DataFrame, key: str, value: str, size: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts and totals per key in tumbling or sliding windows; windows close as the watermark passes."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return stream.withWatermark("ts", LATENESS).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum(value), 2).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(stream: DataFrame, key: str, gap: str = "2 hours") -> DataFrame:
    """Sessions of a key that end after a gap."""
    w = F.session_window("ts", gap)
    return stream.withWatermark("ts", LATENESS).groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def deduped(stream: DataFrame, keys: list[str], keep: str = "1 day") -> DataFrame:
    """Intake that knows a key for a while."""
    return stream.withWatermark("ts", keep).dropDuplicatesWithinWatermark(keys)


def counters(stream: DataFrame, key: str) -> DataFrame:
    """Count, first and last time of a key (update mode)."""
    return stream.groupBy(key).agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def late_rows(stream: DataFrame, seen: str, limit: str = LATENESS) -> tuple[DataFrame, DataFrame]:
    """(in time, late) by the distance of event time to the time it was seen."""
    late = F.col(seen) - F.expr(f"interval {limit}") > F.col("ts")
    return stream.where(~late), stream.where(late)


LIFECYCLE = "file string, version string, polls long, state string, ts timestamp"


def file_lifecycle(stream: DataFrame) -> DataFrame:
    """State of each file over its polls (file, version, failed, ts): seen, ready after equal polls, retry, quarantine.

    A new version starts anew. A failed poll is retried with a doubling wait; after the last retry the file is quarantined.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, polls, fails, due = state.get if state.exists else ("", 0, 0, 0)
        name, last = "seen", None
        rows = pd.concat(list(batches)).sort_values(["ts", "version"], kind="stable")
        for v, failed, ts in zip(rows["version"], rows["failed"], rows["ts"]):
            now = int(ts.timestamp())
            if v != version:
                version, polls, fails, due = v, 0, 0, 0
            if failed:
                fails += 1
                due = now + BACKOFF * 2 ** (fails - 1)
                name = "quarantine" if fails > RETRIES else "retry"
            elif now < due:
                name = "waiting"
            else:
                polls += 1
                name = "ready" if polls >= STABLE_POLLS else "seen"
            last = ts
        state.update((version, polls, fails, due))
        yield pd.DataFrame({"file": [key[0]], "version": [version], "polls": [polls], "state": [name], "ts": [last]})

    return stream.groupBy("file").applyInPandasWithState(step, LIFECYCLE, "version string, polls long, fails long, due long", "update", GroupStateTimeout.NoTimeout)


# ---------------------------------------------------------------- keyed state machines


def _folded(stream: DataFrame, key: str, start: tuple, step, out: str, state: str, mode: str = "append") -> DataFrame:
    """Fold the rows of each key in the order of their time: ``step(state, row)`` gives the new state and the rows to emit.

    The state of a key is small and survives between micro-batches; the rows of a key inside one micro-batch are sorted
    together, so the size of a micro-batch (files a trigger) bounds what one task holds.
    """
    names = [c.split()[0] for c in out.split(", ")]

    def run(k, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.get if held.exists else start
        found = []
        rows = pd.concat(list(batches)).sort_values(["ts", "id"], kind="stable")
        for row in rows.itertuples(index=False):
            now, more = step(now, row)
            found += [(k[0], *m) for m in more]
        held.update(now)
        yield pd.DataFrame(found, columns=names)

    return stream.groupBy(key).applyInPandasWithState(run, out, state, mode, GroupStateTimeout.NoTimeout)


def batch_release(stream: DataFrame, size: int = 5, wait: int = 3 * 3600) -> DataFrame:
    """Batches of the files (source, id, ts) of each source: ``size`` of them, or fewer once the oldest waited ``wait`` seconds."""

    def step(now, row):
        number, n, first = now
        ts, out = row.ts.timestamp(), []
        if n and ts - first >= wait:
            out.append((number + 1, n, "waited"))
            number, n = number + 1, 0
        n, first = n + 1, first if n else ts
        if n == size:
            out.append((number + 1, n, "full"))
            number, n = number + 1, 0
        return (number, n, first), out

    return _folded(stream, "source", (0, 0, 0.0), step, "source string, batch long, n long, reason string", "number long, n long, first double")


def stalls(stream: DataFrame, limit: int = 300) -> DataFrame:
    """Times without a good poll (source, id, ts, good) for more than ``limit`` seconds, once the next good one is seen."""

    def step(now, row):
        if not row.good:
            return now, []
        ts = row.ts.timestamp()
        late = now[0] > 0 and ts - now[0] > limit
        return (ts, row.id), [(now[1], row.id)] if late else []

    return _folded(stream, "source", (0.0, -1), step, "source string, last_good long, next_good long", "last double, id long")


def outbox(stream: DataFrame, attempts: int = 3) -> DataFrame:
    """State of each document's one outbox row over its events (document, id, ts, kind): a request arms it anew (and supersedes an
    older one), ``sent`` finishes it, the last of ``attempts`` failures kills it."""

    def step(now, row):
        state, request, fails = now
        if row.kind == "request":
            state, request, fails = "pending", row.id, 0
        elif state == "pending" and row.kind == "sent":
            state = "done"
        elif state == "pending" and row.kind == "failed":
            fails += 1
            state = "dead" if fails >= attempts else state
        return (state, request, fails), [(state, request, fails, row.id)]

    return _folded(stream, "document", ("none", -1, 0), step, "document string, state string, request long, fails long, id long", "state string, request long, fails long", "update")


def live_drift(stream: DataFrame, n: int = 200, least: int = 20, sigma: float = 3.0, tolerance: float = 0.15) -> DataFrame:
    """Alarms as runs (source, id, ts, value) arrive: a value against the mean of the last ``n`` before it."""

    def step(now, row):
        past = list(now[0])
        out = []
        if len(past) >= least:
            mean = sum(past) / len(past)
            sd = (sum((x - mean) ** 2 for x in past) / len(past)) ** 0.5
            if abs(row.value - mean) > max(sigma * sd, tolerance):
                out.append((row.id,))
        return ([*past, float(row.value)][-n:],), out

    return _folded(stream, "source", ([],), step, "source string, id long", "past array<double>")


def leases(stream: DataFrame, seconds: int = 300, most: int = 3) -> DataFrame:
    """What happens to each job's claims (job, id, ts, worker, kind) in update mode: a ``claim`` holds the job for ``seconds`` and is refused
    while another worker's is live; ``renew`` by its holder prolongs it, ``done`` by its holder ends the job. A lease that nobody renews expires:
    when a later event of the job shows that its time is over, or when the watermark passes it and a timer fires although no event
    comes. An expired job can be claimed again, ``most`` times in all; then it is ``dead``.

    Rows: (job, event, worker, attempt, id); ``id`` is the event's, -1 for an expiry.
    """
    out = "job string, event string, worker string, attempt long, id long"
    kept = "state string, worker string, attempt long, until double"

    def expired(now):
        state, worker, attempt, until = now
        return ("dead" if attempt >= most else "free", "", attempt, 0.0), ("dead" if attempt >= most else "expired", worker, attempt, -1)

    def step(now, row):
        found, ts = [], row.ts.timestamp()
        if now[0] == "held" and ts >= now[3]:
            now, told = expired(now)
            found.append(told)
        state, worker, attempt, until = now
        if row.kind == "claim" and state == "free":
            now = ("held", row.worker, attempt + 1, ts + seconds)
            found.append(("claimed", row.worker, attempt + 1, row.id))
        elif row.kind in ("renew", "done") and state == "held" and row.worker == worker:
            now = ("held", worker, attempt, ts + seconds) if row.kind == "renew" else ("done", worker, attempt, 0.0)
            found.append(("renewed" if row.kind == "renew" else "done", worker, attempt, row.id))
        else:
            found.append(("refused", row.worker, attempt, row.id))
        return now, found

    def run(key, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now, found = held.get if held.exists else ("free", "", 0, 0.0), []
        if held.hasTimedOut:
            if now[0] == "held":
                now, told = expired(now)
                found.append(told)
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "id"], kind="stable")
            for row in rows.itertuples(index=False):
                now, more = step(now, row)
                found += more
        held.update(now)
        if now[0] == "held" and now[3] * 1000 > held.getCurrentWatermarkMs():
            held.setTimeoutTimestamp(int(now[3] * 1000))
        yield pd.DataFrame([(key[0], *f) for f in found], columns=[c.split()[0] for c in out.split(", ")])

    late = stream.withWatermark("ts", "0 seconds")
    return late.groupBy("job").applyInPandasWithState(run, out, kept, "append", GroupStateTimeout.EventTimeTimeout)
