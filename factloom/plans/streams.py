"""Streaming jobs over the events, run over the files that are there, with their batch equivalents in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.plans.registry import register
from factloom.streaming import jobs as J

# the last windows are open until a later event passes the watermark: batch equivalents leave them out
_MARK = "mark as (select max(ts) - interval 1 hour as m from events)"


@register("daily_windows", f"""with {_MARK}, d as (select date_trunc('day', ts) as s, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2)
select strftime(s, '%Y-%m-%d') as day, event_type, n, total from d, mark where s + interval 1 day <= m""")
def daily_windows(spark, sf_dir):
    """K7: counts and means per day and kind."""
    out = J.run_available(J.windowed_stats(J.event_stream(spark, sf_dir), "event_type", "value"))
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


@register("sessions", f"""with {_MARK}, g as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 2 hour then 1 else 0 end as cut from events),
s as (select user_id, ts, sum(cut) over (partition by user_id order by ts rows unbounded preceding) as k from g), a as (select user_id, min(ts) as s, max(ts) as e, count(*) as n from s group by user_id, k)
select user_id, strftime(s, '%Y-%m-%d %H:%M:%S') as started, n from a, mark where e + interval 2 hour <= m""")
def sessions(spark, sf_dir):
    """Session windows per key."""
    out = J.run_available(J.sessions(J.event_stream(spark, sf_dir), "user_id"))
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


@register("stream_dedupe", "select distinct event_id from events")
def stream_dedupe(spark, sf_dir):
    """K5, K6: each key once."""
    s = J.event_stream(spark, sf_dir)
    return J.run_available(J.deduped(s.union(s), ["event_id"], "60 days").select("event_id"))


@register("stream_counters", "select event_type, count(*) as n, strftime(min(ts), '%Y-%m-%d') as first_seen, strftime(max(ts), '%Y-%m-%d') as last_seen from events group by 1")
def stream_counters(spark, sf_dir):
    """Counters with first and last time, in update mode."""
    out = J.run_updates(J.counters(J.event_stream(spark, sf_dir), "event_type"), ["event_type"], "n")
    return out.select("event_type", "n", F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"), F.date_format("last_seen", "yyyy-MM-dd").alias("last_seen"))


@register("file_lifecycle")
def file_lifecycle(spark, sf_dir):
    """K1, K3: state machine per file over its polls."""
    polls = J.event_stream(spark, sf_dir).select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("file"), F.col("event_type").alias("version"), (F.col("value") > 90).alias("failed"), "ts")
    return J.run_updates(J.file_lifecycle(polls), ["file"], "ts").select("file", "version", "polls", "state")


def _sources(spark, sf_dir, **columns):
    e = J.event_stream(spark, sf_dir)
    return e.select(F.col("event_type").alias("source"), F.col("event_id").alias("id"), "ts", *[c.alias(n) for n, c in columns.items()])


@register("batch_release")
def batch_release(spark, sf_dir):
    """K2: files released in batches of five, or fewer once the oldest has waited (held against a plain loop in a test)."""
    return J.run_available(J.batch_release(_sources(spark, sf_dir)))


@register("stalls", """with g as (select event_type as source, event_id, ts, lag(event_id) over w as p, lag(ts) over w as pt from events where value > 20 window w as (partition by event_type order by ts, event_id))
select source, p as last_good, event_id as next_good from g where epoch(ts) - epoch(pt) > 7200""")
def stalls(spark, sf_dir):
    """K4: sources without a good poll for too long."""
    return J.run_available(J.stalls(_sources(spark, sf_dir, good=F.col("value") > 20), 7200))


@register("outbox", """with e as (select cast(user_id as varchar) as document, event_id, ts, event_type, row_number() over (partition by user_id order by ts, event_id) as k from events),
r as (select document, max(k) as rk, max_by(event_id, k) as request from e where event_type in ('click', 'view', 'signup') group by 1),
a as (select e.document, r.request, k, event_type, count(*) filter (where event_type = 'error') over (partition by e.document order by k) as fails from e join r on r.document = e.document and k > rk),
d as (select document, min(k) filter (where event_type = 'purchase' and fails < 3) as sent, min(k) filter (where fails >= 3) as dead, max(fails) as fails from a group by 1),
f as (select a.document, count(*) filter (where event_type = 'error' and k < least(coalesce(d.sent, 1000000000), coalesce(d.dead, 999999999) + 1)) as fails from a join d using (document) group by 1)
select r.document, case when d.sent is not null and d.sent < coalesce(d.dead, 1000000000) then 'done' when d.dead is not null then 'dead' else 'pending' end as state, r.request, coalesce(f.fails, 0) as fails from r left join d on d.document = r.document left join f on f.document = r.document""")
def outbox(spark, sf_dir):
    """K8: one outbox row per document: pending, done or dead since its last request."""
    e = J.event_stream(spark, sf_dir)
    kind = F.when(F.col("event_type") == "purchase", "sent").when(F.col("event_type") == "error", "failed").otherwise("request")
    out = J.run_updates(J.outbox(e.select(F.col("user_id").cast("string").alias("document"), F.col("event_id").alias("id"), "ts", kind.alias("kind"))), ["document"], "id")
    return out.where("state != 'none'").select("document", "state", "request", "fails")


@register("live_drift", """with r as (select event_type as source, event_id as id, value, count(*) over w as n, avg(value) over w as m, stddev_pop(value) over w as sd from events window w as (partition by event_type order by ts, event_id rows between 200 preceding and 1 preceding))
select source, id from r where n >= 20 and abs(value - m) > greatest(3 * sd, 0.15)""")
def live_drift(spark, sf_dir):
    """K9: drift alarms as values arrive."""
    return J.run_available(J.live_drift(_sources(spark, sf_dir, value=F.col("value"))))


@register("sliding_windows", f"""with {_MARK}, w as (select unnest(range(24)) as k), d as (select date_trunc('hour', ts) - k * interval 1 hour as s, event_type, count(*) as n, round(sum(value), 2) as total from events, w group by 1, 2)
select strftime(s, '%Y-%m-%d %H') as start, event_type, n, total from d, mark where s + interval 24 hour <= m""")
def sliding_windows(spark, sf_dir):
    """K7: counts and totals of the last 24 hours, every hour."""
    out = J.run_available(J.windowed_stats(J.event_stream(spark, sf_dir), "event_type", "value", "24 hours", "1 hour"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n", "total")
