"""Streams worked off to the end; each equals its batch twin."""

from __future__ import annotations

import math
from contextlib import contextmanager

from pyspark.sql import functions as F

from storyrank import fixtures as fx
from storyrank.catalog.q_joins import BOOST_SQL
from storyrank.catalog.q_windows import THROTTLE_SQL
from storyrank.catalog.registry import query, with_views
from storyrank.session import scratch
from storyrank.streaming import jobs as st

DELAY = "4 days"  # longer than one landed time range
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def arriving_events(spark, d):
    """Events landed in ten arrivals, one time range after the other: the folder, given after each."""
    path = scratch(spark, "stream-events")
    ev = fx.table(spark, d, "events")
    ends = ev.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    step = (ends["b"] - ends["a"]) / 10
    for i in range(10):
        lo, hi = ends["a"] + i * step, ends["a"] + (i + 1) * step
        part = ev.filter(F.col("ts") >= lo) if i else ev
        part = part.filter(F.col("ts") < hi) if i < 9 else part
        part.write.mode("append").parquet(path)
        yield path


def land_events(spark, d) -> str:
    """The folder with all ten arrivals."""
    return list(arriving_events(spark, d))[-1]


def event_stream(spark, d):
    path = land_events(spark, d)
    landed = spark.read.parquet(path)
    per_trigger = max(1, math.ceil(len(landed.inputFiles()) / 10))
    return spark.readStream.schema(landed.schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def signals_of(ev):
    kind = F.col("event_type")
    return ev.select(
        "user_id", "ts", "value",
        F.concat(F.lit("story-"), F.get_json_object("props", "$.k")).alias("target_id"),
        F.when(kind == "purchase", "up").when(kind == "error", "down").when(kind == "click", "click")
        .when(kind == "view", "dwell").otherwise("nl_instruction").alias("signal"),
        F.col("ts").alias("created_at"))


@contextmanager
def keyed_state(spark):
    """The state store that keyed processors need, for the queries inside."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def arrivals(ev):
    """Every fiftieth row arrives two days after it was published."""
    return ev.select(
        "event_id", "event_type", "ts", fx.family_of(F.col("user_id") % 4).alias("family"), F.col("ts").alias("published_at"),
        F.when(F.col("event_id") % 50 == 0, F.col("ts") + F.expr("interval 48 hours")).otherwise(F.col("ts")).alias("fetched_at"))


@query("STR-01", """
select 'e' || cast(event_id // 10 as varchar) as id, max_by(event_type, (ts, event_id)) as source, max(ts) as published_at,
  count(*) filter (event_id % 50 = 0 and user_id % 4 <> 0) as n_late
from events group by event_id // 10""")
def str_01(spark, d):
    """Ids come again and again with changed values; the newest version stands, late rows are told."""
    items = arrivals(event_stream(spark, d)).select(
        F.concat(F.lit("e"), F.expr("event_id div 10").cast("string")).alias("id"), F.col("event_type").alias("source"),
        "family", "published_at", "fetched_at", "event_id")
    log, late = scratch(spark, "stream-items"), scratch(spark, "stream-late")
    st.stream_ingest(items, log, scratch(spark, "ckpt"), ["published_at", "event_id"], late)
    counts = st.read_log(spark, late).groupBy("id").agg(F.count("*").alias("n_late"))
    return st.ingested(spark, log).join(counts, "id", "left").select(
        "id", "source", "published_at", F.coalesce("n_late", F.lit(0)).cast("long").alias("n_late"))


_ARRIVAL = """select event_id, case user_id % 4 when 0 then 'academia' when 1 then 'industry' when 2 then 'community' else 'meta' end as family,
  case when event_id % 50 = 0 then 48 else 0 end as delay from events"""


@query("STR-02", f"""
select event_id, not (delay = 48 and family <> 'academia') as on_time from ({_ARRIVAL})""")
def str_02(spark, d):
    rows = arrivals(event_stream(spark, d)).select("event_id", "family", "published_at", "fetched_at")
    kept, late = scratch(spark, "stream-kept"), scratch(spark, "stream-late")
    st.stream_window_gate(rows, kept, late, scratch(spark, "ckpt"))
    return st.read_log(spark, kept).select("event_id", F.lit(True).alias("on_time")).union(
        st.read_log(spark, late).select("event_id", F.lit(False)))


@query("STR-03", with_views(f"with {BOOST_SQL.strip()} select target_id, round(boost, 6)::double as boost from boosts", "feedback"))
def str_03(spark, d):
    log = scratch(spark, "stream-boosts")
    with keyed_state(spark):
        st.stream_boosts(signals_of(event_stream(spark, d)), log, scratch(spark, "ckpt"), delay=DELAY)
    return st.boosts_at(spark, log, fx.AS_OF).select("target_id", F.round("boost", 6).alias("boost"))


@query("STR-04", """
with w as (select event_type, value, time_bucket(interval '3' hour, ts) - i * interval '3' hour as start
  from events, range(0, 12) t(i)),
g as (select event_type, start, start + interval '36' hour as "end", count(*) as n, round(sum(value), 4) as total from w group by 1, 2)
select * from g""")
def str_04(spark, d):
    log = scratch(spark, "stream-windows")
    st.stream_engagement(event_stream(spark, d), "event_type", log, scratch(spark, "ckpt"), delay=DELAY)
    return st.engagement_now(spark, log, "event_type").select("event_type", "start", "end", "n", F.round("total", 4).alias("total"))


@query("STR-05", THROTTLE_SQL + " select id, who, admitted from r")
def str_05(spark, d):
    """The throttle with three hits an hour per kind of event, as keyed state.

    Each arrival is worked off before the next one lands. Micro-batches of a number of files
    would mix arrivals of different numbers of files, and hits cut off from their own arrival
    come later than the throttle's watermark allows."""
    log, ckpt = scratch(spark, "stream-throttle"), scratch(spark, "ckpt")
    with keyed_state(spark):
        for path in arriving_events(spark, d):
            hits = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path).select(
                F.col("event_id").alias("id"), F.col("event_type").alias("who"), "ts")
            st.run_available(st.stream_throttle(hits, 3, 3600), ckpt, st.log_batches(log))
    return st.read_log(spark, log).select("id", "who", "admitted")


@query("STR-06", """
with a as (select user_id, ts, case when event_type = 'view' then least(value, 120.0) else 0.0 end as secs,
   case when ts - lag(ts) over (partition by user_id order by ts) < interval '30' minute then 0 else 1 end as fresh
   from events where event_type in ('click', 'view')),
s as (select *, sum(fresh) over (partition by user_id order by ts) as no from a),
g as (select user_id, min(ts) as start, max(ts) + interval '30' minute as "end", count(*) as n, round(sum(secs), 4)::double as dwell from s group by user_id, no)
select * from g""")
def str_06(spark, d):
    log = scratch(spark, "stream-sessions")
    st.run_available(st.reading_sessions(signals_of(event_stream(spark, d)), delay=DELAY), scratch(spark, "ckpt"), st.log_batches(log))
    closed = st.read_log(spark, log).drop("batch")
    now = st.sessions_now(closed, signals_of(fx.table(spark, d, "events")))
    return now.select("user_id", "start", "end", "n", F.round("dwell", 4).alias("dwell"))
