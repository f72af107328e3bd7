"""Structured Streaming twins of the batch operators.

Results that change over time go to a change log: every micro-batch writes its own folder
(rewritten, not doubled, when the batch is retried), and the current table is the latest
row per key over the log.
"""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from storyrank import constants as K
from storyrank.functions import signals as S
from storyrank.operators.feedback import signal_weight
from storyrank.operators.grouping import last_per_key


def run_available(df: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Work off everything there is, batch by batch, then stop."""
    query = (
        df.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def log_batches(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*")


# --- ingest -----------------------------------------------------------------------
def newest_versions(stream: DataFrame, order: list[str]) -> DataFrame:
    """Of each id the newest version by ``order``, and its newest vector, as keyed state of a
    streaming aggregate; an id's row is given whenever the id came again."""
    rest = [c for c in stream.columns if c not in ("id", "embedding")]
    place = F.struct(*order)
    aggs = [F.max_by(F.struct(*rest), place).alias("__row")]
    if "embedding" in stream.columns:
        aggs.append(F.max_by("embedding", F.when(F.col("embedding").isNotNull(), place)).alias("embedding"))
    return stream.groupBy("id").agg(*aggs).select("id", "__row.*", *(["embedding"] if len(aggs) > 1 else []))


def stream_ingest(stream: DataFrame, log: str, checkpoint: str, order: list[str], late: str | None = None) -> None:
    """The item table's changes go to the log: for each id of a micro-batch its row as it then
    stands, the newest by ``order`` (not the last to arrive), with its newest vector.

    No row is dropped for its age. With ``late`` (rows then carry family, published_at and
    fetched_at), those that came after their look-back are written there too, so that they
    can be told and counted.
    """
    run_available(newest_versions(stream, order), checkpoint, log_batches(log), "update")
    if late:
        run_available(stream.filter(~on_time()), f"{checkpoint}-late", log_batches(late))


def ingested(spark: SparkSession, log: str) -> DataFrame:
    """The item table as of the last batch."""
    return last_per_key(read_log(spark, log), ["id"], ["batch"]).drop("batch")


# --- late rows --------------------------------------------------------------------
def on_time():
    """Published inside the look-back of the row's family at the moment it arrived."""
    hours = F.when(F.col("family") == "academia", K.ACADEMIA_LOOKBACK_HOURS).otherwise(K.NEWS_LOOKBACK_HOURS)
    span = hours.cast("bigint") * 3_600_000_000
    return F.coalesce(
        F.unix_micros("published_at") >= F.unix_micros("fetched_at") - span, F.lit(False))


def stream_window_gate(stream: DataFrame, kept: str, late: str, checkpoint: str) -> None:
    """Rows in their window to one log, rows that came too late to another."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        batch.filter(on_time()).write.mode("overwrite").parquet(f"{kept}/batch={batch_id}")
        batch.filter(~on_time()).write.mode("overwrite").parquet(f"{late}/batch={batch_id}")
        batch.unpersist()

    run_available(stream, checkpoint, write)


# --- boosts -----------------------------------------------------------------------
class Boost(StatefulProcessor):
    """Remembers of a target its sum of reaction weights as of its last reaction. The sum is
    carried on to each later reaction, so no fixed date is needed; a target whose sum has
    decayed to nothing is forgotten when its timer, set by the stream's watermark, is due."""

    def __init__(self, half_life_days: float, least: float) -> None:
        self.life, self.least = half_life_days * 86_400_000_000, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.sum = handle, handle.getValueState("sum", "total double, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total, at = self.sum.get() if self.sum.exists() else (0.0, None)
        for frame in rows:
            t, w = frame["t"].to_numpy(), frame["w"].to_numpy()
            now = int(max(t.max(), t.min() if at is None else at))
            total = (total * 0.5 ** ((now - at) / self.life) if at is not None else 0.0) + float((w * 0.5 ** ((now - t) / self.life)).sum())
            at = now
        self.sum.update((total, at))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        lives = max(math.log2(max(abs(total), self.least) / self.least), 0.0)
        self.handle.registerTimer(int((at + lives * self.life) // 1000) + 1)
        yield pd.DataFrame({"target_id": [key[0]], "total": [total], "at": [at], "forgotten": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.sum.clear()
        yield pd.DataFrame({"target_id": [key[0]], "total": [0.0], "at": [timerValues.getCurrentWatermarkInMs() * 1000], "forgotten": [True]})

    def close(self) -> None:
        pass


def running_boosts(stream: DataFrame, half_life_days: float = K.FEEDBACK_HALF_LIFE_DAYS, least: float = 1e-9, delay: str = "1 hour") -> DataFrame:
    """``(target_id, total, at, forgotten)`` whenever a target's sum changes: what its reactions count at
    ``at``, its last one. A reaction without a weight or a time does not count; one that comes
    ``delay`` behind the newest is dropped by the watermark."""
    rows = stream.withColumn("w", signal_weight()).filter(F.col("w").isNotNull() & F.col("created_at").isNotNull())
    rows = rows.withWatermark("created_at", delay).select("target_id", "created_at", "w", F.unix_micros("created_at").alias("t"))
    return rows.groupBy("target_id").transformWithStateInPandas(
        statefulProcessor=Boost(half_life_days, least), outputStructType="target_id string, total double, at long, forgotten boolean",
        outputMode="Append", timeMode="EventTime")


def stream_boosts(stream: DataFrame, log: str, checkpoint: str, **settings) -> None:
    run_available(running_boosts(stream, **settings), checkpoint, log_batches(log))


def boosts_at(spark: SparkSession, log: str, as_of, half_life_days: float = K.FEEDBACK_HALF_LIFE_DAYS) -> DataFrame:
    """``(target_id, boost)`` as of a moment not before the last reaction; forgotten targets are left out."""
    latest = last_per_key(read_log(spark, log), ["target_id"], ["batch"]).filter("NOT forgotten")
    days = S.age_days(F.timestamp_micros("at"), as_of) / half_life_days
    return latest.select("target_id", (F.col("total") * F.pow(F.lit(0.5), days)).alias("boost"))


def compact_log(spark: SparkSession, log: str, target: str, keys: list[str], order: list[str]) -> None:
    """The log's last row of each key as a log of one batch in the folder ``target``; the old
    log stays. It reads as the old one does, and later batches may be written behind it."""
    rows = read_log(spark, log)
    last = rows.agg(F.max("batch")).first()[0]
    if last is not None:
        last_per_key(rows, keys, order).drop("batch").write.mode("overwrite").parquet(f"{target}/batch={last}")


# --- engagement and sessions ------------------------------------------------------
def running_engagement(stream: DataFrame, key: str, length: str = "36 hours", slide: str | None = "3 hours", delay: str = "1 hour") -> DataFrame:
    """Counts and sums per key over sliding (or, without ``slide``, tumbling) windows. In
    update mode every change of an open window is given, in append mode a window once,
    when the watermark has passed it."""
    span = F.window("ts", length, slide) if slide else F.window("ts", length)
    return stream.withWatermark("ts", delay).groupBy(span, key).agg(
        F.count("*").alias("n"), F.sum("value").alias("total")
    ).select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "total")


def stream_engagement(stream: DataFrame, key: str, log: str, checkpoint: str, **spans) -> None:
    run_available(running_engagement(stream, key, **spans), checkpoint, log_batches(log), "update")


def engagement_now(spark: SparkSession, log: str, key: str) -> DataFrame:
    """All windows as they stand, open ones included."""
    return last_per_key(read_log(spark, log), [key, "start", "end"], ["batch"]).drop("batch")


def sessions_now(closed: DataFrame, landed: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """All sessions as they stand: the closed ones the stream has given, and the open ones
    out of the landed rows that lie in none of them."""
    acts = landed.filter(F.col("signal").isin("click", "dwell"))
    known = closed.select(F.col("user_id").alias("__user"), F.col("start").alias("__start"), F.col("end").alias("__end"))
    rest = acts.join(known, (F.col("user_id") == F.col("__user")) & (F.col("ts") >= F.col("__start")) & (F.col("ts") < F.col("__end")), "left_anti")
    return closed.unionByName(_sessions(rest, gap))


def reading_sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Clicks and dwell times of a reader up to a pause: the dwell signal's seconds are
    capped per event."""
    acts = stream.filter(F.col("signal").isin("click", "dwell"))
    return _sessions(acts.withWatermark("ts", delay), gap)


def _sessions(acts: DataFrame, gap: str) -> DataFrame:
    seconds = F.when(F.col("signal") == "dwell", F.least("value", F.lit(K.DWELL_CAP_SECONDS))).otherwise(F.lit(0.0))
    return acts.groupBy(F.session_window("ts", gap), "user_id").agg(
        F.count("*").alias("n"), F.sum(seconds).alias("dwell")
    ).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "dwell")


# --- throttle ---------------------------------------------------------------------
class Throttle(StatefulProcessor):
    """Remembers the admitted times of a key over the window and the lateness that the
    watermark allows, and forgets a key that has been quiet for longer."""

    def __init__(self, n: int, secs: int, late_secs: int = 60) -> None:
        self.n, self.span, self.slack = n, secs * 1_000_000, late_secs * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)  # the hits of one key in one micro-batch, bounded by its trigger
        hits = pd.concat(frames).sort_values(["t", "id"], kind="stable")
        recent = [r[0] for r in self.recent.get()]
        out = []
        for t in hits["t"]:
            # A late hit is judged by what had been admitted at its own time.
            ok = sum(0 <= t - x <= self.span for x in recent) < self.n
            if ok:
                insort(recent, t)
            out.append(ok)
            newest = recent[-1] if recent else t
            recent = [x for x in recent if newest - x <= self.span + self.slack]
        if recent:
            self.recent.put([(int(t),) for t in recent])
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int((recent[-1] + self.span + self.slack) // 1000) + 1)
        yield pd.DataFrame({"id": hits["id"], "who": key[0], "t": hits["t"], "admitted": out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_throttle(stream: DataFrame, n: int = 60, secs: int = 60, late_secs: int = 60) -> DataFrame:
    """``(id, who, t, admitted)`` for hits (id, who, ts): the streaming form of the throttle."""
    rows = stream.withWatermark("ts", f"{late_secs} seconds").select("id", "who", "ts", F.unix_micros("ts").alias("t"))
    return rows.groupBy("who").transformWithStateInPandas(
        statefulProcessor=Throttle(n, secs, late_secs), outputStructType="id long, who string, t long, admitted boolean",
        outputMode="Append", timeMode="EventTime")
