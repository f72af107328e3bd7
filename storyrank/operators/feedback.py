"""What readers did: boosts, interest vectors, steering, throttling."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyrank import constants as K
from storyrank.functions import signals as S
from storyrank.functions import text as X
from storyrank.functions.vectors import l2_normalize, vector_sums


def signal_weight():
    """Weight of one feedback row before decay; NULL for rows that do not count."""
    out = F.lit(None).cast("double")
    for name, weight in K.SIGNAL_WEIGHT.items():
        value = F.lit(weight)
        if name == "dwell":
            value = value * F.least(F.col("value"), F.lit(K.DWELL_CAP_SECONDS)) / K.DWELL_CAP_SECONDS
        out = F.when(F.col("signal") == name, value).otherwise(out)
    return out


def feedback_boosts(
    fb: DataFrame, as_of, half_life_days: float = K.FEEDBACK_HALF_LIFE_DAYS, keys: list[str] = ("target_id",)
) -> DataFrame:
    """Decayed sum of the reactions per target; instructions do not count."""
    rows = fb.withColumn("__w", signal_weight()).filter(F.col("__w").isNotNull())
    return rows.groupBy(*keys).agg(
        F.sum(F.col("__w") * S.decay("created_at", as_of, half_life_days)).alias("boost"))


def feedback_weights(
    fb: DataFrame, as_of, half_life_days: float = K.FEEDBACK_HALF_LIFE_DAYS, keys: list[str] = ()
) -> DataFrame:
    """Decayed up-minus-down weight per target (and reader)."""
    sign = F.when(F.col("signal") == "up", F.lit(1.0)).otherwise(F.lit(-1.0))
    votes = fb.filter(F.col("signal").isin("up", "down"))
    return votes.groupBy(*keys, "target_id").agg(
        F.sum(sign * S.decay("created_at", as_of, half_life_days)).alias("weight"))


def feedback_vectors(weights: DataFrame, stories: DataFrame, dim: int) -> DataFrame:
    """Weights next to story vectors; a zero weight or a vector of another length is skipped."""
    usable = stories.filter(F.size("embedding") == dim).select(F.col("id").alias("target_id"), "embedding")
    return weights.filter(F.col("weight") != 0).join(usable, "target_id")


def interest_vector(
    fb: DataFrame, stories: DataFrame, base: DataFrame, as_of, dim: int,
    half_life_days: float = K.FEEDBACK_HALF_LIFE_DAYS, keys: list[str] = (),
) -> DataFrame:
    """``(keys, vector)`` for the profile rows ``base (keys, vector)``: half profile, half
    the weighted mean of the voted stories, unit norm. Without usable votes the profile
    vector stays as it is."""
    keys = list(keys)
    votes = feedback_vectors(feedback_weights(fb, as_of, half_life_days, keys), stories, dim)
    sums = vector_sums(votes, keys, "embedding", F.col("weight")).filter(F.col("weight_sum") > 0)
    moved = sums.select(
        *keys, l2_normalize(F.transform("total", lambda x: x / F.col("weight_sum"))).alias("__c"))
    if keys:
        joined = base.join(moved, keys, "left")
    else:
        joined = base.withColumn("__c", moved.select("__c").scalar())  # a single row, or none
    blend = F.zip_with(
        F.col("vector").cast("array<double>"), "__c",
        lambda b, c: (1.0 - K.FEEDBACK_BLEND) * b + K.FEEDBACK_BLEND * c)
    return joined.select(
        *keys,
        F.when(F.col("__c").isNull(), F.col("vector").cast("array<double>")).otherwise(
            l2_normalize(blend)).alias("vector"),
    )


def apply_steering(profiles: DataFrame, responses: DataFrame) -> DataFrame:
    """Profiles (user, alpha, beta, gamma, mutes, subfields) after the readers' own
    instructions: responses (user, instruction, response) hold the model's JSON."""
    obj = X.parse_json_obj("response")
    parsed = responses.filter(X.non_blank("instruction").isNotNull()).select(
        "user", *[F.try_variant_get(obj, f"$.{k}", "string").alias(f"__{k}") for k in ("alpha", "beta", "gamma")],
        *[F.try_variant_get(obj, f"$.add_{k}", "array<string>").alias(f"__{k}") for k in ("mutes", "subfields")],
        F.lit(True).alias("__hit"),
    )
    out = profiles.join(parsed, "user", "left")
    for k in ("alpha", "beta", "gamma"):
        out = out.withColumn(k, F.when(F.col("__hit"), S.clamp01(f"__{k}", F.col(k))).otherwise(F.col(k)))
    for k in ("mutes", "subfields"):
        add = F.filter(F.transform(F.col(f"__{k}"), X.strip), lambda x: x != "")
        grown = X.dedupe_ci(F.concat(F.coalesce(k, F.array().cast("array<string>")), add))
        out = out.withColumn(k, F.when(F.size(add) > 0, grown).otherwise(F.col(k)))
    return out.select(*profiles.columns)


# --- throttle ---------------------------------------------------------------------
def throttle(events: DataFrame, key: str, n: int = 60, secs: int = 60, ts: str = "ts", ident: str = "id") -> DataFrame:
    """Adds ``admitted``: fewer than ``n`` admitted hits of the key in the last ``secs``
    seconds, a hit exactly that old included; rejected hits leave no trace.

    Admission depends on earlier admissions, but only as far back as a calm stretch: when
    two neighbouring windows of a key hold at most ``n`` hits, the later one was admitted
    whole. Keys are cut there, so a busy key is many pieces; a piece is scanned in time
    order with ``n`` remembered times, never held in memory.
    """
    if n <= 0:
        return events.withColumn("admitted", F.lit(True))
    micros = F.unix_micros(ts)
    span = secs * 1_000_000
    rows = events.withColumn("__t", micros).withColumn("__win", F.floor(micros / F.lit(span)).cast("bigint"))
    counts = rows.groupBy(key, "__win").agg(F.count("*").alias("__n"))
    by_win = Window.partitionBy(key).orderBy("__win")
    prev_win, prev_n = F.lag("__win", 1).over(by_win), F.lag("__n", 1).over(by_win)
    prev2_win, prev2_n = F.lag("__win", 2).over(by_win), F.lag("__n", 2).over(by_win)
    n1 = F.when(prev_win == F.col("__win") - 1, prev_n).otherwise(F.lit(0))
    n2 = (
        F.when(prev_win == F.col("__win") - 2, prev_n)
        .when(prev2_win == F.col("__win") - 2, prev2_n).otherwise(F.lit(0))
    )
    cut = F.when(F.coalesce(n1, F.lit(0)) + F.coalesce(n2, F.lit(0)) <= n, 1).otherwise(0)
    pieces = counts.withColumn("__cut", cut).withColumn(
        "__piece", F.sum("__cut").over(by_win.rowsBetween(Window.unboundedPreceding, 0)))
    own = rows.join(pieces.select(key, "__win", "__piece"), [key, "__win"])
    starts = pieces.filter("__cut = 1").select(key, (F.col("__win") - 1).alias("__win"), "__piece")
    warm = rows.join(starts, [key, "__win"])
    both = own.withColumn("__warm", F.lit(False)).unionByName(warm.withColumn("__warm", F.lit(True)))
    cols = [*events.columns]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)

    def scan(batches):
        at, recent = None, deque()
        for pdf in batches:
            out = []
            for k, piece, t, warm_row in zip(pdf[key], pdf["__piece"], pdf["__t"], pdf["__warm"], strict=True):
                if (k, piece) != at:
                    at, recent = (k, piece), deque()
                while recent and t - recent[0] > span:
                    recent.popleft()
                if warm_row:  # known to be admitted
                    recent.append(t)
                    out.append(True)
                elif len(recent) < n:
                    recent.append(t)
                    out.append(True)
                else:
                    out.append(False)
            keep = ~pdf["__warm"].to_numpy(dtype=bool)
            yield pdf.assign(admitted=pd.Series(out, index=pdf.index, dtype=bool))[keep][[*cols, "admitted"]]

    ordered = both.repartition(key, "__piece").sortWithinPartitions(key, "__piece", "__t", ident)
    return ordered.mapInPandas(scan, f"{fields}, admitted boolean")
