"""Story scoring: personal fit, boosts, floors, blended rank, tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyrank import constants as K
from storyrank.functions import signals as S
from storyrank.functions.text import _c, announce_score, is_release_title
from storyrank.functions.vectors import cosine
from storyrank.operators.filters import source_lengths
from storyrank.params import Profile, tier_thresholds


SKETCH = 10_000  # a sketch's rank is off by one in this many values at most
BRACKET = 200_000  # values around a wanted rank that are counted one by one


def personal_score(embedding, interest: Column | str) -> Column:
    """Cosine to the interest vector, never below 0; 0 when either is missing."""
    return F.greatest(F.lit(0.0), cosine(embedding, interest))


def story_citation(stories: DataFrame, members: DataFrame, key: str = "story_id") -> DataFrame:
    """Largest member velocity per story, 0 without members."""
    best = members.groupBy(key).agg(F.max("citation").alias("citation"))
    return stories.join(best, key, "left").withColumn("citation", F.coalesce("citation", F.lit(0.0)))


def with_boosts(stories: DataFrame, boosts: DataFrame, key: str = "id") -> DataFrame:
    """Feedback boost per story, 0 when nobody reacted."""
    right = boosts.select(F.col("target_id").alias(key), "boost")
    return stories.join(right, key, "left").withColumn("boost", F.coalesce("boost", F.lit(0.0)))


def announcement_floor(stories: DataFrame, lens: DataFrame | None = None, key: str = "id") -> DataFrame:
    """A confirmed announcement is never less than notable news."""
    if lens is not None:
        right = lens.select(F.col(lens.columns[0]).alias(key), F.col("source_len").alias("__len"))
        stories = stories.join(right, key, "left")
    else:
        stories = stories.withColumn("__len", F.col("source_len"))
    real = is_release_title("title") & (
        (F.col("mention_count") >= 2) | (F.coalesce("__len", F.lit(0)) >= K.MIN_SOURCE_CHARS)
    )
    raised = F.greatest("importance", F.lit(K.ANNOUNCEMENT_FLOOR))
    return stories.withColumn("importance", F.when(real, raised).otherwise(F.col("importance"))).drop("__len")


def with_source_len(stories: DataFrame, members: DataFrame, key: str = "id") -> DataFrame:
    lens = source_lengths(members).withColumnRenamed("story_id", key)
    return stories.join(lens, key, "left").withColumn("source_len", F.coalesce("source_len", F.lit(0)))


def score_stories(
    stories: DataFrame, profile: Profile, as_of, interest=None, boosts: DataFrame | None = None,
) -> DataFrame:
    """Adds importance, personal and final_rank. ``interest`` is a constant vector or the
    name of a vector column (one reader per row)."""
    out = stories.withColumn("boost", F.lit(0.0)) if boosts is None else with_boosts(stories, boosts)
    out = out.withColumn("__imp", S.importance(profile, as_of))
    if interest is None:
        out = out.withColumn("__fit", F.lit(0.0))
    else:
        vector = F.col(interest) if isinstance(interest, str) else (
            interest if isinstance(interest, Column) else F.lit(list(interest)).cast("array<double>"))
        out = out.withColumn("__fit", personal_score("embedding", vector))
    rank = (
        profile.alpha * F.col("__imp") + profile.beta * F.col("__fit")
        + profile.gamma * S.diversity_bonus("family", profile) + F.col("boost")
        - F.when(S.is_muted("title", profile.mutes), F.lit(K.MUTE_PENALTY)).otherwise(F.lit(0.0))
    )
    return out.select(
        *stories.columns, F.round("__imp", 6).alias("importance"), F.round("__fit", 6).alias("personal"),
        F.round(rank, 6).alias("final_rank"),
    )


def order_stories(stories: DataFrame, by_mentions: bool = False) -> DataFrame:
    first = "mention_count" if by_mentions else "final_rank"
    return stories.orderBy(F.desc(first), "id")


# --- tiers ------------------------------------------------------------------------
def day_summary(stories: DataFrame, tiers: dict | None = None, keys: list[str] = ("day",)) -> DataFrame:
    """Per day: best importance and rank, the quiet flag and the three-level tier."""
    t = tier_thresholds(tiers)
    tops = stories.groupBy(*keys).agg(
        F.max("importance").alias("top_importance"), F.max("final_rank").alias("top_rank"))
    top = F.col("top_importance")
    return tops.withColumn("quiet", top < t["quiet_day_min_importance"]).withColumn(
        "day_tier",
        F.when(top >= t["breakthrough_importance_override"], "breakthrough")
        .when(top >= t["notable_day_min_importance"], "notable").otherwise("quiet_day"),
    )


def classify_stories(stories: DataFrame, tiers: dict | None = None, keys: list[str] = ("day",)) -> DataFrame:
    """Adds ``tier`` and ``quiet`` to the stories of every day. The day's maxima are one
    small row per day, so no day is gathered for a window."""
    t = tier_thresholds(tiers)
    days = day_summary(stories, t, keys).select(*keys, "top_rank", "quiet", "day_tier")
    joined = stories.join(days, list(keys))
    tier = S.classify_tier("importance", "final_rank", "top_rank", "quiet", t)
    return joined.withColumn("tier", tier).drop("top_rank")


def classify_days(
    stories: DataFrame, tiers: dict | None = None, keys: list[str] = ("day",), spine: DataFrame | None = None,
) -> DataFrame:
    """Per day: overall tier and quiet flag; a day of ``spine`` without stories is quiet."""
    tagged = classify_stories(stories, tiers, keys)
    best = tagged.groupBy(*keys).agg(
        F.max(S.tier_rank("tier")).alias("__best"), F.max("quiet").alias("quiet"),
        F.count("*").alias("n_stories"),
    )
    names = F.array(*[F.lit(t) for t in K.TIERS])
    out = best.withColumn(
        "overall_tier",
        F.when(F.col("quiet"), "quiet_day").otherwise(F.element_at(names, F.col("__best").cast("int") + 1)),
    ).drop("__best")
    if spine is not None:
        out = spine.join(out, list(keys), "left").select(
            *keys, F.coalesce("quiet", F.lit(True)).alias("quiet"),
            F.coalesce("n_stories", F.lit(0)).alias("n_stories"),
            F.coalesce("overall_tier", F.lit("quiet_day")).alias("overall_tier"),
        )
    return out


def tier_sweep(
    stories: DataFrame, candidates: dict[str, dict] = K.TIER_CANDIDATES, keys: list[str] = ("day",)
) -> DataFrame:
    """Tier counts and quiet flag per candidate threshold set and day: one scan, with the
    few candidates as a literal array on each row."""
    names = sorted(K.TIER_THRESHOLDS)
    sets = F.array(*[
        F.struct(F.lit(name).alias("candidate"),
                 *[F.lit(tier_thresholds(over)[k]).alias(k) for k in names])
        for name, over in candidates.items()
    ])
    tops = stories.groupBy(*keys).agg(
        F.max("importance").alias("top_importance"), F.max("final_rank").alias("top_rank"))
    rows = stories.join(tops, list(keys)).select("*", F.explode(sets).alias("c")).select("*", "c.*")
    rows = rows.withColumn("quiet", F.col("top_importance") < F.col("quiet_day_min_importance"))
    tier = S.classify_tier("importance", "final_rank", "top_rank", "quiet", {k: F.col(k) for k in names})
    counts = [F.count(F.when(F.col("__tier") == t, 1)).alias(t) for t in K.TIERS]
    return rows.withColumn("__tier", tier).groupBy("candidate", *keys).agg(*counts, F.max("quiet").alias("quiet"))


# --- quantiles --------------------------------------------------------------------
def quantiles(df: DataFrame, col: str, qs: list[float], accuracy: int = SKETCH, most: int = BRACKET) -> DataFrame:
    """Nearest-rank quantiles ``(q, value)``, exact, by selection.

    A mergeable sketch brackets each wanted rank; a second scan counts what lies below each
    bracket and inside it. Brackets of more than ``most`` values are cut again by a sketch of
    their own. Only the values inside the last brackets are shuffled, as counts of equal ones;
    the column never is. Nulls are left out; without values there are no rows, as without ``qs``.
    """
    values = df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull())
    qs = sorted({float(q) for q in qs})
    ends = values.agg(F.min("v"), F.max("v"), F.count("*")).first()
    total = ends[2]
    if not total or not qs:
        return df.sparkSession.createDataFrame([], "q double, value double")
    open_ = {q: (ends[0], ends[1], 0, total) for q in qs}  # least, largest, values below, values inside
    rank = {q: round(q * (total - 1)) for q in qs}  # half to even
    while any(low < high and n > most for low, high, _, n in open_.values()):
        wide = [q for q in qs if open_[q][0] < open_[q][1] and open_[q][3] > most]
        inside = {q: F.when(F.col("v").between(*open_[q][:2]), F.col("v")) for q in wide}
        share = {q: (rank[q] - open_[q][2]) / max(open_[q][3] - 1, 1) for q in wide}
        near = [F.percentile_approx(inside[q], [max(0.0, share[q] - 2 / accuracy), min(1.0, share[q] + 2 / accuracy)], accuracy) for q in wide]
        cuts = dict(zip(wide, values.agg(*near).first(), strict=True))
        counts = values.agg(*[F.count_if(c) for q in wide for c in (F.col("v") < cuts[q][0], F.col("v").between(*cuts[q]))]).first()
        for k, q in enumerate(wide):
            below, n = counts[2 * k], counts[2 * k + 1]
            if not below <= rank[q] < below + n or n == open_[q][3]:
                most = max(most, open_[q][3])  # no narrower bracket of this one; it is worked on as it is
                continue
            open_[q] = (*cuts[q], below, n)
    bounds = F.explode(F.array(*[F.struct(*[F.lit(x).alias(name) for x, name in zip((q, *open_[q][:3], rank[q]), ("q", "low", "high", "below", "rank"), strict=True)]) for q in qs]))
    any_ = None
    for low, high, _, _ in open_.values():
        any_ = F.col("v").between(low, high) if any_ is None else any_ | F.col("v").between(low, high)
    held = values.filter(any_).groupBy("v").agg(F.count("*").alias("n")).select("v", "n", bounds.alias("b")).select("v", "n", "b.*")
    run = Window.partitionBy("q").orderBy("v")
    found = held.filter(F.col("v").between(F.col("low"), F.col("high"))).withColumn("upto", F.col("below") + F.sum("n").over(run))
    return found.filter(F.col("upto") > F.col("rank")).groupBy("q").agg(F.min("v").alias("value"))


def family_counts(stories: DataFrame) -> DataFrame:
    return stories.groupBy("family").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "family")


def lead_order() -> list[Column]:
    """Breakthrough bonus and announcement score, then importance."""
    bonus = F.when(F.col("tier") == "breakthrough", F.lit(1.0)).otherwise(F.lit(0.0))
    return [F.desc(bonus + announce_score("title")), F.desc("importance"), F.asc("id")]
