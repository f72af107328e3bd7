"""Column expressions for item and story signals, scores and tiers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyrank import constants as K
from storyrank.functions.text import _c, is_release_title, literal_map
from storyrank.params import Profile


def num(metrics, key: str) -> Column:
    """Metric as a number; missing or non-numeric gives 0."""
    return F.coalesce(F.try_element_at(_c(metrics), F.lit(key)).try_cast("double"), F.lit(0.0))


def engagement(metrics) -> Column:
    up = num(metrics, "upvotes") + num(metrics, "score") + num(metrics, "hf_upvotes")
    raw = up + 0.5 * (num(metrics, "comments") + num(metrics, "num_comments"))
    curve = F.pow(raw / K.VIRAL_ENGAGEMENT, F.lit(K.ENGAGEMENT_POWER))
    return F.when(raw <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), curve))


def age_days(ts, as_of) -> Column:
    micros = F.unix_micros(_ts(as_of)) - F.unix_micros(_c(ts))
    return F.greatest(micros / 86_400_000_000.0, F.lit(0.0))


def _ts(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def citation_velocity(metrics, published, as_of) -> Column:
    cites = num(metrics, "citations") + num(metrics, "citationCount")
    per_day = cites / F.greatest(age_days(published, as_of), F.lit(1.0))
    return F.when(cites <= 0, F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.log1p(per_day) / math.log1p(5.0))
    )


def recent_citations(year, as_of_year) -> Column:
    """Aggregate: citing works at most two years old; later years count as well."""
    return F.count(F.when(_c(as_of_year) - _c(year) <= 2, F.lit(1)))


def paper_velocity(recent, total, pub_year, as_of_year) -> Column:
    """Citations per year of a paper record, from its counts of recent and of all citations."""
    now = _c(as_of_year)
    recent = F.coalesce(_c(recent), F.lit(0))
    count = F.coalesce(_c(total), F.lit(0)).cast("double")
    aged = F.round(count / F.greatest(now - _c(pub_year), F.lit(1)), 3)
    return (
        F.when(recent > 0, F.round(recent / 2, 3))
        .when(_c(pub_year) <= now, aged)
        .otherwise(count)
    )


def half_life_decay(ts, as_of, half_life_days: float) -> Column:
    if half_life_days <= 0:
        return F.lit(1.0)
    return F.pow(F.lit(0.5), age_days(ts, as_of) / float(half_life_days))


def recency(ts, as_of, half_life_days: float = K.RECENCY_HALF_LIFE_DAYS) -> Column:
    return half_life_decay(ts, as_of, half_life_days)


def decay(ts, as_of, half_life_days: float = K.FEEDBACK_HALF_LIFE_DAYS) -> Column:
    return half_life_decay(ts, as_of, half_life_days)


def _lookup(mapping: dict, key, default: float) -> Column:
    return F.coalesce(F.try_element_at(literal_map(mapping), _c(key)), F.lit(default))


def authority(family, source) -> Column:
    return F.greatest(
        _lookup(K.FAMILY_AUTHORITY, family, K.UNKNOWN_AUTHORITY),
        _lookup(K.SOURCE_AUTHORITY, source, 0.0),
    )


def representative_score(metrics, family, source, published, as_of) -> Column:
    return (
        2.0 * engagement(metrics)
        + authority(family, source)
        + 0.5 * citation_velocity(metrics, published, as_of)
    )


def saturate(value, k: float) -> Column:
    v = F.greatest(F.lit(0.0), _c(value).cast("double"))
    return F.when(v + k > 0, v / (v + k)).otherwise(F.lit(0.0))


def unit_clamp(col) -> Column:
    value = F.coalesce(_c(col).cast("double"), F.lit(0.0))  # least() would skip a NULL
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def clamp01(value, fallback) -> Column:
    """Number forced into 0..1; anything non-numeric takes the fallback."""
    number = _c(value).cast("string").try_cast("double")
    fallback = fallback if isinstance(fallback, Column) else F.lit(float(fallback))
    return F.when(number.isNull(), fallback).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))
    )


def is_substantive(mention_count, citation, title) -> Column:
    return (_c(mention_count) > 1) | (_c(citation) > 0) | is_release_title(title)


def importance(profile: Profile, as_of) -> Column:
    """Noisy-OR importance over the story columns
    (family, mention_count, engagement, citation, title, created_at)."""
    weights = {**K.FAMILY_AUTHORITY, **profile.family_weights}
    trust = _lookup(weights, "family", K.UNKNOWN_AUTHORITY)
    mentions = saturate("mention_count", K.MENTION_SATURATION)
    cite = unit_clamp("citation")
    heat = unit_clamp("engagement") * F.when(
        is_substantive("mention_count", cite, "title"), F.lit(1.0)
    ).otherwise(F.lit(K.UNCORROBORATED_FACTOR))
    attention = 1.0 - (1.0 - heat) * (1.0 - K.MENTION_WEIGHT * mentions) * (1.0 - cite)
    fresh = 0.75 + 0.25 * recency("created_at", as_of)
    return unit_clamp(attention * (0.80 + 0.20 * trust) * fresh)


def diversity_bonus(family, profile: Profile) -> Column:
    base = F.when(_c(family) == "academia", F.lit(1.0)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), base + 0.5 * _lookup(profile.family_weights, family, 0.5))


def is_muted(title, mutes) -> Column:
    low = F.lower(_c(title))
    out = F.lit(False)
    for term in mutes:
        out = out | F.contains(low, F.lit(term.lower()))
    return F.coalesce(out, F.lit(False))


def rubric_score(col) -> Column:
    """One criterion forced into the rubric's range; unusable values take the minimum."""
    value = _c(col).cast("string").try_cast("double")
    low, high = F.lit(K.RUBRIC_MIN), F.lit(K.RUBRIC_MAX)
    return F.when(value.isNull(), low).otherwise(F.greatest(low, F.least(high, value)))


def weighted_total(scores: dict) -> Column:
    """Weighted rubric total of ``{criterion: column}``; an absent criterion counts 0."""
    total = F.lit(0.0)
    for name, weight in K.RUBRIC_WEIGHTS.items():
        if name in scores:
            total = total + scores[name] * F.lit(weight)
    return F.round(total, 4)


def tier_rank(tier) -> Column:
    return _lookup({t: float(i) for i, t in enumerate(K.TIERS)}, tier, 0.0)


def classify_tier(importance_col, rank_col, top_rank, quiet, tiers: dict | None = None) -> Column:
    """Tier of a story, given the day's best rank and whether the day is quiet.

    ``tiers`` maps threshold names to numbers or columns.
    """
    t = {k: v if isinstance(v, Column) else F.lit(float(v)) for k, v in
         {**K.TIER_THRESHOLDS, **(tiers or {})}.items()}
    imp, rank = _c(importance_col), _c(rank_col)
    on_quiet = F.when(
        (rank >= t["minor_min_score"]) & (rank >= _c(top_rank)), F.lit("minor")
    ).otherwise(F.lit("quiet_day"))
    return (
        F.when(_c(quiet), on_quiet)
        .when(imp >= t["breakthrough_importance_override"], F.lit("breakthrough"))
        .when(rank >= t["breakthrough_min_score"], F.lit("breakthrough"))
        .when(rank >= t["notable_min_score"], F.lit("notable"))
        .when(rank >= t["minor_min_score"], F.lit("minor"))
        .otherwise(F.lit("quiet_day"))
    )


def is_lead(tier, family) -> Column:
    return (_c(tier) == "breakthrough") | ((_c(tier) == "notable") & (_c(family) != "academia"))
