"""Lookups and enrichment joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyrank import constants as K
from storyrank.functions import text as X
from storyrank.operators.grouping import first_per_key


def story_items(stories: DataFrame, members: DataFrame, items: DataFrame) -> DataFrame:
    """Items of each story with ``ord``: the representative at -1, the others at their
    place in the membership (story_id, item_id, pos). Ids without an item are skipped."""
    reps = stories.filter(F.col("representative_item_id").isNotNull()).select(
        F.col("id").alias("story_id"), F.col("representative_item_id").alias("item_id"),
        F.lit(-1).cast("bigint").alias("ord"))
    rest = members.select("story_id", "item_id", F.col("pos").cast("bigint").alias("ord")).join(
        reps.select("story_id", "item_id"), ["story_id", "item_id"], "left_anti")
    wanted = stories.select(F.col("id").alias("story_id"))
    every = reps.unionByName(rest.join(wanted, "story_id", "left_semi"))
    return every.join(items.withColumnRenamed("id", "item_id"), "item_id")


def enrich_metrics(items: DataFrame, papers: DataFrame) -> DataFrame:
    """Paper metrics (paper_id, metrics) laid over the items' own, by paper id; of several
    rows for a paper the one whose metrics are largest as JSON. Items
    without one skip the join instead of meeting in its NULL bucket."""
    by = F.to_json("metrics")
    new = papers.groupBy("paper_id").agg(F.max_by("metrics", by).alias("__new"))
    plain = items.filter(F.col("paper_id").isNull())
    hit = items.filter(F.col("paper_id").isNotNull()).join(new, "paper_id", "left")
    old = F.map_filter("metrics", lambda k, v: ~F.map_contains_key("__new", k))
    merged = F.when(F.col("__new").isNull(), F.col("metrics")).otherwise(F.map_concat(old, "__new"))
    return hit.withColumn("metrics", merged).select(*items.columns).unionByName(plain)


def covered(ranked: DataFrame, published: DataFrame, keys: list[str]) -> DataFrame:
    return ranked.join(published.select(*keys), keys, "left_semi")


def uncovered(ranked: DataFrame, published: DataFrame, keys: list[str]) -> DataFrame:
    return ranked.join(published.select(*keys), keys, "left_anti")


def effective_profile(base: DataFrame, override: DataFrame, key: str = "user") -> DataFrame:
    """Profiles with the steerable parts (ranking, mutes, subfields) taken from the
    override where it has them; everything else stays the profile's own."""
    steer = [c for c in ("ranking", "mutes", "subfields") if c in override.columns]
    right = override.select(key, *[F.col(c).alias(f"__{c}") for c in steer])
    out = base.join(right, key, "left")
    for c in steer:
        out = out.withColumn(c, F.coalesce(f"__{c}", c))
    return out.select(*base.columns)


def find_stories(ids: DataFrame, ranked: DataFrame, summaries: DataFrame) -> DataFrame:
    """For many ids at once: the ranked story and its summary (the first in section order),
    whichever of the two exists."""
    first = first_per_key(summaries, ["id"], ["pos"]).drop("pos")
    asked = ids.select("id").distinct()
    return asked.join(ranked.join(asked, "id", "left_semi").join(first, "id", "full_outer"), "id")


def richer_body(items: DataFrame, fetched: DataFrame, min_chars: int = K.READER_MIN_CHARS) -> DataFrame:
    """Industry rows with a thin body and a web url take the landed page text
    (url, body) when it is longer; of several pages of a url the longest, ties by text."""
    body = X.strip("body")
    pages = fetched.groupBy("url").agg(F.max_by(body, F.struct(F.length(body), body)).alias("__body"))
    trimmed = F.length(X.strip(F.coalesce("raw_text", F.lit(""))))
    wants = (
        (F.col("family") == "industry") & (trimmed < min_chars)
        & F.rlike("url", F.lit("^https?://"))
    )
    wants = F.coalesce(wants, F.lit(False))
    joined = items.filter(wants).join(pages, "url", "left")
    longer = F.coalesce(F.length("__body"), F.lit(0)) > trimmed
    grown = joined.withColumn(
        "raw_text", F.when(longer, F.left("__body", F.lit(K.READER_MAX_CHARS))).otherwise(F.col("raw_text")))
    return grown.select(*items.columns).unionByName(items.filter(~wants))
