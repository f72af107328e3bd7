"""Scans over the stored tables: filters and limits that reach the Parquet reader."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyrank.functions.text import local_date, strip
from storyrank.operators.grouping import last_per_key

DAILY_CONTENT = "struct<tldr: string, quiet_day: boolean, story_ids: array<string>>"
WEEKLY_CONTENT = "struct<title: string, lede: string, body_markdown: string, story_ids: array<string>>"


def items_since(items: DataFrame, since, family: str | None = None) -> DataFrame:
    out = items.filter(F.col("published_at") >= F.lit(since).cast("timestamp"))
    if family is not None:
        out = out.filter(F.col("family") == family)
    return out.orderBy(F.desc("published_at"), "id")


def items_by_ids(items: DataFrame, ids: DataFrame) -> DataFrame:
    return items.join(ids.select("id"), "id", "left_semi")


def items_without_embedding(items: DataFrame, limit: int = 500) -> DataFrame:
    """Newest rows still lacking a vector; the limit is the feature (one model batch)."""
    pending = items.filter(F.col("embedding").isNull())
    return pending.orderBy(F.desc("published_at"), "id").limit(limit)


def stories_for_date(stories: DataFrame, day: str, tz: str) -> DataFrame:
    """Stories of one local day. Reads the ``local_date`` partition when it is stored."""
    stored = "local_date" in stories.columns
    at = F.col("local_date") if stored else local_date("created_at", tz)
    return stories.filter(at == F.lit(day).cast("date")).orderBy(F.desc("final_rank"), "id")


def stories_by_ids(stories: DataFrame, story_items: DataFrame, ids: DataFrame) -> DataFrame:
    """Wanted stories with one row per member: a story's members stay rows, so a story
    of any size is read in parallel. A story without members keeps one row."""
    wanted = stories.join(ids.select(F.col("id").alias("story_id")).distinct(), "story_id", "left_semi")
    members = story_items.select("story_id", "item_id").distinct()
    return wanted.join(members, "story_id", "left")


def digest_by_id(digests: DataFrame, digest_id: str) -> DataFrame:
    weekly = F.col("kind") == "weekly"
    return digests.filter(F.col("id") == digest_id).select(
        "id", "kind",
        F.when(weekly, F.from_json("content", WEEKLY_CONTENT)).alias("weekly"),
        F.when(~weekly, F.from_json("content", DAILY_CONTENT)).alias("daily"),
    )


def digest_title(kind="kind", content="content"):
    picked = F.when(F.col(kind) == "weekly", F.get_json_object(content, "$.title")).otherwise(
        F.get_json_object(content, "$.tldr")
    )
    return F.coalesce(picked, F.lit(""))


def list_digests(digests: DataFrame, kind: str | None = None, limit: int = 30) -> DataFrame:
    """The latest digests, ``limit`` of them."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    out = digests if kind is None else digests.filter(F.col("kind") == kind)
    return (
        out.select("id", "kind", "date", "tier", "quiet", digest_title().alias("title"), "created_at")
        .orderBy(F.desc("date"), F.desc("created_at"), "id")
        .limit(limit)
    )


def archive_rows(digests: DataFrame) -> DataFrame:
    return digests.select("id", "kind", "date", "tier", "quiet", digest_title().alias("title"), "created_at")


def search_archive(rows: DataFrame, query: str, kind: str = "all") -> DataFrame:
    if kind != "all":
        rows = rows.filter(F.col("kind") == kind)
    q = query.strip().lower()
    if not q:
        return rows
    texts = [F.col("title"), F.col("date").cast("string"), F.col("id")]
    hit = F.lit(False)
    for text in texts:
        hit = hit | F.contains(F.lower(text), F.lit(q))
    return rows.filter(hit)


def feedback_since(fb: DataFrame, signal: str | None = None, since=None) -> DataFrame:
    """Feedback newest first; a stored value of 0 (or none) reads as 1."""
    if signal is not None:
        fb = fb.filter(F.col("signal") == signal)
    if since is not None:
        fb = fb.filter(F.col("created_at") >= F.lit(since).cast("timestamp"))
    read = F.coalesce(F.nullif(F.col("value"), F.lit(0.0)), F.lit(1.0))
    return fb.withColumn("value", read).orderBy(F.desc("created_at"), "id")


def source_registry(src: DataFrame, enabled_only: bool = True) -> DataFrame:
    out = src.filter(F.col("enabled")) if enabled_only else src
    return out.withColumn("authority", F.coalesce("authority", F.lit(0.5))).orderBy("name")


def app_state(state: DataFrame, key: str | None = None) -> DataFrame:
    """Latest value per key; a value that is not a JSON object reads as absent."""
    if key is not None:
        state = state.filter(F.col("key") == key)
    latest = last_per_key(state.select("key", "value", "updated_at"), ["key"], ["updated_at", "value"])
    shape = F.schema_of_variant(F.try_parse_json(strip("value")))
    return latest.filter(F.startswith(shape, F.lit("OBJECT")))
