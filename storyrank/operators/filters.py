"""Row filters and predicates over items, stories and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyrank import constants as K
from storyrank.functions import text as X


def in_window(
    items: DataFrame, as_of,
    news_hours: int = K.NEWS_LOOKBACK_HOURS, academia_hours: int = K.ACADEMIA_LOOKBACK_HOURS,
) -> DataFrame:
    """Papers stay in the window longer than news; both bounds are inclusive. The wider
    bound stands alone as well, so that it can reach the reader and prune partitions."""
    now = F.lit(as_of).cast("timestamp")

    def back(hours: int) -> Column:
        return now - F.expr(f"interval {hours} hours")

    at = F.col("published_at")
    wide = back(max(news_hours, academia_hours))
    return items.filter(at >= wide).filter(
        at >= F.when(F.col("family") == "academia", back(academia_hours)).otherwise(back(news_hours))
    )


def after(col, since) -> Column:
    """Known and at or after ``since``."""
    return F.coalesce(X._c(col) >= F.lit(since).cast("timestamp"), F.lit(False))


def drop_aggregators(items: DataFrame) -> DataFrame:
    named = F.coalesce(F.col("source").isin(*K.AGGREGATOR_SOURCES), F.lit(False))
    mirrored = F.coalesce(F.rlike("url", F.lit(K.AGGREGATOR_URL)), F.lit(False))
    return items.filter(~(named | mirrored))


def is_self_promo(title, mention_count) -> Column:
    return (X._c(mention_count) <= 1) & X.is_promo_title(title)


def is_low_signal(title, mention_count) -> Column:
    return (X._c(mention_count) <= 1) & X.is_anecdote_title(title)


def is_recap(title) -> Column:
    return X.is_recap_title(title)


def curate_prefilter(stories: DataFrame) -> DataFrame:
    return stories.filter(
        ~is_self_promo("title", "mention_count")
        & ~is_low_signal("title", "mention_count")
        & ~is_recap("title")
    )


def body_size() -> Column:
    """Trimmed characters of a body."""
    return F.length(X.strip(F.coalesce("raw_text", F.lit(""))))


def source_lengths(members: DataFrame, key: str = "story_id") -> DataFrame:
    """Trimmed body characters per story. Where the members have a ``body_size``, their bodies need not come along."""
    size = F.col("body_size") if "body_size" in members.columns else body_size()
    return members.groupBy(key).agg(F.sum(size).alias("source_len"))


def with_thin_flag(stories: DataFrame, members: DataFrame, key: str = "story_id") -> DataFrame:
    """``is_thin``: less than the minimum of body text over all members, or no member."""
    joined = stories.join(source_lengths(members, key), key, "left")
    total = F.coalesce("source_len", F.lit(0))
    return joined.withColumn("source_len", total).withColumn("is_thin", total < K.MIN_SOURCE_CHARS)


def facet_filter(df: DataFrame, families: list[str] = (), tags: list[str] = ()) -> DataFrame:
    """Empty facet sets let everything through; tags match on any overlap."""
    if families:
        df = df.filter(F.col("family").isin(*families))
    if tags:
        df = df.filter(F.arrays_overlap("tags", X.literal_array(tags)))
    return df


def available_tags(df: DataFrame, known: list[str]) -> DataFrame:
    """Known tags that occur, in list order; the whole list when no row has a tag."""
    seen = df.select(F.explode("tags").alias("tag")).distinct()
    any_tag = seen.limit(1).agg(F.count("*")).scalar() > 0
    spark = df.sparkSession
    listed = spark.createDataFrame([(i, t) for i, t in enumerate(known)], "pos int, tag string")
    marked = listed.join(seen.withColumn("__hit", F.lit(True)), "tag", "left")
    return marked.filter(F.col("__hit").isNotNull() | ~any_tag).select("pos", "tag").orderBy("pos")


def ground_links(entries: DataFrame, items: DataFrame) -> DataFrame:
    """A link stays only when some item has that url; no item urls at all turn the check
    off. Rows with a blank title go, an unknown family reads as meta."""
    valid = items.select("url").filter(F.col("url") != "").distinct()
    unchecked = valid.limit(1).agg(F.count("*")).scalar() == 0
    rows = entries.withColumn("title", X.strip("title")).filter(F.col("title") != "")
    rows = rows.withColumn("url", X.non_blank("url"))
    marked = rows.join(valid.withColumn("__real", F.lit(True)), "url", "left")
    return marked.withColumn(
        "url", F.when(F.col("__real").isNotNull() | unchecked, F.col("url"))
    ).withColumn(
        "family", F.when(F.col("family").isin(*K.FAMILIES), F.col("family")).otherwise("meta")
    ).select(*entries.columns)


def quiet_gate(markdown, quiet_expected) -> Column:
    """struct(quiet_ok, note): does a report of a quiet day admit it, without hype?"""
    low = F.lower(X._c(markdown))
    said = X.any_of(K.QUIET_MARKERS, lambda m: F.contains(low, F.lit(m)))
    hype = X.any_of(K.INFLATION_MARKERS, lambda m: F.contains(low, F.lit(m)))
    expected = X._c(quiet_expected)
    note = (
        F.when(~expected, "non-quiet day: honesty gate not applicable")
        .when(said & ~hype, "quiet day acknowledged honestly")
        .when(~said, "quiet day not acknowledged (no honest 'quiet day' signal)")
        .otherwise("quiet day inflated with manufactured-importance language")
    )
    return F.struct((~expected | (said & ~hype)).alias("quiet_ok"), note.alias("note"))


def validate_feedback(raw: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good, quarantined) feedback requests out of a column of JSON bodies."""
    allowed = ["target_id", "target_kind", "signal", "value", "text"]
    doc = F.try_parse_json(F.col(col))

    def kind_of(name: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(doc, f"$.{name}", "variant"))

    def text_of(name: str) -> Column:
        return F.when(kind_of(name) == "STRING", F.try_variant_get(doc, f"$.{name}", "string"))

    fields = F.map_keys(F.from_json(F.col(col), "map<string,string>"))
    has_value = F.array_contains(fields, "value")
    amount = F.when(has_value, F.try_variant_get(doc, "$.value", "double")).otherwise(F.lit(1.0))
    reason = (
        F.when(~F.coalesce(F.startswith(F.schema_of_variant(doc), F.lit("OBJECT")), F.lit(False)), "not an object")
        .when(F.size(F.array_except(fields, X.literal_array(allowed))) > 0, "unknown field")
        .when(F.coalesce(text_of("target_id"), F.lit("")) == "", "target_id")
        .when(~F.coalesce(text_of("target_kind").isin(*K.TARGET_KINDS), F.lit(False)), "target_kind")
        .when(~F.coalesce(text_of("signal").isin(*K.SIGNALS), F.lit(False)), "signal")
        .when(amount.isNull(), "value")
        .when(~F.coalesce(kind_of("text").isin("STRING", "VOID"), F.lit(True)), "text")
    )
    rows = raw.select(
        "*", text_of("target_id").alias("__id"), text_of("target_kind").alias("__kind"),
        text_of("signal").alias("__signal"), amount.alias("__amount"), text_of("text").alias("__text"),
        reason.alias("reason"),
    )
    rest = [c for c in raw.columns if c != col]
    good = rows.filter(F.col("reason").isNull()).select(
        *rest, F.col("__id").alias("target_id"), F.col("__kind").alias("target_kind"),
        F.col("__signal").alias("signal"), F.col("__amount").alias("value"), F.col("__text").alias("text"),
    )
    return good, rows.filter(F.col("reason").isNotNull()).select(*raw.columns, "reason")


def story_listing(stories: DataFrame, day: str | None = None) -> DataFrame:
    """Ranked stories of a day without reading their vectors."""
    if day is not None:
        stories = stories.filter(F.col("day") == F.lit(day).cast("date"))
    empty = F.lit(None).cast(stories.schema["embedding"].dataType)
    return stories.withColumn("embedding", empty).orderBy(F.desc("final_rank"), "id")
