"""The given tables seen as items, stories, feedback and digests.

Every view exists twice: as a DataFrame for the queries and as SQL text for the
oracle. ``AS_OF`` and ``LOCAL_TZ`` are the run parameters the queries use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyrank.functions.signals import citation_velocity, engagement, representative_score

AS_OF = "2024-01-31 00:00:00"
LOCAL_TZ = "America/Los_Angeles"
CLUSTER_AT = 0.40  # the fixture vectors have no pair near the default of 0.86


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; zone-free timestamps are read as instants, without a cast that
    would keep filters from the reader."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoned = T.StructType([
        T.StructField(f.name, T.TimestampType()) if isinstance(f.dataType, T.TimestampNTZType) else f
        for f in df.schema
    ])
    if zoned == df.schema:
        return df
    return spark.read.schema(zoned).parquet(f"{sf_dir}/{name}.parquet")


def engagement_counts(spark, d) -> DataFrame:
    kind = F.col("event_type")
    return (
        table(spark, d, "events")
        .groupBy(F.get_json_object("props", "$.k").cast("bigint").alias("k"))
        .agg(
            F.count(F.when(kind == "view", 1)).alias("upvotes"),
            F.count(F.when(kind == "click", 1)).alias("comments"),
            F.count(F.when(kind == "purchase", 1)).alias("citations"),
        )
    )


def items(spark, d) -> DataFrame:
    # The title is cut before the joins, so that they carry bodies only where these are read. A remainder
    # of 100 meets at most 199 keys: their counts are sent, and the rows are not shuffled by it.
    doc = table(spark, d, "documents").withColumn("title", F.split_part("text", F.lit("\n"), F.lit(1)))
    n = F.col("doc_id")
    base = (
        doc.join(
            table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "url"),
            "doc_id", "left",
        )
        .join(
            table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"),
            "doc_id", "left",
        )
        .join(F.broadcast(engagement_counts(spark, d).filter(F.col("k").between(-99, 99))), n % 100 == F.col("k"), "left")
    )
    up = F.coalesce("upvotes", F.lit(0)) * (1 + n % 97)
    com = F.coalesce("comments", F.lit(0)) * (1 + n % 13)
    cit = F.when(n % 4 == 0, F.coalesce("citations", F.lit(0))).otherwise(0)
    return base.select(
        n.alias("item_no"),
        F.concat(F.lit("item-"), n.cast("string")).alias("id"),
        F.when(n % 7 == 0, "arxiv").when(n % 7 == 1, "hn").when(n % 50 == 2, "smol.ai")
        .otherwise(F.col("source")).alias("source"),
        family_of(n % 4).alias("family"),
        "url",
        "title",
        F.timestamp_micros(
            F.unix_micros(F.lit(AS_OF).cast("timestamp")) - n * 360_000_000
        ).alias("published_at"),
        F.col("text").alias("raw_text"),
        "embedding",
        up.alias("upvotes"), com.alias("comments"), cit.alias("citations"),
        F.create_map(
            F.lit("upvotes"), up.cast("double"),
            F.lit("comments"), com.cast("double"),
            F.lit("citations"), cit.cast("double"),
        ).alias("metrics"),
    )


def family_of(code):
    return (
        F.when(code == 0, "academia").when(code == 1, "industry")
        .when(code == 2, "community").otherwise("meta")
    )


def feedback(spark, d) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.concat(F.lit("story-"), F.get_json_object("props", "$.k")).alias("target_id"),
        F.lit("story").alias("target_kind"),
        F.when(kind == "purchase", "up").when(kind == "error", "down").when(kind == "click", "click")
        .when(kind == "view", "dwell").otherwise("nl_instruction").alias("signal"),
        "value",
        F.col("ts").alias("created_at"),
    )


def story_members(spark, d) -> DataFrame:
    """Fixed grouping of the items into a hundred stories, with their signals."""
    return (
        items(spark, d)
        .select(
            F.concat(F.lit("story-"), (F.col("item_no") % 100).cast("string")).alias("story_id"),
            F.col("id").alias("item_id"),
            "item_no", "source", "family", "url", "title", "raw_text", "embedding",
            "published_at", "metrics",
        )
        .withColumn("engagement", engagement("metrics"))
        .withColumn("citation", citation_velocity("metrics", "published_at", AS_OF))
        .withColumn("score", representative_score("metrics", "family", "source", "published_at", AS_OF))
    )


def digests(spark, d) -> DataFrame:
    pr = F.col("o_orderpriority")
    cust = F.col("o_custkey").cast("string")
    return table(spark, d, "orders").select(
        F.concat(F.lit("digest-"), F.col("o_orderkey").cast("string")).alias("id"),
        F.when(pr == "1-URGENT", "weekly").otherwise("daily").alias("kind"),
        F.to_date("o_orderdate").alias("date"),
        F.when(pr == "1-URGENT", "breakthrough").when(pr == "2-HIGH", "notable")
        .when(pr == "3-MEDIUM", "minor").otherwise("quiet_day").alias("tier"),
        (F.col("o_orderstatus") == "F").alias("quiet"),
        (F.col("o_custkey") % 100).alias("story_no"),
        F.concat(F.lit('{"title":"Week '), cust, F.lit('","tldr":"Day '), cust, F.lit('"}')).alias("content"),
        F.timestamp_micros(
            F.unix_micros("o_orderdate") + (F.col("o_orderkey") % 1440) * 60_000_000
        ).alias("created_at"),
    )


def sixth(col):
    """Rounded to six places by steps that every engine takes alike."""
    return F.floor(col * 1e6 + 0.5) / 1e6


def day_stories(spark, d) -> DataFrame:
    day = F.to_date("ts")
    return (
        table(spark, d, "events")
        .groupBy(day.alias("day"), "user_id")
        .agg(
            F.count("*").alias("mention_count"),
            F.max("value").alias("mx"), F.max("ts").alias("created_at"),
            # Whole cents add up the same in any order.
            F.sum(F.floor(F.col("value") * 100 + 0.5)).alias("cents"),
        )
        .select(
            F.concat(F.col("day").cast("string"), F.lit("-"), F.col("user_id").cast("string")).alias("id"),
            "day",
            family_of(F.col("user_id") % 4).alias("family"),
            "mention_count",
            sixth(F.least(F.lit(1.0), F.col("mx") / 500.0 * (F.dayofmonth("day") % 5) / 2.0)).alias("importance"),
            sixth(F.least(F.lit(1.0), F.col("cents") / (F.col("mention_count") * 12000.0))).alias("final_rank"),
            "created_at",
        )
    )


def grounding_pairs(spark, d) -> DataFrame:
    n = F.col("doc_id")
    part = lambda m: (n % m).cast("string")
    return table(spark, d, "documents").select(
        "doc_id",
        F.concat(
            F.lit("Gains of "), part(12), F.lit("% were seen. It cost $"), part(9),
            F.lit(".5M to run! Version "), part(3), F.lit(" is plain."),
        ).alias("text"),
        F.concat(
            F.lit("Source: "), part(4), F.lit("% and $"), part(6), F.lit(".5M, in 1,0"), part(10),
            F.lit("0 runs."),
        ).alias("ground"),
    )


def titled(spark, d) -> DataFrame:
    """Documents with derived titles, so that every title rule has rows to act on."""
    n = F.col("doc_id") % 6
    head = (
        F.when(n == 0, "OpenLab unveils ").when(n == 1, "Show HN: ").when(n == 2, "Weekly recap: ")
        .when(n == 3, "My resume scored ").when(n == 4, "Acme raises $").otherwise("How ")
    )
    return table(spark, d, "documents").select(
        "doc_id",
        F.concat(F.lit("item-"), F.col("doc_id").cast("string")).alias("id"),
        F.concat(
            head, F.split_part("text", F.lit("\n"), F.lit(1))
        ).alias("title"),
        (1 + F.col("doc_id") % 3).alias("mention_count"),
        family_of(F.col("doc_id") % 4).alias("family"),
        F.col("text").alias("raw_text"),
    )


_EV = "cast(json_extract_string(props,'$.k') as bigint)"
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "engagement": ((), f"""
select {_EV} as k,
  count(case when event_type='view' then 1 end) as upvotes,
  count(case when event_type='click' then 1 end) as comments,
  count(case when event_type='purchase' then 1 end) as citations
from events group by 1"""),
    "items": (("engagement",), """
select d.doc_id as item_no, concat('item-', cast(d.doc_id as varchar)) as id,
  case when d.doc_id % 7 = 0 then 'arxiv' when d.doc_id % 7 = 1 then 'hn'
       when d.doc_id % 50 = 2 then 'smol.ai' else d.source end as source,
  case d.doc_id % 4 when 0 then 'academia' when 1 then 'industry' when 2 then 'community' else 'meta' end as family,
  p.url as url, split_part(d.text, chr(10), 1) as title,
  timestamp '2024-01-31 00:00:00' - d.doc_id * interval '6' minute as published_at,
  d.text as raw_text, e.embedding as embedding,
  coalesce(g.upvotes,0) * (1 + d.doc_id % 97) as upvotes,
  coalesce(g.comments,0) * (1 + d.doc_id % 13) as comments,
  case when d.doc_id % 4 = 0 then coalesce(g.citations,0) else 0 end as citations
from documents d left join pages p on p.page_id = d.doc_id
  left join embeddings e on e.vec_id = d.doc_id left join engagement g on g.k = d.doc_id % 100"""),
    "feedback": ((), """
select cast(event_id as varchar) as id, concat('story-', json_extract_string(props,'$.k')) as target_id,
  'story' as target_kind,
  case event_type when 'purchase' then 'up' when 'error' then 'down' when 'click' then 'click'
       when 'view' then 'dwell' else 'nl_instruction' end as signal,
  value, ts as created_at from events"""),
    "item_signals": (("items",), """
select *,
  case when upvotes + 0.5 * comments <= 0 then 0.0
       else least(1.0, pow(cast(upvotes + 0.5 * comments as double) / 2500.0, 0.6)) end as engagement,
  case when citations <= 0 then 0.0
       else least(1.0, ln(1 + citations / greatest(epoch(timestamp '2024-01-31 00:00:00' - published_at) / 86400.0, 1.0)) / ln(6.0)) end as citation,
  greatest(case family when 'academia' then 0.9 when 'industry' then 0.8 when 'meta' then 0.7 when 'community' then 0.6 else 0.5 end,
    case source when 'arxiv' then 0.85 when 'openreview' then 0.9 when 'semantic_scholar' then 0.85
      when 'hf_papers' then 0.8 when 'hn' then 0.65 when 'reddit' then 0.55 else 0.0 end)::double as authority
from items"""),
    "story_members": (("item_signals",), """
select concat('story-', cast(item_no % 100 as varchar)) as story_id, id as item_id, item_no, source, family,
  url, title, raw_text, embedding, published_at, engagement, citation,
  2.0 * engagement + authority + 0.5 * citation as score
from item_signals"""),
    "digests": ((), """
select concat('digest-', cast(o_orderkey as varchar)) as id,
  case when o_orderpriority = '1-URGENT' then 'weekly' else 'daily' end as kind, cast(o_orderdate as date) as date,
  case o_orderpriority when '1-URGENT' then 'breakthrough' when '2-HIGH' then 'notable'
       when '3-MEDIUM' then 'minor' else 'quiet_day' end as tier,
  o_orderstatus = 'F' as quiet, o_custkey % 100 as story_no,
  concat('{"title":"Week ', cast(o_custkey as varchar), '","tldr":"Day ', cast(o_custkey as varchar), '"}') as content,
  o_orderdate + (o_orderkey % 1440) * interval '1' minute as created_at from orders"""),
    "day_stories": ((), """
select concat(cast(cast(ts as date) as varchar), '-', cast(user_id as varchar)) as id, cast(ts as date) as day,
  case user_id % 4 when 0 then 'academia' when 1 then 'industry' when 2 then 'community' else 'meta' end as family,
  count(*) as mention_count,
  floor(least(1.0::double, max(value) / 500.0::double * (extract(day from cast(ts as date)) % 5) / 2.0::double) * 1e6 + 0.5::double) / 1e6 as importance,
  floor(least(1.0::double, cast(sum(cast(floor(value * 100 + 0.5::double) as bigint)) as double) / (count(*) * 12000.0::double)) * 1e6 + 0.5::double) / 1e6 as final_rank, max(ts) as created_at
from events group by cast(ts as date), user_id"""),
    "grounding_pairs": ((), """
select doc_id, concat('Gains of ', cast(doc_id % 12 as varchar), '% were seen. It cost $', cast(doc_id % 9 as varchar),
    '.5M to run! Version ', cast(doc_id % 3 as varchar), ' is plain.') as text,
  concat('Source: ', cast(doc_id % 4 as varchar), '% and $', cast(doc_id % 6 as varchar), '.5M, in 1,0',
    cast(doc_id % 10 as varchar), '0 runs.') as ground
from documents"""),
    "titled": ((), """
select doc_id, concat('item-', cast(doc_id as varchar)) as id,
  concat(case doc_id % 6 when 0 then 'OpenLab unveils ' when 1 then 'Show HN: ' when 2 then 'Weekly recap: '
    when 3 then 'My resume scored ' when 4 then 'Acme raises $' else 'How ' end,
    split_part(text, chr(10), 1)) as title,
  1 + doc_id % 3 as mention_count,
  case doc_id % 4 when 0 then 'academia' when 1 then 'industry' when 2 then 'community' else 'meta' end as family,
  text as raw_text
from documents"""),
}


def doc_stories(spark, d) -> DataFrame:
    """Documents as scored stories of the days they fall on; days are quiet, notable or
    breakthrough days in turn."""
    n = F.col("doc_id")
    day = F.to_date(F.timestamp_micros(F.unix_micros(F.lit(AS_OF).cast("timestamp")) - n * 360_000_000))
    return titled(spark, d).select(
        day.alias("day"), "doc_id", "id", "title", "family", "mention_count", "raw_text",
        F.round((n * 31 % 100) / 100.0 * (1 + F.dayofmonth(day) % 3) / 5.0, 6).alias("importance"),
        F.round((n * 37 % 101) / 130.0, 6).alias("final_rank"),
    )


CTES["doc_stories"] = (("titled",), """
select cast(timestamp '2024-01-31 00:00:00' - doc_id * interval '6' minute as date) as day, doc_id, id, title, family, mention_count, raw_text,
  round((doc_id * 31 % 100) / 100.0 * (1 + extract(day from cast(timestamp '2024-01-31 00:00:00' - doc_id * interval '6' minute as date)) % 3) / 5.0, 6)::double as importance,
  round((doc_id * 37 % 101) / 130.0, 6)::double as final_rank
from titled""")
