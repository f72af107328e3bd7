"""Upserts, replacement and appends over the fixture tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyrank import fixtures as fx
from storyrank.catalog.q_sources import (
    _SUPPLIER_SOURCES, _label_stories, _supplier_sources, event_state, region_stories,
)
from storyrank.catalog.registry import query, with_views
from storyrank.operators import tables as tb
from storyrank.operators.stored import StoredTable, merge_digests, merge_embeddings, merge_items, merge_stories
from storyrank.session import scratch


def _stored(rows: DataFrame, keys: list[str]) -> StoredTable:
    """The rows as a stored table in the shared folder."""
    return StoredTable.create(rows, scratch(rows.sparkSession, "stored"), keys, buckets=8)


def _e0(col="embedding"):
    return F.round(F.try_element_at(F.col(col), F.lit(1)).cast("double"), 6).alias("e0")


@query("SNK-01", with_views("""
select id, case when family in ('academia','meta') then 're-' || source else source end as source,
  round(embedding[1]::double, 6) as e0 from items
union all select 'page-' || cast(page_id as varchar), 'web', null from pages""", "items"))
def snk_01(spark, d):
    items = fx.items(spark, d)
    target = items.select("id", "source", "embedding")
    batch = items.filter(F.col("family").isin("academia", "meta")).select(
        "id", F.concat(F.lit("re-"), "source").alias("source"),
        F.lit(None).cast("array<float>").alias("embedding"))
    pages = fx.table(spark, d, "pages").select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("id"), F.lit("web").alias("source"),
        F.lit(None).cast("array<float>").alias("embedding"))
    table = _stored(target, ["id"])
    merge_items(table, batch.union(pages))
    return table.read().select("id", "source", _e0())


@query("SNK-02", """
select concat('item-', cast(d.doc_id as varchar)) as id, round(e.embedding[1]::double, 6) as e0
from documents d left join embeddings e on e.vec_id = d.doc_id""")
def snk_02(spark, d):
    items = fx.table(spark, d, "documents").select(
        F.concat(F.lit("item-"), F.col("doc_id").cast("string")).alias("id"),
        F.lit(None).cast("array<float>").alias("embedding"))
    vec = fx.table(spark, d, "embeddings")
    known = vec.select(F.concat(F.lit("item-"), F.col("vec_id").cast("string")).alias("id"), "embedding")
    unknown = vec.select(F.concat(F.lit("nowhere-"), F.col("vec_id").cast("string")).alias("id"), "embedding")
    table = _stored(items, ["id"])
    merge_embeddings(table, known.union(unknown))
    return table.read().select("id", _e0())


@query("SNK-03", """
with m as (select concat('story-', cast(label as varchar)) as story_id, label,
                  concat('item-', cast(vec_id as varchar)) as item_id from embeddings),
n as (select story_id, r_regionkey is not null as hit, case when r_regionkey is not null then 'moved-' || item_id else item_id end as item_id
  from m left join region on r_regionkey = label)
select distinct story_id, case when hit then 'new' else 'old' end as title,
  timestamp '2024-01-01 00:00:00' as created_at, item_id from n""")
def snk_03(spark, d):
    stories, members = _label_stories(spark, d)
    rows = stories.select(F.col("story_id").alias("id"), F.lit("old").alias("title"),
                          F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"))
    wanted = region_stories(spark, d).withColumnRenamed("id", "story_id")
    batch = stories.join(wanted, "story_id", "left_semi").select(F.col("story_id").alias("id"), F.lit("new").alias("title"),
                                        F.lit("2024-01-30 00:00:00").cast("timestamp").alias("created_at"))
    moved = members.join(wanted, "story_id", "left_semi").select("story_id", F.concat(F.lit("moved-"), "item_id").alias("item_id"))
    stories, bridge = _stored(rows, ["id"]), _stored(members.select("story_id", "item_id"), ["story_id"])
    merge_stories(stories, bridge, batch, moved.union(moved))
    return stories.read().withColumnRenamed("id", "story_id").join(bridge.read(), "story_id")


@query("SNK-04", with_views("""
select id, final_rank from day_stories where cast(created_at - interval '8' hour as date) <> date '2024-01-15'
union all
select 'new-' || id, final_rank + 0.5 from day_stories
where cast(created_at - interval '8' hour as date) = date '2024-01-15' and family = 'meta'""", "day_stories"))
def snk_04(spark, d):
    old = fx.day_stories(spark, d)
    at = F.to_date(F.from_utc_timestamp("created_at", fx.LOCAL_TZ)) == F.lit("2024-01-15").cast("date")
    new = old.filter(at & (F.col("family") == "meta")).withColumn(
        "id", F.concat(F.lit("new-"), "id")).withColumn("final_rank", F.col("final_rank") + 0.5)
    return tb.replace_day(old, "2024-01-15", fx.LOCAL_TZ, new).select("id", "final_rank")


@query("SNK-05", with_views("""
select id, kind, date, case when kind = 'weekly' then 'notable' else tier end as tier,
  case when kind = 'weekly' then not quiet else quiet end as quiet,
  case when kind = 'weekly' then '{}' else content end as content, created_at from digests
union all
select 'new-' || id, kind, date + 1, 'notable', not quiet, '{}', created_at + interval '1' day
from digests where tier = 'minor'""", "digests"))
def snk_05(spark, d):
    old = fx.digests(spark, d).select("id", "kind", "date", "tier", "quiet", "content", "created_at")
    changed = old.withColumn("quiet_day", ~F.col("quiet")).withColumn("content", F.lit("{}")).withColumn(
        "date", F.date_add("date", 1)).withColumn("created_at", F.col("created_at") + F.expr("interval 1 day"))
    weekly = changed.filter("kind = 'weekly'")
    added = changed.filter("tier = 'minor'").withColumn("id", F.concat(F.lit("new-"), "id"))
    batch = weekly.unionByName(added).withColumn("tier", F.lit("notable")).drop("quiet")
    table = _stored(old, ["id"])
    merge_digests(table, batch)
    return table.read()


@query("SNK-06", with_views("""
select cast((select max(cast(id as bigint)) from feedback where signal <> 'dwell')
            + row_number() over (order by created_at, target_id, signal, value) as varchar) as id,
  target_id, value, created_at from feedback where signal = 'dwell'""", "feedback"))
def snk_06(spark, d):
    fb = fx.feedback(spark, d)
    out = tb.append_feedback(fb.filter("signal <> 'dwell'"), fb.filter("signal = 'dwell'"))
    return out.select("id", "target_id", "value", "created_at")


@query("SNK-07", f"""
with s as ({_SUPPLIER_SOURCES})
select name, family, case when not enabled then 0.1 else authority end::double as authority,
  timestamp '2024-01-01 00:00:00' as created_at from s
union all select 'extra-' || name, family, 0.1, timestamp '2024-01-30 00:00:00' from s where not enabled""")
def snk_07(spark, d):
    first = F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at")
    later = F.lit("2024-01-30 00:00:00").cast("timestamp").alias("created_at")
    src = _supplier_sources(spark, d)
    old = src.select("name", "family", "authority", first)
    batch = src.filter(~F.col("enabled")).select("name", "family", F.lit(0.1).alias("authority"), later)
    extra = batch.withColumn("name", F.concat(F.lit("extra-"), "name"))
    return tb.upsert_sources(old, batch.union(extra))


@query("SNK-08", """
select concat('digest-', cast(doc_id as varchar)) as digest_id,
  '{"quality":' || case quality when 1 then '5.0' else '1.0' end || '}' as scores, 'first' as notes
from labels
union all
select concat('digest-', cast(doc_id as varchar)),
  '{"toxic":' || case toxic when 1 then '1.0' else '0.0' end || '}', null from labels""")
def snk_08(spark, d):
    lab = fx.table(spark, d, "labels")
    key = F.concat(F.lit("digest-"), F.col("doc_id").cast("string")).alias("digest_id")
    score = lambda name, c: F.create_map(F.lit(name), c.cast("double")).alias("scores")
    runs = lab.select(key, F.to_json(score("quality", 1 + 4 * F.col("quality"))).alias("scores"),
                      F.lit("first").alias("notes"))
    return tb.append_eval(runs, lab.select(key, score("toxic", F.col("toxic"))))


@query("SNK-09", """
with s as (select concat('user-', cast(user_id as varchar)) as key,
             case when event_type = 'error' then '[1]' else props end as value, ts as updated_at from events)
select key, arg_max(value, updated_at) as value, max(updated_at) as updated_at from s group by 1""")
def snk_09(spark, d):
    state = event_state(spark, d)
    half = F.col("updated_at") < F.lit("2024-01-15").cast("timestamp")
    return tb.save_state(state.filter(half), state.filter(~half))


@query("SNK-10", with_views("""
select 'check: tier' as what, id from digests where quiet
union all select 'orphan', 'digest-' || cast(doc_id as varchar) from labels
  where 'digest-' || cast(doc_id as varchar) not in (select id from digests where tier <> 'minor')
union all select 'cascade', 'digest-' || cast(doc_id as varchar) from labels
  where 'digest-' || cast(doc_id as varchar) not in (select id from digests where tier = 'notable')
union all select 'set-null', case when tier = 'notable' then null else id end from digests""", "digests"))
def snk_10(spark, d):
    dig = fx.digests(spark, d)
    odd = dig.withColumn("tier", F.when(F.col("quiet"), F.lit("odd")).otherwise(F.col("tier")))
    broken = tb.validate_table(odd, tb.enum_rules("digests")).select(
        F.concat(F.lit("check: "), "rule").alias("what"), "id")
    runs = fx.table(spark, d, "labels").select(
        F.concat(F.lit("digest-"), F.col("doc_id").cast("string")).alias("digest_id"))
    lost = tb.orphans(runs, "digest_id", dig.filter("tier <> 'minor'"))
    gone = dig.filter("tier = 'notable'").select("id")
    left = tb.cascade_delete(gone, runs, "digest_id")
    nulled = tb.set_null(gone, dig.select(F.col("id").alias("digest_id")), "digest_id")
    parts = [("orphan", lost), ("cascade", left), ("set-null", nulled)]
    for name, df in parts:
        broken = broken.union(df.select(F.lit(name), "digest_id"))
    return broken
