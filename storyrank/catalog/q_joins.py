"""Joins: similarity, link rules, lookups and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyrank import fixtures as fx
from storyrank.catalog.q_signals import stories
from storyrank.catalog.q_text import sq_tokens
from storyrank.catalog.registry import query, with_views
from storyrank.operators import clustering as cl
from storyrank.operators import feedback as fb
from storyrank.operators import lookup as lk
from storyrank.operators.ranking import with_boosts
from storyrank.operators.similarity import similar_pairs

PAIRS_SQL = """
v as (select vec_id as id, list_transform(embedding, lambda x: x::double) as e from embeddings),
pairs as (select a.id as id_a, b.id as id_b, list_cosine_similarity(a.e, b.e) as similarity
  from v a join v b on a.id < b.id)"""

BOOST_SQL = """
boosts as (
  select target_id, sum(case signal when 'up' then 1.0 when 'down' then -1.0 when 'click' then 0.25
      when 'dwell' then 0.15 * least(value, 120.0) / 120.0 end
    * pow(0.5, greatest(epoch(timestamp '2024-01-31 00:00:00' - created_at) / 86400.0, 0.0) / 14.0)) as boost
  from feedback where signal in ('up', 'down', 'click', 'dwell') group by 1)"""


@query("JON-01", f"with {PAIRS_SQL.strip()} select id_a, id_b, round(similarity, 6) as similarity from pairs where similarity >= 0.40")
def jon_01(spark, d):
    vec = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    pairs = similar_pairs(vec, 0.40, collapse=False).filter("id_a < id_b")  # copies pair with each other and with all that is near
    return pairs.select("id_a", "id_b", F.round("similarity", 6).alias("similarity"))


def vector_items(spark, d):
    return fx.items(spark, d).filter(F.col("embedding").isNotNull())


def _path_sql(c):
    s = f"split_part(split_part(regexp_replace(lower({c}), '^https?://', ''), '#', 1), '?', 1)"
    return f"coalesce(nullif(case when instr({s}, '/') > 0 then rtrim(substr({s}, instr({s}, '/')), '/') else '' end, ''), {s})"


CANNOT_SQL = """case when a.family = 'academia' and b.family = 'academia' then true
  when a.source = b.source and coalesce(a.path <> b.path, false) then true
  when (a.family = 'academia' or b.family = 'academia') and len(a.tokens) > 0 and len(b.tokens) > 0
    and len(list_intersect(a.tokens, b.tokens))::double / len(list_distinct(list_concat(a.tokens, b.tokens))) < 0.15 then true
  else false end"""
ITEM_PAIRS_SQL = f"""
p as (select id, family, source, {_path_sql('url')} as path, {sq_tokens('title')} as tokens,
   list_transform(embedding, lambda x: x::double) as e from items where embedding is not null),
item_pairs as (select a.id as id_a, b.id as id_b, list_cosine_similarity(a.e, b.e) as similarity, {CANNOT_SQL} as blocked
   from p a join p b on a.id < b.id where list_cosine_similarity(a.e, b.e) >= 0.35)"""


@query("JON-02", with_views(f"with {ITEM_PAIRS_SQL.strip()} select id_a, id_b, blocked from item_pairs", "items"))
def jon_02(spark, d):
    profile = cl.link_profile(vector_items(spark, d), [])
    pairs = similar_pairs(profile, 0.35, collapse=False, carry="p").filter("id_a < id_b")
    return pairs.select("id_a", "id_b", cl.cannot_link().alias("blocked"))


@query("JON-03", """
with m as (select label, vec_id from embeddings), r as (select label, max(vec_id) as rep from m group by 1)
select 's' || cast(m.label as varchar) as story_id, m.vec_id as item_id, length(d.text) as n_chars,
  case when m.vec_id = r.rep then -1 else m.vec_id end as ord
from m join r using (label) join documents d on d.doc_id = m.vec_id""")
def jon_03(spark, d):
    vec = fx.table(spark, d, "embeddings")
    sid = F.concat(F.lit("s"), F.col("label").cast("string"))
    members = vec.select(sid.alias("story_id"), F.col("vec_id").alias("item_id"), F.col("vec_id").alias("pos"))
    reps = members.groupBy(F.col("story_id").alias("id")).agg(F.max("item_id").alias("representative_item_id"))
    items = fx.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.length("text").cast("bigint").alias("n_chars"))
    return lk.story_items(reps, members, items).select("story_id", "item_id", "n_chars", "ord")


@query("JON-04", with_views(f"""
with {BOOST_SQL.strip()}, s as (select distinct story_id as id from story_members union all select 'story-none')
select s.id, round(coalesce(boost, 0.0), 6)::double as boost from s left join boosts on target_id = s.id""",
    "story_members", "feedback"))
def jon_04(spark, d):
    ids = stories(spark, d).select("id").union(spark.createDataFrame([("story-none",)], "id string"))
    out = with_boosts(ids, fb.feedback_boosts(fx.feedback(spark, d), fx.AS_OF))
    return out.select("id", F.round("boost", 6).alias("boost"))


@query("JON-05", """
select d.doc_id, case when l.doc_id is not null and d.doc_id % 3 <> 0 then l.quality * 10 else 7 end::double as citations,
  5.0::double as upvotes, case when l.doc_id is not null and d.doc_id % 3 <> 0 then l.toxic end::double as velocity
from documents d left join labels l using (doc_id)""")
def jon_05(spark, d):
    n = F.col("doc_id")
    items = fx.table(spark, d, "documents").select(
        "doc_id", F.when(n % 3 != 0, F.concat(F.lit("p"), n.cast("string"))).alias("paper_id"),
        F.create_map(F.lit("citations"), F.lit(7.0), F.lit("upvotes"), F.lit(5.0)).alias("metrics"))
    papers = fx.table(spark, d, "labels").select(
        F.concat(F.lit("p"), n.cast("string")).alias("paper_id"),
        F.create_map(F.lit("citations"), (F.col("quality") * 10).cast("double"),
                     F.lit("citation_velocity"), F.col("toxic").cast("double")).alias("metrics"))
    m = lambda k: F.try_element_at("metrics", F.lit(k))
    return lk.enrich_metrics(items, papers).select(
        "doc_id", m("citations").alias("citations"), m("upvotes").alias("upvotes"), m("citation_velocity").alias("velocity"))


def published(spark, d):
    """Stories named by the archive: (family, id) of every order's story number."""
    dig = fx.digests(spark, d).filter("tier <> 'quiet_day'")
    return dig.select(F.concat(F.lit("2024-01-"), F.lpad((1 + F.col("story_no") % 28).cast("string"), 2, "0"),
                               F.lit("-"), F.col("story_no").cast("string")).alias("id")).distinct()


PUBLISHED_SQL = """
published as (select distinct '2024-01-' || lpad(cast(1 + story_no % 28 as varchar), 2, '0') || '-' || cast(story_no as varchar) as id
  from digests where tier <> 'quiet_day')"""


@query("JON-06", with_views(f"""
with {PUBLISHED_SQL.strip()}
select id, id in (select id from published) as covered from day_stories""", "digests", "day_stories"))
def jon_06(spark, d):
    ranked, done = fx.day_stories(spark, d).select("id"), published(spark, d)
    return lk.covered(ranked, done, ["id"]).withColumn("covered", F.lit(True)).union(
        lk.uncovered(ranked, done, ["id"]).withColumn("covered", F.lit(False)))


WEIGHTS_SQL = """
weights as (select target_id, sum(case signal when 'up' then 1.0 else -1.0 end
    * pow(0.5, greatest(epoch(timestamp '2024-01-31 00:00:00' - created_at) / 86400.0, 0.0) / 14.0)) as weight
  from feedback where signal in ('up', 'down') group by 1)"""


def vector_stories(spark, d):
    return fx.table(spark, d, "embeddings").select(
        F.concat(F.lit("story-"), F.col("vec_id").cast("string")).alias("id"), "embedding")


@query("JON-07", with_views(f"""
with {WEIGHTS_SQL.strip()}
select target_id, round(weight, 6) as weight, round(e.embedding[1]::double, 6) as e0
from weights join embeddings e on 'story-' || cast(e.vec_id as varchar) = target_id where weight <> 0""", "feedback"))
def jon_07(spark, d):
    weights = fb.feedback_weights(fx.feedback(spark, d), fx.AS_OF)
    out = fb.feedback_vectors(weights, vector_stories(spark, d), 64)
    return out.select("target_id", F.round("weight", 6).alias("weight"),
                      F.round(F.col("embedding")[0].cast("double"), 6).alias("e0"))


@query("JON-08", """
with b as (select user_id, count(*) as n from events group by 1),
o as (select user_id, arg_max(json_extract_string(props, '$.k')::bigint, (ts, event_id)) as k from events where event_type = 'purchase' group by 1)
select b.user_id, case when k % 2 = 0 then k / 100.0 else 0.5 end::double as alpha,
  case when k % 3 = 0 then 'm' || cast(k as varchar) else 'base' end as mutes, 'v' || cast(n as varchar) as venues
from b left join o using (user_id)""")
def jon_08(spark, d):
    ev = fx.table(spark, d, "events")
    base = ev.groupBy(F.col("user_id").alias("user")).agg(F.count("*").alias("n")).select(
        "user", F.struct(F.lit(0.5).alias("alpha")).alias("ranking"), F.array(F.lit("base")).alias("mutes"),
        F.concat(F.lit("v"), F.col("n").cast("string")).alias("venues"))
    k = F.col("k")
    last = ev.filter("event_type = 'purchase'").groupBy(F.col("user_id").alias("user")).agg(
        F.max_by(F.get_json_object("props", "$.k").cast("bigint"), F.struct("ts", "event_id")).alias("k"))
    override = last.select(
        "user", F.when(k % 2 == 0, F.struct((k / 100.0).alias("alpha"))).alias("ranking"),
        F.when(k % 3 == 0, F.array(F.concat(F.lit("m"), k.cast("string")))).alias("mutes"))
    return lk.effective_profile(base, override).select(
        F.col("user").alias("user_id"), "ranking.alpha", F.array_join("mutes", "|").alias("mutes"), "venues")


@query("JON-09", with_views("""
with last as (select max(day) as day from day_stories),
s as (select d.id, final_rank, family, user_no from (select *, cast(split_part(id, '-', 4) as bigint) as user_no from day_stories) d, last where d.day = last.day),
latest as (select story_no, row_number() over (order by date desc, created_at desc, id) as pos from digests where kind = 'daily'),
summ as (select (select cast(day as varchar) from last) || '-' || cast(story_no as varchar) as id, min(pos) as pos from latest group by 1),
asked as (select distinct (select cast(day as varchar) from last) || '-' || cast(user_id as varchar) as id from events)
select asked.id, s.final_rank, s.family, 'take ' || cast(summ.pos as varchar) as takeaway
from asked left join s on s.id = asked.id left join summ on summ.id = asked.id
where s.id is not null or summ.id is not null""", "day_stories", "digests"))
def jon_09(spark, d):
    from storyrank.operators.grouping import exact_rank

    ranked = fx.day_stories(spark, d)
    last = ranked.agg(F.max("day")).scalar()
    today = ranked.filter(F.col("day") == last).select("id", "final_rank", "family")
    daily = fx.digests(spark, d).filter("kind = 'daily'").select("story_no", "date", "created_at", "id")
    placed = exact_rank(daily, [], [F.desc("date"), F.desc("created_at"), F.asc("id")])
    prefix = F.concat(last.cast("string"), F.lit("-"))
    summaries = placed.select(
        F.concat(prefix, F.col("story_no").cast("string")).alias("id"), "pos",
        F.concat(F.lit("take "), F.col("pos").cast("string")).alias("takeaway"))
    asked = fx.table(spark, d, "events").select(F.concat(prefix, F.col("user_id").cast("string")).alias("id"))
    return lk.find_stories(asked, today, summaries)


@query("JON-10", """
with i as (select d.doc_id, case d.doc_id % 4 when 1 then 'industry' else 'meta' end as family,
   case when d.doc_id % 3 = 0 then d.text else 'thin' end as body, p.url from documents d left join pages p on p.page_id = d.doc_id),
f as (select url, min(trim(html)) as page from pages group by 1)
select doc_id, md5(case when family = 'industry' and url is not null
    and length(trim(body, chr(32)||chr(9)||chr(10)||chr(13))) < 280
    and length(coalesce(page, '')) > length(trim(body, chr(32)||chr(9)||chr(10)||chr(13))) then left(page, 8000) else body end) as body_md5
from i left join f using (url)""")
def jon_10(spark, d):
    n = F.col("doc_id")
    pages = fx.table(spark, d, "pages")
    items = fx.table(spark, d, "documents").join(
        pages.select(F.col("page_id").alias("doc_id"), "url"), "doc_id", "left").select(
        "doc_id", F.when(n % 4 == 1, "industry").otherwise("meta").alias("family"),
        F.when(n % 3 == 0, F.col("text")).otherwise("thin").alias("raw_text"), "url")
    landed = pages.groupBy("url").agg(F.min("html").alias("body"))
    return lk.richer_body(items, landed).select("doc_id", F.md5("raw_text").alias("body_md5"))


