"""Signal, score and vector expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyrank import fixtures as fx
from storyrank.catalog.q_filters import RELEASE_SQL
from storyrank.catalog.registry import query, with_views
from storyrank.functions import signals as S
from storyrank.functions import vectors as V
from storyrank.params import Profile

AGE_SQL = "greatest(epoch(timestamp '2024-01-31 00:00:00' - {c}) / 86400.0, 0.0)"


def r6(col, name):
    return F.round(col, 6).alias(name)


def event_metrics(spark, d):
    """Events as metric maps; one kind writes its number as text, one as junk."""
    kind = F.col("event_type")
    value = (F.when(kind == "error", F.lit("n/a")).when(kind == "signup", F.lit(None))
             .otherwise(F.col("value").cast("string")))
    m = F.create_map(F.lit("upvotes"), value, F.lit("num_comments"), F.col("user_id").cast("string"),
                     F.lit("citations"), F.when(kind == "purchase", F.col("user_id").cast("string")))
    return fx.table(spark, d, "events").select("event_id", "ts", m.alias("metrics"))


_EM = """select event_id, ts, case when event_type = 'error' or event_type = 'signup' then 0.0 else value end as up, user_id as com,
  case when event_type = 'purchase' then user_id else 0 end as cit from events"""


@query("SIG-01", f"select event_id, up::double as up, com::double as com, 0.0::double as missing from ({_EM})")
def sig_01(spark, d):
    return event_metrics(spark, d).select(
        "event_id", S.num("metrics", "upvotes").alias("up"), S.num("metrics", "num_comments").alias("com"),
        S.num("metrics", "score").alias("missing"))


@query("SIG-02", f"""
select event_id, round(case when up + 0.5 * com <= 0 then 0.0 else least(1.0, pow((up + 0.5 * com)::double / 2500.0, 0.6)) end, 6) as engagement
from ({_EM})""")
def sig_02(spark, d):
    return event_metrics(spark, d).select("event_id", r6(S.engagement("metrics"), "engagement"))


@query("SIG-03", f"""
select event_id, round(case when cit <= 0 then 0.0
  else least(1.0, ln(1 + cit / greatest({AGE_SQL.format(c='ts')}, 1.0)) / ln(6.0)) end, 6) as velocity from ({_EM})""")
def sig_03(spark, d):
    return event_metrics(spark, d).select(
        "event_id", r6(S.citation_velocity("metrics", "ts", fx.AS_OF), "velocity"))


@query("SIG-04", """
with c as (select l_orderkey, count(*) as n, count(case when 1998 - extract(year from l_shipdate) <= 2 then 1 end) as recent
  from lineitem group by 1)
select o_orderkey, round(case when coalesce(recent, 0) > 0 then round(recent / 2.0, 3)
  when extract(year from o_orderdate) <= 1998 then round(coalesce(n, 0)::double / greatest(1998 - extract(year from o_orderdate), 1), 3)
  else coalesce(n, 0)::double end, 3)::double as velocity
from orders left join c on l_orderkey = o_orderkey""")
def sig_04(spark, d):
    cites = fx.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        S.recent_citations(F.year("l_shipdate"), F.lit(1998)).alias("recent"), F.count("*").alias("n"))
    papers = fx.table(spark, d, "orders").join(cites, "o_orderkey", "left")
    return papers.select("o_orderkey", F.round(S.paper_velocity(
        F.col("recent"), F.col("n"), F.year("o_orderdate"), F.lit(1998)), 3).alias("velocity"))


@query("SIG-05", f"""
select event_id, round({AGE_SQL.format(c='ts')}, 6)::double as age, round(pow(0.5, {AGE_SQL.format(c='ts')} / 2.0), 6) as recency,
  1.0::double as flat from events""")
def sig_05(spark, d):
    return fx.table(spark, d, "events").select(
        "event_id", r6(S.age_days("ts", fx.AS_OF), "age"), r6(S.recency("ts", fx.AS_OF), "recency"),
        S.recency("ts", fx.AS_OF, 0).alias("flat"))


@query("SIG-06", with_views("select id, authority from item_signals", "item_signals"))
def sig_06(spark, d):
    return fx.items(spark, d).select("id", S.authority("family", "source").alias("authority"))


@query("SIG-07", with_views("""
select id, round(2.0 * engagement + authority + 0.5 * citation, 6)::double as score from item_signals""", "item_signals"))
def sig_07(spark, d):
    return fx.items(spark, d).select(
        "id", r6(S.representative_score("metrics", "family", "source", "published_at", fx.AS_OF), "score"))


@query("SIG-08", "select event_id, round(greatest(value - 50, 0) / (greatest(value - 50, 0) + 4.0), 6)::double as s from events")
def sig_08(spark, d):
    return fx.table(spark, d, "events").select("event_id", r6(S.saturate(F.col("value") - 50, 4.0), "s"))


_E = "list_transform({c}, lambda x: x::double)"


@query("SIG-09", f"""
with v as (select vec_id, label, {_E.format(c='embedding')} as e from embeddings),
h as (select label, e from v join (select label, min(vec_id) as vec_id from v group by 1) using (label, vec_id))
select v.vec_id, round(list_cosine_similarity(v.e, h.e), 6) as sim, round(list_cosine_similarity(v.e, h.e), 6) as bulk,
  0.0::double as other from v join h using (label)""")
def sig_09(spark, d):
    vec = fx.table(spark, d, "embeddings")
    heads = vec.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("head"))
    rows = vec.join(heads, "label")
    return rows.select("vec_id", r6(V.cosine("embedding", "head"), "sim"), r6(V.cosine_bulk("embedding", "head"), "bulk"),
                       V.cosine("embedding", F.slice("head", 1, 8)).alias("other"))


@query("SIG-10", f"""
with v as (select vec_id, list_transform(embedding, lambda x: x::double * 3) as e from embeddings)
select vec_id, round(list_transform(list_slice(e, 1, 16), lambda x: x / sqrt(list_sum(list_transform(list_slice(e, 1, 16), lambda y: y * y))))[1], 6) as cut0,
  round(e[64] / sqrt(list_sum(list_transform(e, lambda y: y * y))), 6) as pad63, 80::bigint as n from v""")
def sig_10(spark, d):
    tripled = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 3)
    rows = fx.table(spark, d, "embeddings").select(
        "vec_id", V.l2_normalize(tripled, 16).alias("cut"), V.l2_normalize(tripled, 80).alias("pad"))
    return rows.select("vec_id", r6(F.col("cut")[0], "cut0"), r6(F.col("pad")[63], "pad63"),
                       F.size("pad").cast("bigint").alias("n"))


@query("SIG-11", f"""
with v as (select vec_id, {_E.format(c='embedding')} as e from embeddings)
select vec_id, round(greatest(0.0, e[1] / sqrt(list_sum(list_transform(e, lambda y: y * y)))), 6) as personal from v""")
def sig_11(spark, d):
    from storyrank.operators.ranking import personal_score

    interest = F.lit([1.0] + [0.0] * 63).cast("array<double>")
    return fx.table(spark, d, "embeddings").select("vec_id", r6(personal_score("embedding", interest), "personal"))


@query("SIG-12", with_views(f"""
select doc_id, mention_count > 1 or doc_id % 5 = 0 or {RELEASE_SQL} as hit from titled""", "titled"))
def sig_12(spark, d):
    cite = F.when(F.col("doc_id") % 5 == 0, 0.5).otherwise(0.0)
    return fx.titled(spark, d).select("doc_id", S.is_substantive("mention_count", cite, "title").alias("hit"))


# Stories of the fixed grouping, with the columns that scoring needs.
STORIES_SQL = """
stories as (
  select m.story_id as id, arg_max(title, (score, -item_no)) as title, arg_max(family, (score, -item_no)) as family,
    count(*) as mention_count, max(engagement) as engagement, max(citation) as citation, max(published_at) as created_at
  from story_members m group by 1)"""


def stories(spark, d):
    best = F.struct("score", -F.col("item_no"))
    return fx.story_members(spark, d).groupBy(F.col("story_id").alias("id")).agg(
        F.max_by("title", best).alias("title"), F.max_by("family", best).alias("family"),
        F.count("*").alias("mention_count"), F.max("engagement").alias("engagement"),
        F.max("citation").alias("citation"), F.max("published_at").alias("created_at"))


FAMILY_WEIGHT_SQL = "case family when 'academia' then 0.9 when 'industry' then 0.8 when 'community' then 0.6 when 'meta' then 0.7 else 0.5 end"
IMPORTANCE_SQL = f"""greatest(0.0, least(1.0,
  (1.0 - (1.0 - engagement * case when mention_count > 1 or citation > 0 or {RELEASE_SQL} then 1.0 else 0.5 end)
       * (1.0 - 0.85 * (mention_count / (mention_count + 4.0))) * (1.0 - citation))
  * (0.8 + 0.2 * {FAMILY_WEIGHT_SQL}) * (0.75 + 0.25 * pow(0.5, {AGE_SQL.format(c='created_at')} / 2.0))))"""


@query("SIG-13", with_views(f"""
with {STORIES_SQL.strip()}
select id, round({IMPORTANCE_SQL}, 6)::double as importance from stories""", "story_members"))
def sig_13(spark, d):
    return stories(spark, d).select("id", r6(S.importance(Profile(), fx.AS_OF), "importance"))


@query("SIG-14", with_views(f"""
select id, least(1.0, case when family = 'academia' then 1.0 else 0.0 end + 0.5 * {FAMILY_WEIGHT_SQL})::double as bonus
from day_stories""", "day_stories"))
def sig_14(spark, d):
    return fx.day_stories(spark, d).select("id", S.diversity_bonus("family", Profile()).alias("bonus"))


@query("SIG-15", f"select event_id, round(pow(0.5, {AGE_SQL.format(c='ts')} / 14.0), 6) as decay, 1.0::double as flat from events")
def sig_15(spark, d):
    return fx.table(spark, d, "events").select(
        "event_id", r6(S.decay("ts", fx.AS_OF), "decay"), S.decay("ts", fx.AS_OF, 0).alias("flat"))


RUBRIC_SQL = """round(0.25 * (1 + 4 * quality) + 0.25 * least(5, 1 + 6 * (1 - toxic)) + 0.20 * 1 + 0.20 * (1 + 2 * quality), 4)::double"""


def rubric_scores():
    return {
        "insight": S.rubric_score(1 + 4 * F.col("quality")),
        "accuracy": S.rubric_score(1 + 6 * (1 - F.col("toxic"))),
        "narrative": S.rubric_score(F.lit("unusable")),
        "personal_fit": S.rubric_score(1 + 2 * F.col("quality")),
    }


@query("SIG-16", f"select doc_id, {RUBRIC_SQL} as total from labels")
def sig_16(spark, d):
    return fx.table(spark, d, "labels").select("doc_id", S.weighted_total(rubric_scores()).alias("total"))


@query("SIG-17", """
select event_id, case event_type when 'error' then 0.4 when 'signup' then 0.4 else least(1.0, greatest(0.0, (value - 20) / 50.0)) end::double as w
from events""")
def sig_17(spark, d):
    kind = F.col("event_type")
    raw = F.when(kind == "error", F.lit("high")).when(kind == "signup", None).otherwise(
        ((F.col("value") - 20) / 50.0).cast("string"))
    return fx.table(spark, d, "events").select("event_id", S.clamp01(raw, 0.4).alias("w"))
