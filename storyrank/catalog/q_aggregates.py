"""Grouping, clustering, scoring, tiers and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyrank import fixtures as fx
from storyrank.catalog.q_filters import GATE_SQL, RELEASE_SQL, gated
from storyrank.catalog.q_joins import (
    BOOST_SQL, ITEM_PAIRS_SQL, PAIRS_SQL, PUBLISHED_SQL, WEIGHTS_SQL, published, vector_items, vector_stories,
)
from storyrank.catalog.q_signals import (
    FAMILY_WEIGHT_SQL, IMPORTANCE_SQL, RUBRIC_SQL, STORIES_SQL, rubric_scores, stories,
)
from storyrank.catalog.q_text import sq_slug
from storyrank.catalog.registry import query, with_views
from storyrank.functions import signals as S
from storyrank.functions import vectors as V
from storyrank.operators import clustering as cl
from storyrank.operators import evaluation as ev
from storyrank.operators import feedback as fb
from storyrank.operators import filters as fl
from storyrank.operators import ranking as rk
from storyrank.operators.grouping import first_per_key
from storyrank.params import Profile
from storyrank.session import stage
from storyrank.sources.landing import union_sources


def r6(col, name):
    return F.round(col, 6).alias(name)


@query("AGG-01", """
with u as (select page_id, url, 0 as batch from pages union all select page_id, url || 'x', 1 from pages
           union all select page_id, url, 2 from pages),
k as (select regexp_extract(url, '^https?://([^/]+)', 1) as host, page_id, batch from u)
select host, min(page_id) as page_id, 0 as batch from k where batch = 0 group by 1""")
def agg_01(spark, d):
    pages = fx.table(spark, d, "pages").select("page_id", "url")
    batches = [pages.withColumn("batch", F.lit(0)),
               pages.withColumn("url", F.concat("url", F.lit("x"))).withColumn("batch", F.lit(1)),
               pages.withColumn("batch", F.lit(2))]
    rows = union_sources(batches).select(
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), "page_id", "batch")
    return first_per_key(rows, ["host"], ["batch", "page_id"])


@query("AGG-02", f"""
with recursive {PAIRS_SQL.strip()},
edges as (select id_a as x, id_b as y from pairs where similarity >= 0.40
          union all select id_b, id_a from pairs where similarity >= 0.40),
reach(id, root) as (select vec_id, vec_id from embeddings union select e.y, r.root from reach r join edges e on e.x = r.id)
select id, min(root) as "group" from reach group by 1""")
def agg_02(spark, d):
    vec = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return cl.dedup_groups(vec, fx.CLUSTER_AT)


def label_members(spark, d):
    """Vectors grouped by label, with made signals, as members of a group."""
    n = F.col("vec_id")
    e0 = F.col("embedding")[0].cast("double")
    return fx.table(spark, d, "embeddings").select(
        F.col("label").alias("group"), F.concat(F.lit("item-"), n.cast("string")).alias("id"),
        F.concat(F.lit("Vector "), n.cast("string")).alias("title"),
        fx.family_of(n % 7 % 4).alias("family"), F.round(e0, 3).alias("score"),
        F.abs(e0).alias("engagement"), (e0 * e0).alias("citation"), "embedding")


MEMBERS_SQL = """
lm as (select label as grp, concat('item-', cast(vec_id as varchar)) as id, concat('Vector ', cast(vec_id as varchar)) as title,
  case vec_id % 7 % 4 when 0 then 'academia' when 1 then 'industry' when 2 then 'community' else 'meta' end as family,
  round(embedding[1]::double, 3) as score, abs(embedding[1]::double) as engagement,
  embedding[1]::double * embedding[1]::double as citation from embeddings)"""


@query("AGG-03", f"""
with {MEMBERS_SQL.strip()},
g as (select grp, row_number() over (order by max(score) desc, grp) as group_rank from lm group by grp)
select grp as "group", id, score, row_number() over (partition by grp order by score desc, id) as pos, group_rank
from lm join g using (grp)""")
def agg_03(spark, d):
    return cl.order_groups(label_members(spark, d))


# One merge a step. The state is the list of pairs that may still merge, best first (a pair is
# named by its groups' smallest ids), and the merges so far; a third group stays near a
# merged one only if it was near both parts, at the smaller similarity.
COMPLETE_SQL = f"""
{ITEM_PAIRS_SQL.strip()},
open as (select list_sort(list({{'n': -similarity, 'a': id_a, 'b': id_b}})) as pairs from item_pairs
  where not blocked and similarity >= {fx.CLUSTER_AT}),
merge(step, pairs, x, y) as (
  select 0, pairs, null::varchar, null::varchar from open
  union all
  select step + 1, list_sort(list_concat(
      list_filter(pairs, lambda e: not list_contains([e.a, e.b], x) and not list_contains([e.a, e.b], y)),
      list_transform(
        list_filter(near_x, lambda u: len(list_filter(near_y, lambda v: v.c = u.c)) > 0),
        lambda u: {{'n': greatest(u.n, list_filter(near_y, lambda v: v.c = u.c)[1].n), 'a': least(x, u.c), 'b': greatest(x, u.c)}}))),
    x, y
  from (select *,
      list_transform(list_filter(pairs, lambda e: (e.a = x) <> (e.b = x) and e.a <> y and e.b <> y),
        lambda e: {{'c': case when e.a = x then e.b else e.a end, 'n': e.n}}) as near_x,
      list_transform(list_filter(pairs, lambda e: (e.a = y) <> (e.b = y) and e.a <> x and e.b <> x),
        lambda e: {{'c': case when e.a = y then e.b else e.a end, 'n': e.n}}) as near_y
    from (select step, pairs, pairs[1].a as x, pairs[1].b as y from merge where len(pairs) > 0))),
up(id, grp) as (
  select id, id from p
  union all
  select up.id, m.x from up join merge m on m.y = up.grp)"""


@query("AGG-04", with_views(f"""with {COMPLETE_SQL.strip()} select id, min(grp) as "group" from up group by id""", "items", recursive=True))
def agg_04(spark, d):
    """Complete-link clusters under the link rules over all items with a vector."""
    return cl.cluster_stories(vector_items(spark, d), fx.CLUSTER_AT)


@query("AGG-05", """
select * from (values ('pair not allowed', 0::bigint), ('pair of groups left to merge', 0::bigint),
  ('item in several groups', 0::bigint)) t("check", violations)""")
def agg_05(spark, d):
    items = vector_items(spark, d)
    nodes, _ = cl.link_nodes(stage(cl.link_profile(items, [])), [])
    nodes = stage(nodes)
    edges = stage(cl.allowed_edges(nodes, fx.CLUSTER_AT, []))
    merged = cl.merged_nodes(edges).withColumnRenamed("node", "id")
    on_nodes = stage(nodes.select("id").join(merged, "id", "left").select("id", F.coalesce("group", "id").alias("group")))
    return cl.cluster_violations(on_nodes, edges)


@query("AGG-06", f"""
with {MEMBERS_SQL.replace("label as grp", "vec_id // 5 as grp").strip()},
o as (select *, row_number() over (partition by grp order by score desc, id) as pos from lm),
s as (select grp, max(case when pos = 1 then title end) as title, max(case when pos = 1 then id end) as rep,
   string_agg(id, '|' order by pos) as ids, string_agg(id, '|' order by id) as sorted_ids, count(*) as mention_count,
   max(engagement) as engagement, max(citation) as citation from o group by 1)
select {sq_slug('title')} || '-' || left(sha256(sorted_ids), 8) as id, title, rep as representative_item_id, md5(ids) as ids_md5,
  mention_count, round(engagement, 6) as engagement, round(citation, 6) as citation from s""")
def agg_06(spark, d):
    members = label_members(spark, d).withColumn("group", F.floor(F.split_part("id", F.lit("-"), F.lit(2)).cast("bigint") / 5))
    out = cl.build_stories(members, with_vectors=False)
    return out.select("id", "title", "representative_item_id", F.md5(F.array_join("item_ids", "|")).alias("ids_md5"),
                      "mention_count", r6("engagement", "engagement"), r6("citation", "citation"))


@query("AGG-07", f"""
with {MEMBERS_SQL.strip()},
c as (select grp, family, count(*) as n, max(score) as best from lm group by 1, 2),
f as (select c.*, min(id) as first_id from c join lm on lm.grp = c.grp and lm.family = c.family and lm.score = c.best group by all)
select "group", family from (select grp as "group", family,
  row_number() over (partition by grp order by n desc, best desc, first_id) as r from f) where r = 1""")
def agg_07(spark, d):
    return cl.modal_family(label_members(spark, d))


@query("AGG-08", """
with v as (select label, i, embedding[i]::double as x from embeddings, range(1, 65) t(i)),
m as (select label, i, avg(x) as a from v group by 1, 2),
n as (select label, sqrt(sum(a * a)) as norm from m group by 1)
select label, i::integer as pos, round(a / norm, 6) as value from m join n using (label)""")
def agg_08(spark, d):
    out = V.centroid(fx.table(spark, d, "embeddings"), ["label"], "embedding")
    return out.select("label", F.posexplode("centroid").alias("p", "v")).select(
        "label", (F.col("p") + 1).alias("pos"), r6("v", "value"))


@query("AGG-09", with_views("""
select id, round(coalesce(citation, 0.0), 6) as citation from (
  select s.id, max(m.citation) as citation from (select distinct story_id as id from story_members union all select 'story-none') s
  left join story_members m on m.story_id = s.id group by 1)""", "story_members"))
def agg_09(spark, d):
    members = fx.story_members(spark, d)
    ids = members.select("story_id").distinct().union(spark.createDataFrame([("story-none",)], "story_id string"))
    return rk.story_citation(ids, members).select(F.col("story_id").alias("id"), r6("citation", "citation"))


@query("AGG-10", with_views(f"with {BOOST_SQL.strip()} select target_id, round(boost, 6)::double as boost from boosts", "feedback"))
def agg_10(spark, d):
    return fb.feedback_boosts(fx.feedback(spark, d), fx.AS_OF).select("target_id", r6("boost", "boost"))


@query("AGG-11", with_views(f"""
with {WEIGHTS_SQL.strip()},
w as (select weight, embedding from weights join embeddings on 'story-' || cast(vec_id as varchar) = target_id where weight <> 0),
c as (select i, sum(weight * embedding[i]::double) / (select sum(abs(weight)) from w) as c from w, range(1, 65) t(i) group by 1),
u as (select i, c / (select sqrt(sum(c * c)) from c) as c from c),
b as (select i, 0.5 * case when i = 1 then 1.0 else 0.0 end + 0.5 * c as b from u)
select i::integer as pos, round(b / (select sqrt(sum(b * b)) from b), 6) as value from b""", "feedback"))
def agg_11(spark, d):
    base = spark.range(1).select(F.lit([1.0] + [0.0] * 63).cast("array<double>").alias("vector"))
    out = fb.interest_vector(fx.feedback(spark, d), vector_stories(spark, d), base, fx.AS_OF, 64)
    return out.select(F.posexplode("vector").alias("p", "v")).select((F.col("p") + 1).alias("pos"), r6("v", "value"))


@query("AGG-12", with_views("""
select story_id, cast(sum(length(trim(raw_text, chr(32)||chr(9)||chr(10)||chr(13)))) as bigint) as source_len
from story_members group by 1""", "story_members"))
def agg_12(spark, d):
    return fl.source_lengths(fx.story_members(spark, d))


@query("AGG-13", with_views(f"""
select doc_id, case when {RELEASE_SQL} and (mention_count >= 2 or length(trim(raw_text, chr(32)||chr(9)||chr(10)||chr(13))) >= 200)
  then greatest(importance, 0.42) else importance end::double as importance
from (select *, (doc_id % 100) / 100.0 as importance from titled)""", "titled"))
def agg_13(spark, d):
    docs = fx.titled(spark, d)
    lens = fl.source_lengths(docs, "id")
    rows = docs.withColumn("importance", (F.col("doc_id") % 100) / 100.0)
    return rk.announcement_floor(rows, lens).select("doc_id", "importance")


def scored_stories(spark, d, profile=None):
    """The fixed stories with centroid vectors, boosts and scores for a fixed reader."""
    members = fx.story_members(spark, d)
    rows = stories(spark, d).join(
        V.centroid(members, ["story_id"], "embedding").select(
            F.col("story_id").alias("id"), F.col("centroid").alias("embedding")), "id", "left")
    boosts = fb.feedback_boosts(fx.feedback(spark, d), fx.AS_OF)
    profile = profile or Profile(mutes=("the",))
    return rk.score_stories(rows, profile, fx.AS_OF, interest=[1.0] + [0.0] * 63, boosts=boosts)


SCORED_SQL = f"""
{STORIES_SQL.strip()},
{BOOST_SQL.strip()},
sv as (select story_id, i, avg(embedding[i]::double) as a from story_members, range(1, 65) t(i) where embedding is not null group by 1, 2),
sn as (select story_id, max(case when i = 1 then a end) / sqrt(sum(a * a)) as e0 from sv group by 1),
scored as (select id, title, family, mention_count, created_at, round({IMPORTANCE_SQL}, 6)::double as importance,
  round(greatest(0.0, coalesce(e0, 0.0)), 6)::double as personal,
  round(0.5 * {IMPORTANCE_SQL} + 0.4 * greatest(0.0, coalesce(e0, 0.0))
    + 0.1 * least(1.0, case when family = 'academia' then 1.0 else 0.0 end + 0.5 * {FAMILY_WEIGHT_SQL})
    + coalesce(boost, 0.0) - case when contains(lower(title), 'the') then 0.5 else 0.0 end, 6)::double as final_rank
  from stories left join sn on sn.story_id = stories.id left join boosts on target_id = stories.id)"""


@query("AGG-14", with_views(f"with {SCORED_SQL} select id, importance, personal, final_rank from scored",
                            "story_members", "feedback"))
def agg_14(spark, d):
    return scored_stories(spark, d).select("id", "importance", "personal", "final_rank")


def tier_sql(t=None):
    t = {"breakthrough_min_score": 0.72, "breakthrough_importance_override": 0.55, "notable_min_score": 0.40,
         "minor_min_score": 0.30, **(t or {})}
    return f"""case when quiet then case when final_rank >= {t['minor_min_score']} and final_rank >= top_rank then 'minor' else 'quiet_day' end
    when importance >= {t['breakthrough_importance_override']} or final_rank >= {t['breakthrough_min_score']} then 'breakthrough'
    when final_rank >= {t['notable_min_score']} then 'notable' when final_rank >= {t['minor_min_score']} then 'minor'
    else 'quiet_day' end"""


TAGGED_SQL = f"""
tops as (select day, max(importance) as top_importance, max(final_rank) as top_rank, max(importance) < 0.32 as quiet,
  case when max(importance) >= 0.55 then 'breakthrough' when max(importance) >= 0.32 then 'notable' else 'quiet_day' end as day_tier
  from day_stories group by 1),
tagged as (select s.*, quiet, day_tier, {tier_sql()} as tier from day_stories s join tops using (day))"""


@query("AGG-15", with_views(f"with {TAGGED_SQL.strip()} select id, tier from tagged", "day_stories"))
def agg_15(spark, d):
    return rk.classify_stories(fx.day_stories(spark, d)).select("id", "tier")


def day_spine(spark, d):
    """Every day from the first to one week after the last event."""
    ends = fx.table(spark, d, "events").agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b"))
    return ends.select(F.explode(F.sequence("a", F.date_add("b", 7))).alias("day"))


SPINE_SQL = """
spine as (select cast(unnest(generate_series((select min(cast(ts as date)) from events),
  (select max(cast(ts as date)) from events) + interval '7' day, interval '1' day)) as date) as day)"""


@query("AGG-16", with_views(f"""
with {TAGGED_SQL.strip()},
{SPINE_SQL.strip()},
o as (select day, bool_or(quiet) as quiet, count(*) as n_stories,
  max(case tier when 'breakthrough' then 3 when 'notable' then 2 when 'minor' then 1 else 0 end) as r from tagged group by 1)
select spine.day, coalesce(quiet, true) as quiet, coalesce(n_stories, 0) as n_stories,
  case when coalesce(quiet, true) then 'quiet_day' when r = 3 then 'breakthrough' when r = 2 then 'notable'
    when r = 1 then 'minor' else 'quiet_day' end as overall_tier
from spine left join o using (day)""", "day_stories"))
def agg_16(spark, d):
    return rk.classify_days(fx.day_stories(spark, d), spine=day_spine(spark, d))


@query("AGG-17", with_views(f"with {TAGGED_SQL.strip()} select day, day_tier from tops", "day_stories"))
def agg_17(spark, d):
    return rk.day_summary(fx.day_stories(spark, d)).select("day", "day_tier")


def _sweep_sql():
    from storyrank.constants import TIER_CANDIDATES

    parts = []
    for name, over in TIER_CANDIDATES.items():
        gate = over.get("quiet_day_min_importance", 0.32)
        parts.append(f"""select '{name}' as candidate, day, count(*) filter (where tier = 'quiet_day') as quiet_day,
          count(*) filter (where tier = 'minor') as minor, count(*) filter (where tier = 'notable') as notable,
          count(*) filter (where tier = 'breakthrough') as breakthrough, bool_or(quiet) as quiet
        from (select *, {tier_sql(over)} as tier from (select s.*, top_rank, top_importance < {gate} as quiet
              from day_stories s join (select day, max(importance) as top_importance, max(final_rank) as top_rank from day_stories group by 1) using (day)))
        group by day""")
    return "\nunion all ".join(parts)


@query("AGG-18", with_views(_sweep_sql(), "day_stories"))
def agg_18(spark, d):
    return rk.tier_sweep(fx.day_stories(spark, d))


@query("AGG-19", """
with s as (select l_extendedprice as v, row_number() over (order by l_extendedprice) - 1 as i, count(*) over () as n from lineitem),
q as (select unnest([0.5, 0.75, 0.9, 1.0])::double as q)
select q, v as value from q join s on i = cast(round_even(q * (n - 1), 0) as bigint)""")
def agg_19(spark, d):
    return rk.quantiles(fx.table(spark, d, "lineitem"), "l_extendedprice", [0.5, 0.75, 0.9, 1.0])


@query("AGG-20", with_views("select family, count(*) as n from titled group by 1", "titled"))
def agg_20(spark, d):
    return rk.family_counts(fx.titled(spark, d))


COVERAGE_SQL = f"""
{PUBLISHED_SQL.strip()},
{SPINE_SQL.strip()},
rk as (select *, row_number() over (partition by day order by final_rank desc, id) as pos from day_stories),
cov as (select day, round(avg(case when p.id is not null then 1.0 else 0.0 end), 3) as coverage, count(*) as top_k,
   string_agg(case when p.id is null then rk.id end, '|' order by pos) as missed from rk left join published p on p.id = rk.id where pos <= 10 group by 1),
cover as (select spine.day, coalesce(coverage, 1.0)::double as coverage, coalesce(top_k, 0) as top_k, coalesce(missed, '') as missed
   from spine left join cov using (day))"""


def covered_days(spark, d):
    done = published(spark, d).withColumn("day", F.to_date(F.substring("id", 1, 10)))
    return ev.coverage(fx.day_stories(spark, d), done, spine=day_spine(spark, d))


@query("AGG-21", with_views(f"with {COVERAGE_SQL.strip()} select * from cover", "digests", "day_stories"))
def agg_21(spark, d):
    return covered_days(spark, d).select("day", "coverage", "top_k", F.array_join("uncovered_titles", "|").alias("missed"))


@query("AGG-22", """
with l as (select doc_id, toxic = 1 as quiet, round(quality * 0.6 + (doc_id % 5) / 10.0, 3)::double as cov, doc_id % 3 as missed, doc_id % 4 as m4 from labels)
select 'recall' as gate, doc_id, case when quiet then '' else array_to_string(list_filter([
    case when cov < 0.7 then 'top-10 coverage ' || cast(cov as varchar) || ' < floor 0.7' end,
    case missed when 1 then '1 important story(ies) dropped: A' when 2 then '2 important story(ies) dropped: A, B' end], lambda x: x is not null), '; ') end as messages from l
union all
select 'golden', doc_id, array_to_string(list_filter(case when quiet then [
    case when m4 >= 2 then 'quiet day expected but the digest is not marked quiet' end,
    case when m4 % 2 = 1 then 'quiet-day honesty gate failed (n)' end]
  else [case when m4 < 2 then 'busy day expected but the digest is marked quiet' end,
    case when missed > 0 then 'busy day expected a BREAKTHROUGH but none surfaced' end,
    case when cov * 4 < 3.0 then 'editorial total ' || cast((cov * 4)::double as varchar) || ' < floor 3.0' end] end, lambda x: x is not null), '; ')
from l""")
def agg_22(spark, d):
    n = F.col("doc_id")
    rows = fx.table(spark, d, "labels").select(
        "doc_id", (F.col("toxic") == 1).alias("quiet"),
        F.round(F.col("quality") * 0.6 + (n % 5) / 10.0, 3).alias("cov"), (n % 3).alias("missed"), (n % 4).alias("m4"))
    titles = F.slice(F.array(F.lit("A"), F.lit("B")), F.lit(1), F.col("missed").cast("int"))
    recall = ev.recall_gate("cov", F.lit(10), titles, "quiet")
    golden = ev.golden_gate("quiet", F.col("m4") < 2, F.col("m4") % 2 == 0, F.lit("n"), F.col("missed") == 0,
                            F.col("cov") * 4, 3.0)
    return rows.select(F.lit("recall").alias("gate"), "doc_id", F.array_join(recall, "; ").alias("messages")).union(
        rows.select(F.lit("golden"), "doc_id", F.array_join(golden, "; ")))


@query("AGG-23", f"""
select doc_id, case when not quiet_ok and t > 2.0 then 2.0 else t end::double as total, quiet_ok,
  note || case when not quiet_ok and t > 2.0 then '; total capped at 2.0 per quiet-day honesty gate' else '' end as notes
from (select *, {RUBRIC_SQL} as t from ({GATE_SQL}))""")
def agg_23(spark, d):
    out = ev.grade(gated(spark, d), S.weighted_total(rubric_scores()))
    return out.select("doc_id", "total", "quiet_ok", "notes")


@query("AGG-24", """
with s as (select conv_id, turn as idx, length(text) % 7 as insight, length(text) % 5 as accuracy from conversations),
b as (select conv_id, arg_max(idx, (insight + accuracy, -idx)) as w, max(idx) as last from s group by 1),
g as (select conv_id, case when conv_id % 3 = 0 and conv_id % 4 between 0 and last then conv_id % 4 else w end as winner from b)
select g.conv_id, g.winner, s.insight::bigint as insight, s.accuracy::bigint as accuracy from g join s on s.conv_id = g.conv_id and s.idx = g.winner""")
def agg_24(spark, d):
    rows = fx.table(spark, d, "conversations").select(
        "conv_id", F.col("turn").alias("idx"), (F.length("text") % 7).cast("bigint").alias("insight"),
        (F.length("text") % 5).cast("bigint").alias("accuracy"))
    named = F.when(F.col("conv_id") % 3 == 0, F.col("conv_id") % 4)  # the judge named one, or nobody
    given = rows.select("conv_id", named.alias("winner")).distinct()
    return ev.pick_winner(rows, ["conv_id"], ["insight", "accuracy"], given)


@query("AGG-25", with_views("""
with a as (select count(*) as n from items),
b as (select count(*) as n from items where published_at >= timestamp '2024-01-31 00:00:00'
  - case when family = 'academia' then interval '96' hour else interval '36' hour end),
c as (select count(*) as n from items where published_at >= timestamp '2024-01-31 00:00:00'
  - case when family = 'academia' then interval '96' hour else interval '36' hour end and source <> 'smol.ai'
  and not coalesce(regexp_matches(url, '(?i)latent\\.space/p/ainews-'), false))
select 0 as ord, 'loaded' as stage, n as rows_in, n as kept, 0::bigint as dropped from a
union all select 1, 'window', a.n, b.n, a.n - b.n from a, b
union all select 2, 'aggregators', b.n, c.n, b.n - c.n from b, c""", "items"))
def agg_25(spark, d):
    audit = ev.RunAudit()
    rows = audit.watch(fx.items(spark, d).select("id", "family", "source", "url", "published_at"), "loaded")
    rows = audit.watch(fl.in_window(rows, fx.AS_OF), "window")
    rows = audit.watch(fl.drop_aggregators(rows), "aggregators")
    rows.write.format("noop").mode("overwrite").save()
    return audit.table(spark)


