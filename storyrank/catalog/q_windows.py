"""Caps, top lists, folding, weeks, throttling; sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyrank import fixtures as fx
from storyrank.catalog.q_aggregates import TAGGED_SQL
from storyrank.catalog.q_text import ANNOUNCE_SQL, sq_strip
from storyrank.catalog.registry import query, with_views
from storyrank.functions import text as X
from storyrank.operators import clustering as cl
from storyrank.operators import feedback as fb
from storyrank.operators import ranking as rk
from storyrank.operators.grouping import exact_rank
from storyrank.plans import assemble as asm
from storyrank.plans.render import note_tags
from storyrank.session import scratch
from storyrank.sources.landing import gather_sources


@query("WIN-01", with_views("""
select id, source, published_at from (
  select *, row_number() over (partition by source order by published_at desc, id) as r from items
  where source <> 'smol.ai' and not coalesce(regexp_matches(url, '(?i)latent\\.space/p/ainews-'), false))
where r <= 20""", "items"))
def win_01(spark, d):
    rows = fx.items(spark, d).select("id", "source", "url", "published_at")
    return asm.balanced_pool(rows).select("id", "source", "published_at")


DOC_TAGGED_SQL = TAGGED_SQL.replace("day_stories", "doc_stories").strip()
LEADS_SQL = f"""
{DOC_TAGGED_SQL},
leads as (select *, case when tier = 'breakthrough' then 1.0 else 0.0 end + {ANNOUNCE_SQL} as news from tagged
  where tier = 'breakthrough' or (tier = 'notable' and family <> 'academia')),
ranked as (select *, row_number() over (partition by day order by news desc, importance desc, id) as pos from leads)"""


def tagged(spark, d):
    return rk.classify_stories(fx.doc_stories(spark, d))


@query("WIN-02", with_views(f"with {LEADS_SQL.strip()} select day, id, pos from ranked", "doc_stories"))
def win_02(spark, d):
    leads = asm.leads_of(tagged(spark, d)).select("day", "id", "title", "tier", "importance")
    return exact_rank(leads, ["day"], rk.lead_order()).select("day", "id", "pos")


# One step per lead of a day, in rank order, carrying the places of the kept leads.
FOLD_SQL = f"""
{LEADS_SQL.strip()},
placed as (select k.day, k.id, k.pos, k.tier, v.embedding::double[] as e from ranked k left join embeddings v on v.vec_id = k.doc_id),
near as (select b.day, b.pos, list(a.pos) as earlier from placed a join placed b on a.day = b.day and a.pos < b.pos
  where list_cosine_similarity(a.e, b.e) >= 0.25 and not (a.tier = 'breakthrough' and b.tier = 'breakthrough') group by 1, 2),
steps as (select p.day, p.id, p.pos, coalesce(n.earlier, []) as earlier from placed p left join near n using (day, pos)),
folded(day, id, pos, kept, under) as (
  select day, id, pos, [pos], pos from steps where pos = 1
  union all
  select day, id, pos, case when first is null then list_append(kept, pos) else kept end, coalesce(first, pos)
  from (select s.day, s.id, s.pos, f.kept, list_min(list_intersect(f.kept, s.earlier)) as first
        from folded f join steps s on s.day = f.day and s.pos = f.pos + 1))"""


@query("WIN-03", with_views(f"""with {FOLD_SQL.strip()}
select f.day, f.id, l.id as lead_id from folded f join placed l on l.day = f.day and l.pos = f.under""", "doc_stories", recursive=True))
def win_03(spark, d):
    """Leads of each day folded at a threshold that fits the fixture vectors."""
    rows = tagged(spark, d)
    vec = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    leads = asm.leads_of(rows).join(vec, "doc_id", "left").withColumn("pos", asm.lead_key())
    return cl.fold_leads(leads, 0.25).select("day", "id", "lead_id")


TOPS_SQL = f"""
{LEADS_SQL.strip()},
firsts as (select day, id, title, family, tier, final_rank, pos from ranked where pos <= 6),
promo as (select day, id, title, family, 'notable' as tier, final_rank, 1 as pos from (
   select *, row_number() over (partition by day order by importance desc, {ANNOUNCE_SQL} desc, id) as r from tagged
   where day_tier <> 'quiet_day' and day not in (select day from leads)) where r = 1),
topset as (select * from firsts union all select * from promo)"""


@query("WIN-04", with_views(
    f"with {TOPS_SQL.strip()} select day, id, tier, pos from topset".replace("doc_stories", "day_t"), "day_stories",
    day_t="select *, id as title from day_stories"))
def win_04(spark, d):
    rows = rk.classify_stories(fx.day_stories(spark, d).withColumn("title", F.col("id")))
    return asm.top_stories(rows).select("day", "id", "tier", F.col("pos").cast("bigint").alias("pos"))


BRIEFS_SQL = f"""
{TOPS_SQL.strip()},
rest as (select * from tagged t where not exists (select 1 from topset k where k.day = t.day and k.id = t.id)),
brief as (select *, row_number() over (partition by day, family order by final_rank desc, id) as pos from rest)"""


def report_rows(spark, d):
    rows = tagged(spark, d)
    tops = asm.top_stories(rows)
    return rows, tops, asm.briefs(asm.non_leads(rows, tops))


@query("WIN-05", with_views(f"with {BRIEFS_SQL.strip()} select day, family, id, pos from brief where pos <= 6", "doc_stories"))
def win_05(spark, d):
    return report_rows(spark, d)[2].select("day", "family", "id", F.col("pos").cast("bigint").alias("pos"))


def talks(spark, d):
    """Conversations as stories and their turns as items."""
    rows = fx.table(spark, d, "conversations")
    sid = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    iid = F.concat(sid, F.lit("-"), F.col("turn").cast("string"))
    items = rows.select(
        iid.alias("id"), F.col("role").alias("source"), F.concat(F.lit("T"), F.col("turn").cast("string")).alias("title"),
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("https://t.example.com/"), iid)).alias("url"),
        F.col("text").alias("raw_text"))
    members = rows.select(sid.alias("story_id"), iid.alias("item_id"), F.col("turn").alias("pos"))
    stories = rows.groupBy("conv_id").agg(F.count("*").alias("mention_count"), F.max("turn").alias("last")).select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("id"),
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("last").cast("string")).alias("representative_item_id"),
        F.concat(F.lit("Talk "), F.col("conv_id").cast("string")).alias("title"), "mention_count",
        F.lit("community").alias("family"), F.lit("minor").alias("tier"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 21).cast("int")).alias("day"),
        (F.col("conv_id") * 7 % 100 / 100.0).alias("final_rank"))
    return stories, members, items


BLOCKS_SQL = f"""
t as (select conv_id, turn, role, replace({sq_strip('text')}, chr(10), ' ') as body, max(turn) over (partition by conv_id) as last from conversations),
o as (select *, row_number() over (partition by conv_id order by case when turn = last then -1 else turn end) as pos from t),
l as (select conv_id, pos, '- [' || role || '] T' || cast(turn as varchar) ||
    case when turn % 2 = 0 then ' (https://t.example.com/c' || cast(conv_id as varchar) || '-' || cast(turn as varchar) || ')' else '' end
    || case when body = '' then '' else chr(10) || '  ' || case when length(body) > 600 then regexp_replace(left(body, 600), '\\s+$', '') || '…' else body end end as line
  from o where pos <= 5),
blocks as (select 'c' || cast(conv_id as varchar) as story_id, string_agg(line, chr(10) order by pos) as block from l group by 1)"""


@query("WIN-06", f"with {BLOCKS_SQL.strip()} select story_id, md5(block) as block_md5 from blocks")
def win_06(spark, d):
    return asm.source_blocks(*talks(spark, d)).select("story_id", F.md5("block").alias("block_md5"))


ROWS_SQL = f"""
{BRIEFS_SQL.strip()},
report as (select day, 0 as section, pos, id, title, family, tier from topset
  union all select day, case family when 'academia' then 1 when 'industry' then 2 when 'community' then 3 else 4 end, pos, id, title, family, tier
  from brief where pos <= 6)"""


def daily_digests(spark, d):
    rows, tops, brief_rows = report_rows(spark, d)
    days = rk.day_summary(fx.doc_stories(spark, d))
    return asm.assemble_daily(asm.section_rows(tops, brief_rows), days)


@query("WIN-07", with_views(f"""
with {ROWS_SQL.strip()},
n as (select *, dense_rank() over (partition by day order by section) - 1 as sec from report)
select 'daily-' || cast(n.day as varchar) as id, t.day_tier as overall_tier, t.day_tier = 'quiet_day' as quiet_day,
  case when t.day_tier = 'quiet_day' then 'Quiet day — nothing major shipped, but a few things worth a glance.' else 'Today in AI.' end as tldr,
  sec::integer as sec, case section when 0 then '⚡ Top Stories' when 1 then 'Academia' when 2 then 'Industry' when 3 then 'Community' else 'Meta' end as heading,
  (pos - 1)::integer as no, n.id as story_id, tier from n join tops t using (day)""", "doc_stories"))
def win_07(spark, d):
    dig = daily_digests(spark, d)
    flat = dig.select("id", "overall_tier", "quiet_day", "tldr", F.posexplode("sections").alias("sec", "s"))
    return flat.select("id", "overall_tier", "quiet_day", "tldr", "sec", "s.heading",
                       F.posexplode("s.summaries").alias("no", "m")).select(
        "id", "overall_tier", "quiet_day", "tldr", "sec", "heading", "no", "m.story_id", "m.tier")


@query("WIN-08", with_views(f"""
with {ROWS_SQL.strip()},
x as (select *, row_number() over (partition by day, section > 0 order by section, pos) as r from report),
y as (select *, row_number() over (partition by day order by section, pos) as k from x where section = 0 or r <= 6)
select day, string_agg(title, '|' order by section, pos) as titles from y where k <= 8 group by 1""", "doc_stories"))
def win_08(spark, d):
    _, tops, brief_rows = report_rows(spark, d)
    out = asm.grounding_titles(asm.section_rows(tops, brief_rows))
    return out.select("day", F.array_join("titles", "|").alias("titles"))


_WEEK_SQL = """
w as (select 'u' || split_part(id, '-', 4) as id, day, final_rank, cast(date_trunc('week', day) as date) as week_of from day_stories)"""


@query("WIN-09", with_views(f"""
with {_WEEK_SQL.strip()}
select week_of, id, day, final_rank from (
  select *, row_number() over (partition by week_of, id order by day, final_rank desc) as r from w) where r = 1""", "day_stories"))
def win_09(spark, d):
    rows = fx.day_stories(spark, d).select(
        F.concat(F.lit("u"), F.element_at(F.split("id", "-"), -1)).alias("id"), "day", "final_rank")
    return asm.week_stories(rows).select("week_of", "id", "day", "final_rank")


@query("WIN-10", f"""
with {BLOCKS_SQL.strip()},
s as (select conv_id, 'c' || cast(conv_id as varchar) as story_id, count(*) as n, cast(date_trunc('week', date '2024-01-01' + cast(conv_id % 21 as integer)) as date) as week_of,
   (conv_id * 7 % 100) / 100.0 as fr from conversations group by conv_id),
r as (select *, row_number() over (partition by week_of order by fr desc, story_id) as pos from s)
select week_of, md5(string_agg('### [minor] Talk ' || cast(conv_id as varchar) || ' (family=community, mentions=' || cast(n as varchar) || ')' || chr(10) || block,
   chr(10) || chr(10) order by pos)) as blocks_md5
from r join blocks using (story_id) where pos <= 20 group by 1""")
def win_10(spark, d):
    stories, members, items = talks(spark, d)
    out = asm.weekly_blocks(asm.week_stories(stories), asm.source_blocks(stories, members, items))
    return out.select("week_of", F.md5("blocks").alias("blocks_md5"))


@query("WIN-11", with_views("""
select kind, id, date, created_at from (
  select *, row_number() over (partition by kind order by date desc, created_at desc, id desc) as r from digests) where r = 1""", "digests"))
def win_11(spark, d):
    return asm.latest_digest(fx.digests(spark, d)).select("kind", "id", "date", "created_at")


# One step per hit of a kind, in time order, carrying the admitted times still in the hour.
THROTTLE_SQL = """
with recursive h as (
  select event_type as who, event_id as id, ts, epoch_us(ts) as t,
    row_number() over (partition by event_type order by ts, event_id) as rn from events),
r(who, rn, id, ts, recent, admitted) as (
  select who, rn, id, ts, [t], true from h where rn = 1
  union all
  select who, rn, id, ts, case when len(kept) < 3 then list_append(kept, t) else kept end, len(kept) < 3
  from (select h.who, h.rn, h.id, h.ts, h.t, list_filter(r.recent, lambda x: h.t - x <= 3600000000) as kept
        from r join h on h.who = r.who and h.rn = r.rn + 1))"""


@query("WIN-12", THROTTLE_SQL + " select id, who, ts, admitted from r")
def win_12(spark, d):
    """Three admitted hits an hour per kind of event."""
    hits = fx.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("who"), "ts")
    return fb.throttle(hits, "who", n=3, secs=3600)


# --- sorts ------------------------------------------------------------------------
@query("SRT-01", with_views("select id, final_rank from day_stories", "day_stories"))
def srt_01(spark, d):
    return rk.order_stories(fx.day_stories(spark, d).select("id", "final_rank"))


@query("SRT-02", "select event_id, ts from events order by ts desc, event_id limit 150")
def srt_02(spark, d):
    """The newest rows; the cut is the feature."""
    return fx.table(spark, d, "events").select("event_id", "ts").orderBy(F.desc("ts"), "event_id").limit(150)


# --- set operations ---------------------------------------------------------------
@query("SET-01", """
select 'page-' || cast(page_id as varchar) as id, url, null as lang from pages
union all select 'doc-' || cast(doc_id as varchar), null, lang from documents""")
def set_01(spark, d):
    web = fx.table(spark, d, "pages").select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("id"), "url")
    plain = fx.table(spark, d, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), "lang")
    never = scratch(spark, "never-landed")
    rows, _ = gather_sources(spark, {"web": lambda: web, "failed": lambda: spark.read.parquet(never), "plain": lambda: plain})
    return rows


@query("SET-01-audit", """
select 'web' as source, true as read, null as reason, count(*) as rows from pages
union all select 'failed', false, 'PATH_NOT_FOUND', 0
union all select 'damaged', false, 'FAILED_READ_FILE', 0
union all select 'plain', true, null, count(*) from documents""")
def set_01_audit(spark, d):
    """A folder that never landed fails when planned, one whose files are no Parquet when read."""
    web, plain = fx.table(spark, d, "pages").select("url"), fx.table(spark, d, "documents").select("lang")
    never, damaged = scratch(spark, "never-landed"), scratch(spark, "damaged")
    fx.table(spark, d, "pages").select("url").write.text(damaged)
    _, audit = gather_sources(spark, {
        "web": lambda: web, "failed": lambda: spark.read.parquet(never),
        "damaged": lambda: spark.read.schema("url string").parquet(damaged), "plain": lambda: plain})
    return audit.withColumn("reason", F.substring_index("reason", ".", 1))


@query("SET-02", with_views(f"with {BRIEFS_SQL.strip()} select day, id from rest", "doc_stories"))
def set_02(spark, d):
    rows = tagged(spark, d)
    return asm.non_leads(rows, asm.top_stories(rows)).select("day", "id")


@query("SET-03", """
select vec_id, case label % 2 when 0 then 'a' || cast(vec_id as varchar) || '|b|c' else 'a' || cast(vec_id as varchar) || '|b' end as ids from embeddings""")
def set_03(spark, d):
    own = F.concat(F.lit("a"), F.col("vec_id").cast("string"))
    left = F.array(own, F.lit("b"))
    right = F.when(F.col("label") % 2 == 0, F.array(F.lit("b"), F.lit("c"), own)).otherwise(F.array(own, F.lit("b")))
    return fx.table(spark, d, "embeddings").select("vec_id", F.array_join(X.merge_ids(left, right), "|").alias("ids"))


@query("SET-04", """
select p_partkey, array_to_string(list_sort(list_distinct([lower(p_type), lower(replace(p_brand, '#', '-')), 'meta'])), '|') as tags from part""")
def set_04(spark, d):
    return fx.table(spark, d, "part").select(
        "p_partkey", F.array_join(note_tags(F.array("p_type", "p_brand", "p_type"), F.lit("meta")), "|").alias("tags"))
