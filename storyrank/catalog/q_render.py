"""Reports, notes, prompts and responses as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyrank import fixtures as fx
from storyrank.catalog.q_text import sq_sents, sq_slug, sq_strip
from storyrank.catalog.q_windows import ROWS_SQL, daily_digests
from storyrank.catalog.registry import query, with_views
from storyrank.functions import text as X
from storyrank.operators import feedback as fb
from storyrank.operators import filters as fl
from storyrank.operators import tables as tb
from storyrank.operators.grouping import exact_rank
from storyrank.plans import prompts as pr
from storyrank.plans import render as rn
from storyrank.session import scratch


def written_digests(spark, d):
    """Daily digests whose top stories carry text, tags and links."""
    def dress(m):
        lead = (m["tier"] == "breakthrough") | (m["tier"] == "notable")
        return F.struct(
            m["story_id"].alias("story_id"), m["title"].alias("title"), m["family"].alias("family"), m["tier"].alias("tier"),
            F.when(lead, F.concat(F.lit("Take "), m["story_id"])).otherwise("").alias("takeaway"),
            F.when(m["tier"] == "breakthrough", "Why.").otherwise("").alias("why_it_matters"),
            F.array(F.concat(F.lit("https://arxiv.org/abs/"), m["story_id"]), F.lit("https://www.x.example.com/p")).alias("links"),
            F.when(lead, F.array(F.lit("Tag B"), F.lit("Tag A"))).otherwise(F.array().cast("array<string>")).alias("tags"),
            m["score"].alias("score"))

    sections = F.transform("sections", lambda s: F.struct(
        s["family"].alias("family"), s["heading"].alias("heading"),
        F.when(s["heading"] == "Academia", " Trend. ").otherwise("").alias("intro"),
        F.transform(s["summaries"], dress).alias("summaries")))
    return daily_digests(spark, d).withColumn("sections", sections)


_DRESS_SQL = f"""
{ROWS_SQL.strip()},
x as (select r.*, {sq_strip('r.title')} as ttl, r.tier in ('breakthrough', 'notable') as lead, t.day_tier,
  case tier when 'breakthrough' then 'BREAKTHROUGH' when 'notable' then 'NOTABLE' when 'minor' then 'MINOR' else 'QUIET' end as label,
  case section when 0 then '⚡ Top Stories' when 1 then '🎓 Academia' when 2 then '🏭 Industry' when 3 then '💬 Community' else '🗞️ Meta' end as heading,
  '[arXiv](https://arxiv.org/abs/' || id || ') · [x.example.com](https://www.x.example.com/p)' as links
  from report r join tops t using (day))"""
_DAY_LABEL = "case day_tier when 'breakthrough' then 'BREAKTHROUGH' when 'notable' then 'NOTABLE' else 'QUIET' end"
_TLDR = "case day_tier when 'quiet_day' then 'Quiet day — nothing major shipped, but a few things worth a glance.' else 'Today in AI.' end"
_NL, _NN = "chr(10)", "chr(10) || chr(10)"


@query("RND-01", with_views(f"""
with {_DRESS_SQL.strip()},
m as (select *, case when lead then '**' || ttl || '** · `' || label || '`' || {_NN} || 'Take ' || id
    || case when tier = 'breakthrough' then {_NN} || '*Why it matters:* Why.' else '' end
    || {_NN} || 'Tags: `Tag B`, `Tag A`' || {_NN} || links
  else '- **' || ttl || '** — ' || links end as md from x),
s as (select day, section, day_tier, count(*) as n, '## ' || heading || case when section = 1 then {_NN} || 'Trend.' else '' end
   || coalesce({_NN} || string_agg(case when lead then md end, {_NN} order by pos), '')
   || coalesce({_NN} || string_agg(case when not lead then md end, {_NL} order by pos), '') as md from m group by day, section, day_tier, heading)
select 'daily-' || cast(day as varchar) as id, md5('# Daily — ' || cast(day as varchar) || {_NN} || '`' || {_DAY_LABEL} || '` · '
   || cast(sum(n) as bigint)::varchar || ' stories' || {_NN} || '> ' || {_TLDR} || {_NN} || string_agg(md, {_NN} order by section) || {_NL}) as md_md5
from s group by day, day_tier""", "doc_stories"))
def rnd_01(spark, d):
    return rn.render_daily(written_digests(spark, d)).select("id", F.md5("md").alias("md_md5"))


def weekly_digests(spark, d):
    """One weekly issue per hundred documents."""
    n = F.col("doc_id")
    entry = F.struct(
        F.concat(F.lit(" E"), n.cast("string")).alias("title"),
        F.when(n % 2 == 0, F.concat(F.lit("https://e.example.com/"), n.cast("string"))).alias("url"),
        F.concat(F.lit("line "), n.cast("string")).alias("one_liner"), F.lit("meta").alias("family"))
    some = F.filter(F.array_sort(F.collect_list(F.struct(n.alias("n"), entry.alias("e")))), lambda x: x["n"] % 100 < 3)
    weeks = fx.table(spark, d, "documents").groupBy(F.floor(n / 100).alias("w")).agg(
        F.transform(some, lambda x: x["e"]).alias("shortlist"), F.count("*").alias("c"))
    w = F.col("w")
    monday = F.date_add(F.lit("2024-01-01").cast("date"), (w * 7).cast("int"))
    return weeks.select(
        X.weekly_id(monday).alias("id"), monday.cast("string").alias("week_of"),
        F.concat(F.lit("Week "), w.cast("string"), F.lit(" ")).alias("title"),
        F.when(w % 2 == 0, " Lede. ").otherwise("").alias("lede"),
        F.concat(F.lit("Body of "), F.col("c").cast("string")).alias("body_markdown"),
        F.when(w % 3 == 0, "quiet_day").otherwise("notable").alias("overall_tier"),
        (w % 3 == 0).alias("quiet_week"), "shortlist",
        F.when(w % 2 == 1, F.col("shortlist")).otherwise(F.slice("shortlist", 1, 0)).alias("on_my_radar"))


_WEEKLY_SQL = f"""
e as (select doc_id // 100 as w, count(*) as c, string_agg(case when doc_id % 100 < 3 then '- ' || case when doc_id % 2 = 0
    then '[E' || cast(doc_id as varchar) || '](https://e.example.com/' || cast(doc_id as varchar) || ')' else 'E' || cast(doc_id as varchar) end
    || ' — line ' || cast(doc_id as varchar) end, {_NL} order by doc_id) as lines from documents group by 1),
wk as (select *, cast(date '2024-01-01' + cast(w * 7 as integer) as date) as monday from e)"""
_WEEK_ID = "'weekly-' || cast(isoyear(monday) as varchar) || '-W' || lpad(cast(weekofyear(monday) as varchar), 2, '0')"


@query("RND-02", f"""
with {_WEEKLY_SQL.strip()}
select {_WEEK_ID} as id, md5('# Week ' || cast(w as varchar) || {_NN} || '`' || case when w % 3 = 0 then 'QUIET' else 'NOTABLE' end || '` · Week of ' || cast(monday as varchar)
  || case when w % 2 = 0 then {_NN} || '_Lede._' else '' end
  || case when w % 3 = 0 then {_NN} || '_Quiet week — little of consequence shipped._' else '' end
  || {_NN} || 'Body of ' || cast(c as varchar) || {_NN} || '## What I''d actually read this week' || {_NL} || lines
  || case when w % 2 = 1 then {_NN} || '## On my radar' || {_NL} || lines else '' end || {_NL}) as md_md5 from wk""")
def rnd_02(spark, d):
    return rn.render_weekly(weekly_digests(spark, d)).select("id", F.md5("md").alias("md_md5"))


def all_notes(spark, d):
    return rn.daily_notes(written_digests(spark, d)).unionByName(rn.weekly_notes(weekly_digests(spark, d)))


_NOTES_SQL = f"""
{_DRESS_SQL.strip()},
{_WEEKLY_SQL.strip()},
st as (select day, section, pos, 'stories/' || {sq_slug('title')} || '.md' as path,
   '---' || {_NL} || 'title: ' || ttl || {_NL} || 'type: story' || {_NL} || 'family: ' || family || {_NL} || 'tier: ' || tier || {_NL} || 'tags:'
   || {_NL} || '  - digest' || {_NL} || '  - ' || replace(tags, ',', {_NL} || '  - ') || {_NL} || '---' || {_NN} || '# ' || ttl || {_NL}
   || case when lead then {_NL} || 'Take ' || id else '' end
   || case when tier = 'breakthrough' then {_NN} || '**Why it matters:** Why.' else '' end
   || {_NN} || '## Sources' || {_NL} || '- https://arxiv.org/abs/' || id || {_NL} || '- https://www.x.example.com/p'
   || {_NN} || '#' || replace(tags, ',', ' #') || {_NN} || 'From [[daily/' || cast(day as varchar) || '|Daily ' || cast(day as varchar) || ']]' || {_NL} as content
  from (select *, case when lead then array_to_string(list_sort([family, 'tag-a', 'tag-b']), ',') else family end as tags from x)),
li as (select day, section, day_tier, '## ' || case section when 0 then '⚡ Top Stories' else regexp_replace(heading, '^[^ ]+ ', '') end || {_NL}
   || string_agg('- [[stories/' || {sq_slug('title')} || '|' || ttl || ']] · `' || tier || '`' || case when lead then {_NL} || '  - Take ' || id else '' end,
      {_NL} order by pos) || {_NL} as block, count(*) as n, bool_or(lead) as any_lead from x group by day, section, day_tier, heading),
dn as (select 'daily/' || cast(day as varchar) || '.md' as path,
   '---' || {_NL} || 'title: Daily — ' || cast(day as varchar) || {_NL} || 'type: daily' || {_NL} || 'date: ' || cast(day as varchar) || {_NL}
   || 'tier: ' || day_tier || {_NL} || 'quiet: ' || case when day_tier = 'quiet_day' then 'true' else 'false' end || {_NL} || 'tags:' || {_NL}
   || '  - digest' || {_NL} || '  - daily' || case when bool_or(any_lead) then {_NL} || '  - tag-a' || {_NL} || '  - tag-b' else '' end || {_NL} || '---'
   || {_NN} || '# Daily — ' || cast(day as varchar) || {_NN} || '`' || day_tier || '` · ' || cast(cast(sum(n) as bigint) as varchar) || ' stories' || {_NN}
   || '> ' || {_TLDR} || {_NN} || regexp_replace(string_agg(block, {_NL} order by section), '\\n$', '') || {_NL} as content
  from li group by day, day_tier),
wn as (select 'weekly/' || {_WEEK_ID} || '.md' as path,
   '---' || {_NL} || 'title: Week ' || cast(w as varchar) || {_NL} || 'type: weekly' || {_NL} || 'week_of: ' || cast(monday as varchar) || {_NL}
   || 'tier: ' || case when w % 3 = 0 then 'quiet_day' else 'notable' end || {_NL} || 'quiet: ' || case when w % 3 = 0 then 'true' else 'false' end || {_NL}
   || 'tags:' || {_NL} || '  - digest' || {_NL} || '  - weekly' || {_NL} || '---' || {_NN} || '# Week ' || cast(w as varchar) || {_NN}
   || case when w % 2 = 0 then '*Lede.*' || {_NN} else '' end
   || '`' || case when w % 3 = 0 then 'quiet_day' else 'notable' end || '` · Week of ' || cast(monday as varchar) || {_NN}
   || case when w % 3 = 0 then '_Quiet week — little of consequence shipped._' || {_NN} else '' end
   || 'Body of ' || cast(c as varchar) || {_NN} || '## What I''d actually read this week' || {_NL} || lines || {_NN}
   || case when w % 2 = 1 then '## On my radar' || {_NL} || lines || {_NN} else '' end
   || '## This week''s editions' || {_NL}
   || array_to_string(list_transform(range(0, 7), lambda i: '- [[daily/' || cast(monday + cast(i as integer) as varchar) || '|Daily ' || cast(monday + cast(i as integer) as varchar) || ']]'), {_NL})
   || {_NL} as content from wk)"""


@query("RND-03", with_views(f"""
with {_NOTES_SQL.strip()}
select path, md5(content) as content_md5 from st union all select path, md5(content) from dn union all select path, md5(content) from wn""", "doc_stories"))
def rnd_03(spark, d):
    return all_notes(spark, d).select("path", F.md5("content").alias("content_md5"))


@query("SNK-11", with_views(f"""
with {_NOTES_SQL.strip()}
select path, md5(arg_max(content, (day, section, pos))) as content_md5 from st group by 1
union all select path, md5(content) from dn union all select path, md5(content) from wn""", "doc_stories"))
def snk_11(spark, d):
    """All notes written as files and read back."""
    return tb.export_notes(all_notes(spark, d), scratch(spark, "notes")).select(
        "path", F.md5("content").alias("content_md5"))


@query("SRT-03", with_views(f"""
with {_DRESS_SQL.strip()},
s as (select day, section, day_tier, {_NL} || heading || coalesce({_NL} || string_agg(case when lead then '• [' || label || '] ' || ttl end, {_NL} order by pos), '')
   || coalesce({_NL} || string_agg(case when not lead and b <= 3 then '• ' || ttl end, {_NL} order by pos), '') as body
  from (select *, row_number() over (partition by day, section, lead order by pos) as b from x) group by day, section, day_tier, heading),
f as (select 'daily-' || cast(day as varchar) as id, '🗞️ Digest — ' || cast(day as varchar) || '  ·  ' || {_DAY_LABEL} || {_NN} || {_TLDR} || {_NL}
   || string_agg(body, {_NL} order by section) || {_NN} || 'Full takeaways → your email / the web dashboard.' as t from s group by day, day_tier)
select id, md5(case when length(t) > 700 then regexp_replace(left(t, 699), '\\s+$', '') || '…' else t end) as body_md5 from f""", "doc_stories"))
def srt_03(spark, d):
    return rn.condensed(written_digests(spark, d), limit=700).select("id", F.md5("body").alias("body_md5"))


_SUBFIELDS = ["Optimization", "Small and Large"]


@query("RND-04", with_views("""
with t as (select *, length(trim(raw_text, chr(32)||chr(9)||chr(10)||chr(13))) < 200 as thin from doc_stories),
g as (select *, case doc_id % 4 when 0 then 'quiet_day' when 1 then 'minor' when 2 then 'notable' else 'breakthrough' end as tier from t)
select id as story_id, tier, case when tier <> 'quiet_day' then case when thin then 'minor' else tier end end as gen_tier,
  case when tier = 'quiet_day' then 'Minor item; nothing major here.' end as takeaway,
  case when tier <> 'quiet_day' then md5('Write the note for one story.' || chr(10) || 'Title: ' || title || chr(10) || 'Family: ' || family || chr(10)
    || 'Tier: ' || case when thin then 'minor' else tier end || chr(10) || 'Mentions: ' || cast(mention_count as varchar) || chr(10)
    || 'Reader follows: Optimization; Small and Large' || chr(10) || chr(10) || 'Sources:' || chr(10) || 'B ' || cast(doc_id as varchar) || chr(10) || chr(10)
    || 'Depth: ' || case case when thin then 'minor' else tier end when 'breakthrough' then 'several sentences: what it is, how it works, the background and the open question.'
        when 'notable' then 'two to four sentences: the result, the change against earlier work, the reason it matters.'
        else 'exactly one line: name it and say what it is.' end || chr(10)
    || 'Answer with JSON: {"takeaway": "...", "why_it_matters": "...", "tags": ["..."]}') end as prompt_md5
from g""", "doc_stories"))
def rnd_04(spark, d):
    n = F.col("doc_id") % 4
    tier = (F.when(n == 0, "quiet_day").when(n == 1, "minor").when(n == 2, "notable").otherwise("breakthrough"))
    stories = fx.doc_stories(spark, d).withColumn("tier", tier)
    thin = fl.with_thin_flag(stories, stories, "id")
    blocks = stories.select(F.col("id").alias("story_id"), F.concat(F.lit("B "), F.col("doc_id").cast("string")).alias("block"))
    return pr.prompt_rows(thin.drop("raw_text"), blocks, _SUBFIELDS).select(
        "story_id", "tier", "gen_tier", "takeaway", F.md5("prompt").alias("prompt_md5"))


@query("RND-05", with_views(f"""
with s as (select doc_id, replace(ground, ',', '') as g, {sq_sents('text')} as sents from grounding_pairs),
k as (select doc_id, array_to_string(list_filter(sents, lambda x: len(list_filter(
   list_transform(regexp_extract_all(x, '\\$?\\d[\\d,]*(?:\\.\\d+)?(?:%|M)'), lambda t: regexp_extract(t, '\\d[\\d,]*(?:\\.\\d+)?')), lambda n: not contains(g, n))) = 0), ' ') as t from s)
select doc_id::varchar as story_id, case when doc_id % 5 = 4 then 'Title ' || cast(doc_id as varchar) when t = '' then 'Title ' || cast(doc_id as varchar) else t end as takeaway,
  case when doc_id % 5 = 4 then '' else t end as why_it_matters, case when doc_id % 5 = 4 then '' else 'Small and Large|other|x' end as tags from k""", "grounding_pairs"))
def rnd_05(spark, d):
    n = F.col("doc_id")
    answer = F.to_json(F.struct(
        F.col("text").alias("takeaway"), F.col("text").alias("why_it_matters"),
        F.array(F.lit(" small & LARGE"), F.lit(""), F.lit("other"), F.lit("x"), F.lit("y")).alias("tags")))
    raw = F.when(n % 5 == 4, F.lit("no json here")).when(n % 5 == 3, F.concat(F.lit("```json\n"), answer, F.lit("\n```"))).otherwise(answer)
    rows = fx.grounding_pairs(spark, d).select(
        n.cast("string").alias("story_id"), F.concat(F.lit("Title "), n.cast("string")).alias("title"),
        F.when(n % 3 == 0, "minor").when(n % 3 == 1, "notable").otherwise("breakthrough").alias("gen_tier"),
        raw.alias("response"), "ground")
    return pr.response_rows(rows, _SUBFIELDS).withColumn("tags", F.array_join("tags", "|"))


@query("RND-06", """
with s as (select user_id as batch, event_id, row_number() over (partition by user_id order by event_id) - 1 as pos,
   count(*) over (partition by user_id) as n, 'community' as family from events),
f as (select user_id as batch, min(json_extract_string(props, '$.k')::bigint) as k from events group by 1),
p as (select f.batch, k + 1 as num, 0 as ord, 'industry' as fam from f where batch % 4 = 0
  union all select batch, 2, 1, null from f where batch % 4 = 0
  union all select batch, 2, 2, 'x' from f where batch % 4 = 0
  union all select batch, 3, 0, null from f where batch % 4 = 3
  union all select batch, 1, 1, 'zzz' from f where batch % 4 = 3),
o as (select batch, num - 1 as pos, min(ord) as ord, arg_min(coalesce(fam, '-'), ord) as fam from p group by 1, 2),
kept as (select s.batch, s.event_id, o.ord::bigint as ord, case when fam = 'industry' then 'industry' else family end as family from s join o using (batch, pos))
select * from kept
union all select batch, event_id, pos::bigint, family from s where batch not in (select batch from kept)""")
def rnd_06(spark, d):
    ev = fx.table(spark, d, "events")
    ranked = exact_rank(ev.select(F.col("user_id").alias("batch"), "event_id"), ["batch"], [F.asc("event_id")])
    stories = ranked.select("batch", (F.col("pos") - 1).alias("pos"), "event_id", F.lit("community").alias("family"))
    k = F.min(F.get_json_object("props", "$.k").cast("bigint")) + 1
    b = F.col("batch") % 4
    answers = ev.groupBy(F.col("user_id").alias("batch")).agg(k.alias("k")).select("batch", (
        F.when(b == 0, F.concat(F.lit('{"keep": [{"n": '), F.col("k").cast("string"),
                                F.lit(', "family": "industry"}, 2, {"n": 2, "family": "x"}, 99999999]}')))
        .when(b == 1, F.lit("junk")).when(b == 2, F.lit('{"keep": []}'))
        .otherwise(F.lit('so: {"keep": [3, {"n": "1", "family": "zzz"}, {"n": "one"}]} done'))).alias("response"))
    return pr.apply_keep(stories, answers).select("batch", "event_id", "ord", "family")


@query("RND-07", """
select p_partkey as "user", case p_partkey % 3 when 0 then least(1.0, p_size / 40.0) else 0.5 end::double as alpha,
  0.4::double as beta, case p_partkey % 3 when 0 then 0.0 else 0.1 end::double as gamma,
  case p_partkey % 3 when 0 then p_type || '|' || p_brand else p_type end as mutes,
  p_name as subfields from part""")
def rnd_07(spark, d):
    n = F.col("p_partkey")
    part = fx.table(spark, d, "part")
    profiles = part.select(
        n.alias("user"), F.lit(0.5).alias("alpha"), F.lit(0.4).alias("beta"), F.lit(0.1).alias("gamma"),
        F.array("p_type").alias("mutes"), F.array("p_name").alias("subfields"))
    answer = F.concat(
        F.lit('{"alpha": '), (F.col("p_size") / 40.0).cast("string"), F.lit(', "beta": "much", "gamma": -3, "add_mutes": ["'),
        F.lower("p_type"), F.lit('", " '), F.col("p_brand"), F.lit(' ", ""], "add_subfields": ["'), F.upper("p_name"), F.lit('"]}'))
    responses = part.select(
        n.alias("user"), F.when(n % 3 == 0, "more please").otherwise("  ").alias("instruction"), answer.alias("response"))
    out = fb.apply_steering(profiles, responses)
    return out.select("user", "alpha", "beta", "gamma", F.array_join("mutes", "|").alias("mutes"),
                      F.array_join("subfields", "|").alias("subfields"))


