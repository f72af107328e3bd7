"""Row filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyrank import constants as K
from storyrank import fixtures as fx
from storyrank.catalog.q_sources import _HITS
from storyrank.catalog.registry import query, with_views
from storyrank.functions import signals as S
from storyrank.functions import text as X
from storyrank.operators import filters as fl
from storyrank.sources import landing

# Oracle patterns: the same fixed values, quoted for SQL.
REL = K.RELEASE_TITLE.replace("'", "''")
DEAL = K.DEAL_TITLE.replace("'", "''")
RECAP = K.RECAP_TITLE.replace("'", "''")
ANEC = K.ANECDOTE_TITLE.replace("'", "''")
RELEASE_SQL = f"(regexp_matches(title, '{REL}') or regexp_matches(title, '{DEAL}'))"
PROMO_SQL = """(mention_count <= 1 and (starts_with(lower(trim(title)), 'show hn:') or starts_with(lower(trim(title)), 'tell hn:')
   or starts_with(lower(trim(title)), 'ask hn:') or contains(lower(title), '[p]')))"""
ANEC_SQL = f"(mention_count <= 1 and regexp_matches(title, '{ANEC}'))"
RECAP_SQL = f"regexp_matches(title, '{RECAP}')"
KEYWORDS_SQL = "[" + ", ".join("'" + k + "'" for k in K.RELEVANCE_KEYWORDS) + "]"


@query("FLT-01", with_views("""
select id, family, published_at from items
where published_at >= timestamp '2024-01-31 00:00:00'
  - case when family = 'academia' then interval '96' hour else interval '36' hour end""", "items"))
def flt_01(spark, d):
    return fl.in_window(fx.items(spark, d), fx.AS_OF).select("id", "family", "published_at")


@query("FLT-02", """
select event_id, coalesce(case when event_type <> 'error' then ts end >= timestamp '2024-01-15 00:00:00', false) as ok
from events""")
def flt_02(spark, d):
    ev = fx.table(spark, d, "events")
    known = F.when(F.col("event_type") != "error", F.col("ts"))
    return ev.select("event_id", fl.after(known, "2024-01-15 00:00:00").alias("ok"))


@query("FLT-03", """
select o_orderkey, coalesce(dt, timestamp '1997-01-01 00:00:00') as dt from (
  select o_orderkey, case when o_orderstatus <> 'P' then o_orderdate end as dt from orders)
where coalesce(dt, timestamp '1997-01-01 00:00:00') >= timestamp '1997-01-01 00:00:00'""")
def flt_03(spark, d):
    rows = fx.table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("dt"))
    return landing.recent_entries(rows, "1997-01-01 00:00:00")


_AGG_URLS = """select page_id,
  case page_id % 5 when 0 then 'smol.ai' when 1 then 'rss:smol.ai' else 'hn' end as source,
  case page_id % 3 when 0 then 'https://www.Latent.Space/p/AINews-x' when 1 then url end as url from pages"""


@query("FLT-04", f"""
select page_id, source, url from ({_AGG_URLS})
where not (source = 'smol.ai' or coalesce(regexp_matches(url, '(?i)latent\\.space/p/ainews-'), false))""")
def flt_04(spark, d):
    n = F.col("page_id")
    rows = fx.table(spark, d, "pages").select(
        "page_id",
        F.when(n % 5 == 0, "smol.ai").when(n % 5 == 1, "rss:smol.ai").otherwise("hn").alias("source"),
        F.when(n % 3 == 0, "https://www.Latent.Space/p/AINews-x").when(n % 3 == 1, F.col("url")).alias("url"))
    return fl.drop_aggregators(rows)


@query("FLT-05", with_views(f"select doc_id, {RELEASE_SQL} as hit from titled", "titled"))
def flt_05(spark, d):
    return fx.titled(spark, d).select("doc_id", X.is_release_title("title").alias("hit"))


@query("FLT-06", with_views(f"select doc_id, {PROMO_SQL} as hit from titled", "titled"))
def flt_06(spark, d):
    return fx.titled(spark, d).select("doc_id", fl.is_self_promo("title", "mention_count").alias("hit"))


@query("FLT-07", with_views(f"select doc_id, {ANEC_SQL} as hit from titled", "titled"))
def flt_07(spark, d):
    return fx.titled(spark, d).select("doc_id", fl.is_low_signal("title", "mention_count").alias("hit"))


@query("FLT-08", with_views(f"select doc_id, {RECAP_SQL} as hit from titled", "titled"))
def flt_08(spark, d):
    return fx.titled(spark, d).select("doc_id", fl.is_recap("title").alias("hit"))


@query("FLT-09", with_views(f"""
select doc_id, title from titled where not {PROMO_SQL} and not {ANEC_SQL} and not {RECAP_SQL}""", "titled"))
def flt_09(spark, d):
    return fl.curate_prefilter(fx.titled(spark, d)).select("doc_id", "title")


@query("FLT-10", f"""
select doc_id, len(list_filter({KEYWORDS_SQL}, lambda k: contains(lower(concat_ws(' ', source, text)), k))) > 0 as relevant
from documents""")
def flt_10(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", X.is_relevant("source", "text").alias("relevant"))


@query("FLT-11", f"""
with h as ({_HITS})
select 'hn' as kind, oid as id from h
where is_show or (points >= 20
  and len(list_filter({KEYWORDS_SQL}, lambda k: contains(lower(concat_ws(' ', coalesce(title, story_title), url)), k))) > 0)
union all
select 'forum', cast(event_id as varchar) from events
where event_type <> 'error' and coalesce(event_id % 17 <> 0, true) and floor(value) >= 5""")
def flt_11(spark, d):
    n = F.col("event_id")
    ev = fx.table(spark, d, "events")
    title = F.concat(F.when(n % 3 == 0, "AI agents, note ").otherwise("Ships sail, note "), n.cast("string"))
    tag = F.when(F.col("event_type") == "purchase", "show_hn").otherwise("story")
    hits = ev.select(
        n.cast("string").alias("objectID"),
        F.when(n % 5 != 0, title).alias("title"),
        F.when(n % 11 != 0, F.concat(F.lit("Story "), title)).alias("story_title"),
        F.when(n % 4 != 0, F.concat(F.lit("https://h.example.com/"), n.cast("string"))).alias("url"),
        F.floor("value").alias("points"), F.array(tag).alias("_tags"))
    posts = ev.select(
        n.cast("string").alias("id"), (F.col("event_type") == "error").alias("stickied"),
        (n % 17 == 0).alias("hidden"), F.floor("value").alias("score"))
    return (landing.admit_hn(hits).select(F.lit("hn").alias("kind"), F.col("objectID").alias("id"))
            .union(landing.admit_reddit(posts).select(F.lit("forum"), "id")))


@query("FLT-12", with_views("""
select doc_id, contains(lower(title), 'hn: the') or contains(lower(title), 'recap') as muted from titled""", "titled"))
def flt_12(spark, d):
    return fx.titled(spark, d).select("doc_id", S.is_muted("title", ["HN: The", "Recap"]).alias("muted"))


@query("FLT-13", """
with m as (select concat('story-', cast(doc_id % 300 as varchar)) as story_id, text from documents),
l as (select story_id, sum(length(trim(text, chr(32)||chr(9)||chr(10)||chr(13)))) as n from m group by 1),
s as (select distinct story_id from m union all select 'story-none')
select s.story_id, cast(coalesce(l.n, 0) as bigint) as source_len, coalesce(l.n, 0) < 200 as is_thin
from s left join l using (story_id)""")
def flt_13(spark, d):
    members = fx.table(spark, d, "documents").select(
        F.concat(F.lit("story-"), (F.col("doc_id") % 300).cast("string")).alias("story_id"),
        F.col("text").alias("raw_text"))
    stories = members.select("story_id").distinct().union(
        spark.createDataFrame([("story-none",)], "story_id string"))
    return fl.with_thin_flag(stories, members)


@query("FLT-14", with_views("""
select doc_id, tier = 'breakthrough' or (tier = 'notable' and family <> 'academia') as lead
from (select doc_id, family, case doc_id % 3 when 0 then 'breakthrough' when 1 then 'notable' else 'minor' end as tier
      from titled)""", "titled"))
def flt_14(spark, d):
    n = F.col("doc_id") % 3
    tier = F.when(n == 0, "breakthrough").when(n == 1, "notable").otherwise("minor")
    return fx.titled(spark, d).select("doc_id", S.is_lead(tier, "family").alias("lead"))


@query("FLT-15", with_views("""
select doc_id from (select doc_id, family, [lang, source] as tags
                    from documents join (select doc_id, family from titled) using (doc_id))
where family in ('academia', 'meta') and list_has_any(tags, ['fr', 'web'])""", "titled"))
def flt_15(spark, d):
    docs = fx.table(spark, d, "documents").select(
        "doc_id", fx.family_of(F.col("doc_id") % 4).alias("family"), F.array("lang", "source").alias("tags"))
    return fl.facet_filter(docs, ["academia", "meta"], ["fr", "web"]).select("doc_id")


_KNOWN = ["SMALL", "no such tag", "ECONOMY", "Brand#7", "STANDARD"]


@query("FLT-16", """
select pos, tag from (values (0, 'SMALL'), (1, 'no such tag'), (2, 'ECONOMY'), (3, 'Brand#7'), (4, 'STANDARD')) k(pos, tag)
where tag in (select p_type from part union select p_brand from part)""")
def flt_16(spark, d):
    rows = fx.table(spark, d, "part").select(F.array("p_type", "p_brand").alias("tags"))
    return fl.available_tags(rows, _KNOWN)


@query("FLT-17", """
select page_id, title, case when page_id % 3 <> 0 and url is not null then url end as url,
  case page_id % 5 when 0 then 'academia' else 'meta' end as family
from (select page_id, 'T ' || cast(page_id as varchar) as title, url from pages) where page_id % 4 <> 0""")
def flt_17(spark, d):
    n = F.col("page_id")
    pages = fx.table(spark, d, "pages")
    entries = pages.select(
        "page_id",
        F.when(n % 4 == 0, "  ").otherwise(F.concat(F.lit(" T "), n.cast("string"))).alias("title"),
        F.when(n % 3 == 0, F.concat(F.lit("https://made.up/"), n.cast("string"))).otherwise(
            F.concat(F.lit(" "), "url")).alias("url"),
        F.when(n % 5 == 0, "academia").otherwise("sports").alias("family"))
    return fl.ground_links(entries, pages.select("url"))


GATED_SQL = """select d.doc_id, l.quality, l.toxic, l.toxic = 1 as quiet_expected,
  case d.doc_id % 4 when 0 then 'Quiet day — nothing major shipped. ' when 1 then 'Quiet day with a stunning launch. '
    when 2 then 'Busy. ' else 'Unprecedented. ' end || d.text as md
from documents d join labels l using (doc_id)"""


def gated(spark, d):
    n = F.col("doc_id") % 4
    head = (F.when(n == 0, "Quiet day — nothing major shipped. ").when(n == 1, "Quiet day with a stunning launch. ")
            .when(n == 2, "Busy. ").otherwise("Unprecedented. "))
    docs = fx.table(spark, d, "documents").join(fx.table(spark, d, "labels"), "doc_id")
    return docs.select("doc_id", "quality", "toxic", (F.col("toxic") == 1).alias("quiet_expected"),
                       F.concat(head, "text").alias("md"))


def _any_sql(words, col="lower(md)"):
    return "(" + " or ".join(f"contains({col}, '{w}')" for w in words) + ")"


SAID_SQL, HYPE_SQL = _any_sql(K.QUIET_MARKERS), _any_sql(K.INFLATION_MARKERS)
GATE_SQL = f"""select *, not quiet_expected or ({SAID_SQL} and not {HYPE_SQL}) as quiet_ok,
  case when not quiet_expected then 'non-quiet day: honesty gate not applicable'
    when {SAID_SQL} and not {HYPE_SQL} then 'quiet day acknowledged honestly'
    when not {SAID_SQL} then 'quiet day not acknowledged (no honest ''quiet day'' signal)'
    else 'quiet day inflated with manufactured-importance language' end as note
from ({GATED_SQL})"""


@query("FLT-18", f"select doc_id, quiet_ok, note from ({GATE_SQL})")
def flt_18(spark, d):
    gate = gated(spark, d).select("doc_id", fl.quiet_gate("md", "quiet_expected").alias("g"))
    return gate.select("doc_id", "g.quiet_ok", "g.note")


@query("FLT-19", """
select event_id,
  case event_type when 'error' then 'signal' when 'purchase' then 'unknown field' when 'view' then null
    when 'click' then null else 'target_id' end as reason,
  case event_type when 'view' then 1.0::double when 'click' then value end as value
from events""")
def flt_19(spark, d):
    kind = F.col("event_type")
    key = F.get_json_object("props", "$.k")
    body = (
        F.when(kind == "error", F.concat(F.lit('{"target_id":"s'), key, F.lit('","target_kind":"story","signal":"meh"}')))
        .when(kind == "purchase", F.concat(F.lit('{"target_id":"s'), key,
                                           F.lit('","target_kind":"story","signal":"up","extra":1}')))
        .when(kind == "view", F.concat(F.lit('{"target_id":"s'), key, F.lit('","target_kind":"item","signal":"dwell"}')))
        .when(kind == "click", F.concat(F.lit('{"target_id":"s'), key,
                                        F.lit('","target_kind":"story","signal":"click","value":'),
                                        F.col("value").cast("string"), F.lit("}")))
        .otherwise(F.lit('{"target_id":"","target_kind":"story","signal":"up"}'))
    )
    raw = fx.table(spark, d, "events").select("event_id", body.alias("value"))
    good, bad = fl.validate_feedback(raw)
    return good.select("event_id", F.lit(None).cast("string").alias("reason"), "value").union(
        bad.select("event_id", "reason", F.lit(None).cast("double")))


@query("FLT-20", """
select vec_id as id, label / 10.0::double as final_rank, true as no_vector from embeddings""")
def flt_20(spark, d):
    stories = fx.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), (F.col("label") / 10.0).alias("final_rank"), "embedding")
    return fl.story_listing(stories).select("id", "final_rank", F.col("embedding").isNull().alias("no_vector"))
