"""Scans and landing sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyrank import fixtures as fx
from storyrank.catalog.registry import query, with_views
from storyrank.operators.nearest import similar_items
from storyrank.session import scratch
from storyrank.sources import landing, scans


@query("SRC-01", with_views("""
select id, source, family, title, published_at from items
where published_at >= timestamp '2024-01-28 00:00:00' and family = 'academia'""", "items"))
def src_01(spark, d):
    out = scans.items_since(fx.items(spark, d), "2024-01-28 00:00:00", "academia")
    return out.select("id", "source", "family", "title", "published_at")


@query("SRC-02", with_views("""
select id, source, family from items
where id in (select concat('item-', cast(doc_id as varchar)) from labels
             union all select concat('item-', cast(page_id as varchar)) from pages)""", "items"))
def src_02(spark, d):
    ids = fx.table(spark, d, "labels").select("doc_id").union(fx.table(spark, d, "pages").select("page_id"))
    ids = ids.select(F.concat(F.lit("item-"), F.col("doc_id").cast("string")).alias("id"))
    return scans.items_by_ids(fx.items(spark, d), ids).select("id", "source", "family")


@query("SRC-03", with_views("""
select id, published_at from items where embedding is null
order by published_at desc, id limit 500""", "items"))
def src_03(spark, d):
    return scans.items_without_embedding(fx.items(spark, d)).select("id", "published_at")


@query("SRC-04", with_views("""
select id, family, final_rank, created_at from day_stories
where cast(created_at - interval '8' hour as date) = date '2024-01-15'""", "day_stories"))
def src_04(spark, d):
    out = scans.stories_for_date(fx.day_stories(spark, d), "2024-01-15", fx.LOCAL_TZ)
    return out.select("id", "family", "final_rank", "created_at")


def _label_stories(spark, d):
    vec = fx.table(spark, d, "embeddings")
    sid = F.concat(F.lit("story-"), F.col("label").cast("string"))
    members = vec.select(sid.alias("story_id"),
                         F.concat(F.lit("item-"), F.col("vec_id").cast("string")).alias("item_id"))
    stories = members.groupBy("story_id").agg(F.count("*").alias("mention_count"))
    return stories, members


def region_stories(spark, d):
    """Ids of the stories numbered like a region."""
    return fx.table(spark, d, "region").select(
        F.concat(F.lit("story-"), F.col("r_regionkey").cast("string")).alias("id"))


@query("SRC-05", """
with m as (select concat('story-', cast(label as varchar)) as story_id,
                  concat('item-', cast(vec_id as varchar)) as item_id, label from embeddings)
select m.story_id, s.mention_count, m.item_id
from (select story_id, count(*) as mention_count from m group by 1) s join m using (story_id)
where m.label in (select r_regionkey from region)""")
def src_05(spark, d):
    stories, members = _label_stories(spark, d)
    return scans.stories_by_ids(stories, members, region_stories(spark, d))


@query("SRC-06", with_views("""
select id, kind, case when kind = 'weekly' then json_extract_string(content, '$.title') end as weekly_title,
  case when kind = 'daily' then json_extract_string(content, '$.tldr') end as daily_tldr
from digests where id = 'digest-42'""", "digests"))
def src_06(spark, d):
    out = scans.digest_by_id(fx.digests(spark, d), "digest-42")
    return out.select("id", "kind", F.col("weekly.title").alias("weekly_title"),
                      F.col("daily.tldr").alias("daily_tldr"))


_TITLE = """case when kind = 'weekly' then json_extract_string(content, '$.title')
       else json_extract_string(content, '$.tldr') end"""


@query("SRC-07", with_views(f"""
select id, kind, date, tier, quiet, {_TITLE} as title, created_at from digests
where kind = 'weekly' order by date desc, created_at desc, id limit 30""", "digests"))
def src_07(spark, d):
    return scans.list_digests(fx.digests(spark, d), kind="weekly", limit=30)


@query("SRC-08", with_views(f"""
select * from (select id, kind, date, {_TITLE} as title from digests) r
where kind = 'daily' and (contains(lower(title), 'day 7') or contains(cast(date as varchar), 'day 7')
                          or contains(lower(id), 'day 7'))""", "digests"))
def src_08(spark, d):
    rows = scans.archive_rows(fx.digests(spark, d))
    return scans.search_archive(rows, " DAY 7 ", "daily").select("id", "kind", "date", "title")


@query("SRC-09", with_views("""
select id, target_id, coalesce(nullif(value, 0), 1.0) as value, created_at from feedback
where signal = 'up' and created_at >= timestamp '2024-01-10 00:00:00'""", "feedback"))
def src_09(spark, d):
    out = scans.feedback_since(fx.feedback(spark, d), "up", "2024-01-10 00:00:00")
    return out.select("id", "target_id", "value", "created_at")


def _supplier_sources(spark, d):
    n = F.col("s_nationkey")
    return fx.table(spark, d, "supplier").select(
        F.col("s_name").alias("name"),
        fx.family_of(n % 4).alias("family"),
        F.when(n % 3 != 0, F.round(F.col("s_acctbal") / 10000.0, 4)).alias("authority"),
        (F.col("s_acctbal") > 0).alias("enabled"),
    )


_SUPPLIER_SOURCES = """
select s_name as name,
  case s_nationkey % 4 when 0 then 'academia' when 1 then 'industry' when 2 then 'community' else 'meta' end as family,
  case when s_nationkey % 3 <> 0 then round(s_acctbal / 10000.0, 4) end as authority, s_acctbal > 0 as enabled
from supplier"""


@query("SRC-10", f"""
with s as ({_SUPPLIER_SOURCES})
select name, family, coalesce(authority, 0.5)::double as authority from s where enabled""")
def src_10(spark, d):
    return scans.source_registry(_supplier_sources(spark, d)).select("name", "family", "authority")


def event_state(spark, d):
    return fx.table(spark, d, "events").select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("key"),
        F.when(F.col("event_type") == "error", F.lit("[1]")).otherwise(F.col("props")).alias("value"),
        F.col("ts").alias("updated_at"),
    )


@query("SRC-11", """
with s as (select concat('user-', cast(user_id as varchar)) as key,
             case when event_type = 'error' then '[1]' else props end as value, ts as updated_at from events),
l as (select key, arg_max(value, updated_at) as value, max(updated_at) as updated_at from s group by 1)
select key, json_extract_string(value, '$.k') as k, updated_at from l where value like '{%'""")
def src_11(spark, d):
    out = scans.app_state(event_state(spark, d))
    return out.select("key", F.get_json_object("value", "$.k").alias("k"), "updated_at")


# --- landing files, derived from the tables ---------------------------------------
def land_hits(spark, d) -> str:
    """Community hits: one per event, fifty to a page."""
    n = F.col("event_id")
    title = F.concat(F.when(n % 3 == 0, "AI agents, note ").otherwise("Ships sail, note "), n.cast("string"))
    hit = F.struct(
        n.cast("string").alias("objectID"),
        F.when(n % 5 != 0, title).alias("title"),
        F.when(n % 11 != 0, F.concat(F.lit("Story "), title)).alias("story_title"),
        F.when(n % 4 != 0, F.concat(F.lit("https://h.example.com/"), n.cast("string"))).alias("url"),
        F.floor(F.unix_micros("ts") / 1_000_000).alias("created_at_i"),
        F.floor("value").alias("points"),
        F.col("user_id").alias("num_comments"),
        F.concat(F.lit(" body "), n.cast("string")).alias("story_text"),
        F.when(F.col("event_type") == "purchase", F.array(F.lit("story"), F.lit("show_hn")))
        .otherwise(F.array(F.lit("story"))).alias("_tags"),
    )
    path = scratch(spark, "landing-hits")
    pages = fx.table(spark, d, "events").groupBy(F.floor(n / 50).alias("page")).agg(
        F.collect_list(hit).alias("hits"))
    pages.select("hits").write.json(path)
    return path


_HITS = """
select event_id, cast(event_id as varchar) as oid,
  case when event_id % 3 = 0 then 'AI agents, note ' else 'Ships sail, note ' end || cast(event_id as varchar) as t,
  case when event_id % 5 <> 0 then t end as title, case when event_id % 11 <> 0 then 'Story ' || t end as story_title,
  case when event_id % 4 <> 0 then 'https://h.example.com/' || cast(event_id as varchar) end as url,
  cast(floor(epoch(ts)) as bigint) as sec, cast(floor(value) as bigint) as points, user_id,
  event_type = 'purchase' as is_show
from events"""
_HIT_ITEMS = f"""
with h as ({_HITS}), i as (
select *, coalesce(title, story_title) as ttl,
  coalesce(url, 'https://news.ycombinator.com/item?id=' || oid) as link from h)
select sha256(lower(link)) as id, ttl as title, link as url, make_timestamp(sec * 1000000) as published_at,
  'body ' || oid as raw_text, cast(points as double) as upvotes, cast(user_id as double) as comments
from i where ttl is not null"""


def _hit_columns(df):
    return df.select("id", "title", "url", "published_at", "raw_text",
                     F.col("metrics")["upvotes"].alias("upvotes"),
                     F.col("metrics")["comments"].alias("comments"))


@query("SRC-12", _HIT_ITEMS)
def src_12(spark, d):
    return _hit_columns(landing.read_hn(spark, land_hits(spark, d)))


def land_broken_hits(spark, d) -> str:
    """The hits, and of every 53rd event a line cut short, a line without a list and a page with
    entries that are no records beside a good one and one whose points are no number."""
    path, n = land_hits(spark, d), F.col("event_id").cast("string")
    good = F.concat(F.lit('{"objectID":"r'), n, F.lit('","title":"Saved '), n, F.lit('","points":3}'))
    odd = F.concat(F.lit('{"objectID":"m'), n, F.lit('","title":"Odd '), n, F.lit('","points":"many"}'))
    lines = F.array(F.concat(F.lit('{"hits":[{"objectID":"c'), n), F.concat(F.lit('{"none":'), n, F.lit("}")), F.lit(" "),
                    F.concat(F.lit('{"hits":['), good, F.lit(","), n, F.lit(",null,"), odd, F.lit("]}")))
    fx.table(spark, d, "events").filter("event_id % 53 = 0").select(F.explode(lines).alias("value")).write.mode("append").text(path)
    return path


_BROKEN = "from (select cast(event_id as varchar) as n from events where event_id % 53 = 0)"


@query("SRC-12-saved", f"""{_HIT_ITEMS}
union all select sha256('https://news.ycombinator.com/item?id=' || p || n), case p when 'r' then 'Saved ' else 'Odd ' end || n,
  'https://news.ycombinator.com/item?id=' || p || n, null, '', case p when 'r' then 3.0 else 0.0 end, 0.0
{_BROKEN} cross join (values ('r'), ('m')) v(p)""")
def src_12_saved(spark, d):
    return _hit_columns(landing.read_hn(spark, land_broken_hits(spark, d)))


@query("SRC-12-faults", f"""
select 'hn' as source, 'not_json' as reason, '{{"hits":[{{"objectID":"c' || n as raw {_BROKEN}
union all select 'hn', 'no_records', '{{"none":' || n || '}}' {_BROKEN}
union all select 'hn', 'not_an_object', n {_BROKEN}
union all select 'hn', 'not_an_object', 'null' {_BROKEN}
union all select 'hn', 'mistyped', '{{"objectID":"m' || n || '","points":"many","title":"Odd ' || n || '"}}' {_BROKEN}""")
def src_12_faults(spark, d):
    return landing.faults(spark, land_broken_hits(spark, d), "hn").select("source", "reason", "raw")


def land_posts(spark, d) -> str:
    n = F.col("event_id")
    post = F.struct(F.struct(
        n.cast("string").alias("id"),
        F.when(n % 13 != 0, F.concat(F.lit(" Post "), n.cast("string"))).alias("title"),
        (F.col("event_type") == "error").alias("stickied"),
        (n % 17 == 0).alias("hidden"),
        F.when(n % 3 != 0, F.concat(F.lit("/r/x/"), n.cast("string"))).alias("permalink"),
        F.concat(F.lit("https://e.example.com/"), n.cast("string")).alias("url"),
        (F.unix_micros("ts") / 1_000_000).alias("created_utc"),
        F.concat(F.lit("<p>text &amp; "), n.cast("string"), F.lit("</p>")).alias("selftext"),
        F.floor("value").alias("score"),
        F.col("user_id").alias("num_comments"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("author"),
        F.lit("x").alias("subreddit"),
    ).alias("data"))
    path = scratch(spark, "landing-posts")
    pages = fx.table(spark, d, "events").groupBy(F.floor(n / 50).alias("page")).agg(
        F.collect_list(post).alias("children"))
    pages.select(F.struct("children").alias("data")).write.json(path)
    return path


@query("SRC-13", """
select coalesce(case when event_id % 3 <> 0 then 'https://www.reddit.com/r/x/' || cast(event_id as varchar) end,
                'https://e.example.com/' || cast(event_id as varchar)) as url,
  'Post ' || cast(event_id as varchar) as title, 'text & ' || cast(event_id as varchar) as raw_text,
  'u' || cast(user_id as varchar) as author, floor(value)::double as upvotes, user_id::double as comments
from events where event_type <> 'error' and event_id % 17 <> 0 and event_id % 13 <> 0""")
def src_13(spark, d):
    out = landing.read_reddit(spark, land_posts(spark, d))
    return out.select("url", "title", "raw_text", "author", F.col("metrics")["upvotes"].alias("upvotes"),
                      F.col("metrics")["comments"].alias("comments"))


def land_papers(spark, d, whole_ids: bool = False) -> str:
    """Trending papers: one per document. Ids have five digits, so that larger numbers are cut
    and may meet; with ``whole_ids`` they keep all digits."""
    n = F.col("doc_id")
    digits = F.greatest(F.lit(5), F.length(n.cast("string"))) if whole_ids else F.lit(5)
    name = lambda k: F.struct(F.concat(F.lit(f" A{k} "), n.cast("string")).alias("name"))
    blank = F.struct(F.lit("  ").alias("name"))
    rows = fx.table(spark, d, "documents").select(
        F.lit("2024-01-05T06:07:08Z").alias("publishedAt"),
        F.struct(
            F.when(n % 4 != 0, F.concat(F.lit("2401."), F.lpad(n.cast("string"), digits, F.lit("0")))).alias("id"),
            F.when(n % 9 != 0, F.concat(F.lit("Paper "), n.cast("string"))).alias("title"),
            F.col("text").alias("summary"),
            (n % 5).alias("upvotes"),
            F.array(name(1), blank, name(2), name(3)).alias("authors"),
        ).alias("paper"),
    )
    path = scratch(spark, "landing-papers")
    rows.write.json(path)
    return path


@query("SRC-14", """
select case when doc_id % 4 <> 0 then 'https://huggingface.co/papers/2401.' || lpad(cast(doc_id as varchar), 5, '0') end as url,
  'Paper ' || cast(doc_id as varchar) as title,
  'A1 ' || cast(doc_id as varchar) || ', A2 ' || cast(doc_id as varchar) as author,
  timestamp '2024-01-05 06:07:08' as published_at,
  md5(left(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), 4000)) as body_md5,
  case when doc_id % 5 > 0 then (doc_id % 5)::double end as hf_upvotes
from documents where doc_id % 9 <> 0""")
def src_14(spark, d):
    out = landing.read_hf_papers(spark, land_papers(spark, d))
    return out.select("url", "title", "author", "published_at", F.md5("raw_text").alias("body_md5"),
                      F.col("metrics")["hf_upvotes"].alias("hf_upvotes"))


def land_notes(spark, d) -> str:
    n = F.col("doc_id")
    wrapped = n % 2 == 0
    value = lambda c: F.struct(c.alias("value"))
    who = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.concat(F.lit("N"), k.cast("string")))
    full = F.to_json(F.struct(value(F.concat(F.lit("Note "), n.cast("string"))).alias("title"),
                              value(F.col("text")).alias("abstract"), value(who).alias("authors"),
                              value(F.lit("ICLR")).alias("venue")))
    bare = F.to_json(F.struct(F.concat(F.lit("Note "), n.cast("string")).alias("title"),
                              F.col("text").alias("abstract"), F.lit("Solo").alias("authors")))
    note = F.struct(n.cast("string").alias("id"),
                    F.parse_json(F.when(wrapped, full).otherwise(bare)).alias("content"),
                    (F.lit(1704067200000) + n * 1000).alias("cdate"))
    path = scratch(spark, "landing-notes")
    docs = fx.table(spark, d, "documents").select(F.floor(n / 25).alias("page"), F.to_json(note).alias("j"))
    docs.groupBy("page").agg(F.concat_ws(",", F.collect_list("j")).alias("js")).select(
        F.concat(F.lit('{"notes":['), "js", F.lit("]}")).alias("value")).write.text(path)
    return path


@query("SRC-15", """
select 'https://openreview.net/forum?id=' || cast(doc_id as varchar) as url, 'Note ' || cast(doc_id as varchar) as title,
  case when doc_id % 2 = 0 then 'N1, N2, N3, N4, N5, N6' else 'Solo' end as author,
  timestamp '2024-01-01 00:00:00' + doc_id * interval '1' second as published_at
from documents""")
def src_15(spark, d):
    out = landing.read_openreview(spark, land_notes(spark, d))
    return out.select("url", "title", "author", "published_at")


def _xml(col):
    out = F.replace(col, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _printable(col):
    return F.regexp_replace(col, r"[\x00-\x08\x0B\x0C\x0E-\x1F\r\n]+", " ")


def _write_feeds(df, key, root: str, path: str) -> None:
    """One well-formed XML file per fifty entries of column ``value``."""
    pages = df.groupBy(F.floor(F.col(key) / 50)).agg(F.concat_ws("", F.collect_list("value")).alias("value"))
    pages.select(F.concat(F.lit(f"<{root}>"), "value", F.lit(f"</{root}>")).alias("value")).write.option(
        "maxRecordsPerFile", 1).text(path)


def land_feed(spark, d, path: str | None = None, rows: str = "true") -> str:
    """RSS items, one per page of the table (those that ``rows`` says); every seventh has no date."""
    n = F.col("page_id")
    when = F.timestamp_micros(F.lit(1704067200 * 1_000_000) + n * 3_600_000_000)
    stamp = F.concat(F.lit("<pubDate>Mon, "), F.date_format(when, "dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate>"))
    line = F.concat(
        F.lit("<item><title> Page "), n.cast("string"), F.lit(" </title><link>"), _xml(F.col("url")),
        F.lit("</link>"), F.when(n % 7 != 0, stamp).otherwise(F.lit("")),
        F.lit("<description>"), _xml(F.col("html")), F.lit("</description></item>"),
    )
    path = path or scratch(spark, "landing-rss")
    _write_feeds(fx.table(spark, d, "pages").filter(rows).select("page_id", _printable(line).alias("value")), "page_id", "rss", path)
    return path


@query("SRC-16", """
select 'rss:' || 'pages' as source, 'Page ' || cast(page_id as varchar) as title, url,
  case when page_id % 7 = 0 then timestamp '2024-01-02 00:00:00'
       else timestamp '2024-01-01 00:00:00' + page_id * interval '1' hour end as published_at
from pages where page_id % 7 = 0 or page_id >= 24""")
def src_16(spark, d):
    out = landing.read_feed(spark, land_feed(spark, d), "pages", "industry", "2024-01-02 00:00:00")
    return out.select("source", "title", "url", "published_at")


def land_broken_feed(spark, d) -> str:
    """The feed, and for every 29th page a file that breaks off after its first item."""
    path, n = land_feed(spark, d), F.col("page_id").cast("string")
    text = F.concat(F.lit("<rss><item><title>Kept "), n, F.lit("</title></item><item><title>Lost "), n, F.lit("</titl></item></rss>"))
    files = fx.table(spark, d, "pages").filter("page_id % 29 = 0").select(text.alias("value"))
    files.write.mode("append").option("maxRecordsPerFile", 1).text(path)
    return path


@query("SRC-16-faults", """
with n as (select cast(page_id as varchar) as n from pages where page_id % 29 = 0)
select 'broken_xml' as reason, 'Lost ' || n as lost from n""")
def src_16_faults(spark, d):
    rows = landing.faults(spark, land_broken_feed(spark, d), "rss:pages")
    return rows.select("reason", F.regexp_extract("raw", "Lost [0-9]+", 0).alias("lost"))


def land_atom(spark, d) -> str:
    n = F.col("doc_id")
    cats = (F.when(n % 3 == 0, '<category term="cs.CL"/><category term="x.Y"/>')
            .when(n % 3 == 1, '<category term="math.CO"/>').otherwise(""))
    aid = F.concat(F.lit("http://arxiv.org/abs/2401."), F.lpad(n.cast("string"), 5, "0"), F.lit("v1"))
    line = F.concat(
        F.lit("<entry><id>"), aid, F.lit("</id><title>Paper "), n.cast("string"),
        F.lit("</title><published>2024-01-05T00:00:00Z</published><summary>"),
        _xml(F.col("text")), F.lit("</summary><author><name>Ann "), n.cast("string"),
        F.lit("</name></author><author><name>Bob</name></author>"), cats,
        F.lit('<link href="'), aid, F.lit('" rel="alternate"/></entry>'),
    )
    path = scratch(spark, "landing-atom")
    _write_feeds(fx.table(spark, d, "documents").select("doc_id", _printable(line).alias("value")), "doc_id", "feed", path)
    return path


@query("SRC-17", """
select 'http://arxiv.org/abs/2401.' || lpad(cast(doc_id as varchar), 5, '0') || 'v1' as url,
  'Paper ' || cast(doc_id as varchar) as title, 'Ann ' || cast(doc_id as varchar) as author,
  '2401.' || lpad(cast(doc_id as varchar), 5, '0') || 'v1' as arxiv_id
from documents where doc_id % 3 <> 1""")
def src_17(spark, d):
    out = landing.read_arxiv(spark, land_atom(spark, d), "2024-01-01 00:00:00")
    return out.select("url", "title", "author", F.get_json_object("raw", "$.arxiv_id").alias("arxiv_id"))


@query("SRC-18", """
select case when s_suppkey % 2 = 0 then 'rss:' || s_name else 'rss:' || s_name end as name,
  'https://f.example.com/' || cast(s_suppkey as varchar) as url
from supplier""")
def src_18(spark, d):
    k = F.col("s_suppkey")
    feeds = fx.table(spark, d, "supplier").select(
        F.when(k % 2 == 0, F.concat(F.lit("rss:"), F.col("s_name"))).otherwise(F.col("s_name")).alias("slug"),
        F.concat(F.lit("https://f.example.com/"), k.cast("string")).alias("url"),
        F.lit("industry").alias("family"))
    return landing.feed_catalogue(feeds).select("name", "url")


@query("SRC-18-entries", """
select 'rss:feed' || cast(page_id % 3 as varchar) as source, case page_id % 3 when 0 then 'industry' else 'community' end as family,
  'Page ' || cast(page_id as varchar) as title, url
from pages where page_id % 4 < 3 and page_id % 3 < 2 and (page_id % 7 = 0 or page_id >= 24)""")
def src_18_entries(spark, d):
    """Feeds below one folder, each with its own; one folder is in no catalogue, one feed never landed."""
    root = scratch(spark, "landing-feeds")
    for k in range(3):
        land_feed(spark, d, f"{root}/feed{k}", f"page_id % 3 = {k} and page_id % 4 < 3")
    feeds = spark.createDataFrame(
        [("feed0", "u0", "industry"), ("feed1", "u1", "community"), ("feed9", "u9", "academia")], "slug string, url string, family string")
    rows = landing.catalogue_entries(spark, root, feeds, "2024-01-02 00:00:00")
    return landing.feed_items(rows, F.col("name"), F.col("family")).select("source", "family", "title", "url")


def land_golden(spark, d) -> str:
    n = F.col("doc_id")
    item = F.struct(
        F.lit("hn").alias("source"), F.lit("community").alias("family"),
        F.concat(F.lit("Doc "), n.cast("string")).alias("title"),
        F.concat(F.lit("https://g.example.com/"), n.cast("string")).alias("url"),
        F.lit("2024-01-05T00:00:00Z").alias("published_at"), F.col("text").alias("raw_text"),
        F.map_from_arrays(F.array(F.lit("upvotes")), F.array((n % 300).cast("double"))).alias("metrics"),
    )
    rows = fx.table(spark, d, "documents").join(fx.table(spark, d, "labels"), "doc_id")
    sets = rows.groupBy(F.floor(n / 100).alias("no"), "toxic").agg(F.collect_list(item).alias("items"))
    path = scratch(spark, "landing-golden")
    sets.select(
        F.concat(F.lit("set-"), F.col("no").cast("string"), F.lit("-"), F.col("toxic").cast("string")).alias("name"),
        F.lit("2024-01-05").alias("date"), (F.col("toxic") == 1).alias("quiet_expected"), "items",
    ).write.option("maxRecordsPerFile", 1).json(path)
    return path


@query("SRC-19", """
select 'set-' || cast(doc_id // 100 as varchar) || '-' || cast(toxic as varchar) as set_name, toxic = 1 as quiet_expected,
  sha256('https://g.example.com/' || cast(doc_id as varchar)) as id, 'Doc ' || cast(doc_id as varchar) as title,
  (doc_id % 300)::double as upvotes
from documents join labels using (doc_id)""")
def src_19(spark, d):
    out = landing.load_golden(spark, land_golden(spark, d))
    return out.select("set_name", "quiet_expected", "id", "title", F.col("metrics")["upvotes"].alias("upvotes"))


@query("SRC-20", """
with v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
q as (select label as query_id, min(vec_id) as vec_id from v group by 1),
s as (select q.query_id, v.vec_id as id,
        greatest(0.0, least(1.0, list_cosine_similarity(v.e, qv.e))) as similarity
      from q join v qv on qv.vec_id = q.vec_id cross join v)
select query_id, id, round(similarity, 6) as similarity, rank from (
  select *, row_number() over (partition by query_id order by similarity desc, id) as rank from s) where rank <= 20""")
def src_20(spark, d):
    vec = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    queries = vec.groupBy(F.col("label").cast("int").alias("query_id")).agg(
        F.min_by("embedding", "id").alias("embedding"))
    out = similar_items(vec, queries, k=20)
    return out.select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))
