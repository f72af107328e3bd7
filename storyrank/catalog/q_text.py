"""Text, title, URL and date expressions, each as a column job over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyrank import constants as K
from storyrank import fixtures as fx
from storyrank.catalog.registry import query, with_views
from storyrank.functions import text as X

WS = K.WS


def sq_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def sq_squeeze(c: str) -> str:
    return sq_strip(f"regexp_replace({c}, '{WS}+', ' ', 'g')")


def sq_slug(c: str) -> str:
    body = f"left(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80)"
    return f"coalesce(nullif({body}, ''), 'untitled')"


def docs(spark, d):
    return fx.table(spark, d, "documents")


def pages(spark, d):
    return fx.table(spark, d, "pages")


@query("TXT-01", f"""
select 'page' as kind, page_id as no, sha256(lower({sq_strip('url')})) as id from pages
union all
select 'doc', doc_id, sha256(lower({sq_squeeze('text')})) from documents""")
def txt_01(spark, d):
    web = pages(spark, d).select(F.lit("page").alias("kind"), F.col("page_id").alias("no"),
                                 X.content_hash(F.concat(F.lit("  "), F.upper("url")), "html").alias("id"))
    plain = docs(spark, d).select(F.lit("doc"), "doc_id", X.content_hash(F.lit("  "), "text"))
    return web.union(plain)


@query("TXT-02", f"select p_partkey, {sq_slug('concat(p_name, chr(32), p_brand, chr(33))')} as slug from part")
def txt_02(spark, d):
    return fx.table(spark, d, "part").select(
        "p_partkey", X.slugify(F.concat("p_name", F.lit(" "), "p_brand", F.lit("!"))).alias("slug"))


@query("TXT-03", f"""
select vec_id // 5 as grp, {sq_slug("concat('Group ', cast(vec_id // 5 as varchar))")} || '-' ||
  left(sha256(string_agg('item-' || cast(vec_id as varchar), '|' order by 'item-' || cast(vec_id as varchar))), 8) as story_id
from embeddings group by vec_id // 5""")
def txt_03(spark, d):
    ids = F.collect_list(F.concat(F.lit("item-"), F.col("vec_id").cast("string"))).alias("ids")
    groups = fx.table(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 5).alias("grp")).agg(ids)
    title = F.concat(F.lit("Group "), F.col("grp").cast("string"))
    return groups.select("grp", X.story_id(title, "ids").alias("story_id"))


@query("TXT-04", """
with b as (select page_id, regexp_replace(split_part(split_part(regexp_replace(lower(url), '^https?://', ''), '#', 1), '?', 1), '$', '') as s
  from pages)
select page_id, coalesce(nullif(case when instr(s, '/') > 0 then rtrim(substr(s, instr(s, '/')), '/') else '' end, ''), s) as path from b""")
def txt_04(spark, d):
    return pages(spark, d).select("page_id", X.url_path("url").alias("path"))


@query("TXT-05", """
select page_id,
  case page_id % 3 when 0 then 'm' || cast(page_id as varchar) when 1 then '2401.' || lpad(cast(page_id as varchar), 5, '0') end as arxiv_id,
  case when page_id % 3 = 1 then '2401.' || lpad(cast(page_id as varchar), 5, '0')
       else nullif(regexp_extract(html, '(\\d{4}\\.\\d{4,5})', 1), '') end as first_id
from pages""")
def txt_05(spark, d):
    n = F.col("page_id")
    raw = F.when(n % 3 == 0, F.concat(F.lit("m"), n.cast("string"), F.lit("v3")))
    url = F.when(n % 3 == 1, F.concat(F.lit("https://arxiv.org/abs/2401."), F.lpad(n.cast("string"), 5, "0"),
                                      F.lit("v2"))).otherwise(F.regexp_replace("url", r"\d", "d"))
    return pages(spark, d).select("page_id", X.arxiv_id(raw, url).alias("arxiv_id"),
                                  X.first_paper_id(url, "html").alias("first_id"))


_STOP = "[" + ", ".join(f"'{w}'" for w in K.TITLE_STOP_WORDS) + "]"


def sq_tokens(c: str) -> str:
    return (f"list_filter(list_distinct(list_transform(regexp_extract_all({c}, '[A-Za-z]{{3,}}'), lambda x: lower(x))), "
            f"lambda x: not list_contains({_STOP}, x))")


@query("TXT-06", f"""
with t as (select doc_id, {sq_tokens('text')} as a, {sq_tokens("source || ' ' || lang || ' alpha the and ' || split_part(text, chr(10), 1)")} as b
  from documents)
select doc_id, len(a) as n_tokens, round(case when len(a) = 0 or len(b) = 0 then 0.0
  else len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))) end, 6) as jaccard from t""")
def txt_06(spark, d):
    other = F.concat("source", F.lit(" "), "lang", F.lit(" alpha the and "), F.split_part("text", F.lit("\n"), F.lit(1)))
    rows = docs(spark, d).select("doc_id", X.title_tokens("text").alias("a"), X.title_tokens(other).alias("b"))
    return rows.select("doc_id", F.size("a").cast("bigint").alias("n_tokens"), F.round(X.token_jaccard("a", "b"), 6).alias("jaccard"))


def sq_html(c: str, n: int) -> str:
    out = f"regexp_replace({c}, '<[^>]+>', ' ', 'g')"
    for entity, char in K.HTML_ENTITIES:
        quoted = char.replace("'", "''")
        out = f"replace({out}, '{entity}', '{quoted}')"
    return f"left({sq_squeeze(out)}, {n})"


@query("TXT-07", f"select page_id, md5({sq_html('html', 4000)}) as text_md5, length({sq_html('html', 100000000)}) as full_len from pages")
def txt_07(spark, d):
    return pages(spark, d).select("page_id", F.md5(X.html_to_text("html")).alias("text_md5"),
                                  F.length(X.html_to_text("html", 100000000)).cast("bigint").alias("full_len"))


_BLOCKS = "html"
for _pat, _to in (
    (r"(?is)<script[^>]*>.*?</script>", "''"), (r"(?is)<style[^>]*>.*?</style>", "''"),
    (r"(?i)<br\s*/?>", "chr(10)"), (r"(?i)</(p|div|h[1-6]|li|tr)>", "chr(10)"), (r"<[^>]+>", "''"),
    (r"\n{3,}", "chr(10) || chr(10)"),
):
    _BLOCKS = f"regexp_replace({_BLOCKS}, '{_pat}', {_to}, 'g')"


@query("TXT-08", f"select page_id, md5({sq_strip(_BLOCKS)}) as text_md5 from pages")
def txt_08(spark, d):
    return pages(spark, d).select("page_id", F.md5(X.html_to_text_blocks("html")).alias("text_md5"))


@query("TXT-09", """
select event_id, case event_id % 5 when 4 then null else date_trunc('second', ts) end as dt from events""")
def txt_09(spark, d):
    n = F.col("event_id") % 5
    ts = F.date_trunc("second", "ts")
    written = (
        F.when(n == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(n == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(n == 2, F.concat(F.lit("Mon, "), F.date_format(ts, "d MMM yyyy HH:mm:ss"), F.lit(" GMT")))
        .when(n == 3, F.unix_seconds(ts).cast("string"))
        .otherwise(F.lit("not a date"))
    )
    return fx.table(spark, d, "events").select("event_id", X.parse_dt(written).alias("dt"))


@query("TXT-10", f"""
select doc_id, md5('T ' || cast(doc_id as varchar) || coalesce(chr(10) || nullif({sq_strip('left(body, 1200)')}, ''), '')) as text_md5
from (select doc_id, case when doc_id % 4 = 0 then '  ' else text end as body from documents)""")
def txt_10(spark, d):
    body = F.when(F.col("doc_id") % 4 == 0, "  ").otherwise(F.col("text"))
    title = F.concat(F.lit("T "), F.col("doc_id").cast("string"))
    return docs(spark, d).select("doc_id", F.md5(X.embedding_text(title, body)).alias("text_md5"))


def sq_clip(c: str, n: int) -> str:
    """Independent form: greedy prefixes instead of reversed searches."""
    def idx(sep, w):
        return (f"case when contains(cut, '{sep}') then length(regexp_extract(cut, '(?s)^(.*){w}', 1)) else -1 end")
    return f"""(select case when length(t) <= {n} then t
      when sent > {n / 2} then {sq_strip('left(cut, sent + 1)')}
      when sm > {n / 2} then {sq_strip('left(cut, sm)')} || '…'
      when comma > {n / 2} then {sq_strip('left(cut, comma)')} || '…'
      else regexp_replace(case when sp > 0 then left(cut, sp) else cut end, '{WS}+$', '') || '…' end
    from (select t, cut, {idx('. ', '[.] ')} as sent, {idx('; ', '; ')} as sm, {idx(', ', ', ')} as comma, {idx(' ', ' ')} as sp
      from (select t, left(t, {n}) as cut from (select {sq_strip(c)} as t))))"""


@query("TXT-11", f"""
select doc_id, md5({sq_clip('d.text', 320)}) as c320, md5({sq_clip('d.text', 45)}) as c45 from documents d""")
def txt_11(spark, d):
    return docs(spark, d).select("doc_id", F.md5(X.clip("text", 320)).alias("c320"), F.md5(X.clip("text", 45)).alias("c45"))


@query("TXT-12", f"""
with t as (select doc_id, text, {sq_strip('text')} as t from documents),
u as (select doc_id, text, t, left(t, 520) as cut from t),
v as (select *, greatest(length(regexp_extract(cut, '(?s)^(.*)[.] ', 1)), length(regexp_extract(cut, '(?s)^(.*)! ', 1)),
       length(regexp_extract(cut, '(?s)^(.*)[?] ', 1))) as best from u)
select doc_id, md5(case when length(t) <= 520 then t when best > 0 then {sq_strip('left(cut, best + 1)')}
  else {sq_clip('v.text', 520)} end) as text_md5 from v""")
def txt_12(spark, d):
    return docs(spark, d).select("doc_id", F.md5(X.clip_sentence("text", 520)).alias("text_md5"))


@query("TXT-13", f"""
select s.no as story_no, coalesce(left({sq_squeeze('d.text')}, 240), '') as snippet
from (select page_id as no, case when page_id % 5 = 0 then -1 else page_id end as rep from pages) s
left join documents d on d.doc_id = s.rep""")
def txt_13(spark, d):
    n = F.col("page_id")
    stories = pages(spark, d).select(n.alias("story_no"), F.when(n % 5 == 0, -1).otherwise(n).alias("rep"))
    bodies = docs(spark, d).select(F.col("doc_id").alias("rep"), "text")
    return stories.join(bodies, "rep", "left").select("story_no", X.snippet("text").alias("snippet"))


_CATALOGUE = ["Small and Large", "ECONOMY", "brand and 7"]


@query("TXT-14", """
select p_partkey, array_to_string([case lower(p_type) when 'economy' then 'ECONOMY' else p_type end,
   'Small and Large', p_brand], '|') as tags from part""")
def txt_14(spark, d):
    tags = F.array(F.lower("p_type"), F.lit("  "), F.lit(" SMALL  & large "), F.col("p_brand"), F.lit("dropped"))
    plain = F.transform(X.canonical_tags(tags, _CATALOGUE), lambda t: t)
    kept = F.when(F.col("p_type") == "ECONOMY", plain).otherwise(
        X.canonical_tags(F.array("p_type", F.lit("  "), F.lit(" SMALL  & large "), "p_brand", F.lit("dropped")), _CATALOGUE))
    return fx.table(spark, d, "part").select("p_partkey", F.array_join(kept, "|").alias("tags"))


_LABEL_SQL = "case " + " ".join(f"when contains(lower(u), '{n}') then '{v}'" for n, v in K.LINK_LABELS) + \
    " else coalesce(nullif(regexp_extract(u, 'https?://(?:www\\.)?([^/]+)', 1), ''), 'link') end"


@query("TXT-15", f"""
select page_id, {_LABEL_SQL} as label from (select page_id,
  case page_id % 6 when 0 then 'https://ArXiv.org/abs/1' when 1 then 'x' when 2 then 'https://www.github.com/a' else url end as u from pages)""")
def txt_15(spark, d):
    n = F.col("page_id") % 6
    url = (F.when(n == 0, "https://ArXiv.org/abs/1").when(n == 1, "x").when(n == 2, "https://www.github.com/a")
           .otherwise(F.col("url")))
    return pages(spark, d).select("page_id", X.link_label(url).alias("label"))


ANNOUNCE_SQL = f"""case when regexp_matches(title, '{K.ANNOUNCE_TITLE}') then 1.0
  when regexp_matches(title, '{K.ESSAY_TITLE}') then 0.0 else 0.4 end::double"""


@query("TXT-16", with_views(f"select doc_id, {ANNOUNCE_SQL} as score from titled", "titled"))
def txt_16(spark, d):
    return fx.titled(spark, d).select("doc_id", X.announce_score("title").alias("score"))


def sq_nums(c: str) -> str:
    return (f"list_filter(list_transform(regexp_extract_all({c}, '{K.SIGNIFICANT_NUMBER}'), "
            f"lambda t: replace(regexp_extract(t, '{K.NUMBER_CORE}'), ',', '')), lambda n: n <> '')")


@query("TXT-17", with_views(f"""
select 'pair' as kind, doc_id, array_to_string({sq_nums('text')}, '|') as nums from grounding_pairs
union all select 'doc', doc_id, array_to_string({sq_nums('text')}, '|') from documents""", "grounding_pairs"))
def txt_17(spark, d):
    def nums(df, kind):
        return df.select(F.lit(kind).alias("kind"), "doc_id", F.array_join(X.sig_numbers("text"), "|").alias("nums"))
    return nums(fx.grounding_pairs(spark, d), "pair").union(nums(docs(spark, d), "doc"))


def sq_bad(c: str, g: str) -> str:
    return f"list_filter({sq_nums(c)}, lambda n: not contains(replace({g}, ',', ''), n))"


@query("TXT-18", with_views(f"""
select doc_id, array_to_string({sq_bad('text', 'ground')}, '|') as bad from grounding_pairs""", "grounding_pairs"))
def txt_18(spark, d):
    return fx.grounding_pairs(spark, d).select("doc_id", F.array_join(X.ungrounded("text", "ground"), "|").alias("bad"))


def sq_sents(c: str) -> str:
    marked = f"regexp_replace({sq_strip(c)}, '([.!?]){WS}+', '\\1' || chr(1), 'g')"
    return f"string_split({marked}, chr(1))"


@query("TXT-19", with_views(f"""
with s as (select doc_id, ground, {sq_sents('text')} as sents from grounding_pairs),
k as (select doc_id, sents, list_filter(sents, lambda x: len(list_filter({sq_nums('x')}, lambda n: not contains(replace(ground, ',', ''), n))) = 0) as kept from s)
select doc_id, array_to_string(kept, ' ') as text, len(sents) - len(kept) as dropped from k""", "grounding_pairs"))
def txt_19(spark, d):
    out = fx.grounding_pairs(spark, d).select("doc_id", X.strip_ungrounded("text", "ground").alias("s"))
    return out.select("doc_id", "s.text", F.col("s.dropped").cast("bigint").alias("dropped"))


@query("TXT-20", """
select event_id, case when event_type in ('view', 'click', 'purchase') then json_extract_string(props, '$.k') end as k
from events""")
def txt_20(spark, d):
    kind = F.col("event_type")
    raw = (
        F.when(kind == "view", F.col("props"))
        .when(kind == "click", F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
        .when(kind == "purchase", F.concat(F.lit("Sure, here: "), "props", F.lit(" done.")))
        .when(kind == "error", F.concat(F.lit("["), "props", F.lit("]")))
        .otherwise(F.lit("{broken"))
    )
    obj = X.parse_json_obj(raw)
    return fx.table(spark, d, "events").select("event_id", F.try_variant_get(obj, "$.k", "string").alias("k"))


def callback_rows(spark, d):
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    data = (
        F.when(kind == "purchase", F.concat(F.lit("fb:up:story:s"), k))
        .when(kind == "error", F.concat(F.lit("fb:down:digest:"), F.repeat(F.lit("x"), 60), k))
        .when(kind == "click", F.concat(F.lit("fb:click:story:s"), k))
        .when(kind == "view", F.concat(F.lit("fb:up:story:a:"), k))
        .otherwise(F.lit("fb:up:story:"))
    )
    return fx.table(spark, d, "events").select("event_id", F.left(data, F.lit(K.CALLBACK_CHARS)).alias("data"))


@query("TXT-21", """
select event_id, case event_type when 'purchase' then 'up' when 'error' then 'down' end as signal,
  case event_type when 'purchase' then 's' || json_extract_string(props, '$.k')
       when 'error' then left(repeat('x', 60) || json_extract_string(props, '$.k'), 64 - length('fb:down:digest:')) end as target_id,
  case event_type when 'purchase' then 1.0 when 'error' then -1.0 end::double as value,
  event_type not in ('purchase', 'error') as quarantined
from events""")
def txt_21(spark, d):
    from storyrank.sources.clicks import parse_callbacks

    good, bad = parse_callbacks(callback_rows(spark, d))
    none = F.lit(None).cast("string")
    return good.select("event_id", "signal", "target_id", "value", F.lit(False).alias("quarantined")).union(
        bad.select("event_id", none, none, F.lit(None).cast("double"), F.lit(True)))


@query("TXT-22", "select event_id, event_id % 5 <> 0 and event_id % 3 <> 0 as ok from events")
def txt_22(spark, d):
    """Every third click carries a wrong signature, every fifth none."""
    from storyrank.sources.clicks import signature, verify_clicks

    n = F.col("event_id")
    rows = fx.table(spark, d, "events").select(
        "event_id", F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("target_id"),
        F.lit("story").alias("target_kind"), F.lit("up").alias("signal"), F.lit("1").alias("value"))
    true_sig = signature("target_id", "target_kind", "signal", "value", "secret")
    signed = rows.withColumn("sig", F.when(n % 5 == 0, None).when(n % 3 == 0, F.lit("0" * 32)).otherwise(true_sig))
    good, bad = verify_clicks(signed, "secret")
    return good.select("event_id", F.lit(True).alias("ok")).union(bad.select("event_id", F.lit(False)))


@query("TXT-23", """
select doc_id, case doc_id % 3 when 0 then doc_id when 1 then 12 else 0 end as upvotes
from documents""")
def txt_23(spark, d):
    n = F.col("doc_id")
    text = (F.when(n % 3 == 0, F.concat(F.lit("Got "), n.cast("string"), F.lit(" Likes today and 7 upvotes")))
            .when(n % 3 == 1, F.lit("12👍 so far")).otherwise(F.lit("no votes 5")))
    return docs(spark, d).select("doc_id", X.text_upvotes(text).alias("upvotes"))


@query("TXT-24", """
select p_partkey, array_to_string(list_concat([p_type, p_brand], case when lower(p_name) in (lower(p_type), lower(p_brand)) then [] else [p_name] end), '|') as vals
from part""")
def txt_24(spark, d):
    arr = F.array(F.col("p_type"), F.lower("p_type"), F.col("p_brand"), F.upper("p_brand"), F.col("p_name"), F.col("p_type"))
    return fx.table(spark, d, "part").select("p_partkey", F.array_join(X.dedupe_ci(arr), "|").alias("vals"))


@query("TXT-25", """
select page_id, array_to_string(case when page_id % 2 = 0 then [url, 'b', 'c'] else [url, 'b'] end, '|') as links from pages""")
def txt_25(spark, d):
    arr = F.array(F.lit(""), F.col("url"), F.lit("b"), F.col("url"), F.lit(None), F.lit("c"), F.lit("e"))
    links = F.when(F.col("page_id") % 2 == 0, X.trim_links(arr, 3)).otherwise(X.trim_links(arr, 2))
    return pages(spark, d).select("page_id", F.array_join(links, "|").alias("links"))


@query("TXT-26", """
select p_partkey, case p_partkey % 4
  when 0 then 'Research subfields: ' || p_type || '; ' || p_brand || '.' || chr(10) || 'Primary venues: ' || p_name || '.' || chr(10) || 'Voices followed: V.'
  when 1 then 'Voices followed: ' || p_name || ', M.'
  when 2 then 'Primary venues: ' || p_name || '.' || chr(10) || 'Voices followed: V.'
  else 'Artificial intelligence research and engineering.' end as text from part""")
def txt_26(spark, d):
    n = F.col("p_partkey") % 4
    none = F.array().cast("array<string>")
    subs = F.when(n == 0, F.array("p_type", F.lit(" "), "p_brand")).otherwise(none)
    venues = F.when((n == 0) | (n == 2), F.array("p_name"))
    voices = F.when((n == 0) | (n == 2), F.array(F.lit(" V "))).otherwise(none)
    must = F.when(n == 1, F.array("p_name", F.lit("M"))).otherwise(none)
    return fx.table(spark, d, "part").select("p_partkey", X.profile_text(subs, venues, voices, must).alias("text"))


@query("TXT-27", """
select o_orderkey, cast(date_trunc('week', o_orderdate) as date) as monday,
  'weekly-' || cast(isoyear(o_orderdate) as varchar) || '-W' || lpad(cast(weekofyear(o_orderdate) as varchar), 2, '0') as weekly_id,
  cast(date_trunc('week', o_orderdate) as date) + 6 as sunday, 7::bigint as n_days,
  cast(o_orderdate - interval '1' hour * case when extract(month from o_orderdate) in (1, 2, 12) then 8 else 24 end as date) <= cast(o_orderdate as date) as local_ok
from orders""")
def txt_27(spark, d):
    day = F.to_date("o_orderdate")
    dates = X.week_dates(day)
    return fx.table(spark, d, "orders").select(
        "o_orderkey", X.week_of(day).alias("monday"), X.weekly_id(day).alias("weekly_id"),
        F.element_at(dates, -1).alias("sunday"), F.size(dates).cast("bigint").alias("n_days"),
        (X.local_date("o_orderdate", fx.LOCAL_TZ) <= day).alias("local_ok"))
