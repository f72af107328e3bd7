"""Readers over landed source files. Each gives rows of the item schema:
id, source, family, url, title, author, published_at, raw_text, metrics, raw.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyrank import constants as K
from storyrank.functions import text as X
from storyrank.operators.grouping import first_per_key
from storyrank.session import scratch
from storyrank.sources.quarantine import json_faults, line_faults, page_records, xml_faults

ITEM_COLUMNS = (
    "id", "source", "family", "url", "title", "author", "published_at", "raw_text", "metrics", "raw",
)

HIT = (
    "objectID string, title string, story_title string, url string, author string,"
    " created_at string, created_at_i bigint, points bigint, num_comments bigint, story_text string,"
    " comment_text string, _tags array<string>"
)
POST = (
    "data struct<id string, title string, stickied boolean,"
    " hidden boolean, permalink string, url string, url_overridden_by_dest string,"
    " created_utc double, selftext string, score bigint, ups bigint, num_comments bigint,"
    " author string, subreddit string, link_flair_text string>"
)
PAPER_SCHEMA = (
    "title string, url string, publishedAt string, paper struct<id string, title string,"
    " summary string, upvotes bigint, publishedAt string, authors array<struct<name string>>>"
)
NOTE = "id string, content variant, cdate bigint, tcdate bigint, invitation string"
PAGES = {  # where a page lists its records, and their fields
    "hn": (["hits"], HIT), "reddit": (["data", "children"], POST), "openreview": (["notes"], NOTE),
}
RSS_SCHEMA = (
    "title string, link string, guid string, pubDate string, updated string, created string,"
    " description string, summary string, `content:encoded` string, `dc:creator` string, author string"
)
ATOM_SCHEMA = (
    "id string, title string, link array<struct<_href string, _rel string>>, published string,"
    " updated string, summary string, content string, author array<struct<name string>>,"
    " category array<struct<_term string>>"
)
GOLDEN_SCHEMA = (
    "name string, description string, date string, quiet_expected boolean,"
    " expected_overall_tier string, items array<struct<source string, family string, title string,"
    " url string, author string, published_at string, raw_text string,"
    " metrics map<string,double>>>"
)


def _counts(**cols: Column) -> Column:
    parts = []
    for name, col in cols.items():
        parts += [F.lit(name), F.coalesce(col, F.lit(0)).cast("double")]
    return F.create_map(*parts)


def _present(col) -> Column:
    """The value unless it is NULL or empty, as a truthiness test would see it."""
    return F.nullif(X._c(col), F.lit(""))


def _items(df: DataFrame, **cols: Column) -> DataFrame:
    """Item rows with a derived id; rows without a title are skipped."""
    out = df.select(*[c.alias(n) for n, c in cols.items()]).filter(F.col("title") != "")
    return out.withColumn("id", X.item_id("url", "title", "raw_text")).select(*ITEM_COLUMNS)


def _first_of(rows: DataFrame, key: str, at: str) -> DataFrame:
    """One row for each key: the earliest by ``at`` (if the rows have it), ties by their values."""
    seen = [F.coalesce(F.col(at).cast("double"), F.lit(0.0))] if at in rows.columns else []
    return first_per_key(rows, [key], [*seen, F.to_json(F.struct(*rows.columns))])


# --- community hits ---------------------------------------------------------------
def hn_hits(spark: SparkSession, path: str) -> DataFrame:
    return page_records(spark, path, *PAGES["hn"])


def admit_hn(hits: DataFrame) -> DataFrame:
    """Front-page rows need the points floor and a relevant title or url; posts tagged
    ``show_hn`` are admitted as they are. One row per object id."""
    show = F.coalesce(F.array_contains("_tags", "show_hn"), F.lit(False))
    title = F.coalesce(_present("title"), _present("story_title"))
    front = (F.coalesce("points", F.lit(0)) >= K.MIN_POINTS) & X.is_relevant(title, F.col("url"))
    admitted = hits.filter(show | front)
    named = F.coalesce("objectID", F.lit("")) != ""
    return _first_of(admitted.filter(named), "objectID", "created_at_i").unionByName(admitted.filter(~named))


def hn_items(hits: DataFrame) -> DataFrame:
    page = F.concat(F.lit("https://news.ycombinator.com/item?id="), _present("objectID"))
    stamp = F.coalesce(X.from_epoch_seconds(F.nullif("created_at_i", F.lit(0))), X.parse_dt("created_at"))
    body = F.coalesce(_present("story_text"), _present("comment_text"), F.lit(""))
    return _items(
        hits,
        source=F.lit("hn"),
        family=F.lit("community"),
        url=F.coalesce(_present("url"), page),
        title=X.strip(F.coalesce(_present("title"), _present("story_title"), F.lit(""))),
        author=F.col("author"),
        published_at=stamp,
        raw_text=X.strip(body),
        metrics=_counts(upvotes=F.col("points"), comments=F.col("num_comments")),
        raw=F.to_json(F.struct(F.col("objectID").alias("hn_id"), page.alias("hn_url"))),
    )


def read_hn(spark: SparkSession, path: str) -> DataFrame:
    return hn_items(hn_hits(spark, path))


# --- forum listings ---------------------------------------------------------------
def forum_posts(spark: SparkSession, path: str) -> DataFrame:
    return page_records(spark, path, *PAGES["reddit"]).filter("data is not null").select("data.*")


def admit_reddit(posts: DataFrame) -> DataFrame:
    shown = ~F.coalesce("stickied", F.lit(False)) & ~F.coalesce("hidden", F.lit(False))
    admitted = posts.filter(shown & (F.coalesce("score", F.lit(0)) >= K.MIN_FORUM_SCORE))
    named = F.coalesce("id", F.lit("")) != ""
    return _first_of(admitted.filter(named), "id", "created_utc").unionByName(admitted.filter(~named))


def forum_items(posts: DataFrame) -> DataFrame:
    external = F.coalesce(_present("url_overridden_by_dest"), _present("url"))
    thread = F.concat(F.lit("https://www.reddit.com"), _present("permalink"))
    shown = ~F.coalesce("stickied", F.lit(False)) & ~F.coalesce("hidden", F.lit(False))
    votes = F.coalesce(F.nullif("score", F.lit(0)), F.col("ups"))
    return _items(
        posts.filter(shown),
        source=F.lit("reddit"),
        family=F.lit("community"),
        url=F.coalesce(thread, external),
        title=X.strip(F.coalesce("title", F.lit(""))),
        author=F.col("author"),
        published_at=X.from_epoch_seconds("created_utc"),
        raw_text=X.html_to_text("selftext"),
        metrics=_counts(upvotes=votes, comments=F.col("num_comments")),
        raw=F.to_json(F.struct(
            "subreddit", F.col("id").alias("reddit_id"), external.alias("external_url"),
            F.col("link_flair_text").alias("flair"),
        )),
    )


def read_reddit(spark: SparkSession, path: str) -> DataFrame:
    return forum_items(forum_posts(spark, path))


# --- trending papers --------------------------------------------------------------
def read_hf_papers(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(PAPER_SCHEMA).json(path)
    paper_id = X.non_blank("paper.id")
    page = F.concat(F.lit("https://huggingface.co/papers/"), paper_id)
    url = F.coalesce(page, _present("url"))
    names = F.transform(
        F.slice(F.coalesce("paper.authors", F.from_json(F.lit("[]"), "array<struct<name string>>")), 1, 3),
        lambda a: X.strip(F.coalesce(a["name"], F.lit(""))),
    )
    names = F.filter(names, lambda n: n != "")
    ups = F.coalesce("paper.upvotes", F.lit(0)).cast("double")
    return _items(
        rows,
        source=F.lit("hf_papers"),
        family=F.lit("academia"),
        url=url,
        title=X.strip(F.coalesce(_present("paper.title"), _present("title"), F.lit(""))),
        author=_present(F.array_join(names, ", ")),
        published_at=X.parse_dt(F.coalesce(_present("publishedAt"), _present("paper.publishedAt"))),
        raw_text=F.left(X.strip(F.coalesce("paper.summary", F.lit(""))), F.lit(K.HTML_CHARS)),
        metrics=F.when(ups != 0, F.create_map(F.lit("hf_upvotes"), ups)).otherwise(
            F.create_map().cast("map<string,double>")
        ),
        raw=F.to_json(F.struct(paper_id.alias("arxiv_id"), url.alias("hf_link"))),
    )


def read_hf_feed(spark: SparkSession, path: str, since) -> DataFrame:
    """The feed form of the trending papers, for days without the JSON listing: votes and
    paper id are found in the text."""
    entries = recent_entries(feed_entries(spark, path), since)
    link, body = _present("link"), X.html_to_text("markup")
    ups = X.text_upvotes(body).cast("double")
    return _items(
        entries,
        source=F.lit("hf_papers"),
        family=F.lit("academia"),
        url=link,
        title=X.strip(F.coalesce("title", F.lit(""))),
        author=F.col("author"),
        published_at=F.col("dt"),
        raw_text=body,
        metrics=F.when(ups != 0, F.create_map(F.lit("hf_upvotes"), ups)).otherwise(
            F.create_map().cast("map<string,double>")
        ),
        raw=F.to_json(F.struct(
            X.first_paper_id("link", "entry_id", body).alias("arxiv_id"), link.alias("hf_link"))),
    )


# --- conference notes -------------------------------------------------------------
def _unwrapped(field: str, kind: str = "string") -> Column:
    """A note value, whether bare or wrapped as ``{"value": X}``."""
    return F.coalesce(
        F.try_variant_get("content", f"$.{field}.value", kind),
        F.try_variant_get("content", f"$.{field}", kind),
    )


def read_openreview(spark: SparkSession, path: str) -> DataFrame:
    notes = page_records(spark, path, *PAGES["openreview"])
    authors = _unwrapped("authors", "array<string>")
    listed = F.when(F.size(authors) > 0, F.array_join(F.slice(authors, 1, 6), ", "))
    millis = F.coalesce(F.nullif("cdate", F.lit(0)), F.col("tcdate"))
    page = F.concat(F.lit("https://openreview.net/forum?id="), _present("id"))
    return _items(
        notes,
        source=F.lit("openreview"),
        family=F.lit("academia"),
        url=page,
        title=X.strip(F.coalesce(_unwrapped("title"), F.lit(""))),
        author=F.coalesce(listed, F.when(authors.isNull(), _present(_unwrapped("authors")))),
        published_at=F.timestamp_millis(millis),
        raw_text=X.html_to_text(_unwrapped("abstract"), 6000),
        metrics=F.create_map().cast("map<string,double>"),
        raw=F.to_json(F.struct(
            F.col("id").alias("openreview_id"),
            F.coalesce(_unwrapped("venue"), F.lit("")).alias("venue"), "invitation",
        )),
    )


# --- XML feeds --------------------------------------------------------------------
def feed_entries(spark: SparkSession, path: str) -> DataFrame:
    """RSS items and Atom entries below one path, in one shape."""
    xml = spark.read.format("xml")
    rss = xml.option("rowTag", "item").schema(RSS_SCHEMA).load(path).select(
        "title", "link", F.col("guid").alias("entry_id"),
        F.coalesce(X.parse_dt("pubDate"), X.parse_dt("updated"), X.parse_dt("created")).alias("dt"),
        F.coalesce(_present("`content:encoded`"), _present("summary"), _present("description"),
                   F.lit("")).alias("markup"),
        F.coalesce(_present("author"), _present("`dc:creator`")).alias("author"),
        F.array().cast("array<string>").alias("categories"),
        F.col("_metadata.file_path").alias("file"),
    )
    atom = xml.option("rowTag", "entry").schema(ATOM_SCHEMA).load(path).select(
        "title",
        F.coalesce(
            F.try_element_at(F.filter("link", lambda a: F.coalesce(a["_rel"], F.lit("alternate")) == "alternate"),
                             F.lit(1))["_href"],
            F.try_element_at("link", F.lit(1))["_href"],
        ).alias("link"),
        F.col("id").alias("entry_id"),
        F.coalesce(X.parse_dt("published"), X.parse_dt("updated")).alias("dt"),
        F.coalesce(_present("content"), _present("summary"), F.lit("")).alias("markup"),
        F.try_element_at("author", F.lit(1))["name"].alias("author"),
        F.filter(F.coalesce("category._term", F.array().cast("array<string>")),
                 lambda t: t.isNotNull() & (t != "")).alias("categories"),
        F.col("_metadata.file_path").alias("file"),
    )
    return rss.unionByName(atom)


def recent_entries(entries: DataFrame, since, col: str = "dt") -> DataFrame:
    """Rows at or after ``since``; an undated row is kept and stamped with it."""
    floor = F.lit(since).cast("timestamp")
    return entries.withColumn(col, F.coalesce(F.col(col), floor)).filter(F.col(col) >= floor)


def feed_items(entries: DataFrame, source, family, chars: int = K.HTML_CHARS, author=None) -> DataFrame:
    source = source if isinstance(source, Column) else F.lit(source)
    family = family if isinstance(family, Column) else F.lit(family)
    return _items(
        entries,
        source=source,
        family=family,
        url=_present("link"),
        title=X.strip(F.coalesce("title", F.lit(""))),
        author=F.col("author") if author is None else F.coalesce("author", F.lit(author)),
        published_at=F.col("dt"),
        raw_text=X.html_to_text("markup", chars),
        metrics=F.create_map().cast("map<string,double>"),
        raw=F.to_json(F.struct(F.col("entry_id"))),
    )


def read_feed(spark: SparkSession, path: str, name: str, family: str, since) -> DataFrame:
    """A plain feed, or the newsletter feed when ``name`` is an aggregator source."""
    entries = recent_entries(feed_entries(spark, path), since)
    if name in K.AGGREGATOR_SOURCES:
        return feed_items(entries, name, family, chars=8000, author=name)
    return feed_items(entries, feed_name(F.lit(name)), family)


def read_arxiv(spark: SparkSession, path: str, since) -> DataFrame:
    entries = recent_entries(feed_entries(spark, path), since)
    wanted = X.literal_array(K.ARXIV_CATEGORIES)
    kept = entries.filter((F.size("categories") == 0) | F.arrays_overlap("categories", wanted))
    return _items(
        kept,
        source=F.lit("arxiv"),
        family=F.lit("academia"),
        url=F.coalesce(_present("link"), _present("entry_id")),
        title=X.strip(F.replace(F.coalesce("title", F.lit("")), F.lit("\n"), F.lit(" "))),
        author=F.col("author"),
        published_at=F.col("dt"),
        raw_text=X.html_to_text("markup", 6000),
        metrics=F.create_map().cast("map<string,double>"),
        raw=F.to_json(F.struct(
            F.substring_index(F.coalesce("entry_id", F.lit("")), "/", -1).alias("arxiv_id"), "categories",
        )),
    )


# --- catalogue --------------------------------------------------------------------
def feed_name(slug) -> Column:
    slug = X._c(slug)
    return F.when(F.startswith(slug, F.lit("rss:")), slug).otherwise(F.concat(F.lit("rss:"), slug))


def feed_catalogue(feeds: DataFrame) -> DataFrame:
    """One logical source per (slug, url, family) row."""
    return feeds.select(feed_name("slug").alias("name"), "slug", "url", "family")


def default_feeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(K.FEED_CATALOGUE), "slug string, url string, family string")


def catalogue_entries(spark: SparkSession, path: str, feeds: DataFrame, since) -> DataFrame:
    """All feeds at once: files land below ``<path>/<slug>/`` and meet their catalogue
    row through the folder name."""
    entries = recent_entries(feed_entries(spark, f"{path}/*"), since)
    slug = F.element_at(F.split("file", "/"), -2)
    return entries.withColumn("slug", slug).join(feed_catalogue(feeds), "slug")


# --- labelled sets ----------------------------------------------------------------
def load_golden(spark: SparkSession, path: str) -> DataFrame:
    """Labelled evaluation sets, one JSON object per file, exploded to item rows."""
    sets = spark.read.schema(GOLDEN_SCHEMA).option("multiLine", True).json(path)
    rows = sets.select(
        F.col("name").alias("set_name"), "date", "quiet_expected", "expected_overall_tier",
        F.explode("items").alias("i"),
    )
    return rows.select(
        "set_name", "date", "quiet_expected", "expected_overall_tier",
        X.item_id("i.url", "i.title", "i.raw_text").alias("id"),
        "i.source", "i.family", "i.title", "i.url", "i.author",
        X.parse_dt("i.published_at").alias("published_at"),
        F.coalesce("i.raw_text", F.lit("")).alias("raw_text"),
        F.coalesce("i.metrics", F.create_map().cast("map<string,double>")).alias("metrics"),
    )


def faults(spark: SparkSession, path: str, source: str) -> DataFrame:
    """``source, file, reason, raw``: what the reader of ``source`` could not read, or only in part."""
    if source in PAGES:
        return json_faults(spark, path, *PAGES[source], source)
    if source == "hf_papers":
        return line_faults(spark, path, PAPER_SCHEMA, source)
    return xml_faults(spark, path, {"item": RSS_SCHEMA, "entry": ATOM_SCHEMA}, source)


def _reason(exc: Exception) -> str:
    """The error condition, also of an error met while the rows were read."""
    if isinstance(exc, PySparkException) and exc.getCondition():
        return exc.getCondition()
    named = re.search(r"\[([A-Z][A-Z0-9_.]+)\]", str(exc))
    return named.group(1) if named else type(exc).__name__


def gather_sources(spark: SparkSession, readers: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(rows of all sources, audit ``source, read, reason, rows``). A source that cannot be planned, such as a
    folder that never landed, or that fails while it is read, such as a damaged archive, gives no rows and its
    reason instead of failing the run. Each source is written to the shared folder once; nothing reads it again."""
    frames, audit = [], []
    for name, read in readers.items():
        path = scratch(spark, "source")
        try:
            read().write.parquet(path)
            kept = spark.read.parquet(path)
            audit.append((name, True, None, kept.count()))
            frames.append(kept)
        except (PySparkException, Py4JJavaError) as exc:
            audit.append((name, False, _reason(exc), 0))
    if not frames:
        raise ValueError(f"no source could be read: {audit}")
    return union_sources(frames), spark.createDataFrame(audit, "source string, read boolean, reason string, rows long")


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """All sources by column name; a missing column reads as NULL."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
