"""From scored stories to the sections of a report, for all days at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyrank import constants as K
from storyrank.functions import signals as S
from storyrank.functions import text as X
from storyrank.operators.filters import drop_aggregators
from storyrank.operators.grouping import first_per_key, last_per_key, top_n
from storyrank.operators.lookup import story_items
from storyrank.operators.ranking import lead_order

FALLBACK_TLDR = "Today in AI."  # fixed value: the line used when a model gave none


def balanced_pool(items: DataFrame, n: int = K.PER_SOURCE_CAP, keys: list[str] = ()) -> DataFrame:
    """The newest ``n`` items of each source (per key of ``keys``), aggregators left out.
    The cap is the feature: a loud source must not crowd out the others."""
    pool = drop_aggregators(items)
    return top_n(pool, [*keys, "source"], [F.desc("published_at"), F.asc("id")], n).drop("pos")


def lead_key() -> Column:
    """Sort key of a lead: newsworthiness, importance, id; smaller is earlier."""
    bonus = F.when(F.col("tier") == "breakthrough", F.lit(1.0)).otherwise(F.lit(0.0))
    return F.struct(
        (-(bonus + X.announce_score("title"))).alias("a"), (-F.col("importance")).alias("b"), F.col("id").alias("c"))


def leads_of(tagged: DataFrame) -> DataFrame:
    return tagged.filter(S.is_lead("tier", "family"))


def top_stories(tagged: DataFrame, folded: DataFrame | None = None, cap: int = K.TOP_STORIES_CAP) -> DataFrame:
    """Per day the first ``cap`` kept leads with ``pos``. A day that is not quiet but has
    no lead gets its most newsworthy story, as a notable one.

    ``folded`` (day, id, lead_id) takes leads out that are shown under another."""
    leads = leads_of(tagged)
    if folded is not None:
        shown = folded.filter(F.col("id") == F.col("lead_id")).select("day", "id")
        leads = leads.join(shown, ["day", "id"], "left_semi")
    first = top_n(leads, ["day"], lead_order(), cap)
    idle = tagged.filter(F.col("day_tier") != "quiet_day").join(
        leads.select("day").distinct(), "day", "left_anti")
    best = first_per_key(
        idle.withColumn("__a", X.announce_score("title")), ["day"],
        [-F.col("importance"), -F.col("__a"), F.col("id")])
    promoted = best.drop("__a").withColumn("tier", F.lit("notable")).withColumn("pos", F.lit(1))
    return first.unionByName(promoted)


def non_leads(tagged: DataFrame, tops: DataFrame, folded: DataFrame | None = None) -> DataFrame:
    """Stories that are neither a top story nor folded into another lead."""
    rest = tagged.join(tops.select("day", "id"), ["day", "id"], "left_anti")
    if folded is not None:
        absorbed = folded.filter(F.col("id") != F.col("lead_id")).select("day", "id")
        rest = rest.join(absorbed, ["day", "id"], "left_anti")
    return rest


def briefs(rest: DataFrame, cap: int = K.BRIEF_CAP) -> DataFrame:
    """The first ``cap`` remaining stories per day and family by rank, with ``pos``."""
    return top_n(rest, ["day", "family"], [F.desc("final_rank"), F.asc("id")], cap)


def section_rows(tops: DataFrame, brief_rows: DataFrame) -> DataFrame:
    """Report rows: day, section (0 is the top section), pos and the story columns."""
    order = F.coalesce(F.array_position(X.literal_array(K.FAMILIES), F.col("family")), F.lit(0)).cast("int")
    a = tops.withColumn("section", F.lit(0))
    b = brief_rows.withColumn("section", order)
    return a.unionByName(b, allowMissingColumns=True)


def _column_or(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def assemble_daily(
    rows: DataFrame, days: DataFrame, intros: DataFrame | None = None, tldrs: DataFrame | None = None
) -> DataFrame:
    """One nested digest per day of ``days`` (day, day_tier).

    ``rows`` are section_rows, with takeaway, why_it_matters, links and tags where they
    exist; ``intros`` (day, family, intro) and ``tldrs`` (day, tldr) come from a model.
    A digest holds at most the top stories and the capped briefs of each family."""
    summary = F.struct(
        F.col("id").alias("story_id"), "title", "family", "tier",
        F.coalesce(_column_or(rows, "takeaway", "string"), F.lit("")).alias("takeaway"),
        F.coalesce(_column_or(rows, "why_it_matters", "string"), F.lit("")).alias("why_it_matters"),
        F.coalesce(_column_or(rows, "links", "array<string>"), F.array().cast("array<string>")).alias("links"),
        F.coalesce(_column_or(rows, "tags", "array<string>"), F.array().cast("array<string>")).alias("tags"),
        F.col("final_rank").alias("score"),
    )
    per_section = rows.groupBy("day", "section").agg(
        F.array_sort(F.collect_list(F.struct("pos", summary.alias("s")))).alias("ss"))
    first_family = F.col("ss")[0]["s"]["family"]
    headings = X.literal_array([K.TOP_HEADING, *[K.FAMILY_HEADINGS[f] for f in K.FAMILIES]])
    named = per_section.select(
        "day", "section", first_family.alias("family"),
        F.element_at(headings, F.col("section") + 1).alias("heading"),
        F.transform("ss", lambda e: e["s"]).alias("summaries"),
    )
    if intros is None:
        named = named.withColumn("intro", F.lit(""))
    else:
        given = intros.select("day", "family", F.col("intro").alias("__intro"))
        named = named.join(given, ["day", "family"], "left").withColumn(
            "intro", F.when(F.col("section") > 0, F.coalesce("__intro", F.lit(""))).otherwise(F.lit("")))
    nested = named.groupBy("day").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("section", F.struct("family", "heading", "intro", "summaries").alias("s")))),
            lambda e: e["s"],
        ).alias("sections"))
    out = days.select("day", "day_tier").join(nested, "day", "left")
    if tldrs is not None:
        out = out.join(tldrs.select("day", F.col("tldr").alias("__tldr")), "day", "left")
    given = F.col("__tldr") if tldrs is not None else F.lit(None).cast("string")
    quiet = (F.col("day_tier") == "quiet_day") | F.col("sections").isNull()
    tldr = F.when(
        quiet, F.when(F.col("sections").isNull(), K.QUIET_TLDR).otherwise(K.QUIET_TLDR_BRIEF)
    ).otherwise(F.coalesce(X.non_blank(X.clip(given, 220)), F.lit(FALLBACK_TLDR)))
    ids = F.flatten(F.transform("sections", lambda s: F.transform(s["summaries"], lambda m: m["story_id"])))
    return out.select(
        F.concat(F.lit("daily-"), F.col("day").cast("string")).alias("id"),
        F.lit("daily").alias("kind"), F.col("day").cast("string").alias("date"), tldr.alias("tldr"),
        F.col("day_tier").alias("overall_tier"), (F.col("day_tier") == "quiet_day").alias("quiet_day"),
        "sections", F.coalesce(ids, F.array().cast("array<string>")).alias("story_ids"),
    )


def grounding_titles(rows: DataFrame) -> DataFrame:
    """Per day the titles a one-line summary may speak of: leads, then the first briefs."""
    lead = F.col("section") == 0
    ordered = F.array_sort(F.collect_list(F.struct("section", "pos", "title", lead.alias("lead"))))
    per_day = rows.groupBy("day").agg(ordered.alias("r"))
    tops = F.filter("r", lambda e: e["lead"])
    rest = F.slice(F.filter("r", lambda e: ~e["lead"]), 1, 6)
    titles = F.transform(F.concat(tops, rest), lambda e: e["title"])
    return per_day.select("day", F.slice(titles, 1, K.GROUNDING_TITLES_CAP).alias("titles"))


# --- source text ------------------------------------------------------------------
def source_line() -> Column:
    """Head and body line of an item in a source block."""
    body = F.replace(X.strip(F.coalesce("raw_text", F.lit(""))), F.lit("\n"), F.lit(" "))
    cut = F.when(
        F.length(body) > K.SOURCE_CHARS,
        F.concat(X.rstrip(F.left(body, F.lit(K.SOURCE_CHARS))), F.lit("…"))).otherwise(body)
    head = X.rstrip(F.concat(F.lit("- ["), "source", F.lit("] "), "title"))
    link = F.when(F.col("url") != "", F.concat(F.lit(" ("), "url", F.lit(")"))).otherwise(F.lit(""))
    return F.concat_ws("\n", F.concat(head, F.coalesce(link, F.lit(""))),
                       F.when(cut != "", F.concat(F.lit("  "), cut)))


def source_blocks(stories: DataFrame, members: DataFrame, items: DataFrame, cap: int = K.SOURCE_ITEMS_CAP) -> DataFrame:
    """``(story_id, block)``: head and body line of the first ``cap`` items of each story. Where the items have a
    ``source_line``, their bodies need not come along."""
    done = "source_line" in items.columns
    placed = story_items(stories, members, items).select(
        "story_id", "ord", "item_id", *(["source_line"] if done else ["source", "title", "url", "raw_text"]))
    few = top_n(placed, ["story_id"], [F.asc("ord"), F.asc("item_id")], cap)
    line = F.col("source_line") if done else source_line()
    blocks = few.groupBy("story_id").agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda e: e["l"]), "\n").alias("block"))
    out = stories.select(F.col("id").alias("story_id"), "title").join(blocks, "story_id", "left")
    none = F.concat(F.lit("(no source text available; title: "), F.coalesce("title", F.lit("")), F.lit(")"))
    return out.select("story_id", F.coalesce("block", none).alias("block"))


def story_links(stories: DataFrame, members: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """``(story_id, links)``: the first ``n`` different urls, representative first."""
    placed = story_items(stories, members, items).filter(F.col("url") != "").select("story_id", "ord", "url")
    once = placed.groupBy("story_id", "url").agg(F.min("ord").alias("ord"))
    few = top_n(once, ["story_id"], [F.asc("ord"), F.asc("url")], n)
    return few.groupBy("story_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "url"))), lambda e: e["url"]).alias("links"))


def snippets(stories: DataFrame, items: DataFrame) -> DataFrame:
    """``(id, snippet)``: the start of the representative's text."""
    bodies = items.select(F.col("id").alias("representative_item_id"), X.snippet("raw_text").alias("snippet"))
    return stories.join(bodies, "representative_item_id", "left").select(
        "id", F.coalesce("snippet", F.lit("")).alias("snippet"))


# --- weeks ------------------------------------------------------------------------
def week_stories(stories: DataFrame, week_of: str | None = None, day: str = "day") -> DataFrame:
    """Stories of each week (or one week), the first day's row of a story id standing."""
    rows = stories.withColumn("week_of", X.week_of(day))
    if week_of is not None:
        monday = F.lit(week_of).cast("date")
        rows = rows.filter(F.col(day).between(monday, F.date_add(monday, 6)))
    return first_per_key(rows, ["week_of", "id"], [F.col(day), -F.col("final_rank")])


def weekly_blocks(week: DataFrame, blocks: DataFrame, cap: int = K.WEEKLY_BLOCKS_CAP) -> DataFrame:
    """``(week_of, blocks)``: headed source blocks of the week's first stories."""
    few = top_n(week, ["week_of"], [F.desc("final_rank"), F.asc("id")], cap)
    joined = few.join(blocks.select(F.col("story_id").alias("id"), "block"), "id", "left")
    head = F.concat(
        F.lit("### ["), "tier", F.lit("] "), "title", F.lit(" (family="), "family", F.lit(", mentions="),
        F.col("mention_count").cast("string"), F.lit(")\n"), F.coalesce("block", F.lit("")))
    return joined.groupBy("week_of").agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", head.alias("b")))), lambda e: e["b"]), "\n\n").alias("blocks"))


def latest_digest(digests: DataFrame, kind: str | None = None) -> DataFrame:
    """The newest digest of each kind by date, then creation."""
    rows = digests if kind is None else digests.filter(F.col("kind") == kind)
    return last_per_key(rows, ["kind"], ["date", "created_at", "id"])
