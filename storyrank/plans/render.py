"""Reports and linked notes as text columns: one row per report, built by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyrank import constants as K
from storyrank.functions import text as X


def tier_label(tier) -> Column:
    known = F.try_element_at(X.literal_map(K.TIER_LABELS), X._c(tier))
    return F.coalesce(known, F.upper(X._c(tier)))


def _join(parts: list[Column], sep: str) -> Column:
    """The parts that are not NULL."""
    return F.concat_ws(sep, *parts)


def _given(col: Column) -> Column:
    return F.nullif(X.strip(F.coalesce(col, F.lit(""))), F.lit(""))


def _links(links: Column) -> Column:
    each = F.transform(links, lambda u: F.concat(F.lit("["), X.link_label(u), F.lit("]("), u, F.lit(")")))
    return F.when(F.size(links) > 0, F.array_join(each, " · "))


def section_heading(section: Column) -> Column:
    """The heading behind its family sign, unless it starts with a sign of its own."""
    h = X.strip(section["heading"])
    sign = F.coalesce(F.try_element_at(X.literal_map(K.FAMILY_EMOJI), section["family"]), F.lit(""))
    return F.when((h != "") & (F.ascii(h) > 0x2000), h).otherwise(X.strip(F.concat(sign, F.lit(" "), h)))


def _full(s: Column) -> Column:
    tags = F.array_join(F.transform(s["tags"], lambda t: F.concat(F.lit("`"), t, F.lit("`"))), ", ")
    return _join([
        F.concat(F.lit("**"), X.strip(s["title"]), F.lit("** · `"), tier_label(s["tier"]), F.lit("`")),
        _given(s["takeaway"]),
        F.concat(F.lit("*Why it matters:* "), _given(s["why_it_matters"])),
        F.when(F.size(s["tags"]) > 0, F.concat(F.lit("Tags: "), tags)),
        _links(s["links"]),
    ], "\n\n")


def _brief(s: Column) -> Column:
    tail = F.coalesce(F.concat(F.lit(" — "), _links(s["links"])), F.lit(""))
    return F.concat(F.lit("- **"), X.strip(s["title"]), F.lit("**"), tail)


def _split(section: Column) -> tuple[Column, Column]:
    full = F.filter(section["summaries"], lambda s: _given(s["takeaway"]).isNotNull())
    brief = F.filter(section["summaries"], lambda s: _given(s["takeaway"]).isNull())
    return full, brief


def _section(section: Column) -> Column:
    full, brief = _split(section)
    empty = _given(section["intro"]).isNull() & (F.size(section["summaries"]) == 0)
    return _join([
        F.concat(F.lit("## "), section_heading(section)),
        _given(section["intro"]),
        F.when(F.size(full) > 0, F.array_join(F.transform(full, _full), "\n\n")),
        F.when(F.size(brief) > 0, F.array_join(F.transform(brief, _brief), "\n")),
        F.when(empty, F.lit("_Nothing notable._")),
    ], "\n\n")


def _no_sections() -> Column:
    return F.col("quiet_day") & (F.coalesce(F.size("sections"), F.lit(0)) <= 0)


def render_daily(digests: DataFrame) -> DataFrame:
    """``(id, md)`` of nested daily digests."""
    body = F.when(F.size("sections") > 0, F.array_join(F.transform("sections", _section), "\n\n"))
    md = _join([
        F.concat(F.lit("# Daily — "), "date"),
        F.concat(F.lit("`"), tier_label("overall_tier"), F.lit("` · "), F.size("story_ids").cast("string"), F.lit(" stories")),
        F.concat(F.lit("> "), _given(F.col("tldr"))),
        F.when(_no_sections(), F.lit("_Quiet day — nothing major shipped._")),
        body,
    ], "\n\n")
    return digests.select("id", F.concat(X.strip(md), F.lit("\n")).alias("md"))


def _entries(title: str, entries: Column) -> Column:
    def line(e):
        link = F.when(
            e["url"] != "", F.concat(F.lit("["), X.strip(e["title"]), F.lit("]("), e["url"], F.lit(")")))
        return F.concat(F.lit("- "), F.coalesce(link, X.strip(e["title"])), F.lit(" — "), X.strip(e["one_liner"]))

    return F.when(F.size(entries) > 0, F.concat(
        F.lit(f"## {title}\n"), F.array_join(F.transform(entries, line), "\n")))


SHORTLIST_TITLE, RADAR_TITLE = "What I'd actually read this week", "On my radar"  # fixed values


def render_weekly(digests: DataFrame) -> DataFrame:
    """``(id, md)`` of weekly digests (id, week_of, title, lede, body_markdown, overall_tier,
    quiet_week, shortlist, on_my_radar)."""
    md = _join([
        F.concat(F.lit("# "), X.strip("title")),
        F.concat(F.lit("`"), tier_label("overall_tier"), F.lit("` · Week of "), "week_of"),
        F.concat(F.lit("_"), _given(F.col("lede")), F.lit("_")),
        F.when(F.col("quiet_week"), F.lit("_Quiet week — little of consequence shipped._")),
        _given(F.col("body_markdown")),
        _entries(SHORTLIST_TITLE, F.col("shortlist")),
        _entries(RADAR_TITLE, F.col("on_my_radar")),
    ], "\n\n")
    return digests.select("id", F.concat(X.strip(md), F.lit("\n")).alias("md"))


def condensed(
    digests: DataFrame, name: str = "Digest", per_section: int = K.CONDENSED_PER_SECTION, limit: int = K.CONDENSED_CHARS
) -> DataFrame:
    """``(id, body)``: plain text with every lead and the first few briefs per section."""
    def lines(section):
        full, brief = _split(section)
        lead = F.transform(full, lambda s: F.concat(
            F.lit("• ["), tier_label(s["tier"]), F.lit("] "), X.strip(s["title"])))
        rest = F.transform(F.slice(brief, 1, per_section), lambda s: F.concat(F.lit("• "), X.strip(s["title"])))
        return F.array_join(F.concat(F.array(F.lit(""), section_heading(section)), lead, rest), "\n")

    full = _join([
        F.concat(F.lit(f"🗞️ {name} — "), "date", F.lit("  ·  "), tier_label("overall_tier")),
        F.concat(F.lit("\n"), _given(F.col("tldr"))),
        F.when(F.size("sections") > 0, F.array_join(F.transform("sections", lines), "\n")),
        F.when(_no_sections(), F.lit("\nNothing notable today.")),
        F.lit("\nFull takeaways → your email / the web dashboard."),
    ], "\n")
    cut = F.concat(X.rstrip(F.left(full, F.lit(limit - 1))), F.lit("…"))
    return digests.select("id", F.when(F.length(full) > limit, cut).otherwise(full).alias("body"))


# --- linked notes -----------------------------------------------------------------
def note_tags(tags, family) -> Column:
    """Sorted tag tokens of a story, its family among them."""
    return F.array_sort(F.array_union(
        F.transform(X._c(tags), lambda t: X.slugify(t)), F.array(X.slugify(family))))


def _front(fields: list[tuple[str, Column]], tags: Column) -> Column:
    lines = [F.lit("---")]
    lines += [F.concat(F.lit(f"{k}: "), v) for k, v in fields]
    listed = F.array_join(F.transform(tags, lambda t: F.concat(F.lit("  - "), t)), "\n")
    return _join([*lines, F.lit("tags:"), listed, F.lit("---")], "\n")


def _bool(col) -> Column:
    return F.when(X._c(col), "true").otherwise("false")


def _wikilink(path: Column, alias: Column) -> Column:
    return F.concat(F.lit("[["), path, F.lit("|"), X.strip(alias), F.lit("]]"))


def _story_path(s: Column) -> Column:
    return F.concat(F.lit("stories/"), X.slugify(s["title"]))


def daily_notes(digests: DataFrame, wiki_tag: str = "digest") -> DataFrame:
    """``(path, content, ord)``: a note per summary and a note per daily issue."""
    flat = digests.select(
        "date", F.posexplode("sections").alias("sec", "section"),
    ).select("date", "sec", F.posexplode("section.summaries").alias("no", "s"))
    s = F.col("s")
    tags = note_tags(s["tags"], s["family"])
    back = F.concat(F.lit("[[daily/"), "date", F.lit("|Daily "), "date", F.lit("]]"))
    story = _join([
        _front([("title", X.strip(s["title"])), ("type", F.lit("story")), ("family", s["family"]), ("tier", s["tier"])],
               F.concat(F.array(F.lit(wiki_tag)), tags)),
        F.lit(""), F.concat(F.lit("# "), X.strip(s["title"])), F.lit(""),
        _given(s["takeaway"]),
        F.concat(F.lit("\n**Why it matters:** "), _given(s["why_it_matters"])),
        F.when(F.size(s["links"]) > 0, F.concat(
            F.lit("\n## Sources\n"), F.array_join(F.transform(s["links"], lambda u: F.concat(F.lit("- "), u)), "\n"))),
        F.concat(F.lit("\n"), F.array_join(F.transform(tags, lambda t: F.concat(F.lit("#"), t)), " ")),
        F.concat(F.lit("\nFrom "), back),
    ], "\n")
    stories = flat.select(
        F.concat(_story_path(s), F.lit(".md")).alias("path"),
        F.concat(X.strip(story), F.lit("\n")).alias("content"),
        F.struct("date", F.col("sec").cast("int").alias("sec"), F.col("no").cast("int").alias("no")).alias("ord"),
    )

    def listed(m):
        line = F.concat(F.lit("- "), _wikilink(_story_path(m), m["title"]), F.lit(" · `"), m["tier"], F.lit("`"))
        return _join([line, F.concat(F.lit("  - "), _given(m["takeaway"]))], "\n")

    def block(section):
        rows = F.when(F.size(section["summaries"]) > 0, F.array_join(F.transform(section["summaries"], listed), "\n"))
        return F.concat(F.lit("## "), X.strip(section["heading"]), F.lit("\n"),
                        F.coalesce(rows, F.lit("_Nothing notable._")), F.lit("\n"))

    used = F.array_sort(F.array_distinct(F.flatten(F.flatten(F.transform(
        F.coalesce("sections", F.array()), lambda x: F.transform(x["summaries"], lambda m: F.transform(m["tags"], lambda t: X.slugify(t))))))))
    none = F.array().cast("array<string>")
    issue = _join([
        _front([("title", F.concat(F.lit("Daily — "), "date")), ("type", F.lit("daily")), ("date", F.col("date")),
                ("tier", F.col("overall_tier")), ("quiet", _bool("quiet_day"))],
               F.concat(F.array(F.lit(wiki_tag), F.lit("daily")), F.coalesce(used, none))),
        F.lit(""), F.concat(F.lit("# Daily — "), "date"), F.lit(""),
        F.concat(F.lit("`"), "overall_tier", F.lit("` · "), F.size("story_ids").cast("string"), F.lit(" stories")), F.lit(""),
        F.concat(F.lit("> "), _given(F.col("tldr")), F.lit("\n")),
        F.when(_no_sections(), F.lit("_Quiet day — nothing major shipped._")),
        F.when(F.size("sections") > 0, F.array_join(F.transform("sections", block), "\n")),
    ], "\n")
    issues = digests.select(
        F.concat(F.lit("daily/"), "date", F.lit(".md")).alias("path"),
        F.concat(X.strip(issue), F.lit("\n")).alias("content"),
        F.struct("date", F.lit(2_000_000_000).alias("sec"), F.lit(0).alias("no")).alias("ord"))
    return stories.unionByName(issues)


def weekly_notes(digests: DataFrame, wiki_tag: str = "digest") -> DataFrame:
    """``(path, content, ord)``: the weekly issue with links to the week's editions."""
    title = F.coalesce(_given(F.col("title")), F.lit("Week at a Glance"))
    dates = F.transform(X.week_dates(F.col("week_of").cast("date")), lambda x: x.cast("string"))
    editions = F.array_join(F.transform(dates, lambda x: F.concat(
        F.lit("- [[daily/"), x, F.lit("|Daily "), x, F.lit("]]"))), "\n")
    entries = lambda name, col: F.concat(_entries(name, F.col(col)), F.lit("\n"))
    md = _join([
        _front([("title", title), ("type", F.lit("weekly")), ("week_of", F.col("week_of")),
                ("tier", F.col("overall_tier")), ("quiet", _bool("quiet_week"))],
               F.array(F.lit(wiki_tag), F.lit("weekly"))),
        F.lit(""), F.concat(F.lit("# "), title), F.lit(""),
        F.concat(F.lit("*"), _given(F.col("lede")), F.lit("*\n")),
        F.concat(F.lit("`"), "overall_tier", F.lit("` · Week of "), "week_of", F.lit("\n")),
        F.when(F.col("quiet_week"), F.lit("_Quiet week — little of consequence shipped._\n")),
        F.concat(_given(F.col("body_markdown")), F.lit("\n")),
        entries(SHORTLIST_TITLE, "shortlist"), entries(RADAR_TITLE, "on_my_radar"),
        F.concat(F.lit("## This week's editions\n"), editions),
    ], "\n")
    return digests.select(
        F.concat(F.lit("weekly/"), "id", F.lit(".md")).alias("path"),
        F.concat(X.strip(md), F.lit("\n")).alias("content"),
        F.struct(F.col("week_of").alias("date"), F.lit(2_000_000_000).alias("sec"), F.lit(0).alias("no")).alias("ord"))
