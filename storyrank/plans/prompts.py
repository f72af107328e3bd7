"""Prompt and response tables around a plug-in model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyrank import constants as K
from storyrank.functions import text as X

# Our own wording; the placeholders are what the table fills in.
SYSTEM = "You write short, exact notes for an expert reader. State only what the sources say."
TEMPLATE = (
    "Write the note for one story.\nTitle: {title}\nFamily: {family}\nTier: {tier}\n"
    "Mentions: {mention_count}\nReader follows: {subfields}\n\nSources:\n{sources}\n\n"
    "Depth: {tier_instruction}\n"
    'Answer with JSON: {"takeaway": "...", "why_it_matters": "...", "tags": ["..."]}'
)
TIER_INSTRUCTIONS = {
    "breakthrough": "several sentences: what it is, how it works, the background and the open question.",
    "notable": "two to four sentences: the result, the change against earlier work, the reason it matters.",
    "minor": "exactly one line: name it and say what it is.",
    "quiet_day": "say plainly that nothing major happened.",
}


def fill(template: str, values: dict[str, Column]) -> Column:
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def prompt_rows(
    stories: DataFrame, blocks: DataFrame, subfields: list[str],
    system: str = SYSTEM, template: str = TEMPLATE, instructions: dict[str, str] = TIER_INSTRUCTIONS,
) -> DataFrame:
    """One row per story (id, title, family, tier, mention_count, is_thin).

    A thin story is written at minor depth. A quiet-day story has no prompt: its fixed
    line is in ``takeaway``, so no model is asked for it."""
    quiet = F.col("tier") == "quiet_day"
    depth = F.when(F.col("is_thin"), F.lit("minor")).otherwise(F.col("tier"))
    joined = stories.join(blocks.select(F.col("story_id").alias("id"), "block"), "id", "left")
    prompt = fill(template, {
        "tier_instruction": F.try_element_at(X.literal_map(instructions), depth),
        "tier": depth, "family": F.col("family"), "mention_count": F.col("mention_count"),
        "subfields": F.lit("; ".join(subfields)), "title": F.col("title"), "sources": F.col("block"),
    })
    return joined.select(
        F.col("id").alias("story_id"), "tier",
        F.when(~quiet, depth).alias("gen_tier"),
        F.when(~quiet, F.lit(system)).alias("system"),
        F.when(~quiet, prompt).alias("prompt"),
        F.when(quiet, F.lit(K.QUIET_TAKEAWAY)).alias("takeaway"),
    )


def response_rows(responses: DataFrame, catalogue: list[str]) -> DataFrame:
    """Model answers (story_id, title, gen_tier, response, ground) to summary columns:
    ungrounded sentences dropped, lengths capped, tags in the catalogue's spelling; the
    title stands in for an empty takeaway."""
    obj = X.parse_json_obj("response")
    parsed = responses.withColumn("__o", obj).select(
        "story_id", "title", "gen_tier", "ground",
        X.strip(F.coalesce(F.try_variant_get("__o", "$.takeaway", "string"), F.lit(""))).alias("t"),
        X.strip(F.coalesce(F.try_variant_get("__o", "$.why_it_matters", "string"), F.lit(""))).alias("w"),
        F.coalesce(F.try_variant_get("__o", "$.tags", "array<string>"), F.array().cast("array<string>")).alias("g"),
    )
    limit = F.coalesce(F.try_element_at(X.literal_map(K.TAKEAWAY_LIMITS), F.col("gen_tier")), F.lit(700))
    kept = parsed.select(
        "*", X.strip_ungrounded("t", "ground")["text"].alias("kt"),
        X.strip_ungrounded("w", "ground")["text"].alias("kw"))
    text = F.coalesce(F.nullif("kt", F.lit("")), F.col("title"))
    return kept.select(
        "story_id", X.clip(text, limit).alias("takeaway"), X.clip("kw", K.WHY_LIMIT).alias("why_it_matters"),
        X.canonical_tags("g", catalogue).alias("tags"),
    )


def apply_keep(stories: DataFrame, responses: DataFrame) -> DataFrame:
    """Curated stories. ``stories`` (batch, pos from 0, family, ...) were listed from 1 to a
    model that answered ``responses`` (batch, response) with ``{"keep": [...]}`` of numbers
    or of objects with ``n`` and ``family``. Adds ``ord``, the place in the answer; a batch
    with no usable answer keeps everything."""
    entries = F.try_variant_get(X.parse_json_obj("response"), "$.keep", "array<variant>")
    listed = responses.select("batch", F.posexplode(entries).alias("ord", "e"))
    is_obj = F.startswith(F.schema_of_variant("e"), F.lit("OBJECT"))
    raw = F.when(is_obj, F.try_variant_get("e", "$.n", "string")).otherwise(F.try_variant_get("e", "$", "string"))
    number = F.when(F.rlike(raw, F.lit(r"^\s*[+-]?\d+(\.\d+)?\s*$")), raw.try_cast("double").cast("bigint"))
    picks = listed.select(
        "batch", (number - 1).alias("pos"), F.col("ord").cast("bigint").alias("ord"),
        F.when(is_obj, F.try_variant_get("e", "$.family", "string")).alias("__family"),
    ).filter(F.col("pos") >= 0)
    once = picks.groupBy("batch", "pos").agg(
        F.min("ord").alias("ord"), F.min_by("__family", "ord").alias("__family"))
    kept = stories.withColumn("pos", F.col("pos").cast("bigint")).join(once, ["batch", "pos"]).withColumn(
        "family", F.when(F.col("__family").isin(*K.FAMILIES), F.col("__family")).otherwise(F.col("family")))
    kept = kept.drop("__family")
    whole = stories.join(kept.select("batch").distinct(), "batch", "left_anti").withColumn(
        "ord", F.col("pos").cast("bigint"))
    return kept.select(*stories.columns, "ord").unionByName(whole)
