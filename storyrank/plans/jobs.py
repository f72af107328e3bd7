"""Whole runs as one plan each: every function takes tables and gives tables, and the day
(or week, or set) is a grouping key, so a backfill of many days is the same single plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyrank import constants as K
from storyrank.functions import signals as S
from storyrank.functions import text as X
from storyrank.functions.vectors import centroid
from storyrank.operators import evaluation as ev
from storyrank.operators import filters as fl
from storyrank.operators import ranking as rk
from storyrank.operators.clustering import cluster_stories, fold_leads, folded_mentions, modal_family
from storyrank.operators.feedback import interest_vector, signal_weight
from storyrank.operators.grouping import exact_rank, first_per_key, top_n
from storyrank.operators.inference import Embedder, Model, embed_missing, infer
from storyrank.operators.lookup import enrich_metrics
from storyrank.operators.tables import append_eval, export_notes, save_digests, save_state, upsert_items
from storyrank.params import Profile
from storyrank.plans import assemble as asm
from storyrank.plans import prompts as pr
from storyrank.plans import render as rn
from storyrank.session import release, stage
from storyrank.sources.landing import union_sources


# --- ingest -----------------------------------------------------------------------
def ingest(sources: list[DataFrame], target: DataFrame) -> DataFrame:
    """The item table after one ingest: all sources, the first of equal ids, upserted."""
    batches = [df.withColumn("__batch", F.lit(i)) for i, df in enumerate(sources)]
    rows = union_sources(batches)
    every = F.to_json(F.struct(*[c for c in rows.columns if c not in ("__batch", "embedding")]))
    once = first_per_key(rows, ["id"], ["__batch", every]).drop("__batch")
    return upsert_items(target, once)


# --- process ----------------------------------------------------------------------
def _every_run(runs: DataFrame) -> DataFrame:
    """The runs, one row a day, for a join with rows laid out over days. Spark's size check
    does not count what the layout multiplies and would send the laid out rows instead."""
    return F.broadcast(runs.select("run_day", "as_of"))


def run_days(items: DataFrame, runs: DataFrame, gate: bool = True) -> DataFrame:
    """Items once per run (run_day, as_of) whose look-back holds them: candidate days come
    from the item's own date, so runs and items meet on equality.

    With ``gate=False`` a run takes every item between its ``since`` (a column of ``runs``;
    without it, or null, from the beginning) and its ``as_of``, whatever the family.
    """
    if not gate:
        return _since_days(items, runs)
    span = F.when(F.col("family") == "academia", F.lit(K.ACADEMIA_LOOKBACK_HOURS)).otherwise(
        F.lit(K.NEWS_LOOKBACK_HOURS))
    at = F.col("published_at")
    reach = F.date_add(F.to_date(at), (F.ceil(span / 24) + 1).cast("int"))
    days = F.explode(F.sequence(F.to_date(at), reach, F.expr("interval 1 day"))).alias("run_day")
    joined = items.select("*", days).join(_every_run(runs), "run_day")
    micros = span.cast("bigint") * 3_600_000_000
    return joined.filter(
        (F.unix_micros(at) >= F.unix_micros("as_of") - micros) & (at <= F.col("as_of")))


MAX_OPEN_RUNS = 10_000


def _since_days(items: DataFrame, runs: DataFrame) -> DataFrame:
    since = F.col("since").cast("timestamp") if "since" in runs.columns else F.lit(None).cast("timestamp")
    open_runs = runs.select("run_day", "as_of", since.alias("__since"))
    if open_runs.count() > MAX_OPEN_RUNS:
        raise ValueError(f"more than {MAX_OPEN_RUNS} runs without a look-back at once; give them in parts")
    at = F.col("published_at")
    inside = (at <= F.col("as_of")) & (F.col("__since").isNull() | (at >= F.col("__since")))
    return items.join(F.broadcast(open_runs), inside).drop("__since")


def signalled(items: DataFrame) -> DataFrame:
    """Adds engagement, citation and score at each row's ``as_of``."""
    return items.withColumn("engagement", S.engagement("metrics")).withColumn(
        "citation", S.citation_velocity("metrics", "published_at", F.col("as_of"))
    ).withColumn("score", S.representative_score("metrics", "family", "source", "published_at", F.col("as_of")))


def run_boosts(feedback: DataFrame, runs: DataFrame, half_life_days: float = K.FEEDBACK_HALF_LIFE_DAYS) -> DataFrame:
    """``(run_day, target_id, boost)`` over the feedback window of every run. A reaction is
    laid out over the runs it counts for and summed in the same map task, so only one row
    per run and target is shuffled."""
    rows = feedback.withColumn("__w", signal_weight()).filter(F.col("__w").isNotNull())
    at = F.to_date("created_at")
    days = F.explode(F.sequence(at, F.date_add(at, K.FEEDBACK_LOOKBACK_DAYS + 3), F.expr("interval 1 day")))
    laid = rows.select("target_id", "created_at", "__w", days.alias("run_day")).join(_every_run(runs), "run_day")
    span = (K.NEWS_LOOKBACK_HOURS + 24 * K.FEEDBACK_LOOKBACK_DAYS) * 3_600_000_000
    kept = laid.filter(
        (F.unix_micros("created_at") >= F.unix_micros("as_of") - F.lit(span)) & (F.col("created_at") <= F.col("as_of")))
    return kept.groupBy("run_day", "target_id").agg(
        F.sum(F.col("__w") * S.decay("created_at", F.col("as_of"), half_life_days)).alias("boost"))


def stories_of_groups(members: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(stories, story_items) of grouped items (key, group, id, ...)."""
    order = F.struct(-F.col("score"), F.col("id"))
    rows = members.groupBy(*key, "group").agg(
        F.min_by("title", order).alias("title"), F.min_by("id", order).alias("representative_item_id"),
        F.transform(F.array_sort(F.collect_list(order)), lambda e: e["id"]).alias("item_ids"),
        F.count("*").alias("mention_count"), F.max("engagement").alias("engagement"),
        F.max("citation").alias("citation"), F.max("as_of").alias("created_at"),
    )
    out = rows.join(modal_family(members), "group").join(
        centroid(members, ["group"], "embedding").withColumnRenamed("centroid", "embedding"), "group", "left")
    out = stage(out.withColumn("id", X.story_id("title", "item_ids")))
    bridge = out.select(*key, F.col("id").alias("story_id"), F.posexplode("item_ids").alias("pos", "item_id"))
    return out, bridge


def process(
    items: DataFrame, feedback: DataFrame, runs: DataFrame, profile: Profile, interest=None,
    embedder: Embedder | None = None, papers: DataFrame | None = None, keep: DataFrame | None = None,
    per_source: int | None = K.PER_SOURCE_CAP, gate: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(stories, story_items) of every run: window, pool, enrichment, clusters, scores,
    curation, announcement floor. ``keep`` (batch = run_day, response) is the curator's
    answer; without it the fixed title rules alone curate."""
    if embedder is not None:
        items = embed_missing(items, embedder)
    items = items.withColumn("body_size", fl.body_size()).drop("raw_text")  # bodies are not laid out over the runs
    placed = run_days(items, runs, gate)
    pool = asm.balanced_pool(placed, per_source, ["run_day"]) if per_source else placed
    if papers is not None:
        raw_id = F.col("arxiv_id") if "arxiv_id" in pool.columns else F.lit(None).cast("string")
        paper = F.when(F.col("family") == "academia", X.arxiv_id(raw_id, "url"))
        pool = enrich_metrics(pool.withColumn("paper_id", paper), papers).drop("paper_id")
    rows = stage(signalled(pool).withColumn("uid", F.concat_ws("|", F.col("run_day").cast("string"), "id")))
    release(rows.sparkSession)
    groups = cluster_stories(
        rows.withColumn("id", F.col("uid")), profile.cluster_threshold, within=["run_day"])
    members = stage(rows.join(groups.withColumnRenamed("id", "uid"), "uid"))
    del rows, groups
    release(members.sparkSession)
    stories, bridge = stories_of_groups(members, ["run_day"])
    release(members.sparkSession)
    boosts = run_boosts(feedback, runs).withColumnRenamed("target_id", "id")
    boosted = stories.join(boosts, ["run_day", "id"], "left").withColumn(
        "boost", F.coalesce("boost", F.lit(0.0)))
    scored = score_runs(boosted, profile, interest)
    kept = fl.curate_prefilter(scored)
    if keep is not None:
        listed = exact_rank(kept, ["run_day"], [F.desc("final_rank"), F.asc("id")])
        listed = listed.withColumn("pos", F.col("pos") - 1).withColumn("batch", F.col("run_day"))
        kept = pr.apply_keep(listed, keep).drop("batch", "pos", "ord")
    lens = fl.source_lengths(members.withColumnRenamed("group", "story_group"), "story_group")
    floored = rk.announcement_floor(kept, lens, "group")
    return stage(floored.drop("group")), bridge


def score_runs(stories: DataFrame, profile: Profile, interest=None) -> DataFrame:
    """score_stories with the boost already on the row and ``created_at`` as the moment."""
    fit = F.lit(0.0) if interest is None else rk.personal_score(
        "embedding", interest if isinstance(interest, Column) else F.lit(list(interest)).cast("array<double>"))
    imp = S.importance(profile, F.col("created_at"))
    out = stories.withColumn("__imp", imp).withColumn("__fit", fit)
    rank = (
        profile.alpha * F.col("__imp") + profile.beta * F.col("__fit")
        + profile.gamma * S.diversity_bonus("family", profile) + F.col("boost")
        - F.when(S.is_muted("title", profile.mutes), F.lit(K.MUTE_PENALTY)).otherwise(F.lit(0.0))
    )
    rest = [c for c in stories.columns if c != "boost"]
    return out.select(*rest, F.round("__imp", 6).alias("importance"), F.round("__fit", 6).alias("personal"),
                      F.round(rank, 6).alias("final_rank"))


# --- daily ------------------------------------------------------------------------
def daily(stories: DataFrame, runs: DataFrame, tiers: dict | None = None, lead_threshold: float = K.LEAD_COSINE) -> DataFrame:
    """Nested digests of all days of ``stories`` (run_day as day); a run without stories is
    an honest quiet day."""
    rows = stories.withColumnRenamed("run_day", "day") if "run_day" in stories.columns else stories
    tagged = stage(rk.classify_stories(rows, tiers))
    leads = asm.leads_of(tagged).withColumn("pos", asm.lead_key())
    folded = stage(fold_leads(leads, lead_threshold)) if "embedding" in tagged.columns else None
    tops = stage(asm.top_stories(tagged, folded))
    report = asm.section_rows(tops, asm.briefs(asm.non_leads(tagged, tops, folded)))
    days = runs.select(F.col("run_day").alias("day")).join(rk.day_summary(rows, tiers), "day", "left")
    return asm.assemble_daily(report, days.withColumn("day_tier", F.coalesce("day_tier", F.lit("quiet_day"))))


TLDR_TEMPLATE = (
    "Sum up the day in one line of at most 200 characters, naming only what is listed.\n{titles}\n\n"
    'Answer with JSON: {"tldr": "..."}'
)


def merged_members(bridge: DataFrame, folded: DataFrame | None) -> DataFrame:
    """``(story_id, item_id, pos)``: a kept lead's own items, then those of the leads folded into it."""
    own = bridge.select("story_id", "item_id", F.col("pos").cast("bigint").alias("pos")).distinct()
    if folded is None:
        return own
    under = folded.filter("id <> lead_id").select(F.col("id").alias("story_id"), "lead_id").distinct()
    moved = own.join(under, "story_id").select(F.col("lead_id").alias("story_id"), "item_id", (F.col("pos") + (1 << 32)).alias("pos"))
    return own.unionByName(moved).groupBy("story_id", "item_id").agg(F.min("pos").alias("pos"))


def story_summaries(rows: DataFrame, members: DataFrame, items: DataFrame, profile: Profile, model: Model,
                    catalogue: list[str], n_links: int = 3) -> DataFrame:
    """``(id, links, takeaway, why_it_matters, tags)`` of the report's stories: prompts from
    their sources, the model's answers grounded in them, their links."""
    first = stage(first_per_key(rows.select("id", "title", "family", "tier", "mention_count", "representative_item_id"),
                                ["id"], ["tier", "title"]))
    placed = stage(members.join(first.select(F.col("id").alias("story_id")), "story_id", "left_semi"))
    named = placed.select(F.col("item_id").alias("id")).unionByName(
        first.select(F.col("representative_item_id").alias("id"))).distinct()
    lines = items.select("id", "url", fl.body_size().alias("body_size"), asm.source_line().alias("source_line"))
    items = stage(lines.join(named, "id", "left_semi"))  # bodies are read once, and only their lines sent on
    release(items.sparkSession)
    bodies = placed.join(items.select(F.col("id").alias("item_id"), "body_size"), "item_id")
    thin = fl.with_thin_flag(first.withColumnRenamed("id", "story_id"), bodies).withColumnRenamed("story_id", "id")
    blocks = stage(asm.source_blocks(first, placed, items))
    prompts = pr.prompt_rows(thin, blocks, list(profile.subfields))
    asked = prompts.filter(F.col("prompt").isNotNull()).select("story_id", "gen_tier", "prompt")
    answers = stage(infer(stage(asked), model)).join(blocks, "story_id").join(first.select(F.col("id").alias("story_id"), "title"), "story_id")
    written = pr.response_rows(answers.withColumnRenamed("block", "ground"), catalogue)
    quiet = prompts.filter(F.col("prompt").isNull()).select("story_id", "takeaway")
    every = written.unionByName(quiet, allowMissingColumns=True)
    links = asm.story_links(first, placed, items, n_links)
    return every.join(links, "story_id", "full").withColumnRenamed("story_id", "id")


def daily_run(
    stories: DataFrame, bridge: DataFrame, items: DataFrame, runs: DataFrame, profile: Profile, model: Model,
    catalogue: list[str], lead_threshold: float = K.LEAD_COSINE,
) -> tuple[DataFrame, DataFrame]:
    """(digests, tagged stories) of all days: tiers, folded leads with their sources, links,
    takeaways and the day's line out of the model's answers."""
    rows = stories.withColumnRenamed("run_day", "day")
    release(rows.sparkSession)
    tagged = stage(rk.classify_stories(rows, profile.tiers))
    leads = asm.leads_of(tagged).withColumn("pos", asm.lead_key())
    folded = stage(fold_leads(leads, lead_threshold))
    tops = asm.top_stories(tagged, folded)
    links = bridge.select("run_day", "story_id", "item_id", "pos")
    counts = folded_mentions(folded, links.select(F.col("run_day").alias("day"), "story_id", "item_id"))
    tops = tops.join(counts.select("day", F.col("lead_id").alias("id"), F.col("mention_count").alias("__n")), ["day", "id"], "left")
    tops = stage(tops.withColumn("mention_count", F.coalesce("__n", "mention_count")).drop("__n"))
    report = stage(asm.section_rows(tops, asm.briefs(asm.non_leads(tagged, tops, folded))))
    release(report.sparkSession)
    told = stage(story_summaries(report, merged_members(bridge, folded), items, profile, model, catalogue))
    titles = asm.grounding_titles(report)
    line = pr.fill(TLDR_TEMPLATE, {"titles": F.array_join("titles", "\n")})
    said = stage(infer(titles.select("day", line.alias("prompt")), model))
    tldrs = said.select("day", F.try_variant_get(X.parse_json_obj("response"), "$.tldr", "string").alias("tldr"))
    days = runs.select(F.col("run_day").alias("day")).join(rk.day_summary(rows, profile.tiers), "day", "left")
    days = days.withColumn("day_tier", F.coalesce("day_tier", F.lit("quiet_day")))
    return stage(asm.assemble_daily(report.join(told, "id", "left"), days, tldrs=tldrs)), tagged


def digest_table(digests: DataFrame) -> DataFrame:
    """Nested digests as rows of the digest table, the report in one JSON column."""
    return digests.select("id", "kind", F.col("date").cast("date").alias("date"), F.col("overall_tier").alias("tier"),
                          F.col("quiet_day").alias("quiet"), F.to_json(F.struct("tldr", "sections", "story_ids")).alias("content"))


def store_digests(table: DataFrame, digests: DataFrame) -> DataFrame:
    """The digest table after the run; running it again changes nothing."""
    return save_digests(table, digest_table(digests))


# --- weekly -----------------------------------------------------------------------
WEEKLY_TEMPLATE = (
    "Draft {n} of {total} of the issue for the week of {week_of} ({tier}, quiet: {quiet}).\n"
    "Reader follows: {subfields}\n\n{blocks}\n\n"
    'Answer with JSON: {"title": "...", "lede": "...", "body_markdown": "...", "shortlist": [], "on_my_radar": []}'
)
ENTRY = "array<struct<title: string, url: string, one_liner: string, family: string>>"


def _entry_rows(parsed: DataFrame, field: str, items: DataFrame) -> DataFrame:
    listed = parsed.select("week_of", F.posexplode(
        F.from_json(F.try_variant_get("__o", f"$.{field}", "variant").cast("string"), ENTRY)).alias("pos", "e"))
    flat = listed.select("week_of", "pos", "e.*").withColumn("title", F.coalesce("title", F.lit("")))
    real = fl.ground_links(flat, items)
    entry = F.struct("title", "url", F.coalesce(X.strip("one_liner"), F.lit("")).alias("one_liner"), "family")
    return real.groupBy("week_of").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", entry.alias("e")))), lambda x: x["e"]).alias(field))


def weekly(
    stories: DataFrame, members: DataFrame, items: DataFrame, profile: Profile, model: Model, judge: Model,
    n_drafts: int = 3, week_of: str | None = None, tiers: dict | None = None,
) -> DataFrame:
    """Weekly digests: the week's stories, source blocks, ``n_drafts`` drafts, the judge's
    pick, grounded links. ``stories`` carry day, id, title, family, representative_item_id."""
    week = stage(asm.week_stories(stories, week_of))
    tagged = rk.classify_stories(week, tiers, ["week_of"])
    blocks = asm.weekly_blocks(tagged, asm.source_blocks(week.select("id", "representative_item_id", "title"), members, items))
    weeks = rk.classify_days(week, tiers, ["week_of"]).select(
        "week_of", "overall_tier", F.col("quiet").alias("quiet_week")).join(blocks, "week_of", "left")
    drafts = weeks.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_drafts - 1))).alias("idx"))
    prompt = pr.fill(WEEKLY_TEMPLATE, {
        "n": F.col("idx") + 1, "total": F.lit(n_drafts), "week_of": F.col("week_of"), "tier": F.col("overall_tier"),
        "quiet": F.col("quiet_week"), "subfields": F.lit("; ".join(profile.subfields)),
        "blocks": F.coalesce("blocks", F.lit("(no stories this week)")),
    })
    answered = infer(drafts.select("week_of", "idx", prompt.alias("prompt")), model)
    judged = infer(answered.select("week_of", "idx", F.col("response").alias("draft"), F.col("response").alias("prompt")), judge)
    obj = X.parse_json_obj("response")
    scores = judged.select(
        "week_of", "idx", "draft",
        *[F.coalesce(F.try_variant_get(obj, f"$.{c}", "double"), F.lit(0.0)).alias(c) for c in K.RUBRIC_WEIGHTS])
    scores = stage(scores)
    best = ev.pick_winner(scores, ["week_of"])
    won = best.join(scores.select("week_of", F.col("idx").alias("winner"), "draft"), ["week_of", "winner"])
    parsed = won.withColumn("__o", X.parse_json_obj("draft"))
    field = lambda name: X.strip(F.coalesce(F.try_variant_get("__o", f"$.{name}", "string"), F.lit("")))
    out = weeks.drop("blocks").join(parsed, "week_of")
    body = field("body_markdown")
    out = out.select(
        X.weekly_id("week_of").alias("id"), F.lit("weekly").alias("kind"), "week_of",
        F.coalesce(F.nullif(field("title"), F.lit("")), F.concat(F.lit("Week at a Glance — "), F.col("week_of").cast("string"))).alias("title"),
        field("lede").alias("lede"),
        F.when(F.col("quiet_week") & (body == ""), "Quiet week — nothing major shipped.").otherwise(body).alias("body_markdown"),
        "overall_tier", "quiet_week", F.lit(n_drafts).alias("candidate_count"), F.col("winner").alias("winning_candidate"),
        F.create_map(*[x for c in K.RUBRIC_WEIGHTS for x in (F.lit(c), F.col(c))]).alias("eval_scores"),
    )
    empty = F.from_json(F.lit("[]"), ENTRY)
    for name in ("shortlist", "on_my_radar"):
        out = out.join(_entry_rows(parsed, name, items), "week_of", "left").withColumn(name, F.coalesce(name, empty))
    return out.withColumn("week_of", F.col("week_of").cast("string"))


# --- nightly ----------------------------------------------------------------------
def nightly(
    feedback: DataFrame, stories: DataFrame, base: DataFrame, state: DataFrame, digests: DataFrame,
    runs_log: DataFrame, as_of, dim: int, criteria: dict,
) -> tuple[DataFrame, DataFrame]:
    """(state, eval runs) after the nightly pass: the interest vector is stored, the latest
    daily digest is rendered and graded with the rubric columns ``criteria``."""
    vector = interest_vector(feedback, stories, base, as_of, dim)
    row = vector.select(
        F.lit("interest_vector").alias("key"),
        F.to_json(F.struct("vector", F.size("vector").alias("dim"))).alias("value"),
        F.lit(as_of).cast("timestamp").alias("updated_at"))
    latest = asm.latest_digest(digests, "daily")
    graded = ev.grade(
        rn.render_daily(latest).join(latest.select("id", F.col("quiet_day").alias("quiet_expected")), "id"),
        S.weighted_total({k: S.rubric_score(v) for k, v in criteria.items()}))
    scores = F.create_map(*[x for k, v in criteria.items() for x in (F.lit(k), S.rubric_score(v))],
                          F.lit("total"), F.col("total"))
    runs = graded.select(F.col("id").alias("digest_id"), scores.alias("scores"), "notes")
    return save_state(state, row), append_eval(runs_log, runs)


# --- replay -----------------------------------------------------------------------
def replay_pool(items: DataFrame, runs: DataFrame, paper_cap: int = 14, industry_cap: int = 5, now=None) -> DataFrame:
    """Items of past days (run_day, as_of): the day's first community hits with enough
    points, strictly inside the day, and a sample of papers (of the two paper sources) and
    industry posts of the last three days before ``now`` (default: the latest ``as_of``).
    The caps are the feature: a replay looks at a front page."""
    day = F.to_date("published_at")
    start = F.col("published_at") > day.cast("timestamp")
    hits = items.filter((F.col("source") == "hn") & start).withColumn("run_day", day).join(
        runs.select("run_day", "as_of"), "run_day")
    points = S.num("metrics", "upvotes")
    front = top_n(hits, ["run_day"], [points.desc(), F.asc("id")], K.REPLAY_LIMIT).drop("pos")
    front = front.filter((points >= K.REPLAY_MIN_POINTS) & X.non_blank("title").isNotNull())
    newest = [F.desc("published_at"), F.asc("id")]
    until = F.lit(now).cast("timestamp") if now is not None else F.lit(runs.agg(F.max("as_of")).scalar())
    fresh = items.withColumn("__until", until).filter(
        F.unix_micros("published_at") >= F.unix_micros("__until") - K.REPLAY_SAMPLE_HOURS * 3_600_000_000).drop("__until")
    papers = fresh.filter((F.col("family") == "academia") & F.col("source").isin(*K.PAPER_SOURCES))
    papers = top_n(papers, ["source"], newest, paper_cap)
    posts = top_n(fresh.filter(F.col("family") == "industry"), ["source"], newest, industry_cap)
    sample = papers.unionByName(posts).drop("pos")
    # The sample is bounded by the caps and belongs to every replayed day.
    every = sample.withColumn("run_day", F.explode(
        runs.agg(F.collect_list("run_day")).scalar())).join(runs.select("run_day", "as_of"), "run_day")
    # A post of the front page may be among the samples as well; it stands once a day.
    return front.unionByName(every.select(front.columns).join(front.select("run_day", "id"), ["run_day", "id"], "left_anti"))


def replay(items: DataFrame, runs: DataFrame, profile: Profile, interest=None) -> DataFrame:
    """Digests of past days: replay pool, clusters, scores, curation, assembly."""
    items = stage(items.drop("raw_text"))  # read once for hits and samples; nothing below reads a body
    rows = stage(signalled(replay_pool(items, runs)).withColumn(
        "uid", F.concat_ws("|", F.col("run_day").cast("string"), "id")))
    groups = cluster_stories(rows.withColumn("id", F.col("uid")), profile.cluster_threshold, within=["run_day"])
    stories, _ = stories_of_groups(stage(rows.join(groups.withColumnRenamed("id", "uid"), "uid")), ["run_day"])
    scored = score_runs(stories.withColumn("boost", F.lit(0.0)), profile, interest)
    return daily(fl.curate_prefilter(scored), runs, profile.tiers)


# --- evaluation -------------------------------------------------------------------
def golden_eval(
    sets: DataFrame, profile: Profile, as_of, embedder: Embedder, criteria: dict, min_total: float | None = None
) -> DataFrame:
    """Verdict per labelled set: dates moved to ``as_of``, then embed, cluster, score,
    classify, assemble, render, grade and gate."""
    sets = stage(sets)  # a file a set: read once, not again for each step
    now = F.lit(as_of).cast("timestamp")
    items = sets.withColumn("published_at", now).withColumn("as_of", now).withColumn(
        "uid", F.concat_ws("|", "set_name", "id"))
    rows = items.withColumn("item_id", F.col("id")).withColumn("id", F.col("uid")).withColumn(
        "embedding", F.lit(None).cast("array<float>"))
    rows = stage(signalled(embed_missing(rows, embedder)).drop("raw_text"))
    groups = cluster_stories(rows, profile.cluster_threshold, within=["set_name"])
    members = stage(rows.join(groups, "id"))
    stories, _ = stories_of_groups(members, ["set_name"])
    scored = score_runs(stories.withColumn("boost", F.lit(0.0)), profile).withColumnRenamed("set_name", "day")
    names = sets.select(F.col("set_name").alias("run_day"), "quiet_expected").distinct()
    digests = stage(daily(scored, names, profile.tiers))
    tagged = rk.classify_stories(scored, profile.tiers)
    big = tagged.groupBy("day").agg(F.max(F.col("tier") == "breakthrough").alias("has_breakthrough"))
    md = digests.join(rn.render_daily(digests), "id").select(F.col("date").alias("run_day"), "md", "quiet_day", "overall_tier")
    joined = md.join(names, "run_day").join(big.withColumnRenamed("day", "run_day"), "run_day", "left")
    graded = ev.grade(joined, S.weighted_total({k: S.rubric_score(v) for k, v in criteria.items()}))
    gate = ev.golden_gate("quiet_expected", "quiet_day", "quiet_ok", "notes",
                          F.coalesce("has_breakthrough", F.lit(False)) | (F.col("overall_tier") == "breakthrough"),
                          "total", min_total)
    return graded.select(F.col("run_day").alias("set_name"), "quiet_expected", "quiet_day", "overall_tier",
                         "total", "quiet_ok", gate.alias("failures"))


def recall_eval(digests: DataFrame, stories: DataFrame, k: int = K.COVERAGE_TOP_K) -> DataFrame:
    """Coverage and gate of the latest daily digest against that day's ranked stories."""
    latest = asm.latest_digest(digests, "daily").select(
        F.col("id").alias("digest_id"), F.to_date("date").alias("day"), "quiet_day", "story_ids")
    today = stories.join(latest.select("day"), "day", "left_semi")
    named = latest.select("day", F.explode("story_ids").alias("id"))
    cov = ev.coverage(today, named, k, spine=latest.select("day"))
    none = F.array().cast("array<string>")
    fails = ev.recall_gate("coverage", "top_k", none, "quiet_day")
    return cov.join(latest, "day").select(
        "digest_id", "coverage", "top_k", F.array_join("uncovered_titles", "|").alias("uncovered"),
        F.when(F.size(fails) > 0, F.array_join(fails, "; ")).otherwise("recall ok").alias("notes"))


def tuning_report(stories: DataFrame, candidates: dict = K.TIER_CANDIDATES, top: int = 20) -> DataFrame:
    """``(part, name, metric, value)``: quantiles of both scores, the top stories, and the
    tier counts under each candidate threshold set over all stories."""
    qs = {0.5: "p50", 0.75: "p75", 0.9: "p90", 1.0: "max"}
    names = X.literal_map({k: v for k, v in qs.items()})
    parts = []
    for col in ("importance", "final_rank"):
        q = rk.quantiles(stories, col, list(qs))
        parts.append(q.select(F.lit("quantile").alias("part"), F.lit(col).alias("name"),
                              F.try_element_at(names, F.col("q")).alias("metric"), "value"))
    best = stories.orderBy(F.desc("final_rank"), "id").limit(top)
    parts.append(best.select(F.lit("top"), "id", F.lit("final_rank"), "final_rank"))
    sweep = rk.tier_sweep(stories.withColumn("__all", F.lit(1)), candidates, ["__all"])
    counts = F.explode(F.array(
        *[F.struct(F.lit(t).alias("m"), F.col(t).cast("double").alias("v")) for t in K.TIERS],
        F.struct(F.lit("quiet").alias("m"), F.col("quiet").cast("double").alias("v"))))
    parts.append(sweep.select("candidate", counts.alias("c")).select(F.lit("sweep"), "candidate", "c.m", "c.v"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def wiki_export(daily_digests: DataFrame, weekly_digests: DataFrame, root: str) -> DataFrame:
    """Notes of the latest daily and the latest weekly issue, as files."""
    day = asm.latest_digest(daily_digests.withColumn("created_at", F.col("date")), "daily")
    week = weekly_digests.withColumn("kind", F.lit("weekly")).withColumn("date", F.col("week_of")).withColumn(
        "created_at", F.col("week_of"))
    notes = rn.daily_notes(day).unionByName(rn.weekly_notes(asm.latest_digest(week, "weekly")))
    return export_notes(notes, root)
