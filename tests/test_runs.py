import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from storyrank import fixtures as fx
from storyrank.functions import registry
from storyrank.operators.inference import HashEmbedder, fit_dim
from storyrank.params import Profile
from storyrank.plans import jobs
from storyrank.plans import render as rn
from storyrank.sources import scans

ROWS = {"SRC": 20, "SNK": 11, "FLT": 20, "TXT": 27, "SIG": 17, "JON": 10, "AGG": 25, "WIN": 12, "SRT": 3,
        "SET": 4, "RND": 7, "PIP": 10, "STR": 6, "UDF": 6}
BESIDE = {"SRC-12-saved", "SRC-12-faults", "SRC-16-faults", "SRC-18-entries", "SET-01-audit"}  # malformed and partial input
AS_OF = "2024-01-31 00:00:00"


def test_every_inventory_row_has_a_query():
    wanted = {f"{k}-{i:02d}" for k, n in ROWS.items() for i in range(1, n + 1)}
    assert len(wanted) == 178
    own = {q for q in entry_module.queries() if not q.startswith("op") and q != "pipeline"}
    assert wanted | {"FLAGSHIP"} | BESIDE == own
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_oracles_do_not_thin_out_tables():
    for key, sql in entry_module.oracle_sql().items():
        assert not re.search(r"(?i)tablesample|using sample", sql), key


@pytest.mark.parametrize("key", ["FLAGSHIP", "AGG-14", "WIN-07", "JON-02", "SNK-05", "RND-03"])
def test_query_equals_oracle_on_small_tables(spark, small, key):
    con = duckdb.connect()
    for t in ("orders", "events", "documents", "embeddings", "pages", "labels", "conversations", "part", "supplier", "lineitem"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    cur = con.execute(entry_module.oracle_sql()[key])
    names = [c[0] for c in cur.description]
    want = sorted(map(repr, (dict(zip(sorted(names), [r[names.index(n)] for n in sorted(names)], strict=True)) for r in cur.fetchall())))
    df = entry_module.queries()[key](spark, small)
    got = sorted(map(repr, ({n: r[n] for n in sorted(df.columns)} for r in df.collect())))
    assert got == want and got


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["day", "id", "tier", "importance", "final_rank", "pos"] and df.count() > 0


def items(spark):
    """A launch told by three sources, an unrelated paper, a recap and a stale post."""
    rows = [
        ("a", "hn", "community", "https://n/1", "OpenLab unveils Foo model", 1, [1.0, 0.0, 0.0], 2400.0),
        ("b", "rss:lab", "industry", "https://lab/foo", "OpenLab unveils Foo model today", 2, [0.99, 0.1, 0.0], 0.0),
        ("c", "reddit", "community", "https://r/1", "Foo model discussion", 3, [0.98, 0.0, 0.15], 900.0),
        ("d", "arxiv", "academia", "https://arxiv.org/abs/2401.00001", "Unrelated paper", 60, [0.0, 1.0, 0.0], 0.0),
        ("e", "blog", "meta", "https://b/1", "Weekly recap: all the news", 2, [0.0, 0.0, 1.0], 0.0),
        ("f", "blog2", "industry", "https://c/1", "Stale note", 60, [0.5, 0.5, 0.5], 50.0),
        ("g", "smol.ai", "meta", "https://d/1", "Mirror", 1, [1.0, 0.0, 0.0], 9999.0),
    ]
    df = spark.createDataFrame(rows, "id string, source string, family string, url string, title string, h int, embedding array<float>, up double")
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(AS_OF)) - F.col("h") * 3600)
    return df.select("id", "source", "family", "url", "title", at.alias("published_at"), F.lit("body " * 60).alias("raw_text"),
                     "embedding", F.create_map(F.lit("upvotes"), "up").alias("metrics"))


def one_run(spark):
    return spark.sql(f"select date '2024-01-30' as run_day, timestamp '{AS_OF}' as as_of")


def no_feedback(spark):
    return spark.createDataFrame([], "target_id string, signal string, value double, created_at timestamp")


def test_busy_day_end_to_end(spark):
    stories, bridge = jobs.process(items(spark), no_feedback(spark), one_run(spark), Profile(), [1.0, 0.0, 0.0])
    got = {r["representative_item_id"]: r for r in stories.collect()}
    assert set(got) == {"a", "d"}
    assert got["a"]["mention_count"] == 3 and got["a"]["item_ids"] == ["a", "c", "b"]
    assert got["a"]["importance"] >= 0.55 and got["d"]["importance"] < 0.32
    assert {r["item_id"] for r in bridge.filter(F.col("story_id") == got["a"]["id"]).collect()} == {"a", "b", "c"}
    digest = jobs.daily(stories, one_run(spark))
    d = digest.first()
    assert d["overall_tier"] == "breakthrough" and d["sections"][0]["summaries"][0]["story_id"] == got["a"]["id"]
    assert d["story_ids"] == [got["a"]["id"], got["d"]["id"]]
    md = rn.render_daily(digest).first()["md"]
    assert md.startswith("# Daily — 2024-01-30\n\n`BREAKTHROUGH` · 2 stories\n\n> ") and "## ⚡ Top Stories" in md
    again, _ = jobs.process(items(spark).repartition(5), no_feedback(spark), one_run(spark), Profile(), [1.0, 0.0, 0.0])
    pick = ["id", "importance", "personal", "final_rank", "mention_count"]
    assert sorted(map(tuple, again.select(pick).collect())) == sorted(map(tuple, stories.select(pick).collect()))


def test_day_without_stories_is_quiet(spark):
    none = items(spark).filter("id = 'f'")
    stories, _ = jobs.process(none, no_feedback(spark), one_run(spark), Profile())
    d = jobs.daily(stories, one_run(spark)).first()
    assert d["quiet_day"] and d["tldr"] == "Quiet day — nothing major shipped." and d["story_ids"] == []
    md = rn.render_daily(jobs.daily(stories, one_run(spark))).first()["md"]
    assert md.endswith("_Quiet day — nothing major shipped._\n")


def test_many_runs_equal_single_runs(spark):
    days = spark.sql("select explode(array(date '2024-01-29', date '2024-01-30')) as run_day").withColumn(
        "as_of", F.date_add("run_day", 1).cast("timestamp"))
    both, _ = jobs.process(items(spark), no_feedback(spark), days, Profile())
    last, _ = jobs.process(items(spark), no_feedback(spark), days.filter("run_day = '2024-01-30'"), Profile())
    pick = ["id", "importance", "final_rank"]
    assert sorted(map(tuple, both.filter("run_day = '2024-01-30'").select(pick).collect())) == sorted(
        map(tuple, last.select(pick).collect()))


def test_ingest_twice_is_once(spark, small):
    fresh = items(spark).select("id", "source", "title", "url", "embedding")
    target = fresh.limit(0)
    once = jobs.ingest([fresh, fresh], target)
    twice = jobs.ingest([fresh.withColumn("embedding", F.lit(None).cast("array<float>"))], once)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_streamed_throttle_equals_batch(spark, small):
    q = entry_module.queries()
    batch = {(r["id"], r["admitted"]) for r in q["WIN-12"](spark, small).collect()}
    assert {(r["id"], r["admitted"]) for r in q["STR-05"](spark, small).collect()} == batch


def test_sql_functions_are_inlined(spark):
    registry.register(spark)
    spark.range(3).selectExpr("cast(id as string) as t").createOrReplaceTempView("sr_t")
    plan = spark.sql("select * from sr_t where sr_is_release(t)")._jdf.queryExecution().optimizedPlan().toString()
    assert "sr_is_release" not in plan and "RLIKE" in plan


def test_filters_reach_the_reader(spark, tmp_path):
    path = str(tmp_path / "items")
    items(spark).write.partitionBy("family").parquet(path)
    plan = scans.items_since(spark.read.parquet(path), "2024-01-30 00:00:00", "academia").select(
        "id", "title")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(published_at), GreaterThanOrEqual(published_at" in plan
    assert "PartitionFilters: [isnotnull(family" in plan and "raw_text" not in plan and "embedding" not in plan


def test_offline_embedder(spark):
    a, b = HashEmbedder(8).embed(["x", "x"])
    assert a == b and abs(sum(v * v for v in a) - 1) < 1e-9
    assert fit_dim([1.0, 2.0], 3) == [1.0, 2.0, 0.0] and fit_dim([1.0, 2.0], 1) == [1.0]


def test_fixture_boundaries(spark, small):
    assert fx.items(spark, small).count() == 200


def test_sql_functions_equal_columns(spark, small):
    from storyrank.functions import text as X

    registry.register(spark)
    docs = fx.titled(spark, small).select("title", F.substring("raw_text", 1, 300).alias("body"))
    pages = fx.table(spark, small, "pages").select("url", "html")
    cases = [
        (pages, "sr_url_path(url)", X.url_path("url")), (pages, "sr_html_to_text(html)", X.html_to_text("html")),
        (pages, "sr_link_label(url)", X.link_label("url")), (pages, "sr_snippet(html)", X.snippet("html")),
        (pages, "sr_content_hash(url, html)", X.content_hash("url", "html")),
        (docs, "sr_slug(title)", X.slugify("title")), (docs, "sr_is_recap(title)", X.is_recap_title("title")),
        (docs, "sr_is_release(title)", X.is_release_title("title")), (docs, "sr_is_promo(title)", X.is_promo_title("title")),
        (docs, "sr_is_anecdote(title)", X.is_anecdote_title("title")), (docs, "sr_is_relevant(body)", X.is_relevant("body")),
        (docs, "array_join(sr_title_tokens(title), ' ')", F.array_join(X.title_tokens("title"), " ")),
        (docs, "round(sr_title_jaccard(title, body), 9)", F.round(X.token_jaccard(X.title_tokens("title"), X.title_tokens("body")), 9)),
        (docs, "array_join(sr_sig_numbers(concat(title, ' costs $1,5M or 40%')), ' ')",
         F.array_join(X.sig_numbers(F.concat("title", F.lit(" costs $1,5M or 40%"))), " ")),
        (docs, "array_join(sr_ungrounded('4.5 and 7%', body), ' ')", F.array_join(X.ungrounded(F.lit("4.5 and 7%"), "body"), " ")),
        (docs, "sr_story_id(title, array('b', 'a'))", X.story_id("title", F.array(F.lit("b"), F.lit("a")))),
        (docs, "sr_weekly_id(date '2027-01-01')", X.weekly_id(F.lit("2027-01-01").cast("date"))),
        (docs, "sr_announce_score(title)", X.announce_score("title")),
    ]
    for df, sql, col in cases:
        both = df.select(F.expr(sql).alias("a"), col.alias("b"))
        assert both.filter(~F.col("a").eqNullSafe(F.col("b"))).count() == 0, sql


def test_daily_run_fills_every_story(spark, small):
    from storyrank.catalog.q_jobs import pip_03

    for r in pip_03(spark, small).collect():
        assert r["n_saved"] == 1 and r["n_takeaways"] == r["n_stories"]
        assert r["n_stories"] == 0 or (r["n_tagged"] >= r["n_stories"] and r["n_links"] > 0)
