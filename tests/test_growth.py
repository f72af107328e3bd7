"""Steps that must not grow with more than their input: what is broadcast, repeated or held."""

import datetime as dt
import json

from pyspark.sql import functions as F

from storyrank.plans import jobs


def plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_laid_out_rows_are_never_broadcast(spark, tmp_path):
    """Reactions and items are laid out over days; the runs, one row a day, are what is sent."""
    at = dt.datetime(2024, 1, 10, 12)
    spark.createDataFrame([("s", "up", 1.0, at), ("s", "down", 1.0, at)], "target_id string, signal string, value double, created_at timestamp").write.parquet(f"{tmp_path}/f")
    days = spark.range(4000).select(F.expr("date_add(date'2020-01-01', cast(id as int))").alias("run_day"))
    days.withColumn("as_of", F.date_add("run_day", 1).cast("timestamp")).write.parquet(f"{tmp_path}/r")
    runs = spark.read.parquet(f"{tmp_path}/r")
    boosts = jobs.run_boosts(spark.read.parquet(f"{tmp_path}/f"), runs)
    assert "BuildRight" in plan(boosts) and "BuildLeft" not in plan(boosts)
    assert boosts.count() > 1
    items = spark.createDataFrame([("i", "meta", at)], "id string, family string, published_at timestamp")
    items.write.parquet(f"{tmp_path}/i")
    placed = jobs.run_days(spark.read.parquet(f"{tmp_path}/i"), runs)
    assert "BuildRight" in plan(placed) and "BuildLeft" not in plan(placed)
    assert placed.count() == 2


def test_papers_of_many_digits_stay_apart(spark, tmp_path):
    """PIP-01 beyond 100,000 documents: as many items as its SQL counts."""
    import duckdb

    import __spark_entry__ as entry_module

    docs = spark.range(99_990, 100_030).selectExpr("id AS doc_id", "concat('text ', id) AS text").unionAll(
        spark.range(1_000_000, 1_000_030).selectExpr("id AS doc_id", "concat('text ', id) AS text"))
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    con.execute("create view events as select * from '/root/testdata/sf0.001/events.parquet'")
    (tmp_path / "events.parquet").symlink_to("/root/testdata/sf0.001/events.parquet")
    want = sorted(con.execute(entry_module.oracle_sql()["PIP-01"]).fetchall())
    got = sorted((r["source"], r["n"]) for r in entry_module.queries()["PIP-01"](spark, str(tmp_path)).collect())
    assert got == want


def test_throttle_of_uneven_arrivals(spark, tmp_path):
    """STR-05 on events whose arrivals land in different numbers of files equals the batch throttle."""
    import __spark_entry__ as entry_module

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events = events.sort("ts").limit(400).unionAll(events.sort("ts").limit(400).withColumn("event_id", F.col("event_id") + 100_000))
    events.repartitionByRange(7, "ts").write.parquet(f"{tmp_path}/events.parquet")
    queries = entry_module.queries()
    want = {(r["id"], r["admitted"]) for r in queries["WIN-12"](spark, str(tmp_path)).collect()}
    got = [(r["id"], r["admitted"]) for r in queries["STR-05"](spark, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(want) == 800


def test_merge_rounds_keep_the_size_estimate_short(spark):
    """AGG-04: the estimated size of checkpointed rows must not multiply from round to round."""
    import random

    from storyrank.operators import clustering as cl

    rng = random.Random(5)
    pairs = [(f"n{a:02d}", f"n{b:02d}", rng.random()) for a in range(40) for b in range(a + 1, 40) if rng.random() < 0.8]
    edges = spark.createDataFrame(pairs, "id_a string, id_b string, similarity double")
    merged = cl._complete_link_rounds(edges)
    size = int(str(merged._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert size.bit_length() < 200
    want = cl._complete_link(edges.toPandas())
    assert {(r["node"], r["group"]) for r in merged.collect()} == set(want.itertuples(index=False, name=None))


def test_invariants_compare_the_vectors_once(spark, small, monkeypatch):
    """AGG-05 checks the groups against the pairs that they were merged from."""
    import __spark_entry__ as entry_module
    from storyrank.operators import clustering as cl

    called, similar_pairs = [], cl.similar_pairs
    monkeypatch.setattr(cl, "similar_pairs", lambda *a, **k: called.append(1) or similar_pairs(*a, **k))
    got = entry_module.queries()["AGG-05"](spark, small).collect()
    assert len(called) == 1 and sorted(r["violations"] for r in got) == [0, 0, 0]


def test_sources_hold_few_rows(spark, tmp_path):
    """UDF-01: what a task holds does not grow with the length of the bodies."""
    from storyrank.sources.plugin import LandedFile, LandedItemsReader, json_lines, register_source

    path = tmp_path / "landed.json"
    lines = [json.dumps({"title": f"t{i}", "body": "x" * 50_000, "published_at": "2024-01-05T01:00:00+01:00"}) for i in range(200)]
    path.write_text("\n".join([*lines[:100], "no json", '{"title": " "}', *lines[100:]]))
    reader = LandedItemsReader({"path": str(path)}, json_lines)
    sizes = [batch.num_rows for batch in reader.read(LandedFile(str(path)))]
    assert sum(sizes) == 200 and max(sizes) <= 40
    register_source(spark)
    back = spark.read.format("landed_items").load(str(tmp_path))
    assert back.count() == 200 and back.filter("published_at = timestamp'2024-01-05 00:00:00' AND url IS NULL AND author IS NULL").count() == 200


def test_models_hold_few_rows(spark):
    """UDF-03: what a task holds as Python objects does not grow with the Arrow batch."""
    from storyrank.operators.inference import BATCH, infer

    class Sized:
        def generate(self, prompts):
            return [str(len(prompts))] * len(prompts)

    got = infer(spark.range(1000).selectExpr("id", "if(id = 3, null, 'x') AS prompt").coalesce(1), Sized()).collect()
    assert sorted(r["id"] for r in got) == list(range(1000)) and got[3]["prompt"] is None
    assert max(int(r["response"]) for r in got) == BATCH


def test_the_daily_run_asks_the_model_once(spark, small, tmp_path, monkeypatch):
    """PIP-03: the answers are kept; the digests read, saved and saved again hold the same ones."""
    import __spark_entry__ as entry_module
    from storyrank.catalog import q_jobs
    from storyrank.operators.inference import EchoModel

    log = str(tmp_path / "asked")

    class Counted(EchoModel):
        def generate(self, prompts):
            with open(log, "a") as out:
                out.writelines(f"{hash(p)}\n" for p in prompts)
            return EchoModel.generate(self, prompts)

    monkeypatch.setattr(q_jobs, "EchoModel", Counted)
    assert entry_module.queries()["PIP-03"](spark, small).count() > 0
    asked = open(log).read().split()
    assert len(asked) == len(set(asked))


def test_a_replayed_post_stands_once_a_day(spark):
    """PIP-06: a post of the front page that is among the industry samples too."""
    at = dt.datetime(2024, 1, 10, 12)
    items = spark.createDataFrame(
        [(f"i{k}", "hn", "industry", f"Title {k}", at, [1.0, 0.1 * k], {"upvotes": 100.0}) for k in range(3)],
        "id string, source string, family string, title string, published_at timestamp, embedding array<float>, metrics map<string,double>")
    runs = spark.createDataFrame([(dt.date(2024, 1, 10), dt.datetime(2024, 1, 11))], "run_day date, as_of timestamp")
    assert sorted(r["id"] for r in jobs.replay_pool(items, runs).collect()) == ["i0", "i1", "i2"]


def test_bodies_are_not_laid_out_over_the_runs(spark, small, monkeypatch):
    """PIP-03: no step keeps bodies, and the items are read as often as they are needed, without a shuffle for their counts."""
    import __spark_entry__ as entry_module
    from storyrank import fixtures as fx

    held, stage = [], jobs.stage
    monkeypatch.setattr(jobs, "stage", lambda df: held.append(df.columns) or stage(df))
    assert entry_module.queries()["PIP-03"](spark, small).count() > 0
    assert held and not any("raw_text" in columns for columns in held)
    assert sum("source_line" in columns for columns in held) == 1
    assert "hashpartitioning((" not in fx.items(spark, small)._jdf.queryExecution().executedPlan().toString()


def test_counted_bodies_and_written_lines_stand_for_bodies(spark):
    """Sizes and lines that are made before a join give the same lengths and blocks as the bodies."""
    from storyrank.operators import filters as fl
    from storyrank.plans import assemble as asm

    items = spark.createDataFrame(
        [("a", "hn", "One ", "https://a.example", "  body\nof a "), ("b", None, "Two", None, None), ("c", "hn", None, "", ""),
         ("d", "hn", "Four", "https://d.example", " " + "word " * 300), ("d", "hn", "Four", "https://d.example", " " + "word " * 300)],
        "id string, source string, title string, url string, raw_text string")
    stories = spark.createDataFrame([("s", "S", "a"), ("t", "T", None), ("u", None, None)], "id string, title string, representative_item_id string")
    members = spark.createDataFrame([("s", "b", 1), ("s", "d", 2), ("s", "a", 0), ("t", "c", 0), ("t", None, 1)], "story_id string, item_id string, pos int")
    lines = items.select("id", "url", fl.body_size().alias("body_size"), asm.source_line().alias("source_line"))
    for make in (
        lambda rows: asm.source_blocks(stories, members, rows),
        lambda rows: fl.source_lengths(members.join(rows.withColumnRenamed("id", "item_id"), "item_id")),
    ):
        got = sorted(map(tuple, make(lines).collect()))
        assert got == sorted(map(tuple, make(items).collect())) and got


def test_what_earlier_steps_shuffled_goes_when_it_is_let_go(spark):
    import time

    from storyrank.session import release, stage

    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x for x in manager.getAllFiles().mkString(",").split(",") if "/shuffle_" in x}
    before = files()
    kept = stage(spark.range(1000).repartition(3))
    made = files() - before
    until = time.time() + 30
    while made & files() and time.time() < until:
        release(spark)
    assert made and not made & files() and kept.count() == 1000


def test_items_meet_their_counts_at_every_remainder(spark, tmp_path):
    """Counts of keys beyond the remainders belong to no item; negative ids have negative remainders."""
    from storyrank import fixtures as fx

    ids = [-101, -1, 0, 5, 99, 100, 205]
    spark.createDataFrame([(i, "t", "en", "s", 1) for i in ids], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    keys = [-1, -1, 0, 5, 5, 5, 99, 100, 205, None]
    spark.createDataFrame([(i, "view", json.dumps({"k": k})) for i, k in enumerate(keys)], "event_id long, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["item_no"]: r["upvotes"] for r in fx.items(spark, str(tmp_path)).collect()}
    n = {-1: 2, 0: 1, 5: 3, 99: 1}
    assert got == {i: n[int(f"-{abs(i) % 100}") if i < 0 else i % 100] * (1 + (-(abs(i) % 97) if i < 0 else i % 97)) for i in ids}
