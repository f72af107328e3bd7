"""Cases where rows used to be lost, doubled or merged."""

import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from storyrank.functions.vectors import centroid
from storyrank.operators.clustering import cluster_stories, fold_leads
from storyrank.operators.lookup import enrich_metrics, richer_body
from storyrank.operators.similarity import similar_pairs
from storyrank.operators.tables import upsert
from storyrank.plans.jobs import run_days
from storyrank.sources.landing import admit_hn, gather_sources
from storyrank.sources.scans import list_digests
from storyrank.streaming.jobs import Throttle


def test_without_a_look_back_nothing_is_dropped(spark):
    items = spark.createDataFrame(
        [("old", "meta", dt.datetime(2023, 12, 1)), ("new", "academia", dt.datetime(2024, 1, 30)),
         ("later", "meta", dt.datetime(2024, 2, 2))], "id string, family string, published_at timestamp")
    runs = spark.createDataFrame([(dt.date(2024, 1, 31), dt.datetime(2024, 1, 31, 12))], "run_day date, as_of timestamp")
    assert {r["id"] for r in run_days(items, runs, gate=False).collect()} == {"old", "new"}
    since = runs.withColumn("since", F.lit("2024-01-01").cast("timestamp"))
    assert {r["id"] for r in run_days(items, since, gate=False).collect()} == {"new"}


def test_digest_limit_is_obeyed(spark):
    rows = [(str(i), "daily", dt.date(2024, 1, 1), "notable", False, json.dumps({}), dt.datetime(2024, 1, 1)) for i in range(150)]
    digests = spark.createDataFrame(
        rows, "id string, kind string, date date, tier string, quiet boolean, content string, created_at timestamp")
    assert list_digests(digests, limit=140).count() == 140
    with pytest.raises(ValueError):
        list_digests(digests, limit=0)


ITEM = "id string, family string, source string, url string, title string, embedding array<double>, score double"


def test_zero_vectors_stay_apart(spark):
    rows = [(i, "meta", "s", "https://x.example/a", "Same title", v, 1.0) for i, v in
            (("a", [0.0, 0.0]), ("b", [0.0, 0.0]), ("c", []), ("d", []), ("e", [float("nan")] * 2), ("f", [float("nan")] * 2))]
    groups = cluster_stories(spark.createDataFrame(rows, ITEM), 0.5)
    assert len({r["group"] for r in groups.collect()}) == 6
    leads = spark.createDataFrame([("2024", i, v, n, "notable") for n, (i, *_, v, _) in enumerate(rows)],
                                  "day string, id string, embedding array<double>, pos int, tier string")
    assert all(r["id"] == r["lead_id"] for r in fold_leads(leads, 0.5).collect())


def test_solo_rows_with_collapse(spark):
    rows = [("a", [1.0, 0.0], True), ("b", [1.0, 0.0], True), ("c", [1.0, 0.0], False), ("d", [1.0, 0.0], False), ("e", [0.0, 1.0], False)]
    frame = spark.createDataFrame(rows, "id string, embedding array<double>, solo boolean")
    got = {(r["id_a"], r["id_b"]) for r in similar_pairs(frame, 0.9, solo="solo").collect()}
    assert ("a", "b") not in got and {("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")} <= got


def test_several_rows_of_a_key(spark):
    target = spark.createDataFrame([("a", "old", None)], "id string, v string, e string")
    batch = spark.createDataFrame([("a", "x", "vec", 1), ("a", "y", None, 2), ("b", "z", None, 1)], "id string, v string, e string, n int")
    got = upsert(target, batch, ["id"], {"e": "coalesce"}, ["n"])
    assert sorted(map(tuple, got.collect())) == [("a", "y", "vec"), ("b", "z", None)]
    assert upsert(target, batch.drop("n"), ["id"]).count() == 2


def test_several_papers_and_pages(spark):
    items = spark.createDataFrame([Row(paper_id="p", metrics={"u": 1.0}, url="https://a", raw_text="", family="industry")])
    papers = spark.createDataFrame([Row(paper_id="p", metrics={"c": 1.0}), Row(paper_id="p", metrics={"c": 2.0})])
    assert enrich_metrics(items, papers).count() == 1
    pages = spark.createDataFrame([Row(url="https://a", body="short"), Row(url="https://a", body="a longer body")])
    assert [r["raw_text"] for r in richer_body(items, pages).collect()] == ["a longer body"]


def test_vectors_of_two_lengths(spark):
    rows = [("k", [1.0, 0.0]), ("k", [1.0, 0.0]), ("k", [0.0, 0.0, 1.0]), ("l", None)]
    got = centroid(spark.createDataFrame(rows, "k string, v array<double>"), ["k"], "v").collect()
    assert [(r["k"], list(r["centroid"])) for r in got] == [("k", [1.0, 0.0])]


def test_first_of_equal_ids_lands(spark):
    rows = [("1", 100, "AI later", 50), ("1", 5, "AI first", 50)]
    hits = spark.createDataFrame(rows, "objectID string, created_at_i long, title string, points long").withColumns(
        {"_tags": F.array(F.lit("story")), "story_title": F.lit(None).cast("string"), "url": F.lit("https://x")})
    assert [r["title"] for r in admit_hn(hits).collect()] == ["AI first"]


class _State:
    def __init__(self):
        self.rows, self.timers = [], []

    def getListState(self, *_):  # noqa: N802
        return self

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = list(rows)

    def listTimers(self):  # noqa: N802
        return iter(())

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)


def test_a_late_hit_is_judged_by_its_own_time():
    throttle, state = Throttle(1, 10), _State()
    throttle.init(state)
    second = 1_000_000
    batch = lambda *ts: iter([pd.DataFrame({"id": range(len(ts)), "t": [t * second for t in ts]})])
    assert list(next(throttle.handleInputRows(("k",), batch(100), None))["admitted"]) == [True]
    assert list(next(throttle.handleInputRows(("k",), batch(80), None))["admitted"]) == [True]
    assert list(next(throttle.handleInputRows(("k",), batch(85, 105), None))["admitted"]) == [False, False]


def test_a_missing_source_is_recorded(spark, tmp_path):
    rows, audit = gather_sources(spark, {
        "here": lambda: spark.range(2), "gone": lambda: spark.read.parquet(f"{tmp_path}/gone")})
    assert rows.count() == 2
    assert {(r["source"], r["read"]) for r in audit.collect()} == {("here", True), ("gone", False)}


def test_a_bad_line_is_skipped(spark, tmp_path):
    from storyrank.sources.plugin import register_source

    register_source(spark)
    (tmp_path / "a.json").write_text('{"title": "one"}\nnot json\n\n[1]\n{"title": "two"}\n')
    got = spark.read.format("landed_items").load(str(tmp_path))
    assert sorted(r["title"] for r in got.collect()) == ["one", "two"]
