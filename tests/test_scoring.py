import pytest
from conftest import rows
from pyspark.sql import functions as F

from storyrank.functions import signals as S
from storyrank.functions import vectors as V
from storyrank.operators import evaluation as ev
from storyrank.operators import feedback as fb
from storyrank.operators import filters as fl
from storyrank.operators import ranking as rk
from storyrank.params import Profile, tier_thresholds

AS_OF = "2024-01-31 00:00:00"


def story(spark, **over):
    base = dict(id="s", title="Plain title", family="community", mention_count=1, engagement=1.0, citation=0.0)
    base.update(over)
    return spark.createDataFrame([tuple(base.values())],
                                 "id string, title string, family string, mention_count long, engagement double, citation double"
                                 ).withColumn("created_at", F.lit(AS_OF).cast("timestamp"))


def imp(spark, **over):
    return story(spark, **over).select(S.importance(Profile(), AS_OF)).first()[0]


def test_viral_reachability(spark):
    assert imp(spark, title="My resume scored 88") < 0.55
    assert imp(spark, title="OpenLab unveils Foo") >= 0.55
    assert imp(spark, title="My resume scored 88", mention_count=4) >= 0.55


@pytest.mark.parametrize("rank,tier", [
    (0.95, "breakthrough"), (0.72, "breakthrough"), (0.71, "notable"), (0.40, "notable"),
    (0.39, "minor"), (0.30, "minor"), (0.29, "quiet_day"), (0.0, "quiet_day"),
])
def test_tier_edges(spark, rank, tier):
    df = spark.createDataFrame([(0.0, rank, 0.95, False)], "i double, r double, t double, q boolean")
    assert df.select(S.classify_tier("i", "r", "t", "q")).first()[0] == tier


def test_quiet_day_keeps_one_minor(spark):
    df = spark.createDataFrame(
        [("d", "a", 0.2, 0.35), ("d", "b", 0.1, 0.31), ("e", "c", 0.6, 0.1), ("f", "g", 0.32, 0.5)],
        "day string, id string, importance double, final_rank double")
    tiers = {r["id"]: r["tier"] for r in rk.classify_stories(df).collect()}
    assert tiers == {"a": "minor", "b": "quiet_day", "c": "breakthrough", "g": "notable"}
    days = {r["day"]: (r["overall_tier"], r["quiet"]) for r in rk.classify_days(df).collect()}
    assert days == {"d": ("quiet_day", True), "e": ("breakthrough", False), "f": ("notable", False)}


def test_thresholds_keep_defaults():
    assert tier_thresholds({"notable_min_score": "x"})["notable_min_score"] == 0.40


def test_boost_signs_and_decay(spark):
    df = spark.createDataFrame(
        [("a", "up", 0.0, "2024-01-31"), ("a", "down", 9.0, "2024-01-17"), ("b", "dwell", 500.0, "2024-01-31"),
         ("b", "nl_instruction", 1.0, "2024-01-31"), ("c", "click", 1.0, "2024-02-05")],
        "target_id string, signal string, value double, t string").withColumn("created_at", F.col("t").cast("timestamp"))
    got = {r[0]: round(r[1], 9) for r in fb.feedback_boosts(df, AS_OF).collect()}
    assert got == {"a": 0.5, "b": 0.15, "c": 0.25}


def test_interest_vector(spark):
    stories = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [1.0, 0.0, 0.0])], "id string, embedding array<double>")
    base = spark.createDataFrame([([1.0, 0.0],)], "vector array<double>")
    votes = spark.createDataFrame([("a", "up"), ("b", "up")], "target_id string, signal string").withColumn(
        "created_at", F.lit(AS_OF).cast("timestamp"))
    got = fb.interest_vector(votes, stories, base, AS_OF, 2).first()["vector"]
    assert got == pytest.approx([2 ** -0.5, 2 ** -0.5])
    none = votes.filter("signal = 'down'")
    assert fb.interest_vector(none, stories, base, AS_OF, 2).first()["vector"] == [1.0, 0.0]


def test_cosine_guards(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame(
        [([1.0, nan], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), (None, [1.0]), ([inf, 1.0], [5.0, 2.0])],
        "a array<double>, b array<double>")
    for fn in (V.cosine, V.cosine_bulk):
        got = [r[0] for r in df.select(fn("a", "b")).collect()]
        assert got == pytest.approx([1.0, 0.0, 0.0, 0.0, 2 / 29 ** 0.5])


def test_quantiles_nearest_rank(spark):
    values = [5.0, 1.0, 9.0, 3.0, 7.0, 3.0, 3.0, 3.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = dict(rows(rk.quantiles(df, "v", [0.0, 0.5, 0.9, 1.0])))
    s = sorted(values)
    assert got == {q: s[int(round(q * (len(s) - 1)))] for q in (0.0, 0.5, 0.9, 1.0)}


def test_quantiles_of_equal_values(spark):
    df = spark.range(50).select(F.lit(2.5).alias("v"))
    assert rows(rk.quantiles(df, "v", [0.5, 1.0])) == [(0.5, 2.5), (1.0, 2.5)]


def test_announcement_floor(spark):
    df = spark.createDataFrame(
        [("a", "X unveils Y", 1, 0.1, 10), ("b", "X unveils Y", 2, 0.1, 0), ("c", "X unveils Y", 1, 0.1, 200),
         ("d", "Plain", 9, 0.1, 900), ("e", "X unveils Y", 2, 0.9, 0)],
        "id string, title string, mention_count long, importance double, source_len long")
    got = {r["id"]: r["importance"] for r in rk.announcement_floor(df).collect()}
    assert got == {"a": 0.1, "b": 0.42, "c": 0.42, "d": 0.1, "e": 0.9}


def test_quiet_gate(spark):
    df = spark.createDataFrame(
        [("Quiet day, really.", True), ("Big launch", True), ("Quiet day but stunning", True), ("stunning", False)],
        "md string, q boolean")
    got = [r[0]["quiet_ok"] for r in df.select(fl.quiet_gate("md", "q")).collect()]
    assert got == [True, False, False, True]


def test_pick_winner_ties_and_range(spark):
    df = spark.createDataFrame([("k", 0, 1.0), ("k", 1, 3.0), ("k", 2, 3.0)], "k string, idx int, insight double")
    assert ev.pick_winner(df, ["k"], ["insight"]).first()["winner"] == 1
    given = spark.createDataFrame([("k", 2)], "k string, winner int")
    assert ev.pick_winner(df, ["k"], ["insight"], given).first()["winner"] == 2
    far = spark.createDataFrame([("k", 7)], "k string, winner int")
    assert ev.pick_winner(df, ["k"], ["insight"], far).first()["winner"] == 1


def test_coverage_of_empty_day(spark):
    stories = spark.createDataFrame([("d", "a", 0.9), ("d", "b", 0.8)], "day string, id string, final_rank double")
    done = spark.createDataFrame([("d", "a")], "day string, id string")
    spine = spark.createDataFrame([("d",), ("e",)], "day string")
    got = {r["day"]: (r["coverage"], r["uncovered_titles"]) for r in ev.coverage(stories, done, spine=spine).collect()}
    assert got == {"d": (0.5, ["b"]), "e": (1.0, [])}


def test_quantiles_by_selection(spark):
    rows = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN 7D WHEN id % 50 = 1 THEN NULL ELSE (id * 7919 % 4999) / 3D - 200 END AS v")
    values = sorted(r[0] for r in rows.collect() if r[0] is not None)
    qs = [0.0, 0.1, 0.33, 0.5, 0.9, 0.999, 1.0]
    want = {q: values[round(q * (len(values) - 1))] for q in qs}
    for most, accuracy in ((200_000, 10_000), (40, 100), (1, 20)):
        got = {r["q"]: r["value"] for r in rk.quantiles(rows, "v", qs, accuracy, most).collect()}
        assert got == want
    assert rk.quantiles(rows.filter("v IS NULL"), "v", qs).count() == 0
    same = spark.range(100).selectExpr("1D AS v")
    assert {r["value"] for r in rk.quantiles(same, "v", qs, most=1).collect()} == {1.0}


def test_cosine_on_buffers(spark):
    rows = spark.createDataFrame([
        ([1.0, 2.0], [2.0, 4.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0], [1.0, 2.0]), (None, [1.0]), ([], []), ([0.0, 0.0], [1.0, 1.0]),
        ([1.0, None], [1.0, 5.0]), ([float("nan"), 1.0], [3.0, 1.0]), ([-1.0, -1.0], [1.0, 1.0])], "a array<double>, b array<double>").repartition(1)
    for r in rows.select(V.cosine("a", "b").alias("x"), V.cosine_bulk("a", "b").alias("y")).collect():
        assert abs(r["x"] - r["y"]) < 1e-12
