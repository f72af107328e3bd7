import pytest
from pyspark.sql import functions as F

from storyrank.functions import text as X


def one(spark, value, expr, kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(expr(F.col("v")).alias("r")).first()["r"]


TITLES = [
    ("OpenLab unveils Foo", True), ("Foo is rolling out", True), ("Acme raises $5M", True),
    ("This raises questions", False), ("Stock drops 5%", False), ("Lab partners with Acme", True),
    ("My resume scored 88", False), ("open-sourcing Bar", True), (None, False),
]


@pytest.mark.parametrize("title,expected", TITLES)
def test_release_titles(spark, title, expected):
    assert one(spark, title, X.is_release_title) is expected


@pytest.mark.parametrize("title,expected", [
    ("Not much happened today", True), ("AINews: Tuesday notes", True), ("AINews hires an editor", False),
    ("A Quiet Step Towards Planning", False), ("Weekly roundup", True), ("quiet weekend", True),
])
def test_recap_titles(spark, title, expected):
    assert one(spark, title, X.is_recap_title) is expected


@pytest.mark.parametrize("title,score", [
    ("Foo now available", 1.0), ("How agents change work", 0.0), ("Results on Foo", 0.4), (None, 0.4),
])
def test_announce_score(spark, title, score):
    assert one(spark, title, X.announce_score) == score


@pytest.mark.parametrize("url,path", [
    ("https://old.reddit.com/r/x/1/?utm=1", "/r/x/1"), ("https://www.reddit.com/r/x/1", "/r/x/1"),
    ("http://h.com", "h.com"), ("https://h.com/#frag", "h.com/"), ("", None), (None, None),
])
def test_url_path(spark, url, path):
    assert one(spark, url, X.url_path) == path


def test_clip(spark):
    assert one(spark, "  short  ", lambda c: X.clip(c, 20)) == "short"
    text = "First sentence here. Second one goes on and on"
    assert one(spark, text, lambda c: X.clip(c, 30)) == "First sentence here."
    assert one(spark, "alpha beta, gamma delta", lambda c: X.clip(c, 15)) == "alpha beta…"
    assert one(spark, "x" * 50, lambda c: X.clip(c, 10)) == "x" * 10 + "…"
    assert one(spark, "A b. C d! E f g h i j", lambda c: X.clip_sentence(c, 14)) == "A b. C d!"


def test_content_hash_identity(spark):
    df = spark.createDataFrame(
        [(" HTTP://A.com/X ", "t"), ("http://a.com/x", "u"), ("  ", "Some\n  Text"), (None, "some text")],
        "url string, body string")
    h = [r[0] for r in df.select(X.content_hash("url", "body")).collect()]
    assert h[0] == h[1] and h[2] == h[3] and h[0] != h[2]


def test_grounding(spark):
    df = spark.createDataFrame(
        [("It gains 40%. It cost $1,500M! GPT 4 is fine.", "we saw 40 and nothing else")], "t string, g string")
    r = df.select(X.strip_ungrounded("t", "g").alias("s"), X.ungrounded("t", "g").alias("u")).first()
    assert r["s"]["text"] == "It gains 40%. GPT 4 is fine."
    assert r["s"]["dropped"] == 1 and r["u"] == ["1500"]


@pytest.mark.parametrize("raw,k", [
    ('{"k": 1}', "1"), ('```json\n{"k": 2}\n```', "2"), ('see {"k": 3} ok', "3"), ("[1]", None), ("junk", None), (None, None),
])
def test_tolerant_json(spark, raw, k):
    got = one(spark, raw, lambda c: F.try_variant_get(X.parse_json_obj(c), "$.k", "string"))
    assert got == k


def test_week_keys(spark):
    df = spark.sql("select date '2027-01-01' as d")
    r = df.select(X.weekly_id("d").alias("w"), X.week_of("d").cast("string").alias("m"), X.week_dates("d").alias("l")).first()
    assert r["w"] == "weekly-2026-W53" and r["m"] == "2026-12-28" and len(r["l"]) == 7


def test_tags_and_lists(spark):
    df = spark.createDataFrame([(["efficient & scalable nlp", " ", "Other", "X", "Y"],)], "t array<string>")
    assert df.select(X.canonical_tags("t", ["Efficient and Scalable NLP"])).first()[0] == [
        "Efficient and Scalable NLP", "Other", "X"]
    df = spark.createDataFrame([(["Crypto", "crypto", "B"],)], "t array<string>")
    assert df.select(X.dedupe_ci("t")).first()[0] == ["Crypto", "B"]
