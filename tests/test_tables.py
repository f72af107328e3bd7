import json
import os
import tempfile

from conftest import rows
from pyspark.sql import functions as F

from storyrank.operators import filters as fl
from storyrank.operators import tables as tb
from storyrank.plans import assemble as asm
from storyrank.plans import prompts as pr
from storyrank.sources import clicks, landing, scans

SINCE = "2024-01-01 00:00:00"


def folder():
    return tempfile.mkdtemp(prefix="run-")


def put(name, text):
    path = os.path.join(folder(), name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_upsert_rules_and_idempotence(spark):
    old = spark.createDataFrame([("a", 1, "x", [1.0]), ("b", 2, "y", None)], "id string, n int, c string, embedding array<double>")
    new = spark.createDataFrame([("b", 5, None, None), ("c", 6, "z", [2.0]), ("a", 7, "q", None)], old.schema)
    out = tb.upsert(old, new, ["id"], {"embedding": "coalesce", "n": "old"})
    want = [("a", 1, "q", [1.0]), ("b", 2, None, None), ("c", 6, "z", [2.0])]
    assert rows(out) == want
    assert rows(tb.upsert(out, new, ["id"], {"embedding": "coalesce", "n": "old"})) == want


def test_days_are_replaced_on_disk(spark):
    path = os.path.join(folder(), "stories")
    ts = lambda s: F.lit(s).cast("timestamp").alias("created_at")
    first = spark.range(3).select(F.col("id").cast("string").alias("id"), ts("2024-01-15 20:00:00")).union(
        spark.range(1).select(F.lit("other"), ts("2024-01-16 20:00:00")))
    tb.write_days(first, path, "America/Los_Angeles")
    again = spark.range(1).select(F.lit("new").alias("id"), ts("2024-01-16 07:00:00"))  # still the 15th there
    tb.write_days(again, path, "America/Los_Angeles")
    tb.write_days(again, path, "America/Los_Angeles")
    got = spark.read.parquet(path)
    assert rows(got.select("id", F.col("local_date").cast("string"))) == [("new", "2024-01-15"), ("other", "2024-01-16")]
    plan = scans.stories_for_date(got.withColumn("final_rank", F.lit(1.0)), "2024-01-15", "x")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(local_date" in plan


def test_hn_rows(spark):
    hits = {"hits": [
        {"objectID": "1", "title": "AI thing", "points": 30, "num_comments": 2, "created_at_i": 1704067200, "_tags": ["story"]},
        {"objectID": "1", "title": "AI thing", "points": 30, "created_at_i": 1704067200, "_tags": ["story"]},
        {"objectID": "2", "title": "Ships", "points": 500, "url": "https://b", "created_at": "2024-01-01T00:00:00Z", "_tags": ["story"]},
        {"objectID": "3", "story_title": "Mine", "points": 1, "_tags": ["show_hn"]}, {"objectID": "4", "points": 99}]}
    path = put("hits.json", json.dumps(hits))
    got = landing.read_hn(spark, path)
    assert rows(got.select("title", "url").distinct()) == [
        ("AI thing", "https://news.ycombinator.com/item?id=1"), ("Mine", "https://news.ycombinator.com/item?id=3"), ("Ships", "https://b")]
    assert rows(landing.admit_hn(landing.hn_hits(spark, path)).select("objectID")) == [("1",), ("3",)]


def test_feeds(spark):
    rss = """<rss><channel><title>c</title>
    <item><title> A &amp; B </title><link>https://x/1</link><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate>
      <description>&lt;p&gt;Hi &amp;amp; bye&lt;/p&gt;</description></item>
    <item><title>Old</title><link>https://x/2</link><pubDate>Tue, 02 Jan 2020 03:04:05 +0000</pubDate></item>
    <item><title>Undated</title><link>https://x/3</link></item><item><link>https://x/4</link></item>
    </channel></rss>"""
    got = landing.read_feed(spark, put("f.xml", rss), "lab", "industry", SINCE)
    assert rows(got.select("source", "title", "raw_text", F.col("published_at").cast("string"))) == [
        ("rss:lab", "A & B", "Hi & bye", "2024-01-02 03:04:05"), ("rss:lab", "Undated", "", SINCE)]


def test_paper_feed(spark):
    rss = """<rss><channel><item><title>P</title><link>https://x/papers/2401.01234</link>
    <description>Liked: 42 upvotes</description></item><item><title>Q</title><link>https://x/q</link>
    <description>see 2312.00001</description></item></channel></rss>"""
    got = landing.read_hf_feed(spark, put("h.xml", rss), SINCE)
    assert rows(got.select("title", F.get_json_object("raw", "$.arxiv_id"), F.try_element_at("metrics", F.lit("hf_upvotes")))) == [
        ("P", "2401.01234", 42.0), ("Q", "2312.00001", None)]


def test_arxiv_categories(spark):
    atom = """<feed xmlns="http://www.w3.org/2005/Atom"><title>q</title>
    <entry><id>http://arxiv.org/abs/2401.1v1</id><title>One
 two</title><published>2024-01-02T00:00:00Z</published><summary>S</summary><author><name>Ann</name></author>
      <link href="http://arxiv.org/abs/2401.1v1" rel="alternate"/><category term="cs.CL"/></entry>
    <entry><id>http://arxiv.org/abs/2401.2v1</id><title>Three</title><published>2024-01-02T00:00:00Z</published>
      <summary>S</summary><category term="math.CO"/></entry></feed>"""
    got = landing.read_arxiv(spark, put("a.xml", atom), SINCE).select("title", "author", "url").collect()
    assert [tuple(r) for r in got] == [("One  two", "Ann", "http://arxiv.org/abs/2401.1v1")]


def test_catalogue_by_folder(spark):
    root = folder()
    for slug in ("lab", "press"):
        os.mkdir(os.path.join(root, slug))
        with open(os.path.join(root, slug, "f.xml"), "w", encoding="utf-8") as f:
            f.write(f"<rss><channel><item><title>{slug}</title><link>https://{slug}</link></item></channel></rss>")
    feeds = spark.createDataFrame([("lab", "u1", "industry"), ("press", "u2", "meta")], "slug string, url string, family string")
    got = landing.catalogue_entries(spark, root, feeds, SINCE)
    assert rows(got.select("name", "title", "family")) == [("rss:lab", "lab", "industry"), ("rss:press", "press", "meta")]
    assert landing.default_feeds(spark).count() == 14


def test_pool_cap(spark):
    df = spark.range(51).select(
        F.concat(F.lit("i"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("id"),
        F.when(F.col("id") < 50, "loud").otherwise("calm").alias("source"), F.lit(None).cast("string").alias("url"),
        F.timestamp_seconds(F.col("id")).alias("published_at"))
    pool = asm.balanced_pool(df)
    assert dict(rows(pool.groupBy("source").count())) == {"loud": 20, "calm": 1}
    assert pool.filter("source = 'loud'").agg(F.min("id")).first()[0] == "i30"


def test_feedback_requests(spark):
    bodies = ['{"target_id":"a","target_kind":"story","signal":"up"}', '{"target_id":"","target_kind":"story","signal":"up"}',
              '{"target_id":"a","target_kind":"story","signal":"up","x":1}', "[]", "junk",
              '{"target_id":"a","target_kind":"story","signal":"dwell","value":"12"}',
              '{"target_id":"a","target_kind":"story","signal":"dwell","value":"much"}', '{"target_id":5,"target_kind":"item","signal":"up"}']
    good, bad = fl.validate_feedback(spark.createDataFrame([(b,) for b in bodies], "value string"))
    assert rows(good.select("signal", "value")) == [("dwell", 12.0), ("up", 1.0)]
    assert good.count() + bad.count() == len(bodies)


def test_click_signatures(spark):
    df = spark.createDataFrame([("a", "story", "up", "1")], "target_id string, target_kind string, signal string, value string")
    signed = df.withColumn("sig", clicks.signature("target_id", "target_kind", "signal", "value", "s"))
    assert len(signed.first()["sig"]) == 32
    assert clicks.verify_clicks(signed, "s")[0].count() == 1
    assert clicks.verify_clicks(signed, "other")[1].count() == 1
    assert clicks.verify_clicks(df.withColumn("sig", F.lit(None).cast("string")), "")[0].count() == 1


def test_keep_list_fallbacks(spark):
    stories = spark.createDataFrame([(b, p, "meta") for b in "abc" for p in range(3)], "batch string, pos int, family string")
    answers = spark.createDataFrame(
        [("a", '{"keep":[{"n":3,"family":"industry"},{"n":3,"family":"meta"},1]}'), ("b", "oops"), ("c", '{"keep":[777]}')],
        "batch string, response string")
    got = rows(pr.apply_keep(stories, answers).select("batch", "ord", "pos", "family"))
    assert got[:2] == [("a", 0, 2, "industry"), ("a", 2, 0, "meta")]
    assert len(got) == 8


def test_available_tags_without_any(spark):
    df = spark.createDataFrame([([],)], "tags array<string>")
    assert rows(fl.available_tags(df, ["b", "a"])) == [(0, "b"), (1, "a")]


def test_notes_last_of_a_path_wins(spark):
    notes = spark.createDataFrame([("a/x.md", "one", 1), ("a/x.md", "two", 2), ("b/y.md", "z", 1)], "path string, content string, ord int")
    assert rows(tb.export_notes(notes, folder())) == [("a/x.md", "two"), ("b/y.md", "z")]
