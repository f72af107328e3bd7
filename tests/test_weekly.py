"""The weekly run with shortlists: links are kept only where an item has them."""

import re

from storyrank.catalog.q_windows import talks
from storyrank.operators.inference import EchoModel, ListingModel
from storyrank.params import Profile
from storyrank.plans import jobs
from pyspark.sql import functions as F


def test_shortlists_are_grounded(spark):
    stories, members, items = talks(spark, "/root/testdata/sf0.001")
    items = items.cache()
    model = ListingModel({"title": "string", "lede": "string", "body_markdown": "string", "shortlist": "entries"})
    judge = EchoModel({c: "number" for c in ("insight", "accuracy", "narrative", "personal_fit", "honesty")})
    rows = jobs.weekly(stories.withColumn("importance", F.col("final_rank")), members, items, Profile(), model, judge).collect()
    real = {r["url"] for r in items.collect() if r["url"]}
    entries = [e for r in rows for e in r["shortlist"]]
    linked = [e["url"] for e in entries if e["url"]]
    assert rows and entries and linked and set(linked) <= real
    assert all(re.fullmatch(r"Talk \d+", e["title"]) and e["one_liner"] == e["title"] and e["family"] == "community" for e in entries)
    assert all(r["on_my_radar"] == [] for r in rows)


def test_made_up_links_are_dropped():
    answer = ListingModel({"shortlist": "entries"})._listed("### [minor] A (family=meta, mentions=1)\nno link\n\n### [minor] B (family=x, mentions=2)\nhttps://b/1 y")
    assert [(e["title"], e["url"], e["family"]) for e in answer] == [("A", "https://made.up/x", "meta"), ("B", "https://b/1", "x")]
