"""Records that cannot be read are listed; those beside them stay."""

import gzip

import pytest

from storyrank.sources import landing


def write(folder, **files):
    for name, text in files.items():
        (folder / name.replace("_", ".")).write_text(text)
    return str(folder)


def listed(df):
    return sorted((r["reason"], r["raw"]) for r in df.collect())


def test_pages_of_hits(spark, tmp_path):
    path = write(tmp_path, a_json="\n".join([
        '{"hits":[{"objectID":"1","title":"A"},{"objectID":"2","title":"B","points":"many"}]}',
        '{"hits":[{"objectID":"3","title":"C"}, 7, null, "x", [1]]}',
        '{"hits":[]}', '{"hits":"none"}', '{"other":1}', "[1,2]", '{"hits":[{"objectID":"4"', "", "  "]))
    assert sorted(r["objectID"] for r in landing.hn_hits(spark, path).collect()) == ["1", "2", "3"]
    assert listed(landing.faults(spark, path, "hn")) == sorted([
        ("mistyped", '{"objectID":"2","points":"many","title":"B"}'),
        ("not_an_object", "7"), ("not_an_object", "null"), ("not_an_object", '"x"'), ("not_an_object", "[1]"),
        ("no_records", '{"hits":"none"}'), ("no_records", '{"other":1}'), ("no_records", "[1,2]"),
        ("not_json", '{"hits":[{"objectID":"4"')])
    assert {r["file"].rsplit("/", 1)[-1] for r in landing.faults(spark, path, "hn").collect()} == {"a.json"}


def test_nested_pages_and_notes(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "n").mkdir()
    forum = write(tmp_path / "f", a_json='{"data":{"children":[{"data":{"id":"1","title":"A"}},{"data":3},5]}}\n{"data":{"children":5}}')
    assert [r["id"] for r in landing.forum_posts(spark, forum).collect()] == ["1"]
    assert [r for r, _ in listed(landing.faults(spark, forum, "reddit"))] == ["mistyped", "no_records", "not_an_object"]
    notes = write(tmp_path / "n", a_json='{"notes":[{"id":"1","content":{"title":"T"}},false]}')
    assert [r["title"] for r in landing.read_openreview(spark, notes).collect()] == ["T"]
    assert listed(landing.faults(spark, notes, "openreview")) == [("not_an_object", "false")]


def test_one_record_a_line(spark, tmp_path):
    path = write(tmp_path, a_json='{"title":"A","paper":{"id":"1","upvotes":"x"}}\n{"title":"B","paper":{"id":"2"}}\n7\n{"title"')
    assert listed(landing.faults(spark, path, "hf_papers")) == [
        ("mistyped", '{"title":"A","paper":{"id":"1","upvotes":"x"}}'), ("not_an_object", "7"), ("not_json", '{"title"')]


def test_feed_files(spark, tmp_path):
    good = "<rss><item><title>ok</title></item></rss>"
    broken = "<rss><item><title>first</title></item><item><title>x</titl></item></rss>"
    path = write(tmp_path, a_xml=good, b_xml=broken, c_xml="no xml", d_xml="<feed><entry><title>e</title></entry></feed>", e_xml="")
    assert sorted(r["title"] for r in landing.feed_entries(spark, path).filter("title is not null").collect()) == ["e", "first", "ok"]
    assert listed(landing.faults(spark, path, "rss:x")) == [("broken_xml", broken), ("broken_xml", "no xml")]


def test_no_faults(spark, tmp_path):
    path = write(tmp_path, a_json='{"hits":[{"objectID":"1","title":"A"}]}\n{"hits":[]}')
    assert landing.faults(spark, path, "hn").count() == 0


def test_damaged_archive_costs_its_source_only(spark, tmp_path):
    (tmp_path / "bad").mkdir()
    (tmp_path / "good").mkdir()
    packed = gzip.compress(b'{"hits":[{"objectID":"1","title":"A"}]}\n' * 3000)
    (tmp_path / "bad" / "a.json.gz").write_bytes(packed[:len(packed) // 2])
    good = write(tmp_path / "good", a_json='{"hits":[{"objectID":"1","title":"A"}]}')
    rows, audit = landing.gather_sources(spark, {
        "bad": lambda: landing.read_hn(spark, str(tmp_path / "bad")), "good": lambda: landing.read_hn(spark, good),
        "missing": lambda: landing.read_hn(spark, str(tmp_path / "none"))})
    assert rows.count() == 1
    found = {r["source"]: (r["read"], r["reason"], r["rows"]) for r in audit.collect()}
    assert found["good"] == (True, None, 1) and found["missing"] == (False, "PATH_NOT_FOUND", 0)
    assert found["bad"][0] is False and found["bad"][1].startswith("FAILED_READ_FILE")


def test_no_source_at_all(spark):
    with pytest.raises(ValueError):
        landing.gather_sources(spark, {"none": lambda: spark.read.parquet("/nowhere/at/all")})
