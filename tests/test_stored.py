"""Stored tables: merges equal the upsert of whole tables and leave other buckets alone."""

import pytest
from pyspark.sql import functions as F

from storyrank.operators import tables as tb
from storyrank.operators.stored import StoredTable, merge_digests, merge_embeddings, merge_items, merge_stories


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def items(spark, ids, source="old", vec="array(1F, 2F)"):
    return spark.createDataFrame([(i,) for i in ids], "k long").selectExpr(
        "concat('item-', k) AS id", f"'{source}' AS source", f"CAST({vec} AS array<float>) AS embedding")


@pytest.fixture
def table(spark, tmp_path):
    return StoredTable.create(items(spark, range(200)), str(tmp_path / "items"), ["id"], buckets=16)


def test_merge_equals_upsert_and_keeps_other_files(spark, table):
    target, before = rows_of(table.read()), set(table.files())
    assert len(target) == 200
    batch = items(spark, [3, 5, 500], "new", "NULL")
    touched = merge_items(table, batch)
    assert 1 <= touched <= 3
    assert rows_of(table.read()) == rows_of(tb.upsert_items(items(spark, range(200)), batch))
    after = set(table.files())
    assert len(before - after) <= touched and len(before & after) >= len(before) - touched
    merge_items(table, batch)  # once more changes nothing
    assert rows_of(table.read()) == rows_of(tb.upsert_items(items(spark, range(200)), batch))
    assert merge_items(table, batch.limit(0)) == 0


def test_a_write_that_dies_leaves_the_old_rows(spark, table, monkeypatch):
    before, files = rows_of(table.read()), table.files()
    batch = items(spark, range(0, 400, 7), "new")
    with monkeypatch.context() as broken:
        broken.setattr(StoredTable, "_commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            merge_items(table, batch)
    again = StoredTable(spark, table.path)
    assert rows_of(again.read()) == before and again.files() == files
    merge_items(again, batch)
    want = rows_of(tb.upsert_items(items(spark, range(200)), batch))
    assert rows_of(again.read()) == want
    assert again.vacuum() > 0 and rows_of(again.read()) == want and again.vacuum() == 0


def test_vectors_stories_and_digests(spark, table, tmp_path):
    vecs = items(spark, [1, 999], vec="array(9F)").select("id", "embedding")
    merge_embeddings(table, vecs)
    assert rows_of(table.read()) == rows_of(tb.set_embeddings(items(spark, range(200)), vecs))
    kind = "id string, title string, created_at long"
    old = spark.createDataFrame([(f"s{i}", "old", i) for i in range(30)], kind)
    bridge = spark.createDataFrame([(f"s{i}", f"i{i}-{k}") for i in range(30) for k in range(3)], "story_id string, item_id string")
    batch = spark.createDataFrame([("s1", "new", 99), ("s77", "new", 77), ("s2", "new", 99)], kind)
    members = spark.createDataFrame([("s1", "x"), ("s1", "x"), ("s77", "y"), ("s5", "never written")], bridge.schema)
    stories = StoredTable.create(old, str(tmp_path / "stories"), ["id"], buckets=8)
    kept = StoredTable.create(bridge, str(tmp_path / "bridge"), ["story_id"], buckets=8)
    for _ in range(2):
        merge_stories(stories, kept, batch, members)
        rows, links = tb.upsert_stories(old, bridge, batch, members.filter("story_id <> 's5'"))
        assert rows_of(stories.read()) == rows_of(rows) and rows_of(kept.read()) == rows_of(links)
    digests = spark.createDataFrame([("d1", "daily", 1, False, 5), ("d2", "daily", 2, False, 5)], "id string, kind string, date int, quiet boolean, created_at long")
    new = spark.createDataFrame([("d2", "weekly", 9, True, 8), ("d3", "weekly", 3, None, 8)], "id string, kind string, date int, quiet_day boolean, created_at long")
    saved = StoredTable.create(digests, str(tmp_path / "digests"), ["id"], buckets=4)
    merge_digests(saved, new)
    assert rows_of(saved.read()) == rows_of(tb.save_digests(digests, new))


def test_empty_table_and_null_keys(spark, tmp_path):
    table = StoredTable.create(items(spark, []), str(tmp_path / "t"), ["id"], buckets=4)
    assert table.read().count() == 0 and table.read().columns == ["id", "source", "embedding"]
    batch = items(spark, [1]).unionByName(items(spark, [2]).withColumn("id", F.lit(None).cast("string")))
    merge_items(table, batch)
    assert table.read().count() == 2
