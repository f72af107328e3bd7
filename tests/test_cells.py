"""Similarity pairs over metric cells: the same pairs, fewer blocks compared."""

import numpy as np
import pytest

from storyrank.operators import similarity


def clusters(spark, number, each, dim=24, spread=0.05, days=1, seed=4):
    rnd = np.random.default_rng(seed)
    rows, k = [], 0
    for day in range(days):
        for centre in rnd.standard_normal((number, dim)):
            centre /= np.linalg.norm(centre)
            for noise in rnd.standard_normal((each, dim)):
                rows.append((k, f"d{day}", [float(x) for x in centre + spread * noise], k % 7 == 0))
                k += 1
    rows += [(k, "d0", [0.0] * dim, False), (k + 1, "d0", None, False), (k + 2, "d0", [1.0, 0.0], False),
             (k + 3, "d0", [float("nan")] * dim, False), (k + 4, None, rows[0][2], False), (k + 5, None, rows[1][2], False)]
    return spark.createDataFrame(rows, "id long, day string, embedding array<double>, solo boolean").repartition(4)


def brute(frame, threshold, within=None, solo=None):
    rows = [r for r in frame.collect() if r["embedding"]]
    out = {}
    unit = [np.nan_to_num(np.array(r["embedding"])) for r in rows]
    unit = [u / (np.linalg.norm(u) or 1.0) for u in unit]
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if len(unit[i]) != len(unit[j]) or within and a[within] != b[within] or solo and a[solo] and b[solo]:
                continue
            s = float(unit[i] @ unit[j])
            if s >= threshold:
                out[min(a["id"], b["id"]), max(a["id"], b["id"])] = s
    return out


@pytest.mark.parametrize("threshold", [0.99, 0.9, 0.6, 0.05])
@pytest.mark.parametrize("within", [None, "day"])
def test_same_pairs_as_brute_force(spark, threshold, within):
    frame = clusters(spark, 6, 20, days=2).cache()
    for solo in (None, "solo"):
        found = similarity.similar_pairs(frame, threshold, within=[within] if within else None, solo=solo, collapse=False, block_rows=16)
        got = {(r["id_a"], r["id_b"]): r["similarity"] for r in found.collect()}
        # A null key groups with nothing in the brute force as in a join of blocks.
        want = {k: v for k, v in brute(frame, threshold, within, solo).items()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
        assert found.count() == len(got)


def test_compared_pairs_grow_with_clusters(spark):
    counts = []
    for number in (8, 16, 32):
        frame = clusters(spark, number, 40, dim=48, spread=0.02).filter("id < 40 * %d" % number)
        n = number * 40
        found = similarity.compared_blocks(frame, 0.9, block_rows=20).agg({"comparisons": "sum"}).first()[0]
        counts.append(found)
        assert found < n * (n - 1) // 6
    assert counts[2] < 2.6 * counts[1] < 2.6 * 2.6 * counts[0]


def test_one_hot_cell_is_cut(spark):
    """Everything in one direction: blocks keep their size, and all pairs are found."""
    frame = spark.range(90).selectExpr("id", "array(1D, id / 1e6D) AS embedding")
    found = similarity.similar_pairs(frame, 0.99, collapse=False, block_rows=10)
    assert found.count() == 90 * 89 // 2
    edges = similarity.link_edges(frame, 0.99, block_rows=10)
    assert edges.count() < 90 * 20


def test_given_vectors_compare_fewer_blocks(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id AS id", "embedding").cache()
    n = frame.count()
    compared = similarity.compared_blocks(frame, 0.97, block_rows=32).agg({"comparisons": "sum"}).first()[0]
    assert compared < 0.96 * n * (n - 1) / 2  # noise of 64 dimensions: little can be left out
    whole = {(r["id_a"], r["id_b"]) for r in similarity.similar_pairs(frame, 0.9, collapse=False).collect()}
    cells = {(r["id_a"], r["id_b"]) for r in similarity.similar_pairs(frame, 0.9, collapse=False, block_rows=64).collect()}
    assert cells == whole


def test_rows_are_sent_to_a_bounded_number_of_tiles(spark, monkeypatch):
    """However many blocks there are, a row goes to at most ``TILES`` pairs of tiles, and no pair is lost."""
    monkeypatch.setattr(similarity, "TILES", 4)
    rnd = np.random.default_rng(3)
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rnd.standard_normal((160, 24)))], "id long, embedding array<double>")
    rows = frame.selectExpr("id AS __id", "embedding AS __v", "false AS __solo", "24 AS __dim")
    sent = similarity._spread(rows, ["__dim"], ["__dim", "__id", "__v", "__solo"], 0.3, 16)
    assert 160 < sent.filter("__id IS NOT NULL").count() <= 4 * 160
    found = similarity.similar_pairs(frame, 0.3, collapse=False, block_rows=16, carry="embedding").collect()
    assert {(r["id_a"], r["id_b"]) for r in found} == brute(frame, 0.3).keys()
    at = {r["id"]: r["embedding"] for r in frame.collect()}
    assert found and all(r["a"] == at[r["id_a"]] and r["b"] == at[r["id_b"]] for r in found)


def _tables(spark, path, vectors):
    """The tables behind items, with ``vectors`` (vec_id, embedding)."""
    docs = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").select("vec_id").distinct()
    title = "concat('gains of ', vec_id % 3, ' new models ', vec_id % 5)"
    docs.selectExpr("vec_id AS doc_id", f"concat({title}, '\\nbody') AS text", "'en' AS lang", "concat('src', vec_id % 2) AS source", "20L AS n_chars").coalesce(1).write.parquet(f"{path}/documents.parquet")
    docs.selectExpr("vec_id AS page_id", "concat('https://a.example/', vec_id % 4) AS url", "'x' AS html").coalesce(1).write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([(i, 0, e) for i, e in vectors], "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    spark.range(3).selectExpr("id AS event_id", "timestamp'2024-01-01 00:00:00' AS ts", "id AS user_id", "'view' AS event_type", "1D AS value", "concat('{\"k\": ', id, '}') AS props").coalesce(1).write.parquet(f"{path}/events.parquet")


@pytest.mark.parametrize("query", ["JON-01", "JON-02"])
@pytest.mark.parametrize("block_rows", [None, 16])
def test_copies_pair_with_all_that_is_near(spark, tmp_path, monkeypatch, query, block_rows):
    """Equal vectors under several ids, and an id that comes twice: the pairs of the SQL, in one block and in many."""
    import duckdb

    import __spark_entry__ as entry_module
    from storyrank.catalog import q_joins

    if block_rows:
        monkeypatch.setattr(q_joins, "similar_pairs", lambda *a, **k: similarity.similar_pairs(*a, **k, block_rows=block_rows))
    rnd = np.random.default_rng(11)
    some = [[float(x) for x in v] for v in rnd.standard_normal((40, 6)).astype(np.float32)]
    copies = [some[0]] * 30 + [some[1]] * 5 + [[2 * x for x in some[0]]]
    vectors = [*enumerate([*some, *copies]), (7, some[7]), (8, some[9])]
    _tables(spark, tmp_path, vectors)
    con = duckdb.connect()
    for name in ("documents", "pages", "embeddings", "events"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(con.execute(entry_module.oracle_sql()[query]).fetchall())
    got = sorted(tuple(r) for r in entry_module.queries()[query](spark, str(tmp_path)).collect())
    assert got == want and len(want) > 31 * 30 // 2
