"""Nearest items by cells: the same as brute force, with few items compared on clusters."""

import numpy as np
import pytest

from storyrank.operators import nearest


def brute(items, queries, k):
    rows = [r for r in items.collect() if r["embedding"]]
    unit = lambda v: np.nan_to_num(np.array(v, dtype=float)) / (np.linalg.norm(np.nan_to_num(np.array(v, dtype=float))) or 1.0)
    out = {}
    for q in queries.collect():
        if not q["embedding"]:
            continue
        near = [(-min(1.0, max(0.0, float(unit(q["embedding"]) @ unit(r["embedding"])))), r["id"])
                for r in rows if len(r["embedding"]) == len(q["embedding"])]
        out[q["query_id"]] = sorted((round(s, 9), i) for s, i in near)[:k]
    return {q: v for q, v in out.items() if v}


def clusters(spark, number, each, dim, spread=0.03, seed=7, text_ids=False):
    rnd = np.random.default_rng(seed)
    rows = []
    for centre in rnd.standard_normal((number, dim)):
        centre /= np.linalg.norm(centre)
        rows += [[float(x) for x in centre + spread * n] for n in rnd.standard_normal((each, dim))]
    rows += [rows[0]] * 40 + [[0.0] * dim, None, [1.0, 0.0], [0.0, 1.0], [float("nan")] * dim]
    kind = "string" if text_ids else "long"
    return spark.createDataFrame([(f"i{k:04d}" if text_ids else k, v) for k, v in enumerate(rows)],
                                 f"id {kind}, embedding array<double>").repartition(5)


@pytest.mark.parametrize("k,dim,text_ids", [(1, 8, False), (7, 8, True), (30, 3, False)])
def test_equals_brute_force(spark, k, dim, text_ids):
    items = clusters(spark, 6, 25, dim, text_ids=text_ids).cache()
    queries = items.selectExpr("id AS query_id", "embedding")
    got = {}
    for r in nearest.similar_items(items, queries, k=k, max_broadcast=3, block_rows=16).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], -round(r["similarity"], 9) + 0.0, r["id"]))
    want = brute(items, queries, k)
    assert got.keys() == want.keys()
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(want[q]) + 1))
        # Similarities agree everywhere; where they are told apart, so do ids.
        assert np.allclose([s for _, s, _ in found], [s for s, _ in want[q]], atol=1e-7)
        sure = [j for j, (s, _) in enumerate(want[q]) if all(abs(s - t) > 1e-7 or i == j for i, (t, _) in enumerate(want[q]))]
        assert all(found[j][2] == want[q][j][1] for j in sure[:-1])


def test_few_items_are_compared_on_clusters(spark):
    shares = []
    for number in (8, 32):
        items = clusters(spark, number, 40, 48, spread=0.02).filter(f"id < 40 * {number}").cache()
        queries = items.filter("id % 10 = 0").selectExpr("id AS query_id", "embedding")
        met = nearest.met_items(items, queries, k=5, block_rows=20).collect()
        assert len(met) == queries.count()
        shares.append(sum(r["compared"] for r in met) / len(met))
    assert shares[0] < 8 * 40 / 2 and shares[1] < 2 * shares[0]


def test_copies_and_repeated_queries(spark):
    items = spark.range(300).selectExpr("id", "IF(id < 290, array(1D, 0D), array(1D, CAST(id AS DOUBLE))) AS embedding")
    queries = spark.range(20).selectExpr("id AS query_id", "array(2D, 0D) AS embedding")
    got = nearest.similar_items(items, queries, k=4, max_broadcast=1, block_rows=10).collect()
    assert {(r["query_id"], r["rank"], r["id"]) for r in got} == {(q, i + 1, i) for q in range(20) for i in range(4)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, embedding array<double>")
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0])], "query_id long, embedding array<double>")
    assert nearest.by_cells(none, one, 3).count() == 0
    assert nearest.by_cells(one.withColumnRenamed("query_id", "id"), one.limit(0), 3).count() == 0
