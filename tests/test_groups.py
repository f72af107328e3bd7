import itertools
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from storyrank.operators import clustering as cl
from storyrank.operators import feedback as fb
from storyrank.operators.components import connected_components
from storyrank.operators.grouping import exact_rank, first_per_key, top_n
from storyrank.operators.nearest import similar_items
from storyrank.operators.similarity import similar_pairs


def vectors(n, d, seed, copies=0):
    rng = np.random.default_rng(seed)
    mat = rng.normal(size=(n, d)) + rng.normal(size=(1, d)) * 0.7
    for i in range(copies):
        mat[n - 1 - i] = mat[0]
    return mat.astype(np.float32)


def frame(spark, mat):
    return spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(mat)], "id long, embedding array<float>")


def cosines(mat):
    m = mat.astype(np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    return m @ m.T


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_pairs_equal_brute_force(spark, block_rows):
    mat = vectors(60, 8, 1)
    sim = cosines(mat)
    want = {(i, j) for i, j in itertools.combinations(range(60), 2) if sim[i, j] >= 0.6}
    got = similar_pairs(frame(spark, mat), 0.6, block_rows=block_rows).collect()
    assert {(r["id_a"], r["id_b"]) for r in got} == want
    assert all(abs(r["similarity"] - sim[r["id_a"], r["id_b"]]) < 1e-9 for r in got)


def test_copies_add_rows_not_squares(spark):
    mat = vectors(90, 8, 2, copies=60)
    got = similar_pairs(frame(spark, mat), 0.9).collect()
    stars = [r for r in got if r["similarity"] == 1.0 and r["id_a"] == 0]
    assert len(stars) == 60
    assert not any(r["id_a"] >= 30 for r in got)


def test_within_keeps_windows_apart(spark):
    df = spark.createDataFrame([(1, "x", [1.0, 0.0]), (2, "x", [1.0, 0.1]), (3, "y", [1.0, 0.0])],
                               "id long, day string, embedding array<double>")
    got = similar_pairs(df, 0.9, within=["day"]).collect()
    assert [(r["id_a"], r["id_b"]) for r in got] == [(1, 2)]


@pytest.mark.parametrize("seed,block_rows", [(3, 9), (4, 1000)])
def test_single_link_groups(spark, seed, block_rows):
    mat = vectors(70, 6, seed, copies=20)
    sim = cosines(mat)
    label = list(range(70))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in itertools.combinations(range(70), 2):
        if sim[i, j] >= 0.85 or np.array_equal(mat[i], mat[j]):
            a, b = find(i), find(j)
            label[max(a, b)] = min(a, b)
    got = dict(rows(cl.dedup_groups(frame(spark, mat), 0.85, block_rows=block_rows)))
    assert got == {i: find(i) for i in range(70)}


def test_components_of_a_long_chain(spark):
    edges = spark.range(60).select(F.col("id").alias("id_a"), (F.col("id") + 1).alias("id_b"))
    more = edges.union(spark.createDataFrame([(100, 101)], "id_a long, id_b long"))
    got = dict(rows(connected_components(more)))
    assert set(got[i] for i in range(61)) == {0} and got[101] == 100


def greedy(sim, threshold):
    groups = [[i] for i in range(len(sim))]
    while len(groups) > 1:
        best, at = -1.0, None
        for a in range(len(groups)):
            for b in range(a + 1, len(groups)):
                low = min(sim[i][j] for i in groups[a] for j in groups[b])
                if low > best:
                    best, at = low, (a, b)
        if best < threshold:
            break
        groups[at[0]] += groups.pop(at[1])
    return sorted(tuple(sorted(g)) for g in groups)


def items_of(spark, mat, fields):
    data = [(f"i{k:03d}", [float(x) for x in v], *fields(k)) for k, v in enumerate(mat)]
    return spark.createDataFrame(data, "id string, embedding array<float>, family string, source string, url string, title string")


def clusters(df):
    out = {}
    for item, group in rows(df):
        out.setdefault(group, []).append(item)
    return sorted(tuple(sorted(g)) for g in out.values())


@pytest.mark.parametrize("seed", [5, 6, 7])
@pytest.mark.parametrize("max_edges", [200_000, 2])
def test_complete_link_equals_greedy(spark, seed, max_edges):
    mat = vectors(40, 5, seed)
    sim = cosines(mat)
    rnd = random.Random(seed)
    src = [f"s{rnd.randrange(6)}" for _ in range(40)]
    fields = lambda k: ("community", src[k], f"https://h/{k}", "t")
    for i, j in itertools.combinations(range(40), 2):
        if src[i] == src[j]:
            sim[i, j] = sim[j, i] = -1.0
    want = sorted(tuple(f"i{k:03d}" for k in g) for g in greedy(sim, 0.7))
    got = clusters(cl.cluster_stories(items_of(spark, mat, fields), 0.7, max_edges=max_edges, block_rows=11))
    assert got == want


def test_no_chaining(spark):
    rad = np.deg2rad([0, 22.8, 45.6])
    mat = np.stack([np.cos(rad), np.sin(rad)], axis=1)
    got = clusters(cl.cluster_stories(items_of(spark, mat, lambda k: ("community", f"s{k}", None, "t")), 0.86))
    assert sorted(len(g) for g in got) == [1, 2]


def test_link_rules(spark):
    one = np.array([[1.0, 0.0]] * 7)
    kinds = [
        ("academia", "arxiv", "https://arxiv.org/abs/2401.00001v1", "Graph Routing Models"),
        ("academia", "hf", "https://arxiv.org/abs/2401.00001v2", "Graph Routing Models"),
        ("academia", "arxiv", "https://arxiv.org/abs/2401.00002", "Other Paper"),
        ("community", "reddit", "https://r/x", "Thread on Graph Routing"),
        ("community", "hn", "https://n/y", "Sparse planner tools"),
        ("industry", "tc", "https://tc/a", "Story A"),
        ("industry", "tc", "https://tc/b", "Story B"),
    ]
    df = items_of(spark, one, lambda k: kinds[k])
    profile = cl.link_profile(df, []).select("id", "p")
    pairs = profile.select(F.col("id").alias("x"), F.col("p").alias("a")).join(
        profile.select(F.col("id").alias("y"), F.col("p").alias("b")), F.col("x") < F.col("y"))
    got = {(r["x"][-1], r["y"][-1]) for r in pairs.filter(cl.cannot_link()).select("x", "y").collect()}
    assert ("0", "1") not in got and ("0", "2") in got and ("0", "3") not in got
    assert ("0", "4") in got and ("5", "6") in got and ("3", "4") not in got


def test_cluster_copies_collapse(spark):
    mat = np.array([[1.0, 0.0]] * 30 + [[0.0, 1.0]] * 2)
    fields = lambda k: ("community", "same", "https://h/one", "same title")
    df = items_of(spark, mat, fields)
    nodes, _ = cl.link_nodes(cl.link_profile(df, []), [])
    assert nodes.count() == 2
    assert sorted(len(g) for g in clusters(cl.cluster_stories(df, 0.86))) == [2, 30]


def fold_by_hand(leads, threshold):
    kept, under = [], {}
    for lead in sorted(leads, key=lambda r: r["pos"]):
        to = next((k for k in kept if not (lead["tier"] == k["tier"] == "breakthrough")
                   and np.dot(lead["v"], k["v"]) / np.linalg.norm(lead["v"]) / np.linalg.norm(k["v"]) >= threshold), None)
        if to is None:
            kept.append(lead)
        under[lead["id"]] = (to or lead)["id"]
    return under


@pytest.mark.parametrize("seed", [8, 9, 10])
def test_fold_equals_greedy(spark, seed):
    mat = vectors(50, 4, seed, copies=12)
    rnd = random.Random(seed)
    order = list(range(50))
    rnd.shuffle(order)
    leads = [dict(day="d", id=f"l{i:02d}", pos=order[i], v=mat[i].astype(float),
                  tier="breakthrough" if rnd.random() < 0.4 else "notable") for i in range(50)]
    df = spark.createDataFrame([(x["day"], x["id"], x["pos"], [float(e) for e in x["v"]], x["tier"]) for x in leads],
                               "day string, id string, pos int, embedding array<float>, tier string")
    got = {r["id"]: r["lead_id"] for r in cl.fold_leads(df, 0.8).collect()}
    assert got == fold_by_hand(leads, 0.8)


def throttle_by_hand(hits, n, secs):
    recent, out = {}, {}
    for who, t, i in sorted(hits, key=lambda h: (h[0], h[1], h[2])):
        q = [x for x in recent.get(who, []) if t - x <= secs]
        out[i] = len(q) < n
        if out[i]:
            q.append(t)
        recent[who] = q
    return out


@pytest.mark.parametrize("n,gap", [(3, 5), (3, 40), (60, 2), (1, 30)])
def test_throttle_equals_scan(spark, n, gap):
    rnd = random.Random(n * 100 + gap)
    hits, t = [], 0
    for i in range(400):
        t += rnd.randrange(0, gap * 2) if rnd.random() < 0.95 else 500
        hits.append(("hot" if rnd.random() < 0.8 else "cold", t, i))
    df = spark.createDataFrame(hits, "who string, t long, id long").withColumn("ts", F.timestamp_seconds("t"))
    got = {r["id"]: r["admitted"] for r in fb.throttle(df, "who", n, 60).collect()}
    assert got == throttle_by_hand(hits, n, 60)


@pytest.mark.parametrize("big", [False, True])
def test_nearest_items(spark, big):
    mat = vectors(80, 6, 11)
    sim = np.clip(cosines(mat), 0, 1)
    df = frame(spark, mat)
    q = df.filter("id < 5").withColumnRenamed("id", "query_id")
    got = similar_items(df, q, k=7, max_broadcast=2 if big else 4096, block_rows=13).collect()
    for qid in range(5):
        want = sorted(range(80), key=lambda j: (-sim[qid, j], j))[:7]
        assert [r["id"] for r in sorted((r for r in got if r["query_id"] == qid), key=lambda r: r["rank"])] == want


def test_exact_rank_and_caps(spark):
    df = spark.range(500).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("x").alias("k"),
                                 (F.col("id") * 37 % 101).alias("v"), F.col("id").alias("id")).repartition(7)
    got = exact_rank(df, ["k"], [F.desc("v"), F.asc("id")]).collect()
    for key in ("hot", "x"):
        part = sorted((r for r in got if r["k"] == key), key=lambda r: (-r["v"], r["id"]))
        assert [r["pos"] for r in part] == list(range(1, len(part) + 1))
    few = top_n(df, ["k"], [F.desc("v"), F.asc("id")], 4).collect()
    assert len(few) == 8
    first = {r["k"]: r["id"] for r in first_per_key(df, ["k"], ["v", "id"]).collect()}
    assert first == {"hot": 101, "x": 0}
