"""Chosen-path set similarity join against all pairs."""

import random
import re

import pytest

from storyrank.llm import chosenpath
from tests.llm.conftest import edge_rows, prose


def sets_of(texts, k=2):
    out = []
    for text in texts:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        out.append({tuple(w[i:i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set())
    return out


def brute(rows):
    sets, ids = sets_of([r[1] for r in rows]), [r[0] for r in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                label[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    out = []
    for i, d in enumerate(ids):
        c = least.get(root(i))
        out.append((d, len(sets[i]), c, d is not None and d == c))
    return sorted(out, key=repr)


def copies(seed, groups, n):
    """Groups of near-copies around the threshold, chains, and texts that share a passage."""
    rnd, rows = random.Random(seed), []
    common = prose(999, 40)
    for g in range(groups):
        base = prose(seed * 1000 + g, rnd.choice([3, 10, 60, 200]))
        for _ in range(rnd.choice([1, 2, n])):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 8))):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
            if rnd.random() < 0.2:
                base = w  # a chain
            rows.append((len(rows), " ".join(w if rnd.random() < 0.7 else common + w), "en", "s", 1))
    return rows


def got(frame, **kw):
    return sorted((tuple(r) for r in chosenpath.similar_components(frame, **kw).collect()), key=repr)


def test_edge_rows_and_clashing_names(make, edges):
    want = brute(edge_rows())
    assert got(edges) == want
    assert got(make(edge_rows(), clash=True)) == want
    assert got(make([])) == []


@pytest.mark.parametrize("limits", [{}, {"small": 3, "tile": 6, "block": 700}])
def test_near_copies_equal_all_pairs(make, limits):
    rows = copies(1, 60, 25)
    assert got(make(rows).repartition(5), **limits) == brute(rows)


def test_large_groups_without_copies(make):
    """Everything alike in most words: nodes stay large, and few pairs or all of them link."""
    rnd = random.Random(3)
    base = prose(7, 120)
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(4 if i % 2 else 9):
            w[rnd.randrange(len(w))] = f"y{i}-{rnd.randrange(99)}"
        rows.append((i, " ".join(w), "en", "s", 1))
    assert got(make(rows).repartition(4), small=8, tile=50, block=5000) == brute(rows)


def test_null_ids_only(make):
    a = " ".join(prose(1, 50))
    assert got(make([(None, a, "en", "s", 1), (None, a + " more", "en", "s", 1), (None, None, "en", "s", 1)])) == [
        (None, 0, None, False), (None, 49, None, False), (None, 50, None, False)]


def test_trees_reach_the_recall():
    assert chosenpath.missed(1, 0.8) == pytest.approx(0.16)
    for depth in (1, 4):
        assert chosenpath.missed(depth, 0.8) ** chosenpath.trees_for(0.9999, 0.8, depth) <= 1e-4
