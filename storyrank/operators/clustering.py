"""Near-duplicate groups and constrained complete-link story clusters."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyrank import constants as K
from storyrank.functions import text as X
from storyrank.functions.vectors import centroid
from storyrank.operators.components import connected_components
from storyrank.operators.grouping import exact_rank
from storyrank.operators.similarity import BLOCK_ROWS, has_direction, link_edges, similar_pairs
from storyrank.session import ensure_checkpoint_dir, stage

MAX_EDGES = 200_000  # allowed pairs of a component that one task merges


def dedup_groups(
    items: DataFrame, threshold: float = K.DEDUP_COSINE, within: list[str] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(id, group)`` by single link; an item without a vector is its own group."""
    edges = link_edges(items, threshold, within=within, block_rows=block_rows)
    return connected_components(edges, items).withColumnRenamed("component", "group")


def cannot_link(a: str = "a", b: str = "b") -> Column:
    """Two items that must not share a story, over struct columns with the fields
    family, source, path, paper and tokens.

    Papers only join the same paper; one source does not tell one story under two paths;
    a paper and a non-paper need some words in common unless the paper id matches.
    """
    f = lambda side, name: F.col(f"{side}.{name}")
    paper_a, paper_b = f(a, "family") == "academia", f(b, "family") == "academia"
    same_paper = F.coalesce(f(a, "paper") == f(b, "paper"), F.lit(False))
    other_path = F.coalesce(
        (f(a, "path") != "") & (f(b, "path") != "") & (f(a, "path") != f(b, "path")), F.lit(False))
    apart = (
        (F.size(f(a, "tokens")) > 0) & (F.size(f(b, "tokens")) > 0)
        & (X.token_jaccard(f(a, "tokens"), f(b, "tokens")) < K.PAPER_TITLE_OVERLAP)
    )
    return (
        F.when(paper_a & paper_b, ~same_paper)
        .when((f(a, "source") == f(b, "source")) & other_path, F.lit(True))
        .otherwise((paper_a | paper_b) & ~same_paper & apart)
    )


def link_profile(items: DataFrame, within: list[str]) -> DataFrame:
    """What clustering needs to know of an item."""
    raw_id = F.col("arxiv_id") if "arxiv_id" in items.columns else F.lit(None).cast("string")
    return items.select(
        *within, "id", "embedding",
        F.struct(
            "family", "source", F.nullif(X.url_path("url"), F.lit("")).alias("path"),
            X.arxiv_id(raw_id, "url").alias("paper"), X.title_tokens("title").alias("tokens"),
        ).alias("p"),
    )


def link_nodes(profile: DataFrame, within: list[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, id -> node). Items alike in vector and in every field the link rules read
    always end up together, so they stand as one node; papers without an id never join
    another paper and stay single (``solo``)."""
    solo = (F.col("p.family") == "academia") & F.col("p.paper").isNull()
    parts = [*within, "embedding", "p"]
    sig = F.concat_ws("-", F.hex(F.xxhash64(*parts)), F.hex(F.xxhash64(F.lit(7), *parts)))
    marked = profile.withColumn("solo", F.coalesce(solo, F.lit(False))).withColumn(
        "sig", F.when(
            F.col("solo") | ~has_direction("embedding"), F.concat(F.lit("id:"), F.col("id").cast("string"))
        ).otherwise(sig))
    heads = marked.groupBy("sig").agg(F.min("id").alias("node"))
    owner = marked.select("id", "sig").join(heads, "sig").select("id", "node")
    nodes = marked.join(heads.select(F.col("node").alias("id")), "id", "left_semi").drop("sig")
    return nodes, owner


def allowed_edges(
    nodes: DataFrame, threshold: float, within: list[str], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Node pairs at or above the threshold that may share a story."""
    pairs = similar_pairs(nodes, threshold, within=within, solo="solo", collapse=False, block_rows=block_rows, carry="p")
    return pairs.filter(~cannot_link()).select("id_a", "id_b", "similarity")


def _complete_link(pdf: pd.DataFrame) -> pd.DataFrame:
    """Exact greedy merging of one component. The best pair is the most similar one, then
    the one with the smallest ids; a pair that is not listed can never merge."""
    near: dict = {}
    heap = []
    for a, b, s in zip(pdf["id_a"], pdf["id_b"], pdf["similarity"], strict=True):
        near.setdefault(a, {})[b] = s
        near.setdefault(b, {})[a] = s
        heap.append((-s, a, b))
    heapq.heapify(heap)
    members = {n: [n] for n in near}
    while heap:
        neg, a, b = heapq.heappop(heap)
        if near.get(a, {}).get(b) != -neg:
            continue
        merged = {c: min(near[a][c], near[b][c]) for c in near[a].keys() & near[b].keys()}
        for gone in (a, b):
            for c in near[gone]:
                if c in near:
                    near[c].pop(gone, None)
        del near[b]
        near[a] = merged
        members[a] += members.pop(b)
        for c, s in merged.items():
            near[c][a] = s
            heapq.heappush(heap, (-s, min(a, c), max(a, c)))
    rows = [(n, head) for head, nodes in members.items() for n in nodes]
    return pd.DataFrame(rows, columns=["node", "group"])


def _complete_link_rounds(edges: DataFrame) -> DataFrame:
    """The same merges for components of any size, as joins and aggregates.

    Each round merges all pairs of groups that are each other's best pair. Complete
    linkage never brings a merged group closer to a third, so those merges are the ones
    the greedy order makes as well, ties included.

    A checkpoint keeps the estimated size of its rows, and a join multiplies the sizes of its
    sides unless one is known to hold each key once. Each group moves at most once a round; the
    grouping of the moves says so, or the estimate would take three times the digits each round.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    live = edges.select("id_a", "id_b", "similarity").checkpoint()
    owner = live.select(F.col("id_a").alias("node")).union(live.select("id_b")).distinct().select(
        "node", F.col("node").alias("group")).checkpoint()
    while True:
        order = F.struct(-F.col("similarity"), "id_a", "id_b")
        ends = live.select("*", F.explode(F.array("id_a", "id_b")).alias("end"))
        best = ends.groupBy("end").agg(F.min_by(F.struct("id_a", "id_b"), order).alias("pick"))
        mutual = best.groupBy("pick").agg(F.count("*").alias("n")).filter("n = 2").select("pick.*").checkpoint()
        if mutual.isEmpty():
            return owner
        moves = mutual.select(
            F.explode(F.array("id_a", "id_b")).alias("old"), F.col("id_a").alias("new")).groupBy("old").agg(F.min("new").alias("new"))
        owner = owner.join(moves, owner["group"] == moves["old"], "left").select(
            "node", F.coalesce("new", "group").alias("group")).checkpoint()
        m_a = moves.select(F.col("old").alias("id_a"), F.col("new").alias("new_a"))
        m_b = moves.select(F.col("old").alias("id_b"), F.col("new").alias("new_b"))
        parts = lambda c: F.when(F.col(c).isNull(), 1).otherwise(2)
        moved = live.join(m_a, "id_a", "left").join(m_b, "id_b", "left").select(
            F.coalesce("new_a", "id_a").alias("x"), F.coalesce("new_b", "id_b").alias("y"),
            "similarity", (parts("new_a") * parts("new_b")).alias("need"),
        ).filter("x <> y")
        live = (
            moved.groupBy(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
            .agg(F.min("similarity").alias("similarity"), F.count("*").alias("n"), F.max("need").alias("need"))
            .filter("n = need").select("id_a", "id_b", "similarity").checkpoint()
        )


def cluster_stories(
    items: DataFrame, threshold: float = K.STORY_COSINE, within: list[str] | None = None,
    max_edges: int = MAX_EDGES, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(id, group)``: complete-link clusters under the link rules.

    A group lies inside one connected component of the allowed pairs, so components are
    clustered apart: up to ``max_edges`` pairs in one task, larger ones in rounds over
    the whole cluster. ``within`` (the day) keeps windows from meeting.
    """
    within = within or []
    nodes, owner = link_nodes(stage(link_profile(items, within)), within)
    edges = stage(allowed_edges(stage(nodes), threshold, within, block_rows))
    return owner.join(merged_nodes(edges, max_edges), "node", "left").select("id", F.coalesce("group", "node").alias("group"))


def merged_nodes(edges: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """``(node, group)`` of the nodes that the allowed pairs ``edges`` name."""
    found = connected_components(edges)
    placed = edges.join(found.select(F.col("id").alias("id_a"), "component"), "id_a")
    placed = placed.join(placed.groupBy("component").agg(F.count("*").alias("size")), "component")
    kind = edges.schema["id_a"].dataType.simpleString()
    small = placed.filter(F.col("size") <= max_edges).groupBy("component").applyInPandas(
        lambda pdf: _complete_link(pdf), f"node {kind}, group {kind}")
    big = placed.filter(F.col("size") > max_edges)
    return small if big.isEmpty() else small.unionByName(_complete_link_rounds(big))


def cluster_violations(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """``(check, violations)``: in-group pairs that are not allowed, pairs of groups that
    could still merge, items in several groups. Counts pairs instead of listing members.

    ``groups`` and ``edges`` are over the same nodes, ``edges`` holding the allowed pairs."""
    size = groups.groupBy("group").agg(F.count("*").alias("m"))
    ga = groups.select(F.col("id").alias("id_a"), F.col("group").alias("ga"))
    gb = groups.select(F.col("id").alias("id_b"), F.col("group").alias("gb"))
    placed = edges.join(ga, "id_a").join(gb, "id_b")
    inside = placed.filter("ga = gb").groupBy(F.col("ga").alias("group")).agg(F.count("*").alias("n"))
    lacking = size.join(inside, "group", "left").filter(
        F.coalesce("n", F.lit(0)) < F.col("m") * (F.col("m") - 1) / 2)
    across = placed.filter("ga <> gb").groupBy(
        F.least("ga", "gb").alias("x"), F.greatest("ga", "gb").alias("y")).agg(F.count("*").alias("n"))
    sx = size.select(F.col("group").alias("x"), F.col("m").alias("mx"))
    sy = size.select(F.col("group").alias("y"), F.col("m").alias("my"))
    open_pairs = across.join(sx, "x").join(sy, "y").filter(F.col("n") == F.col("mx") * F.col("my"))
    twice = groups.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    checks = [("pair not allowed", lacking), ("pair of groups left to merge", open_pairs),
              ("item in several groups", twice)]
    out = None
    for name, df in checks:
        one = df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
        out = one if out is None else out.union(one)
    return out


# --- stories out of groups --------------------------------------------------------
def order_groups(members: DataFrame) -> DataFrame:
    """``(group, id, score, pos, group_rank)``: members by score, groups by their best."""
    ranked = exact_rank(members.select("group", "id", "score"), ["group"], [F.desc("score"), F.asc("id")])
    heads = members.groupBy("group").agg(F.max("score").alias("best"))
    placed = exact_rank(heads, [], [F.desc("best"), F.asc("group")], "group_rank")
    return ranked.join(placed.select("group", "group_rank"), "group")


def modal_family(members: DataFrame) -> DataFrame:
    """Most frequent family per group; of equals, that of the best-scored member."""
    first = F.min(F.struct(-F.col("score"), "id"))
    counts = members.groupBy("group", "family").agg(F.count("*").alias("n"), first.alias("first"))
    return counts.groupBy("group").agg(
        F.min_by("family", F.struct(-F.col("n"), "first")).alias("family"))


def build_stories(members: DataFrame, with_vectors: bool = True) -> DataFrame:
    """One story per group of rows (group, id, title, family, score, engagement, citation,
    and embedding): the best-scored item represents it.

    The id list is part of a story and of its id; it holds ids only, never bodies."""
    order = F.struct(-F.col("score"), "id")
    rows = members.groupBy("group").agg(
        F.min_by("title", order).alias("title"),
        F.min_by("id", order).alias("representative_item_id"),
        F.transform(F.array_sort(F.collect_list(order)), lambda e: e["id"]).alias("item_ids"),
        F.count("*").alias("mention_count"),
        F.max("engagement").alias("engagement"),
        F.max("citation").alias("citation"),
    )
    out = rows.join(modal_family(members), "group").withColumn("id", X.story_id("title", "item_ids"))
    if with_vectors:
        out = out.join(centroid(members, ["group"], "embedding").withColumnRenamed("centroid", "embedding"),
                       "group", "left")
    return out


def membership(stories: DataFrame) -> DataFrame:
    """Bridge rows ``(story_id, item_id, pos)`` of the id lists."""
    return stories.select(F.col("id").alias("story_id"), F.posexplode("item_ids").alias("pos", "item_id"))


# --- folding of near-duplicate leads ----------------------------------------------
def fold_leads(
    leads: DataFrame, threshold: float = K.LEAD_COSINE, keys: list[str] = ("day",), order: str = "pos",
) -> DataFrame:
    """``(keys, id, lead_id)``: each lead and the kept lead it is shown under (itself if kept).

    In rank order a lead is folded into the first kept lead near enough, never a
    breakthrough into a breakthrough. Whether two leads are near is fixed from the start,
    so this is the greedy independent set of the near-pair graph: per round, a lead whose
    earlier neighbours are all decided against is kept and takes its later neighbours.
    """
    keys = list(keys)
    ensure_checkpoint_dir(leads.sparkSession)
    top = F.col("tier") == "breakthrough"
    rows = leads.select(*keys, "id", "embedding", order, top.alias("solo"))
    # Equal vectors outside the breakthroughs share their fate with the best-ranked copy.
    sig = F.when(F.col("solo") | ~has_direction("embedding"), F.col("id").cast("string")).otherwise(
        F.concat_ws("-", F.hex(F.xxhash64(*keys, "embedding")), F.hex(F.xxhash64(F.lit(7), *keys, "embedding"))))
    marked = stage(rows.withColumn("sig", sig))
    heads = marked.groupBy(*keys, "sig").agg(F.min_by("id", order).alias("head"), F.min(order).alias("head_pos"))
    nodes = marked.join(heads.select(*keys, F.col("head").alias("id"), F.col("head_pos")), [*keys, "id"])
    ident = stage(nodes).withColumn("node", F.concat_ws("\u0001", *[F.col(k).cast("string") for k in keys], F.col("id").cast("string")))
    pairs = similar_pairs(ident, threshold, ident="node", within=keys, solo="solo", collapse=False)
    at = ident.select("node", F.col(order).alias("at"))
    placed = pairs.join(at.withColumnRenamed("node", "id_a").withColumnRenamed("at", "at_a"), "id_a").join(
        at.withColumnRenamed("node", "id_b").withColumnRenamed("at", "at_b"), "id_b")
    a_first = F.col("at_a") < F.col("at_b")
    edges = placed.select(
        F.when(a_first, F.col("id_a")).otherwise(F.col("id_b")).alias("early"),
        F.when(a_first, F.col("id_b")).otherwise(F.col("id_a")).alias("late"),
        F.least("at_a", "at_b").alias("early_at"),
    ).checkpoint()
    open_edges, folded = edges, None
    while not open_edges.isEmpty():
        waiting = open_edges.select(F.col("late").alias("n")).distinct()
        kept = open_edges.select(F.col("early").alias("n")).distinct().join(waiting, "n", "left_anti")
        taken = open_edges.join(kept.select(F.col("n").alias("early")), "early", "left_semi").select(
            F.col("late").alias("n")).distinct().checkpoint()
        folded = taken if folded is None else folded.union(taken)
        gone = taken.select(F.col("n").alias("early"))
        open_edges = open_edges.join(gone, "early", "left_anti").join(
            taken.select(F.col("n").alias("late")), "late", "left_anti").checkpoint()
    if folded is None:
        under = ident.select("node", F.col("id").alias("lead"))
    else:
        folded = folded.distinct().checkpoint()
        target = edges.join(folded.select(F.col("n").alias("early")), "early", "left_anti").groupBy(
            F.col("late").alias("node")).agg(F.min_by("early", "early_at").alias("to"))
        target = target.join(folded.select(F.col("n").alias("node")), "node", "left_semi")
        names = ident.select(F.col("node").alias("to"), F.col("id").alias("to_id"))
        under = ident.select("node", "id").join(target, "node", "left").join(names, "to", "left").select(
            "node", F.coalesce("to_id", "id").alias("lead"))
    heads_under = ident.select(*keys, F.col("id").alias("head"), "node").join(under, "node").drop("node")
    return marked.join(heads, [*keys, "sig"]).join(heads_under, [*keys, "head"]).select(
        *keys, "id", F.col("lead").alias("lead_id"))


def folded_mentions(fold: DataFrame, story_items: DataFrame, keys: list[str] = ("day",)) -> DataFrame:
    """``(keys, lead_id, mention_count)``: distinct items behind each kept lead."""
    return fold.join(story_items.select(F.col("story_id").alias("id"), "item_id"), "id").groupBy(
        *keys, "lead_id").agg(F.countDistinct("item_id").alias("mention_count"))


