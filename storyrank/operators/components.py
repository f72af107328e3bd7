"""Connected components by alternating star contraction (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyrank.session import ensure_checkpoint_dir

MAX_LOCAL_NODES = 2_000_000  # nodes a task remembers before it hands its stars on


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node around it."""
    both = edges.select("u", "v").union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.filter(F.col("v") > F.col("u")).join(least, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.union(own).filter("u <> v").distinct()


def _is_star(edges: DataFrame) -> bool:
    """Every edge goes straight to a root: no node has two parents, no parent has one."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("u").alias("n"), F.lit(1).alias("child")),
        F.struct(F.col("v").alias("n"), F.lit(0).alias("child")))).alias("e")).select("e.*")
    seen = ends.groupBy("n").agg(F.sum("child").alias("up"), F.count("*").alias("all"))
    return seen.filter((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("all") > F.col("up")))).isEmpty()


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of one partition as stars around the smallest id, a map-side combine:
    what leaves is at most one edge per node seen."""
    parent: dict = {}

    def root(x):
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for pdf in batches:
        for a, b in zip(pdf["id_a"], pdf["id_b"], strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        if len(parent) > MAX_LOCAL_NODES:
            yield _stars(parent, root)
            parent.clear()
    yield _stars(parent, root)


def _stars(parent: dict, root) -> pd.DataFrame:
    rows = [(n, root(n)) for n in parent]
    return pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["u", "v"])


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(id, component)``: the smallest id each node is connected to.

    ``edges`` has id_a and id_b; ``nodes`` (column id) adds nodes without edges. Rounds
    stop when every edge leads straight to a root; a reliable checkpoint per round keeps
    the plan short and lets a lost executor's part be read back.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    kind = edges.schema["id_a"].dataType.simpleString()
    current = (
        edges.select("id_a", "id_b").filter("id_a <> id_b")
        .mapInPandas(_contract, f"u {kind}, v {kind}").distinct().checkpoint()
    )
    while not _is_star(current):
        current = _small_star(_large_star(current)).checkpoint()
    roots = current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    found = current.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
    if nodes is None:
        return found
    return nodes.select("id").join(found, "id", "left").select(
        "id", F.coalesce("component", "id").alias("component"))
