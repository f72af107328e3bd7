"""Exact nearest items: small query sets ride along with the scan, large ones search metric cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyrank.functions.vectors import unit_rows
from storyrank.operators.similarity import (
    BLOCK_ROWS, MARGIN, RINGS, block_number, blocked, in_cells, matrix,
)
from storyrank.session import stage

MAX_BROADCAST_QUERIES = 4096
RING = 0.1  # width of a cell's rings, in radians
STRIP = 256  # queries whose distances to all blocks are held at once


def _top_block(q_ids, q_unit: np.ndarray, ids, unit: np.ndarray, k: int):
    sim = np.clip(q_unit @ unit.T, 0.0, 1.0)
    for row, qid in enumerate(q_ids):
        if len(ids) > k:
            floor = np.partition(sim[row], len(ids) - k)[len(ids) - k]
            best = np.flatnonzero(sim[row] >= floor)
        else:
            best = np.arange(len(ids))
        order = sorted(best.tolist(), key=lambda j: (-sim[row, j], ids[j]))[:k]
        for j in order:
            yield qid, ids[j], float(sim[row, j])


def similar_items(
    items: DataFrame, queries: DataFrame, k: int = 20, since=None,
    max_broadcast: int = MAX_BROADCAST_QUERIES, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(query_id, id, similarity, rank)``: the ``k`` nearest items of each query.

    Exact. Similarity is the cosine, at least 0; ties go by the smaller id. A query meets items of
    its own length; an item or a query without a direction is like nothing (similarity 0). Rows
    without a vector are left out. A small set of queries (its size is checked) rides along with
    the scan and every task ships only its own best ``k``; more queries than that search the
    items' cells (``by_cells``).
    """
    items = items.filter(F.col("embedding").isNotNull())
    if since is not None:
        items = items.filter(F.col("published_at") >= F.lit(since).cast("timestamp"))
    q_type = queries.schema["query_id"].dataType.simpleString()
    i_type = items.schema["id"].dataType.simpleString()
    schema = f"query_id {q_type}, id {i_type}, similarity double"
    rows = items.select("id", "embedding")
    small = queries.select("query_id", "embedding").limit(max_broadcast + 1).collect()
    if len(small) <= max_broadcast:
        by_dim: dict[int, tuple[list, list]] = {}
        for r in small:
            ids, vecs = by_dim.setdefault(len(r["embedding"]), ([], []))
            ids.append(r["query_id"])
            vecs.append(r["embedding"])
        packed = {dim: (ids, unit_rows(np.nan_to_num(np.array(v, dtype=np.float64), nan=0.0, posinf=0.0, neginf=0.0)))
                  for dim, (ids, v) in by_dim.items()}
        shared = items.sparkSession.sparkContext.broadcast(packed)

        def scan(batches):
            import pandas as pd

            best: dict = {}  # of each query the nearest so far, so a task sends k rows a query
            for pdf in batches:
                dims = pdf["embedding"].map(len)
                out = []
                for dim, (q_ids, q_unit) in shared.value.items():
                    part = pdf[dims == dim]
                    if len(part):
                        unit = unit_rows(np.nan_to_num(np.vstack(part["embedding"].to_numpy()).astype(np.float64),
                                                       nan=0.0, posinf=0.0, neginf=0.0))
                        out += _top_block(q_ids, q_unit, part["id"].tolist(), unit, k)
                for query, other, near in out:
                    best.setdefault(query, []).append((-near, other))
                best = {q: sorted(found)[:k] for q, found in best.items()}
            yield pd.DataFrame([(q, other, -near) for q, found in best.items() for near, other in found],
                               columns=["query_id", "id", "similarity"])

        found = rows.mapInPandas(scan, schema)
    else:
        found = by_cells(rows, queries.select("query_id", "embedding"), k, block_rows)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# --- search in cells --------------------------------------------------------------
def _guide(pivots: DataFrame, bounds: DataFrame, cut: DataFrame) -> DataFrame:
    """One row for each vector length: pivots, and of every block code its size, its blocks and the
    angles it spans (at most ``MAX_PIVOTS * RINGS`` codes by ``REFERENCES`` angles)."""
    spans = bounds.groupBy("__dim", "__code").agg(
        F.array_sort(F.collect_list(F.struct("k", "low", "high"))).alias("e"))
    codes = spans.join(cut, ["__dim", "__code"]).groupBy("__dim").agg(F.array_sort(F.collect_list(
        F.struct("__code", "__size", "__parts", F.col("e.low").alias("low"), F.col("e.high").alias("high")))).alias("c"))
    return codes.join(pivots, "__dim").select(
        "__dim", "__pivots", "__count", F.col("c.__code").alias("codes"), F.col("c.__size").alias("sizes"),
        F.col("c.__parts").alias("parts"), F.flatten("c.low").alias("low"), F.flatten("c.high").alias("high"))


def _target_kernel(k: int, block_rows: int, again: bool):
    """The block codes each query has to meet: ``query, code, parts, size``.

    No item of a code is nearer than the query's angle to any pivot differs from the code's.
    First a query meets its most promising codes, as many as hold ``k`` items and a block of
    rows; then (``again``) each other code that could hold an item as near as its ``k``-th so far.
    """
    need = max(k, block_rows)
    schema = pa.schema([("__place", pa.int64()), ("__code", pa.int64()), ("__parts", pa.int64()), ("__size", pa.int64())])

    def kernel(queries: pa.Table, guide: pa.Table) -> pa.Table:
        if not len(queries) or not len(guide):
            return schema.empty_table()
        one = {name: guide[name][0] for name in guide.column_names}
        codes, sizes, parts = (one[c].values.to_numpy() for c in ("codes", "sizes", "parts"))
        low, high = (one[c].values.to_numpy().reshape(len(codes), -1) for c in ("low", "high"))
        pivots = one["__pivots"].values.to_numpy().reshape(one["__count"].as_py(), -1)
        unit = unit_rows(matrix(queries["__v"]))
        places = queries["__place"].to_numpy()
        limit = queries["__limit"].to_numpy() if again else None
        out = []
        for a in range(0, len(unit), STRIP):
            angle = np.arccos(np.clip(unit[a:a + STRIP] @ pivots.T, -1.0, 1.0))
            least = np.zeros((len(angle), len(codes)))
            for r in range(low.shape[1]):
                own = angle[:, r][:, None]
                np.maximum(least, np.maximum(low[:, r] - own, own - high[:, r]), out=least)
            order = np.argsort(least + angle[:, codes // RINGS], axis=1, kind="stable")
            held = np.cumsum(sizes[order], axis=1) - sizes[order]
            take = np.zeros(least.shape, dtype=bool)
            np.put_along_axis(take, order, held < need, axis=1)
            near = least <= np.pi / 2 + MARGIN
            if again:
                take = ~take & (least <= limit[a:a + STRIP][:, None] + MARGIN)
            rows, cols = np.nonzero(take & near)
            out.append(pa.table([places[a + rows], codes[cols], parts[cols], sizes[cols]], schema=schema))
        return pa.concat_tables(out)

    return kernel


def _meet_kernel(k: int, schema: pa.Schema):
    """Of each query the nearest ``k`` items of one block that are like it and as near as its floor."""
    def kernel(queries: pa.Table, items: pa.Table) -> pa.Table:
        if not len(queries) or not len(items):
            return schema.empty_table()
        items = items.sort_by("__id")  # then positions break ties as ids do
        sim = np.minimum(unit_rows(matrix(queries["__v"])) @ unit_rows(matrix(items["__v"])).T, 1.0)
        floor = queries["__floor"].to_numpy()[:, None] - MARGIN
        if sim.shape[1] > k:
            floor = np.maximum(floor, np.partition(sim, sim.shape[1] - k, axis=1)[:, [sim.shape[1] - k]])
        rows, cols = np.nonzero((sim > 0) & (sim >= floor))
        order = np.lexsort((cols, -sim[rows, cols], rows))
        rows, cols = rows[order], cols[order]
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        rank = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))
        rows, cols = rows[rank < k], cols[rank < k]
        return pa.table([queries["__place"].take(pa.array(rows)), items["__id"].take(pa.array(cols)),
                         pa.array(sim[rows, cols])], schema=schema)

    return kernel


def _targets(asked: DataFrame, guide: DataFrame, k: int, block_rows: int, again: bool) -> DataFrame:
    chunks = asked.select("__dim", F.col("__qb").alias("__to")).distinct()
    sent = guide.join(chunks, "__dim")
    return asked.groupBy("__dim", "__qb").cogroup(sent.groupBy("__dim", "__to")).applyInArrow(
        _target_kernel(k, block_rows, again), "__place long, __code long, __parts long, __size long")


def _meet(asked: DataFrame, targets: DataFrame, items: DataFrame, k: int, block_rows: int) -> DataFrame:
    """Queries against the blocks of their codes; a block that very many queries meet is met in chunks of these."""
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1))
    wanted = targets.groupBy("__code", "__dim").agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("long").alias("__chunks"))
    asks = targets.join(wanted, ["__code", "__dim"]).withColumn("__chunk", F.pmod(F.xxhash64("__place"), F.col("__chunks")))
    asks = asks.join(asked.select("__place", "__v", "__floor"), "__place").withColumn("__part", each).select(
        "__place", "__v", "__floor", "__dim", "__chunk", block_number("__code", F.col("__part")).alias("__b"))
    rows = items.join(wanted, ["__code", "__dim"]).select(
        "__id", "__v", "__dim", "__b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__chunks") - 1)).alias("__chunk"))
    id_type = items.schema["__id"].dataType
    arrow = pa.string() if isinstance(id_type, T.StringType) else pa.int32() if isinstance(id_type, T.IntegerType) else pa.int64()
    kernel = _meet_kernel(k, pa.schema([("__place", pa.int64()), ("id", arrow), ("similarity", pa.float64())]))
    keys = ["__dim", "__b", "__chunk"]
    return asks.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(
        kernel, f"__place long, id {id_type.simpleString()}, similarity double")


def _prepared(items: DataFrame, queries: DataFrame, k: int, block_rows: int):
    """Items in their blocks, the guide to these, and the distinct query vectors with a number each."""
    usable = lambda df, ident, name: df.filter(F.size("embedding") > 0).select(
        F.col(ident).alias(name), F.col("embedding").alias("__v"), F.size("embedding").alias("__dim"))
    rows = usable(items, "id", "__id")
    # Of equal vectors only the k smallest ids can be among anyone's nearest k.
    same = Window.partitionBy("__v").orderBy("__id")
    heads = stage(rows.withColumn("__copy", F.row_number().over(same)).filter(F.col("__copy") <= k).drop("__copy"))
    names = ["__dim", "__id", "__v"]
    placed, pivots, bounds, cut = in_cells(blocked(heads, ["__dim"], "__id", block_rows), ["__dim"], RING, names, block_rows)
    blocks = placed.join(cut, ["__dim", "__code"]).select(
        *names, "__code", block_number("__code", F.pmod(F.xxhash64("__id"), F.col("__parts"))).alias("__b"))
    vectors = queries.filter(F.size("embedding") > 0).select(F.col("embedding").alias("__v")).distinct().select(
        "__v", F.size("__v").alias("__dim"), F.monotonically_increasing_id().alias("__place"))
    asked = stage(blocked(vectors, ["__dim"], "__place", block_rows).select("__v", "__dim", "__place", F.col("__b").alias("__qb")))
    return heads, blocks, stage(_guide(pivots, bounds, cut)), asked


def _search(blocks: DataFrame, guide: DataFrame, asked: DataFrame, k: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """(items like each query vector, at least its nearest ``k``; the codes it met)."""
    with_dim = lambda targets: targets.join(asked.select("__place", "__dim"), "__place")
    begun = with_dim(_targets(asked, guide, k, block_rows, False))
    first = stage(_meet(asked.withColumn("__floor", F.lit(0.0)), begun, blocks, k, block_rows))
    best = first.withColumn("__rank", F.row_number().over(
        Window.partitionBy("__place").orderBy(F.desc("similarity"), "id"))).filter(F.col("__rank") == k).select(
            "__place", F.col("similarity").alias("__floor"))
    bounded = asked.join(best, "__place", "left").withColumn("__floor", F.coalesce("__floor", F.lit(0.0))).withColumn(
        "__limit", F.acos(F.least("__floor", F.lit(1.0))))
    further = with_dim(_targets(bounded, guide, k, block_rows, True))
    rest = _meet(bounded, further, blocks, k, block_rows)
    return first.unionByName(rest), begun.unionByName(further)


def by_cells(items: DataFrame, queries: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(query_id, id, similarity)``: at least the ``k`` nearest items of each query, by two rounds over cells.

    Items lie in cells around pivots and rings of these. Each query first meets the most promising
    blocks; the ``k``-th nearest item there bounds the angle within which the others can matter,
    and by the triangle inequality most blocks of clustered vectors are never met. Equal query
    vectors search once. Only where fewer than ``k`` items are like a query, the smallest ids
    fill its list with similarity 0.
    """
    heads, blocks, guide, asked = _prepared(items, queries, k, block_rows)
    found, _ = _search(blocks, guide, asked, k, block_rows)
    nearest = stage(found.withColumn("__rank", F.row_number().over(
        Window.partitionBy("__place").orderBy(F.desc("similarity"), "id"))).filter(F.col("__rank") <= k).drop("__rank"))
    few = asked.select("__place", "__dim").join(nearest.groupBy("__place").agg(F.count("*").alias("n")), "__place", "left").filter(
        F.coalesce("n", F.lit(0)) < k)
    # Fewer than k of the 2 k smallest ids are like the query already.
    low = heads.select("__dim", F.col("__id").alias("id")).withColumn("__rank", F.row_number().over(
        Window.partitionBy("__dim").orderBy("id"))).filter(F.col("__rank") <= 2 * k)
    filler = few.join(low, "__dim").join(nearest, ["__place", "id"], "left_anti").select("__place", "id", F.lit(0.0).alias("similarity"))
    answers = nearest.unionByName(filler).join(asked.select("__place", "__v"), "__place")
    return queries.join(answers, queries["embedding"] == answers["__v"]).select("query_id", "id", "similarity")


def met_items(items: DataFrame, queries: DataFrame, k: int = 20, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(query_id, compared)``: with how many items ``by_cells`` compares each query."""
    _, blocks, guide, asked = _prepared(items, queries, k, block_rows)
    _, met = _search(blocks, guide, asked, k, block_rows)
    compared = met.groupBy("__place").agg(F.sum("__size").alias("compared")).join(asked.select("__place", "__v"), "__place")
    return queries.join(compared, queries["embedding"] == compared["__v"]).select("query_id", "compared")
