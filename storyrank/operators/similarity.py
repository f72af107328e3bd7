"""Exact similarity joins: block-partitioned pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyrank.functions.vectors import unit_rows
from storyrank.session import stage

BLOCK_ROWS = 2048
MAX_PIVOTS = 256  # cells of a group
RINGS = 16  # rings of a cell
REFERENCES = 32  # pivots whose angles bound a block
TILES = 32  # tiles of a group: a row is sent to so many pairs of them at most
TILE_ROWS = 65_536  # rows of a tile
SAMPLE = 1024  # rows of a group that pivots are picked from
MARGIN = 1e-6  # rounding of angles
OUT_ROWS = 10_000  # pairs that a task hands on at once


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of one list column as float64, non-finite parts read as 0."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks)
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.nan_to_num(flat.reshape(len(arr), -1), nan=0.0, posinf=0.0, neginf=0.0)


def blocked(df: DataFrame, keys: list[str], ident: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``__nb``, the number of even blocks of a row's key group, and ``__b``, its own.

    Only groups larger than a block are listed for the lookup, so the listed side has at
    most rows / block_rows entries and hot groups are the ones that get split.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n")) if keys else df.agg(F.count("*").alias("__n"))
    split = F.ceil(F.col("__n") / F.lit(block_rows)).cast("int")
    if keys:
        large = counts.filter(F.col("__n") > block_rows).select(*keys, split.alias("__nb"))
        out = df.join(large, keys, "left").withColumn("__nb", F.coalesce("__nb", F.lit(1)))
    else:
        out = df.withColumn("__nb", F.greatest(counts.select(split).scalar(), F.lit(1)))
    return out.withColumn("__b", F.pmod(F.xxhash64(ident), F.col("__nb")).cast("int"))


def _block_pairs(rows: DataFrame) -> DataFrame:
    """Each row once per block pair that holds its block: (__p <= __q)."""
    other = F.explode(F.sequence(F.lit(0), F.col("__nb") - 1)).alias("__other")
    return rows.select("*", other).select(
        *rows.columns,
        F.least("__b", "__other").alias("__p"),
        F.greatest("__b", "__other").alias("__q"),
    )


def _pair_kernel(threshold: float, id_type: pa.DataType, forest: bool, carry: bool):
    """Near pairs of the rows of one pair of tiles, block pair by block pair: those of ``__todo``, or ``__p, __q`` itself."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        todo = [(x["p"], x["q"]) for listed in table["__todo"].drop_null().to_pylist() for x in listed]
        todo = todo or [(table["__p"][0].as_py(), table["__q"][0].as_py())]
        table = table.filter(table["__id"].is_valid())
        if not len(table):  # blocks are cut by hash, so some may be empty
            return
        block = table["__b"].to_numpy()
        order = np.argsort(block, kind="stable")
        codes, starts = np.unique(block[order], return_index=True)
        held = dict(zip(codes.tolist(), np.split(order, starts[1:]), strict=True)) if len(codes) else {}
        unit = unit_rows(matrix(table["__v"]))
        ids = table["__id"].to_numpy()
        solo = table["__solo"].to_numpy(zero_copy_only=False)
        parent = np.arange(len(ids)) if forest else None
        for p, q in todo:
            if p not in held or q not in held:
                continue
            left, right = held[p], held[q]
            sim = np.clip(unit[left] @ unit[right].T, -1.0, 1.0)
            hit = sim >= threshold
            hit &= ~(solo[left][:, None] & solo[right][None, :])
            if p == q:
                hit = np.triu(hit, 1)
            rows, cols = np.nonzero(hit)
            sims = sim[rows, cols]
            rows, cols = left[rows], right[cols]
            if forest:
                keep = _spanning(rows, cols, parent)
                rows, cols, sims = rows[keep], cols[keep], sims[keep]
            for start in range(0, len(rows), OUT_ROWS):  # two blocks of copies pair all with all
                part = slice(start, start + OUT_ROWS)
                swap = (ids[rows[part]] > ids[cols[part]]).astype(bool)
                low, high = np.where(swap, cols[part], rows[part]), np.where(swap, rows[part], cols[part])
                out = {"id_a": pa.array(ids[low], id_type), "id_b": pa.array(ids[high], id_type), "similarity": pa.array(sims[part], pa.float64())}
                if carry:
                    out |= {"a": table["__c"].take(pa.array(low)), "b": table["__c"].take(pa.array(high))}
                yield from pa.table(out).to_batches()

    return kernel


def _spanning(rows: np.ndarray, cols: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Positions of edges that connect something new; ``parent`` keeps what is connected."""
    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = []
    for pos, (a, b) in enumerate(zip(rows.tolist(), cols.tolist(), strict=True)):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            keep.append(pos)
    return np.array(keep, dtype=int)


def distinct_vectors(df: DataFrame, ident: str, vec: str, within: list[str]) -> DataFrame:
    """One row per different vector: its smallest id, with the number of copies."""
    return df.groupBy(*within, F.col(vec)).agg(F.min(ident).alias(ident), F.count("*").alias("copies"))


def _pairs(
    df: DataFrame, threshold: float, ident: str, vec: str, within: list[str],
    solo: str | None, block_rows: int, forest: bool, carry: str | None = None,
) -> DataFrame:
    rows = df.filter(F.col(vec).isNotNull() & (F.size(vec) > 0)).select(
        *within, F.col(ident).alias("__id"), F.col(vec).alias("__v"),
        (F.lit(False) if solo is None else F.coalesce(F.col(solo), F.lit(False))).alias("__solo"),
        F.size(vec).alias("__dim"), *([F.col(carry).alias("__c")] if carry else []),
    )
    keys = [*within, "__dim"]
    names = [*keys, "__id", "__v", "__solo", *(["__c"] if carry else [])]
    spread = _spread(rows, keys, names, threshold, block_rows)
    id_type = df.schema[ident].dataType
    kernel = _pair_kernel(threshold, pa.string() if id_type.typeName() == "string" else pa.int64(), forest, carry is not None)
    fields = [T.StructField("id_a", id_type), T.StructField("id_b", id_type), T.StructField("similarity", T.DoubleType())]
    if carry:
        fields += [T.StructField("a", df.schema[carry].dataType), T.StructField("b", df.schema[carry].dataType)]
    return spread.groupBy(*keys, "__p", "__q").applyInArrow(kernel, T.StructType(fields))


# --- metric cells -----------------------------------------------------------------
def _spread(rows: DataFrame, keys: list[str], names: list[str], threshold: float, block_rows: int) -> DataFrame:
    """Each row (``names``, its block ``__b``) once for each pair of tiles ``__p <= __q`` it takes part in.

    A group of one block meets itself. In larger groups blocks are cells around pivots, pairs of
    blocks that no two rows within the threshold can lie in are left out, and blocks are dealt
    to a bounded number of tiles, so that what is sent grows with the rows and not with the
    blocks. One more row for each pair of tiles lists the pairs of blocks to compare (``__todo``).
    """
    counted = blocked(rows, keys, "__id", block_rows)
    kind = "array<struct<p: bigint, q: bigint>>"
    columns = [*names, *[F.col(c).cast("long").alias(c) for c in ("__b", "__p", "__q")], F.lit(None).cast(kind).alias("__todo")]
    if threshold <= 0:
        return _block_pairs(counted).select(*columns)
    small, large = counted.filter("__nb = 1"), counted.filter("__nb > 1")
    alone = small.withColumns({c: F.lit(0) for c in ("__b", "__p", "__q")}).select(*columns)
    if large.isEmpty():
        return alone
    placed, pairs = _near_blocks(large, keys, names, threshold, block_rows)
    tile = lambda c: F.pmod(F.xxhash64(c), F.col("__tiles"))
    pairs = stage(pairs.withColumns({"__b_p": F.col("__p"), "__b_q": F.col("__q"), "__p": F.least(tile("__p"), tile("__q")), "__q": F.greatest(tile("__p"), tile("__q"))}))
    ends = pairs.select(*keys, F.explode(F.array("__b_p", "__b_q")).alias("__b"), "__p", "__q").distinct()
    met = placed.join(ends, [*keys, "__b"]).select(*columns)
    listed = pairs.groupBy(*keys, "__p", "__q").agg(
        F.collect_list(F.struct(F.col("__b_p").alias("p"), F.col("__b_q").alias("q"))).cast(kind).alias("__todo"))
    return alone.unionByName(met).unionByName(listed, allowMissingColumns=True)


def _pick_pivots(rows: pa.Table, number: int) -> np.ndarray:
    """Directions that lie far apart: each next one is the farthest from those before it."""
    unit = unit_rows(matrix(rows["__v"]))
    unit = unit[np.linalg.norm(unit, axis=1) > 0.5]
    if not len(unit):
        return np.zeros((1, 0))
    chosen, near = [0], unit @ unit[0]
    while len(chosen) < min(number, len(unit)):
        far = int(near.argmin())
        if near[far] > 1 - 1e-12:
            break
        chosen.append(far)
        near = np.maximum(near, unit @ unit[far])
    return unit[chosen]


def _pivot_kernel(keys: list[str], block_rows: int):
    def kernel(table: pa.Table) -> pa.Table:
        number = min(MAX_PIVOTS, -(-table["__n"][0].as_py() // block_rows))
        pivots = _pick_pivots(table, number)
        return table.select(keys).slice(0, 1).append_column("__pivots", pa.array([pivots.ravel().tolist()], pa.list_(pa.float64()))).append_column(
            "__count", pa.array([len(pivots)], pa.int32()))

    return kernel


def _cell_kernel(keys: list[str], theta: float, names: list[str]):
    """Cell, ring and the angles to the first pivots: for each block of the task its least and largest."""
    def kernel(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        unit = unit_rows(matrix(rows["__v"]))
        some = np.flatnonzero(np.linalg.norm(unit, axis=1) > 0.5)  # without a direction nothing is near
        centre = pivots["__pivots"][0].values.to_numpy().reshape(pivots["__count"][0].as_py(), -1)
        if not centre.shape[1]:
            some = some[:0]
            centre = np.zeros((1, unit.shape[1]))
        angle = np.arccos(np.clip(unit[some] @ centre.T, -1.0, 1.0))
        cell = angle.argmin(axis=1) if len(some) else np.empty(0, dtype=np.int64)
        ring = np.minimum(angle[np.arange(len(some)), cell] // theta, RINGS - 1).astype(np.int64)
        code = cell * RINGS + ring
        order = np.argsort(code, kind="stable")
        some, code, angle = some[order], code[order], angle[order, :REFERENCES]
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        low, high = [None] * len(some), [None] * len(some)
        for a, z in zip(starts, np.append(starts[1:], len(code)), strict=True):
            low[a], high[a] = angle[a:z].min(axis=0).tolist(), angle[a:z].max(axis=0).tolist()
        out = rows.select(names).take(pa.array(some))
        for name, values, kind in (("__code", code, pa.int64()), ("__low", low, pa.list_(pa.float64())), ("__high", high, pa.list_(pa.float64()))):
            out = out.append_column(name, pa.array(values, kind))
        return out

    return kernel


def _near_kernel(keys: list[str], theta: float):
    """Pairs of blocks whose angles to every pivot leave room for two rows within ``theta``."""
    def kernel(table: pa.Table) -> pa.Table:
        code, at = np.unique(table["__code"].to_numpy(), return_inverse=True)
        k = table["k"].to_numpy()
        low, high = np.zeros((2, len(code), k.max() + 1))
        low[at, k], high[at, k] = table["low"].to_numpy(), table["high"].to_numpy()
        a, b = [], []
        for i in range(len(code)):
            gap = np.maximum(low[i] - high[i:], low[i:] - high[i]).max(axis=1)
            near = i + np.flatnonzero(gap <= theta + MARGIN)
            a.append(np.full(len(near), code[i]))
            b.append(code[near])
        a, b = np.concatenate(a), np.concatenate(b)
        first = table.select(keys).take(pa.array(np.zeros(len(a), dtype=np.int64)))
        return first.append_column("__a", pa.array(a)).append_column("__z", pa.array(b))

    return kernel


def block_number(code: str, part: Column) -> Column:
    return F.col(code) * F.lit(1 << 32) + part


def in_cells(
    rows: DataFrame, keys: list[str], width: float, names: list[str], block_rows: int,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows (``__nb``, ``__b`` by ``blocked``) in cells and rings of ``width``: the rows with their ``__code``,
    the pivots, each code's least and largest angle to the first pivots, and its size with the blocks it is cut to.

    Pivots come from a bounded sample of a group. Rows without a direction are left out.
    """
    field = {f.name: f for f in rows.schema.fields}
    key_fields = [field[k] for k in keys]
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    first = Window.partitionBy(*keys).orderBy(F.xxhash64("__id"), "__id")
    sample = rows.select(*keys, "__id", "__v").withColumn("__rank", F.row_number().over(first)).filter(F.col("__rank") <= SAMPLE)
    sample = sample.join(sizes, keys)
    pivots = sample.groupBy(*keys).applyInArrow(_pivot_kernel(keys, block_rows), T.StructType(
        [*key_fields, T.StructField("__pivots", T.ArrayType(T.DoubleType())), T.StructField("__count", T.IntegerType())]))
    parts = rows.select(*keys, "__nb").distinct()
    sent = pivots.join(parts, keys).select(*keys, "__pivots", "__count", F.explode(F.sequence(F.lit(0), F.col("__nb") - 1)).alias("__b"))
    angles = T.ArrayType(T.DoubleType())
    placed = stage(rows.groupBy(*keys, "__b").cogroup(sent.groupBy(*keys, "__b")).applyInArrow(
        _cell_kernel(keys, width, names),
        T.StructType([*[field[n] for n in names], T.StructField("__code", T.LongType()), T.StructField("__low", angles), T.StructField("__high", angles)])))
    ends = placed.filter(F.col("__low").isNotNull()).select(
        *keys, "__code", F.posexplode(F.arrays_zip("__low", "__high")).alias("k", "e"))
    bounds = ends.groupBy(*keys, "__code", "k").agg(F.min("e.__low").alias("low"), F.max("e.__high").alias("high"))
    cut = placed.groupBy(*keys, "__code").agg(
        F.count("*").alias("__size"), F.ceil(F.count("*") / F.lit(block_rows)).cast("long").alias("__parts"))
    return placed, pivots, bounds, cut


def _near_blocks(large: DataFrame, keys: list[str], names: list[str], threshold: float, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their block ``__b``, and the pairs of blocks that may hold near rows, with the number of tiles.

    A group's pivots are picked from a bounded sample; which ones does not change the result.
    Each row goes to its nearest pivot's cell and, by its angle, to a ring of it. By the
    triangle inequality two rows are at least as far apart as their angles to any one pivot
    differ, so blocks whose angles to some pivot differ by more than the threshold's are not
    compared. Blocks are cut to ``block_rows`` rows by hash, and what is kept of a group (at
    most ``MAX_PIVOTS * RINGS`` blocks by ``REFERENCES`` angles) fits one task.
    """
    theta = float(np.arccos(min(threshold, 1.0)))
    placed, _, bounds, cut = in_cells(large, keys, max(theta, 1e-3), names, block_rows)
    whole = F.sum("__size")
    tiles = cut.groupBy(*keys).agg(F.greatest(
        F.least(F.ceil(whole / F.lit(block_rows)), F.lit(TILES)), F.ceil(whole / F.lit(TILE_ROWS))).cast("long").alias("__tiles"))
    key_fields = [large.schema[k] for k in keys]
    near = bounds.groupBy(*keys).applyInArrow(_near_kernel(keys, theta), T.StructType(
        [*key_fields, T.StructField("__a", T.LongType()), T.StructField("__z", T.LongType())]))
    side = lambda code, name: cut.select(*keys, F.col("__code").alias(code), F.col("__parts").alias(name))
    each = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))
    pairs = near.join(side("__a", "__na"), [*keys, "__a"]).join(side("__z", "__nz"), [*keys, "__z"]).join(tiles, keys)
    pairs = pairs.withColumn("__i", each("__na")).withColumn("__j", each("__nz")).filter("__a <> __z or __i <= __j").select(
        *keys, "__tiles", block_number("__a", F.col("__i")).alias("__p"), block_number("__z", F.col("__j")).alias("__q"))
    rows = placed.join(cut, [*keys, "__code"]).select(
        *names, block_number("__code", F.pmod(F.xxhash64("__id"), F.col("__parts"))).alias("__b"))
    return rows, pairs


def compared_blocks(
    df: DataFrame, threshold: float, ident: str = "id", vec: str = "embedding", within: list[str] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(within, __dim, __p, __q, comparisons)``: the pairs of blocks that ``similar_pairs`` compares
    in its groups of several blocks, with the number of pairs of rows in each."""
    keys = [*(within or []), "__dim"]
    rows = df.filter(F.col(vec).isNotNull() & (F.size(vec) > 0)).select(
        *(within or []), F.col(ident).alias("__id"), F.col(vec).alias("__v"), F.lit(False).alias("__solo"), F.size(vec).alias("__dim"))
    names = [*keys, "__id", "__v", "__solo"]
    placed, pairs = _near_blocks(blocked(rows, keys, "__id", block_rows).filter("__nb > 1"), keys, names, threshold, block_rows)
    held = placed.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
    side = lambda end, n: held.select(*keys, F.col("__b").alias(end), F.col("__n").alias(n))
    own = F.col("__np") * (F.col("__np") - 1) / 2
    return pairs.join(side("__p", "__np"), [*keys, "__p"]).join(side("__q", "__nq"), [*keys, "__q"]).select(
        *keys, "__p", "__q", F.when(F.col("__p") == F.col("__q"), own).otherwise(F.col("__np") * F.col("__nq")).cast("long").alias("comparisons"))


def has_direction(vec: str) -> Column:
    """False for a null, empty or zero vector, or one without finite numbers: it is like nothing."""
    return F.coalesce(
        F.exists(F.col(vec), lambda x: (x != 0) & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def similar_pairs(
    df: DataFrame,
    threshold: float,
    ident: str = "id",
    vec: str = "embedding",
    within: list[str] | None = None,
    solo: str | None = None,
    collapse: bool = True,
    block_rows: int = BLOCK_ROWS,
    carry: str | None = None,
) -> DataFrame:
    """Unordered pairs ``(id_a < id_b, similarity)`` with cosine at or above ``threshold``.

    Exact. A ``within`` group of more than a block is cut into cells around pivots; every pair
    of blocks that may hold near rows is one matrix product, the others are skipped by the
    triangle inequality, and a task holds two tiles of blocks and the pairs of two blocks. Equal vectors stand as one:
    copies are linked to their smallest id (similarity 1), and that id carries the pairs
    with other vectors, so a group of copies adds rows, not squares of rows. With
    ``collapse=False`` each row pairs on its own. Two rows flagged ``solo`` never pair. With
    ``carry`` a pair has that column of both rows as ``a`` and ``b``: it travels with the rows,
    so that the pairs need not be shuffled to look it up.
    """
    within = within or []
    args = (ident, vec, within, solo, block_rows, False)
    if not collapse:
        return _pairs(df, threshold, *args, carry)
    if solo and carry:
        raise ValueError("carry with solo needs collapse=False")
    usable = df.filter(F.col(vec).isNotNull() & (F.size(vec) > 0))
    if solo:
        return _with_solo(usable, threshold, ident, vec, within, solo, block_rows)
    heads = distinct_vectors(usable, ident, vec, within)
    if carry:
        heads = heads.join(usable.select(ident, carry), ident)
    pairs = _pairs(heads, threshold, *args, carry)
    side = lambda end: [F.col(ident).alias(f"id_{end}"), *([F.col(carry).alias(end)] if carry else [])]
    copied = heads.filter((F.col("copies") > 1) & has_direction(vec)).select(*within, vec, *side("a"))
    stars = (
        usable.select(*within, vec, *side("b"))
        .join(copied, [*within, vec]).filter(F.col("id_b") != F.col("id_a"))
        .withColumn("similarity", F.lit(1.0)).select(*pairs.columns)
    )
    return pairs.unionByName(stars)


def _with_solo(usable: DataFrame, threshold: float, ident: str, vec: str, within: list[str], solo: str, block_rows: int) -> DataFrame:
    """Solo rows keep their own place, the others collapse; a copy of a solo row is found by
    the comparison like any other near row."""
    flag = F.coalesce(F.col(solo), F.lit(False))
    alone, rest = usable.filter(flag), usable.filter(~flag)
    heads = distinct_vectors(rest, ident, vec, within)
    both = alone.select(*within, ident, vec, F.lit(True).alias(solo)).unionByName(
        heads.select(*within, ident, vec, F.lit(False).alias(solo)))
    pairs = _pairs(both, threshold, ident, vec, within, solo, block_rows, False)
    copied = heads.filter((F.col("copies") > 1) & has_direction(vec)).select(*within, vec, F.col(ident).alias("head"))
    others = rest.select(*within, vec, F.col(ident).alias("copy")).join(copied, [*within, vec]).filter(
        F.col("head") != F.col("copy")).select("head", "copy")
    stars = others.select(F.col("head").alias("id_a"), F.col("copy").alias("id_b"), F.lit(1.0).alias("similarity"))
    # A solo row is like every copy of a head that it is like, as without a collapse.
    lone = alone.select(F.col(ident).alias("lone"))
    ends = pairs.select(F.col("id_a").alias("lone"), F.col("id_b").alias("head"), "similarity").unionByName(
        pairs.select(F.col("id_b").alias("lone"), F.col("id_a").alias("head"), "similarity")).join(lone, "lone", "left_semi")
    carried = ends.join(others, "head").select(
        F.least("lone", "copy").alias("id_a"), F.greatest("lone", "copy").alias("id_b"), "similarity")
    return pairs.unionByName(stars).unionByName(carried)


def link_edges(
    df: DataFrame, threshold: float, ident: str = "id", vec: str = "embedding",
    within: list[str] | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Edges with the same connected components as all pairs at or above ``threshold``.

    Each block pair gives only a spanning forest, and copies hang on their smallest id, so
    the edge count stays linear in the rows even when everything is alike.
    """
    within = within or []
    usable = df.filter(F.col(vec).isNotNull() & (F.size(vec) > 0))
    heads = distinct_vectors(usable, ident, vec, within)
    edges = _pairs(heads, threshold, ident, vec, within, None, block_rows, True)
    copied = heads.filter((F.col("copies") > 1) & has_direction(vec)).select(*within, vec, F.col(ident).alias("id_a"))
    stars = (
        usable.select(*within, vec, F.col(ident).alias("id_b"))
        .join(copied, [*within, vec]).filter(F.col("id_b") != F.col("id_a"))
    )
    return edges.select("id_a", "id_b").unionByName(stars.select("id_a", "id_b"))
