"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are summed in the JVM. Distinct fingerprints are laid into cells by their
population counts (of the whole, or of equal segments); each cell is cut into tiles of
about ``TILE`` fingerprints. Two tiles are compared only if their counts (and, if given,
their size classes) can be within the radius; every other pair of tiles is skipped, which
loses nothing, since the Hamming distance is at least the sum of the differences of the
counts. A comparison is numpy exclusive-or and bit counts and gives a spanning forest, so
a group of copies leaves as many rows as it has members, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyrank.llm import scan
from storyrank.llm.text import ascii_lower, bit_count_of, bit_sums, whole, words
from storyrank.operators.components import connected_components
from storyrank.session import stage

TILE = 4096
STRIP = 256  # rows of a tile that are compared at once
TASK = 4 * TILE * TILE  # comparisons for one task
BLOCK = 1 << 19  # shingles of a block of sets
LEAST_COST = 64  # shingles that a smaller set counts for
FINE_FROM = 20_000_000  # distinct fingerprints from which eight segments pay for their copies


def _words_of(hashed: DataFrame, seeds: tuple[int, ...], *keys: str) -> DataFrame:
    """``keys``, ``size`` and a word for each seed, from a row for each hash ``h0`` of ``n``."""
    for n in range(1, len(seeds)):  # further words hash the first hash again with their seed
        hashed = hashed.withColumn(f"h{n}", F.xxhash64("h0", F.lit(seeds[n])))
    sums = [c for n in range(len(seeds)) for c in bit_sums(F.col(f"h{n}"), f"s{n}_")]
    # A repeated row multiplies every count, the votes too: bits stay, the size is one text's.
    summed = hashed.groupBy(*keys).agg(F.min("n").alias("size"), F.count(F.lit(1)).alias("votes"), *sums)

    def word(n: int) -> Column:
        bits = [F.when(2 * bit_count_of(f"s{n}_", b) > F.col("votes"), F.lit(1 << b if b < 63 else -(1 << 63)))
                .otherwise(F.lit(0)) for b in range(64)]
        while len(bits) > 1:
            bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2], strict=True)]
        return bits[0].alias(f"w{n}")

    return summed.select(*keys, "size", *[word(n) for n in range(len(seeds))])


def bound_words(text: Column) -> Column:
    """The text's words as a generator, so that they are split once and not for each shingle."""
    return F.explode_outer(F.array(words(ascii_lower(whole(text)))))


def shingle_set(w: Column, shingle: int) -> Column:
    """The XXH64 values of the distinct shingles of ``bound_words``, cut as in ``fingerprints``, in order."""
    run = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - shingle, F.lit(0))), lambda i: F.xxhash64(
        F.concat_ws(" ", *[F.get(w, i + k) for k in range(shingle)])))
    return F.when(F.size(w) > 0, F.sort_array(F.array_distinct(run))).otherwise(F.array().cast("array<bigint>"))


def fingerprints(docs: DataFrame, shingle: int = 3, seeds: tuple[int, ...] = (42,),
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_hash, size, w0, w1, ...)``: a 64-bit word for each seed.

    Shingles are runs of ``shingle`` words of the ASCII-lower-cased text, repeats
    included; a shorter text is one shingle, one without words has ``size`` 0 and words of
    zeros (null counts as empty). A bit is set if more than half of the XXH64 values have it.
    Repeated rows (same id, same text) give one row; an id with several texts gives one
    row for each.
    """
    if seeds[0] != 42:
        raise ValueError("the first seed is 42, the seed of xxhash64")
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(F.col(text_col)).alias("t"))
    rows = rows.select("doc_id", F.xxhash64("t").alias("text_hash"), words(ascii_lower(F.col("t"))).alias("w"))
    last = F.greatest(F.size("w") - shingle, F.lit(0))
    units = rows.filter(F.size("w") > 0).select(
        "doc_id", "text_hash", "w", (last + 1).cast("long").alias("n"), F.explode(F.sequence(F.lit(0), last)).alias("i"))
    gram = F.concat_ws(" ", *[F.get("w", F.col("i") + k) for k in range(shingle)])
    hashed = units.select("doc_id", "text_hash", "n", F.xxhash64(gram).alias("h0"))
    full = _words_of(hashed, seeds, "doc_id", "text_hash")
    empty = rows.filter(F.size("w") == 0).select(
        "doc_id", "text_hash", F.lit(0).cast("long").alias("size"),
        *[F.lit(0).cast("long").alias(f"w{n}") for n in range(len(seeds))]).distinct()
    return full.unionByName(empty)


def _offsets(segments: int, width: int, radius: int, classes: bool) -> list[tuple[int, ...]]:
    """Steps to the cells that may hold a partner; of a step and its opposite, one."""
    reach = range(-(-(-radius // width)), -(-radius // width) + 1)
    cost = {o: max(0, (abs(o) - 1) * width + 1) for o in reach}
    found: list[tuple[tuple[int, ...], int]] = [((), 0)]
    for _ in range(segments):
        found = [((*v, o), c + cost[o]) for v, c in found for o in reach if c + cost[o] <= radius]
    steps = [(k, *v) for k in ((-1, 0, 1) if classes else (0,)) for v, _ in found]
    return [s for s in steps if s >= (0,) * (segments + 1)]


def _forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows of ``a`` followed by those of ``b``: indices not at their root, and the roots.

    A strip of rows at a time is compared and its links are contracted at once, so a tile
    in which everything is alike holds one strip's links and no more.
    """
    label = np.arange(len(a) + len(b))
    for start in range(0, len(a), STRIP):
        far = np.zeros((min(STRIP, len(a) - start), len(b)), dtype=np.uint16)
        for k in range(a.shape[1]):
            far += np.bitwise_count(a[start:start + STRIP, k, None] ^ b[None, :, k])
        i, j = np.nonzero(far <= radius)
        i, j = label[i + start], label[j + len(a)]
        while (open_ := i != j).any():
            low, high = np.minimum(i[open_], j[open_]), np.maximum(i[open_], j[open_])
            np.minimum.at(label, high, low)
            while (label[label] != label).any():
                label = label[label]
            i, j = label[low], label[high]
            again = i != j  # a high end that went to another root
            i, j = i[again], j[again]
    moved = np.nonzero(label != np.arange(len(label)))[0]
    return moved, label[moved]


def _compare(n_words: int, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
            for x, y in zip(batch.column("tile_a"), batch.column("tile_b"), strict=True):
                pair = []
                for tile in (x, y):
                    flat = tile.values.flatten()
                    pair.append((flat[0].to_numpy(zero_copy_only=False),
                                 np.stack([f.to_numpy(zero_copy_only=False) for f in flat[1:]], axis=1).view(np.uint64)))
                (ids_a, fa), (ids_b, fb) = pair
                ids = np.concatenate([ids_a, ids_b])
                moved, roots = _forest(fa, fb, radius)
                keep = ids[moved] != ids[roots]
                out_a.append(ids[moved][keep])
                out_b.append(ids[roots][keep])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["id_a", "id_b"])

    return run


def links(prints: DataFrame, radius: int, segments: int = 4, width: int = 1,
          size_class: Column | None = None, tile: int = TILE) -> DataFrame:
    """Edges ``(id_a, id_b)`` that join all fingerprints within ``radius`` bits.

    ``prints`` has one row for each ``id`` with words ``w0``...; ids are not null. With
    ``size_class`` only neighbouring classes are compared. Edges form a forest for each
    pair of tiles: their connected components are those of all links.
    """
    names = sorted((c for c in prints.columns if c[0] == "w" and c[1:].isdigit()), key=lambda c: int(c[1:]))
    bits = 64 * len(names)
    step = bits // segments
    if bits % segments or step > 64 and step % 64 or step < 64 and 64 % step:
        raise ValueError("segments must divide the words evenly")

    def pop(s: int) -> Column:
        if step >= 64:
            parts = [F.bit_count(n) for n in names[s * step // 64:(s + 1) * step // 64]]
        else:
            at = s * step
            mask = (1 << step) - 1
            parts = [F.bit_count(F.shiftrightunsigned(names[at // 64], at % 64).bitwiseAND(F.lit(mask)))]
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        return F.floor(total / width).cast("int")

    axes = [(F.lit(0) if size_class is None else size_class).cast("int"), *[pop(s) for s in range(segments)]]
    base = prints.select("id", *names, F.array(*axes).alias("cell"))
    counts = base.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).alias("n_tiles"))
    tiles = (
        base.join(counts, "cell")
        .groupBy("cell", F.pmod(F.xxhash64("id"), F.col("n_tiles")).alias("no"))
        .agg(F.collect_list(F.struct("id", *names)).alias("tile"))  # about `tile` rows, by the count above
    )
    tiles = stage(tiles)
    steps = _offsets(segments, width, radius, size_class is not None)
    known = F.explode(F.array(*[F.array(*[F.lit(int(x)) for x in s]) for s in steps]))
    # How many tiles each cell has is known, so a tile goes to each tile it meets under that
    # tile's own key: no cell, however full, is one task.
    cells = stage(counts.join(tiles.groupBy("cell").agg(F.sum(F.size("tile")).alias("rows")), "cell")
                  .withColumnRenamed("cell", "to"))
    left = tiles.select("cell", F.col("no").alias("no_a"), F.col("tile").alias("tile_a"), known.alias("step"))
    left = left.select(
        F.zip_with("cell", "step", lambda c, s: c + s).alias("to"),
        F.forall("step", lambda s: s == 0).alias("own"), "no_a", "tile_a")
    met = left.join(cells, "to")
    work = met.agg(F.sum(F.size("tile_a") * F.col("rows"))).first()[0] or 0
    parts = max(int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(work // TASK))
    spread = met.select("to", "own", "no_a", "tile_a", F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1)).alias("no_b"))
    spread = spread.filter(~F.col("own") | (F.col("no_a") <= F.col("no_b"))).repartition(parts, "to", "no_b")
    right = tiles.select(F.col("cell").alias("to"), F.col("no").alias("no_b"), F.col("tile").alias("tile_b"))
    pairs = spread.join(right.repartition(parts, "to", "no_b"), ["to", "no_b"])
    return pairs.select("tile_a", "tile_b").mapInArrow(_compare(len(names), radius), "id_a long, id_b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)``: fingerprints link at ``radius`` or fewer bits.

    Equal fingerprints stand as one node, named by its smallest id. A null id takes part
    under its fingerprint's smallest id (null if none is known).
    """
    prints = stage(fingerprints(docs, shingle, id_col=id_col, text_col=text_col).select("doc_id", "w0"))
    nodes = stage(prints.groupBy("w0").agg(F.min("doc_id").alias("id")))
    known = nodes.filter("id is not null")
    fine = known.count() >= FINE_FROM
    edges = links(known, radius, segments=8 if fine else 4)
    found = connected_components(edges, nodes=known.select("id")).withColumnRenamed("component", "component_id")
    classes = nodes.join(found, "id", "left").select("w0", F.coalesce("component_id", "id").alias("component_id"))
    return prints.join(classes, "w0").select(
        "doc_id", F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")


def _joined(prints: np.ndarray, sets: np.ndarray, starts: np.ndarray, first: int | None, radius: int,
            similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices not at their root, and the roots, of the rows joined by pairs within ``radius``
    whose sets have at least ``similarity``. Rows before ``first`` are paired with those from
    it on, or each with all later ones. Only pairs that are joined already are not looked at."""
    label, length = np.arange(len(prints)), np.diff(starts)
    known, code = np.unique(sets, return_inverse=True)
    mark = np.zeros(len(known), dtype=bool)
    for i in range(len(prints) if first is None else first):
        j = np.arange(i + 1 if first is None else first, len(prints))
        j = j[label[j] != label[i]]
        j = j[np.minimum(length[j], length[i]) / np.maximum(length[j], length[i]) >= similarity]
        j = j[np.bitwise_count(prints[j] ^ prints[i]).sum(axis=1, dtype=np.int64) <= radius]
        if not len(j):
            continue
        offsets = length[j].cumsum() - length[j]
        at = np.arange(length[j].sum()) + np.repeat(starts[j] - offsets, length[j])
        mine = code[starts[i]:starts[i + 1]]
        mark[mine] = True
        both = np.add.reduceat(mark[code[at]], offsets, dtype=np.int64)
        mark[mine] = False
        j = j[both / (length[i] + length[j] - both) >= similarity]
        if len(j):
            roots = np.unique(label[np.append(j, i)])
            label[np.isin(label, roots)] = roots[0]
    moved = np.nonzero(label != np.arange(len(label)))[0]
    return moved, label[moved]


def _check(radius: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
            for x, y in zip(batch.column("block_a"), batch.column("block_b"), strict=True):
                ids, prints, sets, sizes = [], [], [], []
                for block in (x, y) if y.is_valid else (x,):
                    id_, *ws, grams = block.values.flatten()
                    ids.append(id_.to_numpy(zero_copy_only=False))
                    prints.append(np.stack([w.to_numpy(zero_copy_only=False) for w in ws], axis=1).view(np.uint64))
                    sets.append(grams.flatten().to_numpy(zero_copy_only=False))
                    sizes.append(np.diff(grams.offsets.to_numpy()))
                ids, starts = np.concatenate(ids), np.append(0, np.concatenate(sizes).astype(np.int64).cumsum())
                moved, roots = _joined(np.concatenate(prints), np.concatenate(sets), starts,
                                       len(sizes[0]) if y.is_valid else None, radius, similarity)
                out_a.append(ids[moved])
                out_b.append(ids[roots])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["id_a", "id_b"])

    return run


def similar(docs: DataFrame, nodes: DataFrame, near: DataFrame, radius: int, similarity: float, shingle: int,
            id_col: str, text_col: str, block: int = BLOCK) -> DataFrame:
    """Edges ``(id_a, id_b)`` whose connected components are those of all pairs within
    ``radius`` with a Jaccard similarity of at least ``similarity`` between their shingle sets.

    ``near`` joins, as a forest, all pairs within the radius; so every such pair lies inside
    one of its components. A component's sets are cut into blocks of about ``block``
    shingles, and each block meets each: a group of near-copies leaves a forest of checked
    links for each pair of blocks, never its pairs.
    """
    scan.small_batches(docs.sparkSession)
    names = sorted((c for c in nodes.columns if c[0] == "w" and c[1:].isdigit()), key=lambda c: int(c[1:]))
    members = connected_components(near).join(nodes, "id")
    cost = F.greatest(F.col("size"), F.lit(LEAST_COST))
    counts = members.groupBy("component").agg(F.ceil(F.sum(cost) / block).cast("int").alias("n_blocks"))
    members = members.join(counts, "component").select(
        "id", "component", "n_blocks", *names, F.col("least.doc_id").alias("__id"), F.col("least.text_hash").alias("__hash"))
    texts = docs.select(F.col(id_col).alias("__id"), F.xxhash64(whole(F.col(text_col))).alias("__hash"), F.col(text_col).alias("__text"))
    sets = texts.join(members, ["__id", "__hash"]).dropDuplicates(["__id", "__hash"])
    sets = sets.select("id", *names, "component", "n_blocks", bound_words(F.col("__text")).alias("__words")).select(
        "component", "n_blocks", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int").alias("no"),
        F.struct("id", *names, shingle_set(F.col("__words"), shingle).alias("grams")).alias("m"))
    blocks = stage(sets.groupBy("component", "n_blocks", "no").agg(F.collect_list("m").alias("block")))  # about `block` shingles
    own = blocks.select(F.col("block").alias("block_a"), F.lit(None).cast(blocks.schema["block"].dataType).alias("block_b"))
    left = blocks.filter("no + 1 < n_blocks").select(
        "component", F.explode(F.sequence(F.col("no") + 1, F.col("n_blocks") - 1)).alias("no"), F.col("block").alias("block_a"))
    right = blocks.filter("n_blocks > 1").select("component", "no", F.col("block").alias("block_b"))
    cross = left.join(right, ["component", "no"]).select("block_a", "block_b")
    return own.unionByName(cross).mapInArrow(_check(radius, similarity), "id_a long, id_b long")


def representatives(docs: DataFrame, shingle: int = 5, seeds: tuple[int, ...] = (42, 43), radius: int = 32,
                    similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of which each group of near-copies keeps its smallest id (of several
    texts of that id in the group, the one of smallest hash).

    Near-copies are texts whose sets of shingles have a Jaccard similarity of at least
    ``similarity``, and those such links chain. Candidates are the pairs of sets whose
    128-bit fingerprints differ in ``radius`` bits at most: with 0.8 they differ in about 19,
    with a deviation of 4, so that one such pair in some 1,500 is missed; every other link is checked on the
    sets. Only sets whose sizes are in neighbouring classes of ratio ``1 / similarity`` are
    compared, which loses nothing. Texts without words form one group. Rows without id stay;
    of repeated rows (same id, same text) one stays.
    """
    rows = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.xxhash64(whole(F.col(text_col))).alias("text_hash"),
        bound_words(F.col(text_col)).alias("w"))
    rows = rows.select("doc_id", "text_hash", F.explode_outer(F.array(shingle_set(F.col("w"), shingle))).alias("g"))
    marks = [F.xxhash64("g").alias("set_a"), F.xxhash64(F.lit(7), "g").alias("set_b")]
    keys = ["doc_id", "text_hash", "set_a", "set_b"]
    # The marks are made before the rows are multiplied: beside the explode they would be made for each shingle.
    marked = rows.select("doc_id", "text_hash", *marks, F.size("g").cast("long").alias("n"), "g")
    hashed = marked.select("doc_id", "text_hash", "set_a", "set_b", "n", F.explode_outer("g").alias("h0"))
    prints = _words_of(hashed, seeds, *keys)
    words_ = [f"w{n}" for n in range(len(seeds))]
    # A node is a set with a number of its own: an id may have several texts, each in another group.
    nodes = prints.groupBy("set_a", "set_b", "size", *words_).agg(F.min(F.struct("doc_id", "text_hash")).alias("least"))
    nodes = stage(nodes.withColumn("id", F.monotonically_increasing_id()))
    level = F.floor(F.log(F.greatest(F.col("size"), F.lit(1))) / F.log(F.lit(1 / similarity)))
    level = F.when(F.col("size") == 0, -9).otherwise(level)
    near = links(nodes, radius, segments=1, width=radius + 1, size_class=level)
    edges = similar(docs, nodes, near, radius, similarity, shingle, id_col, text_col)
    groups = nodes.join(connected_components(edges), "id", "left").groupBy(F.coalesce("component", "id"))
    keep = groups.agg(F.min("least").alias("k")).select(
        F.col("k.doc_id").alias("__keep"), F.col("k.text_hash").alias("__keep_hash"))
    named = docs.withColumn("__text_hash", F.xxhash64(whole(F.col(text_col))))
    kept = named.join(keep, (F.col(id_col) == F.col("__keep")) & (F.col("__text_hash") == F.col("__keep_hash")), "left_semi")
    once = kept.dropDuplicates([id_col, "__text_hash"])
    return once.unionByName(named.filter(F.col(id_col).isNull())).drop("__text_hash")
