"""Set similarity join by chosen paths.

Each document's set of shingles gets ``WIDTH`` minwise tokens. A tree branches its
documents by the values of tokens that the node selects, on average one in ``1 /
similarity``, so that a pair at the threshold meets in one child on average at every
level. Nodes of one document end; small nodes are compared exhaustively on sketches;
large nodes are first compared with a pivot (whoever is nearly equal to it has met all its
partners' pivot too and goes no further) and branch again, ``DEPTH`` times at most; what is
then still large is compared tile by tile. Enough independent trees are grown for the
target recall at exactly the threshold.

Candidates only say which sets to read: inside each candidate component the full sets are
compared in blocks and links confirmed on them. A first pass compares each block with
itself; a second one compares what is not joined with the most frequent class of its
component against the blocks of near sizes, so a group of near-copies stays linear.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyrank.llm import scan
from storyrank.llm.text import whole
from storyrank.operators.components import connected_components
from storyrank.session import stage

WIDTH = 64  # minwise tokens of a set
DEPTH = 4  # branchings below the root
SMALL = 64  # documents of a node that is compared exhaustively
TILE = 2048  # documents of a tile of a node that stays large
NEAR = 0.55  # share of equal sketch tokens of a candidate: five deviations below 0.8
SETTLED = 0.85  # share from which a document goes no further than its node's pivot
RECALL = 0.9999  # of pairs at exactly the threshold, before components add to it
BLOCK = 1 << 21  # shingles of a block of full sets
STEPS = 2  # size classes to a factor of the threshold
DENSE = 1 << 24  # cells of a matrix of frequent shingles
FREQUENT = 8192  # shingles of it at most
STRIP = 256  # its rows that are multiplied at once
FIRST = 32  # sets that are read at a time, nearest first
BROADCAST = 8192  # large nodes, with their pivots' sketches about 1 MB, that ride along with the scan
NAMED = 100_000  # documents of candidates, of 40 bytes, that do so
LEAST_COST = 64  # shingles that a smaller set counts for
_ODD = np.random.default_rng(2024).integers(0, 1 << 63, size=(WIDTH, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def missed(depth: int, similarity: float) -> float:
    """Chance that a pair at the threshold shares no node ``depth`` levels down one tree."""
    more = 1 / similarity - 1  # chance of a second selected token
    lost = 0.0
    for _ in range(depth):
        once = 1 - similarity + similarity * lost
        lost = (1 - more) * once + more * once * once
    return lost


def trees_for(recall: float, similarity: float, depth: int = DEPTH) -> int:
    return math.ceil(math.log(1 - recall) / math.log(missed(depth, similarity)))


# --- sets ------------------------------------------------------------------------
def _shingles(piece: scan.Piece, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each distinct shingle, by row and hash. A text of fewer words is one."""
    data = scan.LOWER[piece.data]
    starts, ends = scan.spans(data, scan.BLANKS)
    rows = np.searchsorted(piece.ends, starts, side="right")
    n = np.bincount(rows, minlength=len(piece))
    first = np.append(0, n.cumsum())
    word = scan.hashes(data, starts, ends)
    count = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    owner = np.repeat(np.arange(len(piece)), count)
    begin = np.arange(count.sum()) - np.repeat(count.cumsum() - count, count) + first[owner]
    grams = scan.sequence_hashes(word, begin, np.minimum(begin + shingle, first[owner + 1]))
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], owner[new]


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _sketched(shingle: int):
    """Per text: size, two sums that name the set, minwise tokens and the sketch, a byte hashed from each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            size = np.zeros(len(batch), dtype=np.int64)
            names = np.zeros((2, len(batch)), dtype=np.uint64)
            tokens = np.zeros((len(batch), WIDTH), dtype=np.uint64)
            for piece in scan.pieces(text):
                grams, owner = _shingles(piece, shingle)
                rows, starts = np.unique(owner, return_index=True)
                if not len(rows):
                    continue
                at = rows + piece.first
                size[at] = np.diff(np.append(starts, len(grams)))
                names[0, at] = np.add.reduceat(scan.mixed(grams), starts)
                names[1, at] = np.add.reduceat(scan.mixed(grams ^ _ODD[0, 0]), starts)
                for k in range(WIDTH):
                    tokens[at, k] = np.minimum.reduceat((grams ^ _ODD[k, 0]) * _ODD[k, 1], starts)
            arrays = [_signed(tokens), (scan.mixed(tokens) >> np.uint64(56)).astype(np.uint8).view(np.int8)]
            lists = [pa.ListArray.from_arrays(np.arange(len(batch) + 1, dtype=np.int32) * a.shape[1], pa.array(a.ravel())) for a in arrays]
            keep = [batch.column(c) for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(size), pa.array(_signed(names[0])), pa.array(_signed(names[1])), *lists],
                names=[*[c for c in batch.schema.names if c != "text"], "size", "set_a", "set_b", "tokens", "sketch"])

    return run


def sketches(docs: DataFrame, shingle: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_hash, size, set_a, set_b, tokens, sketch)`` for each row; ``size`` counts distinct shingles."""
    scan.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(whole(F.col(text_col))).alias("text_hash"), whole(F.col(text_col)).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_sketched(shingle), f"doc_id {kind}, text_hash long, size long, set_a long, set_b long, "
                                               "tokens array<long>, sketch array<tinyint>")


# --- trees -----------------------------------------------------------------------
def _forest(sketch: np.ndarray, size: np.ndarray, first: int, similarity: float, share: float = NEAR) -> tuple[np.ndarray, np.ndarray]:
    """Rows not at their root, and the roots, joined by pairs alike in sketch and size, of rows
    before ``first`` with rows from it on, or of all if it is 0. Rows that are joined already
    are not compared again."""
    label = np.arange(len(sketch))
    for i in range(first or len(sketch)):
        j = np.arange(first or i + 1, len(sketch))
        j = j[label[j] != label[i]]
        j = j[np.minimum(size[j], size[i]) >= similarity * np.maximum(size[j], size[i]) - 1e-9]
        j = j[(sketch[j] == sketch[i]).sum(axis=1) >= share * WIDTH]
        if len(j):
            roots = np.unique(label[np.append(j, i)])
            label[np.isin(label, roots)] = roots[0]
    moved = np.flatnonzero(label != np.arange(len(label)))
    return moved, label[moved]


def _rows_of(lists: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, size, sketch = lists[k].values.flatten()
    flat = sketch.flatten().to_numpy().reshape(len(ids), WIDTH)
    return ids.to_numpy(), size.to_numpy(), flat


def _compared(similarity: float, share: float = NEAR):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.empty((2, 0), dtype=np.int64)]
            left, right = batch.column("left"), batch.column("right")
            for k in range(len(batch)):
                ids, size, sketch = _rows_of(left, k)
                first = 0
                if right[k].is_valid:
                    first = len(ids)
                    more = _rows_of(right, k)
                    ids, size, sketch = (np.concatenate(p) for p in zip((ids, size, sketch), more, strict=True))
                moved, roots = _forest(np.ascontiguousarray(sketch), size, first, similarity, share)
                out.append(np.stack([ids[moved], ids[roots]]))
            a, b = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["id_a", "id_b"])

    return run


def _roots(nodes: DataFrame, trees: int, similarity: float) -> DataFrame:
    """``(id, node, sketch)``: each tree's first branching, by tokens of its own; the wanted share
    of the trees selects two."""
    second = max(0, min(round(trees * (1 / similarity - 1)), WIDTH - trees))
    picks = [(t % WIDTH, t) for t in range(trees)] + [(trees + t, t) for t in range(second)]
    pick = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("t")) for k, t in picks])).alias("p")
    return nodes.select("id", "tokens", "sketch", pick).select(
        "id", F.xxhash64("p.t", "p.k", F.get("tokens", F.col("p.k"))).alias("node"), "sketch")


def _children(rows: DataFrame, similarity: float) -> DataFrame:
    """Each row of ``(id, node, sketch)`` once for each token that its node selects. Below the root
    a token's byte stands for it: other tokens of that byte join the child and go at the next."""
    pick = lambda salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(WIDTH)).cast("int")
    second = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1 << 20)) < F.lit(int((1 / similarity - 1) * (1 << 20)))
    picks = F.when(second, F.array_distinct(F.array(pick(1), pick(2)))).otherwise(F.array(pick(1)))
    return rows.select("id", "node", "sketch", F.explode(picks).alias("k")).select(
        "id", F.xxhash64("node", "k", F.get("sketch", F.col("k"))).alias("node"), "sketch")


def _small_nodes(rows: DataFrame, counts: DataFrame, small: int) -> DataFrame:
    return rows.select("id", "node").join(counts.filter(F.col("n") <= small).select("node"), "node")


def candidates(nodes: DataFrame, similarity: float, recall: float = RECALL, depth: int = DEPTH, small: int = SMALL,
               tile: int = TILE) -> DataFrame:
    """Edges ``(id_a, id_b)`` that join, as forests of nodes, pairs likely at ``similarity`` or more.

    ``nodes`` has ``id``, ``size``, ``tokens`` and ``sketch``, staged; ids are not null.
    """
    prints = nodes.select("id", "size", "sketch")
    member = F.struct("id", "size", "sketch").alias("m")
    rows = _roots(nodes, trees_for(recall, similarity), similarity)
    leaves, links = [], []
    for level in range(depth + 1):
        count = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("pivot"))
        counts = stage(count.filter("n > 1"))
        leaves.append(_small_nodes(rows, counts, small))
        heads = counts.filter(F.col("n") > small)
        number = heads.count()
        if not number or level == depth:
            break
        heads = heads.select("node", "pivot").join(
            nodes.select(F.col("id").alias("pivot"), F.col("sketch").alias("pivot_sketch")), "pivot")
        if number <= BROADCAST:
            large = rows.join(F.broadcast(heads), "node")
        else:  # a node of very many documents is split by the join itself
            large = rows.select("id", "node").join(heads, "node").join(nodes.select("id", "sketch"), "id")
        alike = F.aggregate(F.zip_with("sketch", "pivot_sketch", lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x)
        large = stage(large.select("id", "node", "pivot", "sketch", (alike / WIDTH).alias("alike")))
        links.append(large.filter((F.col("alike") >= NEAR) & (F.col("id") != F.col("pivot"))).select(
            F.col("id").alias("id_a"), F.col("pivot").alias("id_b")))
        rows = _children(large.filter(F.col("alike") < SETTLED), similarity)
    found = leaves[0]
    for more in leaves[1:]:
        found = found.unionByName(more)
    # Near-copies meet in most trees: of equal nodes one is compared.
    lists = found.groupBy("node").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    lists = lists.groupBy("ids").agg(F.min("node").alias("node")).select("node", F.explode("ids").alias("id"))
    met = lists.join(prints, "id").groupBy("node").agg(F.collect_list(member).alias("left"))
    met = met.select("left", F.lit(None).cast(met.schema["left"].dataType).alias("right"))
    if number:
        wide = rows.select("id", "node").join(heads, "node").withColumn("parts", F.ceil(F.col("n") / tile).cast("int"))
        tiles = wide.join(prints, "id").groupBy("node", "parts", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("no")).agg(
            F.collect_list(member).alias("left"))  # about `tile` rows
        met = met.unionByName(_block_pairs(stage(tiles), "node", "left"))
    out = met.mapInArrow(_compared(similarity, NEAR), "id_a long, id_b long")
    for edges in links:
        out = out.unionByName(edges)
    return out


def _block_pairs(blocks: DataFrame, key: str, held: str) -> DataFrame:
    """``(left, right)``: each block alone and with each later block of its key (``no`` of ``parts``)."""
    kind = blocks.schema[held].dataType
    own = blocks.select(F.col(held).alias("left"), F.lit(None).cast(kind).alias("right"))
    left = blocks.filter("no + 1 < parts").select(
        key, F.explode(F.sequence(F.col("no") + 1, F.col("parts") - 1)).alias("no"), F.col(held).alias("left"))
    right = blocks.filter("parts > 1").select(key, "no", F.col(held).alias("right"))
    return own.unionByName(left.join(right, [key, "no"]).select("left", "right"))


# --- full sets -------------------------------------------------------------------
def _grams(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, values = [np.zeros(1, dtype=np.int64)], []
            for piece in scan.pieces(batch.column("text")):
                grams, owner = _shingles(piece, shingle)
                offsets.append(np.bincount(owner, minlength=len(piece)).cumsum() + offsets[-1][-1])
                values.append(_signed(grams))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(offsets).astype(np.int32)), pa.array(np.concatenate(values or [np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in batch.schema.names[:-1]], lists],
                                             names=[*batch.schema.names[:-1], "grams"])

    return run


@dataclass
class _Block:
    """Sets of a block: ``codes`` are places in ``known``, its different shingles, in order."""

    ids: np.ndarray
    sketch: np.ndarray
    starts: np.ndarray
    known: np.ndarray
    codes: np.ndarray

    def bytes(self) -> bytes:
        """Codes rise inside a set, so their differences are small where sets are alike."""
        steps = np.diff(self.codes, prepend=self.codes[:1])
        parts = (self.ids, self.sketch, self.starts, self.known, steps.astype(np.int32))
        return zstandard.ZstdCompressor(level=1).compress(b"".join([np.array([len(self.ids), len(self.known), len(self.codes), int(self.codes[0]) if len(self.codes) else 0]).tobytes(), *[np.ascontiguousarray(p).tobytes() for p in parts]]))

    @staticmethod
    def of(blob: bytes) -> _Block:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n, known, codes, first = np.frombuffer(raw, np.int64, 4)
        at, out = 32, []
        for count, kind in ((n, np.int64), (n * WIDTH, np.int8), (n + 1, np.int64), (known, np.int64), (codes, np.int32)):
            out.append(np.frombuffer(raw, kind, count, at))
            at += out[-1].nbytes
        return _Block(out[0], out[1].reshape(n, WIDTH), out[2], out[3], first + out[4].cumsum(dtype=np.int64))

    def only(self, keep: np.ndarray) -> _Block:
        length = np.diff(self.starts)
        return _Block(self.ids[keep], self.sketch[keep], np.append(0, length[keep].cumsum()), self.known, self.codes[np.repeat(keep, length)])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs = []
        for row in batch.column("held"):
            ids, sketch, grams = row.values.flatten()
            flat = grams.flatten().to_numpy()
            known, codes = np.unique(flat, return_inverse=True)
            starts = np.append(0, np.diff(grams.offsets.to_numpy()).astype(np.int64).cumsum())
            owner = np.repeat(np.arange(len(ids)), np.diff(starts))
            codes = codes[np.lexsort((codes, owner))]
            blobs.append(_Block(ids.to_numpy(), sketch.flatten().to_numpy(), starts, known, codes).bytes())
        keep = [c for c in batch.schema.names if c != "held"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(blobs, pa.binary())], names=[*keep, "blob"])


def _both(a: _Block, b: _Block) -> _Block:
    known, at = np.unique(np.concatenate([a.known, b.known]), return_inverse=True)
    return _Block(np.append(a.ids, b.ids), np.concatenate([a.sketch, b.sketch]), np.append(a.starts, b.starts[1:] + a.starts[-1]),
                  known, np.append(at[:len(a.known)][a.codes], at[len(a.known):][b.codes]))


def _confirmed(sets: _Block, label: np.ndarray, first: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the rows they turned out to be linked to (a forest over ``label``), by the sizes
    of intersection and union, of rows before ``first`` with those from it on, or of all if 0.

    Rows of one label are not compared, nor those too unlike in size or sketch. What frequent
    shingles two sets share comes from a product of matrices; with the smaller number of the
    others it bounds the intersection, and only what may be a link by that bound is read.
    """
    n, length = len(sets.ids), np.diff(sets.starts)
    often = np.bincount(sets.codes, minlength=len(sets.known))
    top = np.argsort(-often, kind="stable")[:min(FREQUENT, max(DENSE // max(n, 1), 1))]
    top = top[often[top] > 1]
    place = np.full(len(sets.known), -1)
    place[top] = np.arange(len(top))
    owner = np.repeat(np.arange(n), length)
    column = place[sets.codes]
    dense = np.zeros((n, len(top)), dtype=np.float32)
    dense[owner[column >= 0], column[column >= 0]] = 1
    rare = length - dense.sum(axis=1, dtype=np.float64)
    mark = np.zeros(len(sets.known), dtype=bool)
    label = label.copy()
    found_a, found_b = [], []
    for i in range(first or n):
        low = first or i + 1
        if i % STRIP == 0:
            strip_low = first or i
            shared = dense[i:min(i + STRIP, first or n)] @ dense[strip_low:].T
        j = low + np.flatnonzero(label[low:] != label[i])
        j = j[100 * np.minimum(length[j], length[i]) >= percent * np.maximum(length[j], length[i])]
        most = shared[i % STRIP, j - strip_low] + np.minimum(rare[i], rare[j])
        fits = 100 * most >= percent * (length[i] + length[j] - most)
        j, most = j[fits], most[fits]
        near = (sets.sketch[j] == sets.sketch[i]).sum(axis=1) >= NEAR * WIDTH
        j, most = j[near], most[near]
        if not len(j):
            continue
        j = j[np.argsort(-most, kind="stable")]
        mine = sets.codes[sets.starts[i]:sets.starts[i + 1]]
        mark[mine] = True
        while len(j):
            some, j = j[:FIRST], j[FIRST:]
            size = length[some]
            offsets = size.cumsum() - size
            at = np.arange(size.sum()) + np.repeat(sets.starts[some] - offsets, size)
            both = np.add.reduceat(mark[sets.codes[at]], offsets, dtype=np.int64)
            some = some[100 * both >= percent * (length[i] + size - both)]
            some = some[np.unique(label[some], return_index=True)[1]]
            if len(some):
                found_a.append(np.full(len(some), i))
                found_b.append(some)
                roots = np.unique(label[np.append(some, i)])
                label[np.isin(label, roots)] = roots[0]
                j = j[label[j] != label[i]]
        mark[mine] = False
    none = [np.empty(0, dtype=np.int64)]
    return np.concatenate(found_a or none), np.concatenate(found_b or none)


def _links_of(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = np.concatenate([np.empty((2, 0), dtype=np.int64), *[np.stack(p) for p in pairs]], axis=1)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["id_a", "id_b"])


def _confirm_own(percent: int):
    def links(blob):
        sets = _Block.of(blob.as_py())
        i, j = _confirmed(sets, np.arange(len(sets.ids)), 0, percent)
        return sets.ids[i], sets.ids[j]

    return lambda batches: (_links_of(map(links, batch.column("blob"))) for batch in batches)


def _confirm_apart(percent: int):
    """Rows of the left block that are apart against all rows of the right one."""
    def links(left, labels, right, more):
        a, b = _Block.of(left.as_py()), _Block.of(right.as_py())
        of, to = {}, set()
        for pairs in (labels, more):
            ids, label, apart = (c.to_numpy(zero_copy_only=False) for c in pairs.values.flatten())
            of.update(zip(ids.tolist(), label.tolist(), strict=True))
            to.update(ids[apart].tolist())
        a = a.only(np.array([i in to for i in a.ids.tolist()], dtype=bool))
        sets = _both(a, b)
        i, j = _confirmed(sets, np.array([of[i] for i in sets.ids.tolist()]), len(a.ids), percent)
        return sets.ids[i], sets.ids[j]

    return lambda batches: (_links_of(links(*row) for row in zip(*[b.column(c) for c in ("left", "labels", "right", "more")], strict=True)) for b in batches)


def confirmed(docs: DataFrame, nodes: DataFrame, near: DataFrame, percent: int, shingle: int, id_col: str, text_col: str,
              block: int = BLOCK) -> DataFrame:
    """``(id, component)``: connected components of the links between full sets, for the nodes in ``near``.

    All pairs inside a component of ``near`` are decided, but for those that are joined already
    and those whose sketches are no candidates. A component of more than ``block`` shingles is cut
    by classes of size, and only blocks of classes that can hold a link meet.
    """
    members = stage(connected_components(near).withColumnRenamed("component", "group").join(
        nodes.select("id", "size", "sketch", "least"), "id"))
    cost = F.greatest(F.col("size"), F.lit(LEAST_COST))
    wide = members.groupBy("group").agg(F.sum(cost).alias("cost")).filter(F.col("cost") > block).select("group", F.lit(True).alias("wide"))
    level = F.when(F.col("wide"), F.floor(F.log("size") / F.lit(math.log(100 / percent) / STEPS)).cast("int")).otherwise(0)
    graded = stage(members.join(wide, "group", "left").withColumn("wide", F.coalesce("wide", F.lit(False))).withColumn("level", level))
    counts = stage(graded.filter("wide").groupBy("group", "level").agg(F.ceil(F.sum(cost) / block).cast("int").alias("parts")))
    placed = graded.join(counts, ["group", "level"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    number = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    named = placed.select("id", "group", "wide", "level", "sketch", number.alias("no"), F.col("least.doc_id").alias("__id"), F.col("least.text_hash").alias("__hash"))
    texts = docs.select(F.col(id_col).alias("__id"), F.xxhash64(whole(F.col(text_col))).alias("__hash"), whole(F.col(text_col)).alias("text"))
    named = F.broadcast(named) if members.count() <= NAMED else named
    same = (F.col("t.__hash") == F.col("n.__hash")) & F.col("t.__id").eqNullSafe(F.col("n.__id"))
    rows = texts.alias("t").join(named.alias("n"), same).dropDuplicates(["id"]).select("id", "group", "wide", "level", "no", "sketch", "text")
    sets = rows.mapInArrow(_grams(shingle), "id long, group long, wide boolean, level int, no int, sketch array<tinyint>, grams array<long>")
    held = sets.groupBy("group", "wide", "level", "no").agg(F.collect_list(F.struct("id", "sketch", "grams")).alias("held"))  # about `block` shingles
    # Blocks of small components are compared alone, as they come; those of wide ones are kept for the next pass.
    blocks = stage(held.mapInArrow(_packed, "group long, wide boolean, level int, no int, blob binary"))
    first = stage(blocks.select("blob").mapInArrow(_confirm_own(percent), "id_a long, id_b long"))
    joined = connected_components(first, nodes=members.select("id"))
    if counts.isEmpty():
        return joined
    # What is not joined with a wide component's most frequent class meets the blocks of near sizes.
    labels = stage(placed.filter("wide").select("id", "group", "level", number.alias("no")).join(joined, "id"))
    common = labels.groupBy("group", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("group").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"))
    told = labels.join(common, "group").groupBy("group", "level", "no").agg(
        F.collect_list(F.struct("id", F.col("component").alias("label"), (F.col("component") != F.col("main")).alias("apart"))).alias("labels"),
        F.max(F.col("component") != F.col("main")).alias("any"))
    kept = stage(blocks.filter("wide").select("group", "level", "no", "blob").join(told, ["group", "level", "no"]))
    steps = F.explode(F.sequence(F.lit(-STEPS), F.lit(STEPS)))
    left = kept.filter("any").select("group", F.col("level").alias("own"), F.col("no").alias("own_no"), F.col("blob").alias("left"), "labels", steps.alias("step"))
    left = left.withColumn("level", F.col("own") + F.col("step")).join(counts, ["group", "level"])
    left = left.withColumn("no", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter("own <> level or own_no <> no")
    right = kept.select("group", "level", "no", F.col("blob").alias("right"), F.col("labels").alias("more"))
    pairs = left.join(right, ["group", "level", "no"]).select("left", "labels", "right", "more")
    second = pairs.mapInArrow(_confirm_apart(percent), "id_a long, id_b long")
    return connected_components(first.unionByName(second), nodes=members.select("id"))


def similar_components(docs: DataFrame, percent: int = 80, shingle: int = 2, recall: float = RECALL, id_col: str = "doc_id",
                       text_col: str = "text", small: int = SMALL, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row.

    Sets of distinct shingles of ASCII-lower-cased words link when ``100 * intersection >=
    percent * union``; links chain. A text of fewer words is one shingle; one without words, or
    null, has the empty set and links with nothing. ``component_id`` is the smallest id reachable
    (null if only null ids are); repeated rows and texts of one id stand each for themselves. ``kept``
    says that a row has its component's id. A 64-bit value stands for a shingle.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints = stage(sketches(docs, shingle))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    heads = prints.filter("size > 0").groupBy("set_a", "set_b", "size").agg(least.alias("least"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch"))
    nodes = stage(heads.withColumn("id", F.monotonically_increasing_id()))
    near = candidates(nodes.select("id", "size", "tokens", "sketch"), percent / 100, recall, small=small, tile=tile)
    found = confirmed(docs, nodes, near, percent, shingle, "doc_id", "text", block)
    named = nodes.select("id", "set_a", "set_b", "size", F.col("least.doc_id").alias("own")).join(found, "id", "left")
    ids = named.groupBy(F.coalesce("component", "id").alias("component")).agg(F.min("own").alias("component_id"))
    classes = named.withColumn("component", F.coalesce("component", "id")).join(ids, "component").select("set_a", "set_b", "size", "component_id")
    rows = prints.select("doc_id", "size", "set_a", "set_b").join(classes, ["set_a", "set_b", "size"], "left")
    component = F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"),
                       F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
