"""Benchmark decontamination by latent semantic retrieval.

Three scans over the whole corpus for each block of benchmark items:

1. how often each term of the block occurs (terms hashed to ``TERMS`` numbers; terms that
   no item has cannot make a match);
2. a distributed randomised SVD of the TF-IDF matrix A of passages: every task adds up its
   part of B = A'(A R) for a sparse random R; the sum has ``TERMS`` x ``SKETCH`` numbers
   whatever the corpus, and a Nystroem step on the driver turns it into the leading right
   singular vectors;
3. search: overlapping passages are folded into the latent space and compared with the
   items by cosine; every candidate at or above ``NEAR`` that has enough of the item's
   terms is checked on its words by the longest common subsequence, and by the answer's
   words where that is only a paraphrase.

Texts never move; tasks exchange sums of fixed size only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyrank.llm import scan

TERMS = 8192
RANK = 80
SKETCH = 96
SIGNS = 4  # entries of R in each row
PASSAGE = 48  # words of a passage; half as many for items of at most SHORT words
SHORT = 24
STEP = 12  # words of a block; passages are two or four blocks and start at every one or two
COMMON = 1 / 500  # terms with a larger share of all words are left out of the vectors
NEAR = 0.4  # least cosine of a candidate
SHARED = 0.5  # least weight of the item's terms in a candidate, as a share of what fits into a passage
SAME = 0.8  # common subsequence, as a share of the item's words, that is a leak by itself
PARAPHRASE = 0.65  # and that is one if the answer is there as well
ANSWER = 0.8  # share of the answer's words that must be there in order
SLICE = 1 << 18  # bytes of texts that are worked on at once
ROWS = 1000  # rows of a batch that are searched, and sent on, at once
BLOCK = 2000  # items that are searched for at once
SEED = 20240

FOUND = "item_id long, cosine double, overlap double, answer double, first_word int, last_word int"


def _words(column: pa.Array) -> Iterator[tuple[scan.Piece, np.ndarray, np.ndarray]]:
    """Pieces with the hash of each lower-cased word, trimmed of ASCII punctuation, and its row."""
    for piece in scan.pieces(column, SLICE):
        data = scan.LOWER[piece.data]
        starts, ends = scan.spans(data, SEPARATORS)
        row_at = np.repeat(np.arange(len(piece)), piece.ends - piece.starts + 1)
        yield piece, scan.hashes(data, starts, ends), row_at[starts] if len(starts) else np.empty(0, dtype=np.int64)


SEPARATORS = np.zeros(256, dtype=bool)
SEPARATORS[:48] = SEPARATORS[58:65] = SEPARATORS[91:97] = SEPARATORS[123:128] = True


@dataclass
class Items:
    """A block of benchmark items, at most ``BLOCK``: small enough for a closure."""

    ids: list[int]
    words: list[np.ndarray]
    answers: list[np.ndarray]
    vocabulary: np.ndarray = field(init=False)
    seen: np.ndarray = field(init=False)

    def __post_init__(self):
        self.vocabulary = np.unique(np.concatenate(self.words)) if self.words else np.empty(0, dtype=np.uint64)
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True

    def terms(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and term numbers of the words that some item has."""
        place = np.flatnonzero(self.seen[(hashes >> np.uint64(44)).astype(np.int64)])
        known = np.minimum(np.searchsorted(self.vocabulary, hashes[place]), max(len(self.vocabulary) - 1, 0))
        place = place[self.vocabulary[known] == hashes[place]] if len(self.vocabulary) else place[:0]
        return place, (hashes[place] % np.uint64(TERMS)).astype(np.int64)


def last_sentence(text: str) -> str:
    """An item's answer where it has no column of its own: its last line or sentence of three words or more."""
    parts = [p for p in text.replace("?", ".").replace("!", ".").replace("\n", ".").split(".") if len(p.split()) >= 3]
    return parts[-1] if parts else text


def items_of(rows: list) -> Items:
    """From (item_id, text, answer) rows; items without words are left out."""
    def hashed(texts: list[str]) -> list[np.ndarray]:
        out = [np.empty(0, dtype=np.uint64) for _ in texts]
        for piece, hashes, at in _words(pa.array(texts, pa.string())):
            for k in range(len(piece)):
                out[piece.first + k] = hashes[at == k]
        return out

    texts = hashed([r[1] or "" for r in rows])
    answers = hashed([r[2] if r[2] is not None else last_sentence(r[1] or "") for r in rows])
    kept = [k for k, w in enumerate(texts) if len(w)]
    return Items([rows[k][0] for k in kept], [texts[k] for k in kept], [answers[k] for k in kept])


def term_counts(docs: DataFrame, items: Items, text_col: str) -> np.ndarray:
    """Occurrences of each term, and of all words in the last place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TERMS + 1, dtype=np.int64)
        for batch in batches:
            for _, hashes, _ in _words(batch.column(0)):
                total[:TERMS] += np.bincount(items.terms(hashes)[1], minlength=TERMS)
                total[TERMS] += len(hashes)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    rows = docs.select(F.col(text_col)).mapInArrow(run, "term long, n long").groupBy("term").agg(
        F.sum("n").alias("n")).collect()  # TERMS + 1 rows at most
    out = np.zeros(TERMS + 1)
    for r in rows:
        out[r["term"]] = r["n"]
    return out


def weights(counts: np.ndarray, items: Items) -> np.ndarray:
    """Inverse frequencies of the terms; common ones weigh nothing, unless an item would be
    left with fewer than five terms."""
    share = (counts[:TERMS] + 1) / (counts[TERMS] + 1)
    full = np.maximum(-np.log(np.minimum(share, 1.0)), 0.01)
    used = share < COMMON
    for words in items.words:
        terms = (words % np.uint64(TERMS)).astype(np.int64)
        if used[terms].sum() < 5:
            used[terms] = True
    return np.where(used, full, 0.0)


def _random() -> tuple[np.ndarray, np.ndarray]:
    """Columns and signs of the entries of R, for each term."""
    draw = np.random.default_rng(SEED)
    columns = np.argsort(draw.random((TERMS, SKETCH)), axis=1)[:, :SIGNS]
    return columns, draw.choice([-1.0, 1.0], size=(TERMS, SIGNS)) / np.sqrt(SIGNS)


def latent_space(docs: DataFrame, items: Items, weight: np.ndarray, text_col: str) -> np.ndarray:
    """Term vectors, ``TERMS`` x ``RANK``: leading right singular vectors of the weighted
    term counts of all passages (consecutive, not overlapping), times the weights."""
    columns, signs = _random()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((SKETCH, TERMS))
        for batch in batches:
            for piece, hashes, at in _words(batch.column(0)):
                place, term = items.terms(hashes)
                keep = weight[term] > 0
                place, term = place[keep], term[keep]
                if not len(place):
                    continue
                count = np.bincount(at, minlength=len(piece))
                first = np.cumsum(count) - count
                passage = at[place] << 32 | (place - first[at[place]]) // PASSAGE
                no = np.cumsum(np.concatenate(([0], passage[1:] != passage[:-1])))
                n, w = int(no[-1]) + 1, weight[term]
                y = np.zeros(SKETCH * n)
                for k in range(SIGNS):
                    y += np.bincount(columns[term, k] * n + no, signs[term, k] * w, SKETCH * n)
                for row, part in zip(total, y.reshape(SKETCH, n), strict=True):
                    row += np.bincount(term, part[no] * w, TERMS)
        some = np.flatnonzero(total.any(axis=0))
        scan.give_back()
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), *[pa.array(row[some].astype(np.float32)) for row in total]], names=names)

    names = ["term", *[f"y{k}" for k in range(SKETCH)]]
    schema = "term long, " + ", ".join(f"{n} float" for n in names[1:])
    summed = docs.select(F.col(text_col)).mapInArrow(run, schema).groupBy("term").agg(
        *[F.sum(n).alias(n) for n in names[1:]]).toPandas()  # TERMS rows at most
    b, start = np.zeros((TERMS, SKETCH)), np.zeros((TERMS, SKETCH))
    b[summed["term"].to_numpy()] = summed[names[1:]].to_numpy()
    np.put_along_axis(start, columns, signs, axis=1)
    return nystroem(start, b)[:, :RANK] * weight[:, None]


def nystroem(start: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading eigenvectors of a positive matrix G from ``start`` and b = G ``start``."""
    norm = np.linalg.norm(b)
    if norm == 0:
        return np.zeros_like(b)
    shift = 1e-9 * norm
    b = b + shift * start
    core = start.T @ b
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    root = vectors / np.sqrt(np.maximum(values, 1e-12 * max(values.max(), 1e-300)))
    left, _, _ = np.linalg.svd(b @ root, full_matrices=False)
    return left


def common_subsequence(item: dict, length: int, words: list) -> int:
    """Length of the longest common subsequence; ``item`` maps a word to the bits of its places."""
    full = (1 << length) - 1
    v = full
    for w in words:
        u = v & item.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


def _places(words: np.ndarray) -> dict:
    out: dict = {}
    for k, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << k
    return out


@dataclass
class Searcher:
    items: Items
    vectors: np.ndarray  # TERMS x RANK, weighted
    weight: np.ndarray

    def prepare(self) -> None:
        rows = [self.vectors[(w % np.uint64(TERMS)).astype(np.int64)].sum(axis=0) for w in self.items.words]
        q = np.array(rows).reshape(len(rows), self.vectors.shape[1])
        self.queries = (q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        self.used = self.weight > 0
        self.own = np.zeros((TERMS, len(self.items.words)), dtype=np.float32)
        for k, w in enumerate(self.items.words):
            terms = (w % np.uint64(TERMS)).astype(np.int64)
            self.own[terms, k] = self.weight[terms]
        length = np.array([len(w) for w in self.items.words])
        blocks = PASSAGE // STEP
        self.folded = self.vectors.astype(np.float32)
        self.item_places = [_places(w) for w in self.items.words]
        self.answer_places = [_places(w) for w in self.items.answers]
        self.scales = []  # blocks of a passage, blocks from one to the next, items, weight they need
        for wide, stride, chosen in ((blocks, blocks // 2, length > SHORT), (blocks // 2, blocks // 4, length <= SHORT)):
            some = np.flatnonzero(chosen)
            fits = np.minimum(1.0, (wide - stride / 2) * STEP / length[some])
            if len(some):
                self.scales.append((wide, stride, some, SHARED * fits * self.own[:, some].sum(axis=0)))

    def leaks(self, column: pa.Array) -> Iterator[tuple[int, int, float, float, float, int, int]]:
        """``(row, item, cosine, overlap, answer, first word, last word)``, one for each row and leaked item."""
        for piece, hashes, at in _words(column):
            place, term = self.items.terms(hashes)
            keep = self.used[term]
            place, term = place[keep], term[keep]
            if not len(place):
                continue
            count = np.bincount(at, minlength=len(piece))
            first = np.cumsum(count) - count
            n_blocks = -(-count // STEP)
            first_block = np.cumsum(n_blocks) - n_blocks
            text = at[place]
            block = first_block[text] + (place - first[text]) // STEP
            size = int(n_blocks.sum())
            sums = np.zeros((self.folded.shape[1], size + PASSAGE // STEP), dtype=np.float32)
            for row, column in zip(sums, self.folded.T, strict=True):
                row[:size] = np.bincount(block, column[term], size)
            for wide, stride, items, needed in self.scales:
                n = np.maximum(0, -(-(n_blocks - wide) // stride)) + 1  # passages of each text; the last reaches its end
                whose = np.repeat(np.arange(len(piece)), n)
                inner = stride * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                start = first[whose] + STEP * inner
                stop = np.minimum(start + STEP * wide, first[whose] + count[whose])
                low, high = np.searchsorted(place, start), np.searchsorted(place, stop)
                some = np.flatnonzero(high - low >= 2)
                for part in np.array_split(some, max(1, len(some) // 10_000)):
                    x = np.zeros((len(part), len(sums)), dtype=np.float32)
                    for k in range(wide):
                        inside = inner[part] + k < n_blocks[whose[part]]
                        x += sums[:, first_block[whose[part]] + inner[part] + k].T * inside[:, None]
                    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                    cosine = x @ self.queries[items].T
                    near, item = np.nonzero(cosine >= NEAR)
                    tokens = (high - low)[part][near]
                    token = np.arange(int(tokens.sum())) + np.repeat(low[part][near] - (np.cumsum(tokens) - tokens), tokens)
                    candidate = np.repeat(np.arange(len(near)), tokens)
                    shared = np.bincount(candidate, self.own[term[token], items[item[candidate]]], len(near))
                    enough = shared >= needed[item]
                    near, item = near[enough], item[enough]
                    yield from self._checked(piece, hashes, first, count, whose[part[near]], items[item],
                                             cosine[near, item], start[part[near]], stop[part[near]])

    def _checked(self, piece, hashes, first, count, rows, items, cosine, start, stop):
        order = np.lexsort((-cosine, items, rows))
        done = None
        for k in order:
            row, item = int(rows[k]), int(items[k])
            if (row, item) == done:
                continue
            m = len(self.items.words[item])
            a = max(int(start[k]) - m, int(first[row]))
            z = min(int(stop[k]) + m, int(first[row] + count[row]))
            words = hashes[a:z].tolist()
            overlap = common_subsequence(self.item_places[item], m, words) / m
            if overlap < PARAPHRASE:
                continue
            size = len(self.items.answers[item])
            answer = common_subsequence(self.answer_places[item], size, words) / size if size else 1.0
            if overlap >= SAME or answer >= ANSWER:
                done = (row, item)
                yield (piece.first + row, item, float(cosine[k]), overlap, answer,
                       a - int(first[row]), z - int(first[row]))


def searchers(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "item_id",
              item_text: str = "text", answer_col: str | None = None, block: int = BLOCK) -> Iterator[Searcher]:
    """One fitted searcher for each block of items; items are read in blocks of bounded size,
    so a large benchmark costs more scans, not more memory."""
    scan.small_batches(docs.sparkSession)
    answer = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(item_text).alias("t"), answer.alias("a"))
    blocks = max(1, -(-rows.count() // block))
    for k in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == k)
        items = items_of([tuple(r) for r in part.orderBy("id", "t").collect()])
        if items.ids:
            weight = weights(term_counts(docs, items, text_col), items)
            yield Searcher(items, latent_space(docs, items, weight, text_col), weight)


def leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", **names) -> DataFrame:
    """``(doc_id, item_id, cosine, overlap, answer, first_word, last_word)``: a row for each
    document and benchmark item that it holds. Null and empty texts hold none; a row without
    id is reported under null; repeated rows are reported once each."""
    out = None
    for searcher in searchers(docs, benchmark, text_col, **names):
        def run(batches: Iterator[pa.RecordBatch], searcher=searcher) -> Iterator[pa.RecordBatch]:
            searcher.prepare()
            for batch in batches:
                found = list(_once(searcher.leaks(batch.column(1))))
                at = pa.array([f[0] for f in found], pa.int64())
                columns = list(zip(*found, strict=True)) or [[]] * 7
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), pa.array([searcher.items.ids[i] for i in columns[1]], pa.int64()),
                     *[pa.array(c, pa.float64()) for c in columns[2:5]], *[pa.array(c, pa.int32()) for c in columns[5:]]],
                    names=["doc_id", "item_id", "cosine", "overlap", "answer", "first_word", "last_word"])

        kind = docs.schema[id_col].dataType.simpleString()
        part = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, {FOUND}")
        out = part if out is None else out.unionByName(part)
    if out is None:
        kind = docs.schema[id_col].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, {FOUND}")
    return out


def _once(found: Iterator[tuple]) -> Iterator[tuple]:
    """A text's passages may come in parts: the first leak of each row and item."""
    seen = set()
    for f in found:
        if f[:2] not in seen:
            seen.add(f[:2])
            yield f


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **names) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, found in the scan that keeps them."""
    out = docs
    for searcher in list(searchers(docs, benchmark, text_col, **names)):
        def run(batches: Iterator[pa.RecordBatch], searcher=searcher) -> Iterator[pa.RecordBatch]:
            searcher.prepare()
            for batch in batches:
                for start in range(0, len(batch), ROWS):
                    part = batch.slice(start, ROWS)
                    keep = np.ones(len(part), dtype=bool)
                    for f in searcher.leaks(part.column(part.schema.get_field_index(text_col))):
                        keep[f[0]] = False
                    yield part.filter(pa.array(keep))
            scan.give_back()

        out = out.mapInArrow(run, out.schema)
    return out
