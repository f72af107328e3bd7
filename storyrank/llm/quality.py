"""Quality of documents by boosted trees over statistics of their whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyrank.llm import boosting, scan
from storyrank.llm.toxicity import SAMPLE, held_out, training_rows

SIGNS = b".,!?#$%&*|;:\"'()[]{}<>/\\=+-_@~^`"
_NEWLINE = np.zeros(256, dtype=bool)
_NEWLINE[10] = True


def _masks() -> dict[str, np.ndarray]:
    def mask(members) -> np.ndarray:
        m = np.zeros(256, dtype=bool)
        m[list(members)] = True
        return m

    out = {"upper": mask(range(65, 91)), "lower": mask(range(97, 123)), "digit": mask(range(48, 58)),
           "wide": mask(range(0xC0, 256)), "newline": mask([10]), "blank": scan.BLANKS,
           "control": mask([*range(9), *range(14, 32), 127])}
    out |= {f"sign_{chr(c)}": mask([c]) for c in SIGNS[:10]}
    out["sign"] = mask(SIGNS)
    return out


MASKS = _masks()
NAMES = (
    "log_chars", "log_words", "word_length", "word_length_spread", "short_words", "long_words", "capital_words",
    "letterless_words", "ends_in_sign", "ends_in_stop", "distinct_words", "top_word", "repeated_pairs",
    "log_lines", "line_words", "distinct_lines", "top_line", *MASKS,
)


def _repeats(rows: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: how many different keys it has, and how often its commonest comes."""
    distinct, top = np.zeros(n), np.zeros(n)
    if len(keys):
        order = np.lexsort((keys, rows))
        r, k = rows[order], keys[order]
        new = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (k[1:] != k[:-1]))))
        counts = np.diff(np.concatenate((new, [len(k)])))
        distinct = np.bincount(r[new], minlength=n).astype(float)
        np.maximum.at(top, r[new], counts)
    return distinct, top


def statistics(column: pa.Array) -> np.ndarray:
    """A row of ``NAMES`` for each text; the empty text and null have zeros."""
    parts = []
    for piece in scan.pieces(column):
        n, data = len(piece), piece.data
        row_at = np.repeat(np.arange(n), piece.ends - piece.starts + 1)
        size = (piece.ends - piece.starts).astype(float)
        chars = size - scan.per_row((data & 0xC0) == 0x80, row_at, n)
        starts, ends = scan.spans(data, scan.BLANKS)
        rows = row_at[starts] if len(starts) else np.empty(0, int)
        count = np.bincount(rows, minlength=n).astype(float)
        some, lengths = np.maximum(count, 1), (ends - starts).astype(float)
        first, last = (data[starts], data[ends - 1]) if len(starts) else (data[:0], data[:0])
        letters = np.concatenate(([0], np.cumsum(MASKS["upper"][data] | MASKS["lower"][data] | (data >= 0x80))))
        mean = scan.per_row(lengths, rows, n) / some
        spread = np.sqrt(np.maximum(scan.per_row(lengths ** 2, rows, n) / some - mean ** 2, 0))
        keys = scan.hashes(scan.LOWER[data], starts, ends)
        distinct, top = _repeats(rows, keys, n)
        same = rows[1:] == rows[:-1]
        pairs = scan.mixed(keys[:-1] * np.uint64(3) + keys[1:])[same]
        pair_kinds, _ = _repeats(rows[1:][same], pairs, n)
        l_starts, l_ends = scan.spans(data, _NEWLINE)
        l_rows = row_at[l_starts] if len(l_starts) else np.empty(0, int)
        n_lines = np.bincount(l_rows, minlength=n).astype(float)
        l_kinds, l_top = _repeats(l_rows, scan.hashes(data, l_starts, l_ends), n)
        share = lambda flags: scan.per_row(flags, rows, n) / some
        columns = [
            np.log1p(chars), np.log1p(count), mean, spread, share(lengths <= 3), share(lengths >= 14),
            share(MASKS["upper"][first]), share(letters[ends] == letters[starts]) if len(starts) else np.zeros(n),
            share(MASKS["sign"][last]), share(np.isin(last, np.frombuffer(b".!?", np.uint8))),
            distinct / some, top / some, np.where(count > 1, 1 - pair_kinds / np.maximum(count - 1, 1), 0),
            np.log1p(n_lines), count / np.maximum(n_lines, 1), l_kinds / np.maximum(n_lines, 1),
            l_top / np.maximum(n_lines, 1),
            *[scan.per_row(mask[data], row_at, n) / np.maximum(size, 1) for mask in MASKS.values()],
        ]
        parts.append(np.where((size > 0)[:, None], np.column_stack(columns), 0.0))
    return np.concatenate(parts) if parts else np.zeros((0, len(NAMES)))


def learn(rows: DataFrame, trees: int = 120) -> boosting.Trees:
    """Trees from ``training_rows`` (at most ``SAMPLE``): their statistics are computed by Spark,
    and only that bounded table of numbers reaches the driver."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            block = np.column_stack([statistics(batch.column("text")), batch.column("y").to_numpy(zero_copy_only=False)])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in block.T], names=[*wide, "y"])

    wide = [f"f{i}" for i in range(len(NAMES))]
    schema = ", ".join(f"{c} double" for c in [*wide, "y"])
    data = rows.select("text", "y").mapInArrow(measured, schema).toPandas()
    data = data.sort_values(list(data.columns)).to_numpy()  # the same trees from any order of rows
    return boosting.fit(data[:, :-1], data[:, -1], trees=trees)


def with_scores(docs: DataFrame, trees: boosting.Trees, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the likelihood of label 1 for every row; one scan, no shuffle."""
    scan.small_batches(docs.sparkSession)
    kept = docs.drop(name)
    schema = kept.withColumn(name, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(batch.schema.get_field_index(text_col)))
            scores = pa.array(trees.probability(x), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, name])

    return kept.mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs``; labels are learned
    outside the held-out fold only. Rows without id are scored too, repeated rows alike."""
    trees = learn(training_rows(docs, labels, "quality", sample))
    scored = with_scores(docs.select("doc_id", "text"), trees)
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
