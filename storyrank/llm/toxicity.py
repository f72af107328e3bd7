"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

The lexicon holds whole words and word stems with weights learned from labelled rows. A
text is folded (lower case, look-alike letters to Latin, digits and signs that stand for
letters inside a word), matched in one pass, freed from matches inside exception phrases,
and its weights are normalised by its length; a logistic curve makes a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyrank.llm.scan import small_batches
from storyrank.session import stage

SAMPLE = 20_000  # labelled rows that are learned from, at most
ENTRIES = 2_000  # entries of a lexicon, at most
LEAST_SUPPORT = 8  # toxic texts that an entry is found in
LEAST_EVIDENCE = 30.0  # twice the log-likelihood ratio against the general share
STEMS = range(4, 11)  # lengths of stems, in characters
HELD = 100_000  # counts that a task holds before it sends them
ROWS = 500  # rows of a batch that are scored, and sent on, at once

# Phrases in which a word of the lexicon is harmless.
EXCEPTIONS = (
    "trash can", "trash cans", "trash bag", "trash bin", "taking out the trash", "take out the trash",
    "pond scum", "clown fish", "circus clown", "class clown", "idiot proof", "winner and loser",
    "winners and losers", "stupid question", "no such thing as a stupid question",
)
# Characters that are drawn like a Latin letter, and that letter.
LOOKALIKES = str.maketrans(
    "аеорсухіјѕԁһӏгктвмнαεορτυικνβηχγ" "０１２３４５６７８９",
    "aeopcyxijsdhlrktbmhaeoptuiknbnxy" "0123456789")
DIGITS = str.maketrans("0134578", "oieastb")
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l", "€": "e", "£": "l"}
INNER_SIGNS = re.compile(r"(?<=[^\W\d_])[@$!|€£]+(?=[^\W\d_])")
NOT_WORD = re.compile(r"[\W_]+")


def folded(text: str | None) -> str:
    """Words of the folded text, one blank before, between and after them."""
    low = (text or "").lower()
    if not low.isascii():
        low = low.translate(LOOKALIKES)
    low = low.translate(DIGITS)
    if any(s in low for s in SIGNS):
        low = INNER_SIGNS.sub(lambda m: "".join(SIGNS[c] for c in m.group()), low)
    return f" {NOT_WORD.sub(' ', low).strip()} "


@dataclass(frozen=True)
class Lexicon:
    """Entries with a blank at each end that is a word's end, weights, and the curve."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, ...] = (-4.0, 1.0, 1.0, 1.0)

    def automaton(self) -> ahocorasick.Automaton:
        machine = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            machine.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            entry = f" {phrase} "
            machine.add_word(entry, (len(entry), None))
        if self.weights or self.exceptions:
            machine.make_automaton()
        return machine

    def measures(self, texts: list[str | None], machine: ahocorasick.Automaton | None = None) -> np.ndarray:
        """Per text: 1, and three measures of its weights: summed, by length, by root of length."""
        machine = machine or self.automaton()
        out = np.zeros((len(texts), 4))
        for row, text in enumerate(texts):
            plain = folded(text)
            best: dict[int, float] = {}
            free: list[tuple[int, int]] = []
            for end, (length, weight) in machine.iter(plain) if len(machine) else ():
                start = end - length + 1
                if weight is None:
                    free.append((start, end))
                elif weight > best.get(start, 0.0):
                    best[start] = weight
            total = sum(w for s, w in best.items() if not any(a <= s < b for a, b in free))
            n = plain.count(" ") - 1
            out[row] = 1.0, math.log1p(total), total / (n + 20), total / math.sqrt(n + 20)
        return out

    def scores(self, texts: list[str | None], machine: ahocorasick.Automaton | None = None) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.measures(texts, machine) @ np.array(self.curve), -40, 40)))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for ids that are never learned from. A null id is not held out, as nothing is learned from it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int = SAMPLE) -> DataFrame:
    """``(doc_id, text, y)``: labelled texts outside the held-out fold, at most ``limit`` ids,
    those of smallest hash. The sample's ids are broadcast: ``limit`` bounds them. An id
    labelled more than once counts by its largest label; an id with several texts gives
    each. The rows are kept in the shared folder."""
    small_batches(docs.sparkSession)
    ids = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out()).groupBy("doc_id").agg(
        F.max(label).cast("int").alias("y"))
    picked = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return stage(rows.join(F.broadcast(picked), "doc_id"))


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many toxic and other texts of a partition hold each word and stem."""
    toxic, other = Counter(), Counter()

    def flush() -> pd.DataFrame:
        names = list(toxic.keys() | other.keys())
        frame = pd.DataFrame({"entry": pd.Series(names, dtype=object), "a": [toxic[n] for n in names],
                              "b": [other[n] for n in names]})
        toxic.clear()
        other.clear()
        return frame

    for pdf in batches:
        for text, y in zip(pdf["text"], pdf["y"], strict=True):
            found = set()
            for word in set(folded(text).split()):
                found.add(f" {word} ")
                found.update(f" {word[:k]}" for k in STEMS if k <= len(word))
            (toxic if y else other).update(found)
        if len(toxic) + len(other) > HELD:
            yield flush()
    yield flush()


def learn(rows: DataFrame, entries: int = ENTRIES, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon from ``training_rows``. Without labels of both kinds it is empty and scores
    every text alike, by the share of toxic rows."""
    share = {int(r["y"]): r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = share.get(1, 0), share.get(0, 0)
    if not n1 or not n0:
        return Lexicon({}, exceptions, (4.0 if n1 else -4.0, 0.0, 0.0, 0.0))
    p = n1 / (n1 + n0)
    counts = rows.select("text", "y").mapInPandas(_entries, "entry string, a long, b long").groupBy("entry").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b")).filter(F.col("a") >= LEAST_SUPPORT)
    a, b, n = F.col("a"), F.col("b"), F.col("a") + F.col("b")
    part = F.when(b > 0, b * F.log(b / (n * (1 - p)))).otherwise(F.lit(0.0))
    weighed = counts.withColumns({
        "weight": F.log((a + 0.5) / (n1 + 1.0)) - F.log((b + 0.5) / (n0 + 1.0)),
        "evidence": 2 * (a * F.log(a / (n * p)) + part),
    }).filter((F.col("weight") > 1.5) & (F.col("evidence") >= LEAST_EVIDENCE))
    top = weighed.orderBy(F.desc("evidence"), "entry").limit(entries).collect()
    draft = Lexicon({r["entry"]: float(r["weight"]) for r in top}, exceptions)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame(np.column_stack([draft.measures(list(pdf["text"])), pdf["y"]]), columns=list("abcdy"))

    data = rows.select("text", "y").mapInPandas(measured, "a double, b double, c double, d double, y double").toPandas()
    return Lexicon(draft.weights, exceptions, tuple(_logistic(data[list("abcd")].to_numpy(), data["y"].to_numpy())))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton's method; rows are bounded by the sample."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    z, w = x / scale, np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        grad = z.T @ (p - y) + ridge * 1e-2 * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + ridge * 1e-2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def with_scores(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score for every row; null counts as the empty text. A column of that
    name is replaced. One scan, no shuffle; every batch holds whole texts."""
    small_batches(docs.sparkSession)
    kept = docs.drop(name)
    schema = kept.withColumn(name, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.automaton()
        for batch in batches:
            for start in range(0, len(batch), ROWS):
                part = batch.slice(start, ROWS)
                texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
                scores = pa.array(lexicon.scores(texts, machine), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, scores], names=[*part.schema.names, name])

    return kept.mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs``; rows without id get
    a score too, and repeated rows one each."""
    lexicon = learn(training_rows(docs, labels, "toxic"))
    scored = with_scores(docs.select("doc_id", "text"), lexicon)
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
