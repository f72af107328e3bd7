"""Substring dedup with suffix automata: spans of words that also occur elsewhere go.

The reference is the corpus itself, so it is cut into shards that only hold what can
repeat, and documents' text goes to the shards it could match instead of every shard going
to every document. Each window of ``SPAN`` words has an anchor, the smallest hash among its
``GRAM``-word runs; equal windows have equal anchors. Consecutive windows with the same
anchor form a segment, so every window lies in exactly one segment. Segments whose anchor
occurs once in the corpus cannot repeat and never move. The others meet by anchor; a task
takes them in shards of about ``SHARD`` words, builds the shard's suffix automaton with
occurrence counts, streams the segments through it for matching statistics, and reports
the spans covered by windows that occur twice or more.

Anchors with more than ``HOT`` segments would gather in one task. Their windows are counted
one by one, by 128-bit hash: a task settles those it sees twice itself and sends one row
for each other, so however many copies a passage has, a window gives at most one row for
each task. Equal texts stand as one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyrank.llm import scan
from storyrank.llm.text import whole
from storyrank.session import stage

SPAN = 35
GRAM = 8
HOT = 200
SHARD = 20_000
FLUSH = 200_000  # windows of hot anchors that a task holds before it settles them
NO_ID = -(1 << 63)
_PLACE = 26  # low bits of a gram's rank that hold its place


class SuffixAutomaton:
    """Suffix automaton of several sequences, with the number of occurrences of each state."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, link: int, following: dict) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.link) - 1

    def _split(self, p: int, symbol, q: int) -> int:
        """The state for the longest suffix of ``q`` that ``p`` and ``symbol`` make."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def add(self, sequence, times: int = 1) -> None:
        last = 0
        for symbol in sequence:
            q = self.next[last].get(symbol)
            if q is not None:  # a prefix that is known from another sequence
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, symbol, q)
            else:
                new = self._state(self.length[last] + 1, 0, {})
                p = last
                while p >= 0 and symbol not in self.next[p]:
                    self.next[p][symbol] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][symbol]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, symbol, q)
                last = new
            self.count[last] += times

    def close(self) -> None:
        """Hands every state's occurrences on to its suffixes; call once, after the last ``add``."""
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[state]] += self.count[state]

    def spans(self, sequence, span: int, least: int = 2) -> list[tuple[int, int]]:
        """Maximal ranges of ``sequence`` covered by runs of ``span`` symbols that occur
        ``least`` times, from matching statistics bounded by ``span``."""
        found: list[tuple[int, int]] = []
        state, length = 0, 0
        for end, symbol in enumerate(sequence, 1):
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if symbol in self.next[state]:
                state, length = self.next[state][symbol], length + 1
            if length > span:
                length = span
            while self.length[self.link[state]] >= length and state:
                state = self.link[state]
            if length == span and self.count[state] >= least:
                start = end - span
                if found and found[-1][1] >= start:
                    found[-1] = (found[-1][0], end)
                else:
                    found.append((start, end))
        return found


class _Runs:
    """The segments of a piece of texts."""

    def __init__(self, piece: scan.Piece, span: int, gram: int):
        starts, ends = scan.spans(piece.data, scan.BLANKS)
        row_at = np.repeat(np.arange(len(piece)), piece.ends - piece.starts + 1)
        self.rows = row_at[starts] if len(starts) else np.empty(0, dtype=np.int64)
        self.words = scan.hashes(piece.data, starts, ends)
        count = np.bincount(self.rows, minlength=len(piece))
        self.first = np.concatenate(([0], np.cumsum(count)[:-1]))
        n, width = len(self.words), span - gram + 1
        if n < span:
            self.low = self.high = self.anchor = self.row = np.empty(0, dtype=np.int64)
            return
        if n >> _PLACE:
            raise ValueError("a text has too many words")
        at = np.arange(n - gram + 1)
        grams = scan.sequence_hashes(self.words, at, at + gram)
        rank = (grams >> np.uint64(_PLACE) << np.uint64(_PLACE)) | at.astype(np.uint64)
        best, reach = rank, 1
        while reach < width:
            step = min(reach, width - reach)
            best = np.minimum(best[:len(best) - step], best[step:])
            reach += step
        window = np.arange(n - span + 1)
        inside = self.rows[window] == self.rows[window + span - 1]
        window = window[inside]
        place = (best[inside] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else np.empty(0, int)
        self.low = window[new]
        self.high = window[np.concatenate((new[1:], [len(window)])) - 1] if len(new) else window[:0]
        self.anchor = grams[place[new]].view(np.int64)
        self.row = self.rows[self.low]


def _anchors(span: int, gram: int):
    """Rows (id, a, b, low, anchor) of every segment; ``low`` is its first word's number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in ("id", "a", "b")]
            for piece in scan.pieces(batch.column("text")):
                runs = _Runs(piece, span, gram)
                at = piece.first + runs.row
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(k[at]) for k in keys], pa.array((runs.low - runs.first[runs.row]).astype(np.int32)),
                     pa.array(runs.anchor)], names=["id", "a", "b", "low", "anchor"])

    return run


ROUTED = "key long, key2 long, id long, a long, b long, start int, stop int, times int, words binary"
_ROUTED = pa.schema([("key", pa.int64()), ("key2", pa.int64()), ("id", pa.int64()), ("a", pa.int64()), ("b", pa.int64()),
                     ("start", pa.int32()), ("stop", pa.int32()), ("times", pa.int32()), ("words", pa.binary())])


def _binary(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(lengths * 8))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())])


def _expand(low: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers ``low``, ``low + 1``, ... of every range, one range after another."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(low - before, lengths)


def _route(span: int, gram: int):
    """Rows to be dealt by ``key``: a segment with its words; or a window of a hot anchor, as
    an open occurrence (``times`` 1), a notice that it repeats (2, no id), or settled (0)."""
    def settle(held: list) -> pa.RecordBatch:
        k, k2, i, a, b, s = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((k2, k))
        same = (k[order][1:] == k[order][:-1]) & (k2[order][1:] == k2[order][:-1])
        multiple = np.zeros(len(k), dtype=bool)
        multiple[order] = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        notice = order[np.concatenate((same, [False])) & ~np.concatenate(([False], same))]
        times = np.where(multiple, 0, 1)
        spread = np.where(multiple, scan.mixed((i + s).view(np.uint64)).view(np.int64), k)
        n = len(notice)
        columns = [np.concatenate((spread, k[notice])), np.concatenate((k2, k2[notice])),
                   *[np.concatenate((c, np.full(n, NO_ID if c is i else 0))) for c in (i, a, b)],
                   np.concatenate((s, np.zeros(n, int))), np.concatenate((s + span, np.zeros(n, int))),
                   np.concatenate((times, np.full(n, 2)))]
        arrays = [pa.array(c, t) for c, t in zip(columns, _ROUTED.types, strict=False)]
        return pa.RecordBatch.from_arrays([*arrays, pa.nulls(len(k) + n, pa.binary())], schema=_ROUTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in ("id", "a", "b")]
            lists = batch.column("starts")
            flat, per_row = lists.flatten(), np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(len(batch)), per_row)
            lows, hots = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("low", "hot"))
            code = owner.astype(np.int64) << 32 | lows
            order = np.argsort(code)
            code, hots = code[order], hots[order].astype(bool)
            for piece in scan.pieces(batch.column("text")):
                runs = _Runs(piece, span, gram)
                at = piece.first + runs.row
                mine = at << 32 | (runs.low - runs.first[runs.row])
                found = np.minimum(np.searchsorted(code, mine), max(len(code) - 1, 0))
                wanted = code[found] == mine if len(code) else np.zeros(len(mine), dtype=bool)
                hot = np.zeros(len(mine), dtype=bool)
                hot[wanted] = hots[found[wanted]]
                k = np.flatnonzero(wanted & ~hot)
                lengths = runs.high[k] - runs.low[k] + span
                start = (runs.low - runs.first[runs.row]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(runs.anchor[k]), pa.array(np.zeros(len(k), dtype=np.int64)), *[pa.array(c[at[k]]) for c in keys],
                     pa.array(start[k]), pa.array((start[k] + lengths).astype(np.int32)),
                     pa.array(np.ones(len(k), dtype=np.int32)), _binary(runs.words[_expand(runs.low[k], lengths)], lengths)],
                    schema=_ROUTED)
                k = np.flatnonzero(wanted & hot)
                if len(k):
                    number = runs.high[k] - runs.low[k] + 1
                    s = _expand(runs.low[k], number)
                    whose = np.repeat(k, number)
                    one = scan.sequence_hashes(runs.words, s, s + span).view(np.int64)
                    two = scan.sequence_hashes(scan.mixed(runs.words), s, s + span).view(np.int64)
                    held.append((one, two, *[c[at[whose]] for c in keys], s - runs.first[runs.row[whose]]))
                    size += len(s)
                if size >= FLUSH:
                    yield settle(held)
                    held, size = [], 0
        if held:
            yield settle(held)

    return run


def _resolve(span: int):
    """Covered ranges (id, a, b, start, stop) out of routed rows that come sorted by key."""
    names = ["id", "a", "b", "start", "stop"]
    schema = pa.schema([(n, _ROUTED.field(n).type) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        shard: list[dict] = []  # of undecided groups: words -> occurrences
        size = 0

        def decide(group: dict, windows: list, times: int) -> None:
            nonlocal size
            if times >= 2:
                out.extend(windows)
            if len(group) == 1:  # one text: repeated as a whole, or not at all
                (places,) = group.values()
                if len(places) > 1:
                    out.extend(places)
            elif group:
                shard.append(group)
                size += sum(map(len, group)) // 8

        def settle() -> None:
            nonlocal size
            machine = SuffixAutomaton()
            texts = {raw: np.frombuffer(raw, dtype=np.uint64).tolist() for group in shard for raw in group}
            for group in shard:
                for raw, places in group.items():
                    machine.add(texts[raw], len(places))
            machine.close()
            for group in shard:
                for raw, places in group.items():
                    for start, stop in machine.spans(texts[raw], span):
                        out.extend((i, a, b, s + start, s + stop) for i, a, b, s, _ in places)
            shard.clear()
            size = 0

        def emit() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 5
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            out.clear()
            return batch

        current, group, windows, times = None, {}, [], 0
        for batch in batches:
            for key, key2, *place, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n == 0:
                    out.append(tuple(place))
                    continue
                if (key, key2) != current:
                    decide(group, windows, times)
                    current, group, windows, times = (key, key2), {}, [], 0
                    if size >= SHARD:
                        settle()
                if raw is not None:
                    group.setdefault(raw, []).append(tuple(place))
                else:
                    times += n
                    if n == 1:
                        windows.append(tuple(place))
            if len(out) >= 50_000:
                yield emit()
        decide(group, windows, times)
        settle()
        yield emit()

    return run


def _cut(span: int):
    """The rows with their words counted and the covered ones cut out, one text at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept_texts, digests = [], [], [], []
            for text, copy, starts, stops in zip(*(batch.column(c) for c in ("text", "copy", "starts", "stops")), strict=True):
                words = text.as_py().encode().split()
                kept = words
                if copy.as_py() and len(words) >= span:
                    kept = []
                elif starts.is_valid and len(starts):
                    cut = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(cut, starts.as_py(), 1)
                    np.add.at(cut, stops.as_py(), -1)
                    kept = [w for w, c in zip(words, cut.cumsum().tolist(), strict=False) if not c]
                joined = b" ".join(kept)
                total.append(len(words))
                removed.append(len(words) - len(kept))
                kept_texts.append(joined.decode())
                digests.append(hashlib.sha256(joined).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(digests, pa.string()), pa.array(kept_texts, pa.string())],
                names=["id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256, kept)`` for every row of ``docs``.

    Words are runs of other than ASCII blanks, unchanged. A word goes if a window of
    ``span`` words that covers it has the same words as a window that starts elsewhere, in
    this or another row. Null text has no words; a null id is a row like any other;
    repeated rows are repeats of each other.
    """
    scan.small_batches(docs.sparkSession)
    text = whole(F.col(text_col))
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID).cast("long")).alias("id"),
                       F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"), text.alias("text"))
    keys = ["id", "a", "b"]
    texts = base.groupBy("a", "b").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    found = base.select(*keys, "text").mapInArrow(_anchors(span, gram), "id long, a long, b long, low int, anchor long")
    # Kept in the shared folder, so that the join below reads it by an exchange of its own and can be split.
    repeated = stage(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "anchor", (F.col("n") > HOT).alias("hot")))
    starts = found.join(repeated, "anchor").groupBy(*keys).agg(F.collect_set(F.struct("low", "hot")).alias("starts"))
    starts = starts.join(texts.select(*keys), keys)  # of equal texts, one
    routed = base.join(starts, keys).select(*keys, "text", "starts").mapInArrow(_route(span, gram), ROUTED)
    dealt = routed.repartition(F.col("key")).sortWithinPartitions("key", "key2")
    covered = dealt.mapInArrow(_resolve(span), "id long, a long, b long, start int, stop int")
    copies = base.select(*keys).join(texts.filter("n > 1").select("a", "b"), ["a", "b"])
    marks = covered.select(*keys, "start", "stop", F.lit(False).alias("copy")).unionByName(
        copies.select(*keys, F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("stop"),
                      F.lit(True).alias("copy")))
    marks = marks.groupBy(*keys).agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"),
                                     F.max("copy").alias("copy"))
    # The same columns as for `routed`, so that both read one exchange of the texts.
    out = base.join(marks, keys, "left").select(
        "id", "text", "starts", "stops", F.coalesce("copy", F.lit(False)).alias("copy"))
    out = out.mapInArrow(_cut(span), "id long, n_words long, n_removed long, kept_sha256 string, kept string")
    kind = docs.schema[id_col].dataType
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).cast(kind).alias("doc_id"),
                      "n_words", "n_removed", "kept_sha256", "kept")
