"""Repair of conversation structure over a suffix-shared automaton.

A conversation's rows become a signature, a letter for each row's role and fault. Distinct
signatures, read from the end and sorted, are the paths of an automaton whose nodes are the
different suffixes; cost-to-go and the best first edits of each node and grammar state are
computed when the path first reaches it, once for all conversations that end so (a border
between two tasks computes the nodes on its path a second time). The repaired texts are
hashed as a stream of rows behind their conversation's audit, so no conversation is held.

Grammar of the role initials: ``(s?(ua)+)?``. Keep, rerole and delete use up a row, an
insertion does not. In every state one role may come next by insertion or rerole, and two
choices that use up a row differ in their letters before they do so, or lead to one state;
so ties are broken by a node's own edits and no audit is compared beyond them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from storyrank.llm.text import BLANK_CHARS
from storyrank.session import stage

# Costs of the edits, and what a truncated row that stays adds.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
START, OPENED, ASKED, ANSWERED = range(4)  # nothing yet, after s, after u, after a
STATES = (START, OPENED, ASKED, ANSWERED)
NEXT = "uuau"  # the role that an insertion or rerole gives in each state
AFTER = {"s": OPENED, "u": ASKED, "a": ANSWERED}
ACCEPTED = (START, ANSWERED)
SALTS = 16  # parts of the conversations of one signature
CHUNK = 1 << 14  # rows of an output batch
CHARS = 1 << 22  # characters of an output batch

Step = tuple[int, str, int]  # cost-to-go, edits up to and with the next row, state after it


# --- damage and faults -----------------------------------------------------------
def damaged(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` after the damage by ``crc32('conv_id:turn') % 20``.

    Null counts as one space, in the key, the role and the text. 0 drops a row, 1 empties
    its text, 2 takes its ``.!?``, 3 repeats it, 4 makes it the user's.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.concat(space("conv_id"), F.lit(":"), space("turn"))
    named = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(key) % 20).alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("harm") == 3, 2).otherwise(1))
    return named.filter("harm <> 0").select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def letter(role: str, fault: str) -> str:
    """The letter of a row: ``d`` for one that must go, else the initial (``x`` if it is none
    of the grammar's), upper case if it is truncated."""
    if fault in ("blank", "duplicate"):
        return "d"
    initial = role[:1] if role[:1] in AFTER else "x"
    return initial.upper() if fault == "truncated" else initial


class _Conversation:
    """Counts and letters of one conversation, row by row."""

    def __init__(self, conv_id):
        self.conv_id, self.letters = conv_id, bytearray()
        self.low = self.turn = self.last = None
        self.turns = self.illegal = 0
        self.faults = dict.fromkeys(("", "blank", "duplicate", "truncated"), 0)

    def add(self, turn, role: str, blank: bool, again: bool, cut: bool) -> None:
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.low, self.turn = turn if self.low is None else self.low, turn
        fault = "blank" if blank else "duplicate" if again else "truncated" if cut else ""
        self.faults[fault] += 1
        self.letters += letter(role, fault).encode()
        initial = role[:1]
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.turn - self.low + 1 - self.turns
        return (self.conv_id, self.letters.decode(), gaps if gaps < 1 << 63 else None, self.faults["blank"],
                self.faults["duplicate"], self.faults["truncated"], self.illegal)


def _columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*[batch.column(n).to_pylist() for n in names], strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows in batches of bounded rows and characters."""
    out, held = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        out.append(row)
        held += sum(len(v) for v in row if isinstance(v, str))
        if len(out) >= CHUNK or held >= CHARS:
            yield batch()
            out, held = [], 0
    if out:
        yield batch()


def _signatures(schema: pa.Schema):
    """One row for each run of rows of a conversation, which lie together and in order."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        open_ = None
        for batch in batches:
            for conv_id, *row in _columns(batch, "conv_id", "turn", "role", "blank", "again", "cut"):
                if open_ is None or conv_id != open_.conv_id:
                    if open_ is not None:
                        yield open_.row()
                    open_ = _Conversation(conv_id)
                open_.add(*row)
        if open_ is not None:
            yield open_.row()

    return lambda batches: _batches(rows(batches), schema)


def signatures(rows: DataFrame) -> DataFrame:
    """``(conv_id, signature, gaps, blank, duplicate, truncated, illegal)`` of damaged rows.

    Rows go by turn, null first; rows of one turn by role, then text. A null id is a
    conversation of its own.
    """
    kind = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), T.StructField("signature", T.StringType()),
                         *[T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal")]])
    first = Window.partitionBy("conv_id", "role", "text").orderBy("turn")
    bare = F.rtrim(F.col("text"), F.lit(BLANK_CHARS))
    placed = rows.repartition("conv_id").select(
        "*", (F.row_number().over(first) > 1).alias("again"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    laid = placed.sortWithinPartitions("conv_id", "turn", "role", "text", "again")
    return laid.select("conv_id", "turn", "role", "blank", "again", "cut").mapInArrow(_signatures(to_arrow_schema(kind)), kind)


# --- automaton -------------------------------------------------------------------
def ending(state: int) -> Step:
    """Insertions up to an accepted end."""
    edits = ""
    while state not in ACCEPTED:
        state, edits = AFTER[NEXT[state]], edits + "I"
    return INSERT * len(edits), edits, state


def node(symbol: str, after: tuple[Step, ...]) -> tuple[Step, ...]:
    """The best step of each grammar state before ``symbol``, given those of the suffix behind it."""
    steps = []
    for start in STATES:
        state, edits, choices = start, "", []
        for _ in STATES:  # more insertions come back to a state they have been in
            paid = INSERT * len(edits)
            choices.append((paid + DELETE + after[state][0], edits + "D", state))
            if symbol != "d":
                initial, extra = symbol.lower(), TRUNCATED if symbol.isupper() else 0
                if initial == NEXT[state] or initial == "s" and state == START:
                    to = AFTER[initial]
                    choices.append((paid + extra + after[to][0], edits + "K", to))
                to = AFTER[NEXT[state]]
                choices.append((paid + REROLE + extra + after[to][0], edits + "R", to))
            state, edits = AFTER[NEXT[state]], edits + "I"
        steps.append(min(choices))
    return tuple(steps)


LEAF = tuple(ending(s) for s in STATES)


class Automaton:
    """The path of the last signature, from the end; a sorted signature keeps what it shares."""

    def __init__(self):
        self.path, self.word, self.built = [LEAF], "", 0

    def solve(self, backwards: str) -> tuple[int, str]:
        """Cost and audit of the signature whose letters are given from the last to the first."""
        shared = 0
        for a, b in zip(backwards, self.word):
            if a != b:
                break
            shared += 1
        del self.path[shared + 1:]
        for symbol in backwards[shared:]:
            self.path.append(node(symbol, self.path[-1]))
            self.built += 1
        self.word = backwards
        state, edits = START, []
        for steps in reversed(self.path[1:]):
            edits.append(steps[state][1])
            state = steps[state][2]
        edits.append(ending(state)[1])
        return self.path[-1][START][0], "".join(edits)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = Automaton()
    for batch in batches:
        words = batch.column("backwards").to_pylist()
        found = [automaton.solve(w) for w in words]
        yield pa.RecordBatch.from_arrays(
            [pa.array([w[::-1] for w in words], pa.string()), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())],
            names=["signature", "cost", "audit"])


def audits(found: DataFrame) -> DataFrame:
    """``(signature, cost, audit)`` for each distinct signature."""
    distinct = found.select("signature").distinct().select(F.reverse("signature").alias("backwards"))
    laid = distinct.repartitionByRange("backwards").sortWithinPartitions("backwards")
    return laid.mapInArrow(_solved, "signature string, cost long, audit string")


# --- repaired texts --------------------------------------------------------------
def edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The repaired ``(role, text)`` rows: the audit's edits applied to rows as they come."""
    state = START
    for edit in audit:
        if edit == "I":
            given = NEXT[state]
            state = AFTER[given]
            yield ROLES[given], ""
            continue
        role, text = next(rows)
        if edit == "K":
            state = AFTER[role[0]]
            yield role, text
        elif edit == "R":
            given = NEXT[state]
            state = AFTER[given]
            yield ROLES[given], text


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(conv_id, repaired rows)`` for each conversation, whose audit comes before its rows."""
    rows = (row for batch in batches for row in _columns(batch, "conv_id", "audit", "role", "text"))
    ahead: list[tuple] = []

    def own() -> Iterator[tuple[str, str]]:
        for row in rows:
            if row[1] is not None:
                ahead.append(row)
                return
            yield row[2], row[3]

    head = next(rows, None)
    while head is not None:
        turns = own()
        yield head[0], edited(head[1], turns)
        for _ in turns:
            pass
        head = ahead.pop() if ahead else None


def _digests(schema: pa.Schema):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv_id, turns in _replayed(batches):
            digest, joint = hashlib.sha256(), ""
            for role, text in turns:
                digest.update(f"{joint}{role}:{text}".encode())
                joint = "\n"
            yield conv_id, digest.hexdigest()

    return lambda batches: _batches(rows(batches), schema)


def _rows(schema: pa.Schema):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv_id, turns in _replayed(batches):
            for turn, (role, text) in enumerate(turns):
                yield conv_id, turn, role, text

    return lambda batches: _batches(rows(batches), schema)


def _replay(rows: DataFrame, solved: DataFrame, kernel, *fields: T.StructField) -> DataFrame:
    """Rows behind their audits, read once over sorted partitions."""
    kind = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *fields])
    none = F.lit(None)
    heads = solved.select("conv_id", F.lit(0).alias("part"), none.cast(rows.schema["turn"].dataType).alias("turn"),
                          none.cast("string").alias("role"), none.cast("string").alias("text"), "audit")
    bodies = rows.select("conv_id", F.lit(1).alias("part"), "turn", "role", "text", none.cast("string").alias("audit"))
    laid = heads.unionByName(bodies).repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "role", "text")
    return laid.select("conv_id", "audit", "role", "text").mapInArrow(kernel(to_arrow_schema(kind)), kind)


def solve(rows: DataFrame) -> DataFrame:
    """``signatures`` with ``cost`` and ``audit``. A signature that very many conversations share
    is joined in ``SALTS`` parts."""
    salted = stage(signatures(rows)).withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)))
    parts = audits(salted).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return stage(salted.join(parts, ["signature", "salt"]).drop("salt"))


def repaired_rows(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)``: the cheapest legal conversations, turns numbered from 0.

    ``rows`` have ``conv_id``, ``turn``, ``role`` and ``text``; a null role or text counts as a space.
    """
    filled = rows.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    return _replay(filled, solve(filled), _rows, T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                   T.StructField("text", T.StringType()))


def report(conversations: DataFrame) -> DataFrame:
    """A row for each conversation of the table, as damaged, checked and repaired.

    A null id is one conversation; repeated rows are rows. A conversation without rows after
    the damage has zeros, an empty audit and the digest of nothing. ``gaps`` is null where a
    long cannot hold it. The audit and the digest of one conversation are one ordered pass,
    streamed; of a row only its letter is held.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    broken = damaged(rows)
    solved = solve(broken)
    digests = _replay(broken, solved, _digests, T.StructField("repaired_sha256", T.StringType()))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))
    full = solved.alias("a").join(digests.alias("b"), same).select("a.conv_id", *numbers, "audit", "repaired_sha256")
    gone = rows.select("conv_id").distinct().alias("a").join(solved.select("conv_id").alias("b"), same, "left_anti")
    nothing = gone.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in numbers], F.lit("").alias("audit"),
                          F.lit(hashlib.sha256().hexdigest()).alias("repaired_sha256"))
    return full.unionByName(nothing)
