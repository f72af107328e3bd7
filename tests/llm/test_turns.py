"""Conversation repair against an exhaustive search over all edits."""

import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import types as T

from storyrank.llm import turns

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                       T.StructField("text", T.StringType()), T.StructField("audit", T.StringType())])
LEGAL = re.compile(r"(s?(ua)+)?\Z")
BLANK = " \t\n\x0b\x0c\r"


def harmed(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(BLANK)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, most):
    """Every edit of every row and up to ``most`` insertions in each place; nothing is shared."""
    marks = faults(rows)
    added = [p for n in range(most + 1) for p in itertools.product(("user", "assistant"), repeat=n)]
    per_row = []
    for (_, _, role, text), mark in zip(rows, marks, strict=True):
        choice = [("D", 3, None)]
        if mark not in ("blank", "duplicate"):
            extra = mark == "truncated"
            choice += [("K", extra, (role, text)), *[("R", 2 + extra, (r, text)) for r in ("user", "assistant")]]
        per_row.append([(("I" * len(p) + c[0]), 2 * len(p) + c[1], [*[(r, "") for r in p], *([c[2]] if c[2] else [])])
                        for p in added for c in choice])
    best = None
    for picks in itertools.product(*per_row, [("I" * len(p), 2 * len(p), [(r, "") for r in p]) for p in added]):
        cost, audit = sum(p[1] for p in picks), "".join(p[0] for p in picks)
        if best is None or (cost, audit) < best[:2]:
            left = [r for p in picks for r in p[2]]
            if LEGAL.match("".join((r or "-")[0] for r, _ in left)):
                best = (cost, audit, left)
    return best


def expected(rows, most):
    live = harmed(rows)
    if not live:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    marks, known = faults(live), [r[1] for r in live if r[1] is not None]
    firsts = [r[2][:1] for r in live]
    cost, audit, left = cheapest(live, most)
    return ((max(known) - min(known) + 1 - len(set(known))) if known else 0, marks.count("blank"), marks.count("duplicate"),
            marks.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(firsts)), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest())


def got(frame):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r["conv_id"]: tuple(r[c] for c in names) for r in turns.report(frame).collect()}


def test_equals_exhaustive_search(spark):
    rnd = random.Random(5)
    texts = ["Yes.", "No", "Why?", " \t", "", None, "Yes.", "Ende …", "Oh!\n", "𝄞."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "User"]
    rows = []
    for conv in [None, *range(1, 120)]:
        for turn in range(rnd.randint(1, 2 if conv and conv % 3 else 3)):
            rows.append((conv, rnd.choice([turn, turn, turn, turn + 5, None]), rnd.choice(roles), rnd.choice(texts)))
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(4)
    found = got(frame)
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert set(found) == set(by) and turns.report(frame).count() == len(by)
    for conv, mine in by.items():
        assert found[conv] == expected(mine, 2 if len(harmed(mine)) < 3 else 1), (conv, mine)


def test_empty_table_and_wide_turns(spark):
    assert turns.report(spark.createDataFrame([], SCHEMA)).count() == 0
    wide = spark.createDataFrame([(1, -(1 << 63), "user", "a.", ""), (1, (1 << 63) - 1, "assistant", "b.", "")], SCHEMA)
    assert turns.report(wide).collect()[0]["gaps"] is None


def test_long_conversation_and_real_rows(spark):
    frame = spark.range(20_000).selectExpr("7L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role",
                                           "concat('turn ', id, if(id % 50 = 0, '', '.')) AS text", "'' AS audit")
    row = turns.report(frame).collect()[0]
    assert len(row["audit"]) > 18_000 and row["cost"] > 0
    left = [(r["role"], r["text"]) for r in sorted(turns.repaired_rows(turns.damaged(frame)).collect(), key=lambda r: r["turn"])]
    assert LEGAL.match("".join(r[0] for r, _ in left))
    assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest() == row["repaired_sha256"]


def test_each_suffix_is_one_node():
    words = sorted("".join(w)[::-1] for n in range(1, 5) for w in itertools.product("suaUd", repeat=n))
    automaton = turns.Automaton()
    solved = {w: automaton.solve(w) for w in words}
    assert automaton.built == len(words)  # every suffix of a word is a word here
    for word in words[::37]:
        alone = turns.Automaton()
        assert alone.solve(word) == solved[word]
