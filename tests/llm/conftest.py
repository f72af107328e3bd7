import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType())])
CLASHING = ("id", "w", "w0", "words", "score", "rate", "h0", "n", "th", "a", "b", "starts", "lines", "cell", "component")
SYLLABLES = "ka lo mi ru te sa no vi pe du zo fa".split()


def prose(seed: int, n: int) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 4))) for _ in range(n)]


def text_of(words: list[str], line: int = 12) -> str:
    return "\n".join(" ".join(words[i:i + line]) for i in range(0, len(words), line))


def edge_rows() -> list[tuple]:
    """Null and empty texts, blanks, copies, near-copies, overlaps, repeats inside a text, a
    long text, repeated rows, a null id, wide characters."""
    a, b, c = prose(1, 150), prose(2, 90), prose(3, 60)
    near = [*a[:70], "changed", *a[71:]]
    loop = prose(4, 7) * 12
    long = prose(5, 30_000)
    texts = [
        (1, None), (2, ""), (3, " \t\n "), (4, text_of(a)), (5, text_of(a)), (6, text_of(near)),
        (7, text_of(c + a[20:90] + b)), (8, text_of(loop)), (9, text_of(long)), (10, "one two"),
        (11, "one"), (12, text_of(b)), (12, text_of(b)), (None, text_of(c)), (14, "Ünïcode ÄÖ straße 𝄞 " * 30),
        (15, "\n".join(["same line"] * 9)), (16, text_of(long[100:200] + c)),
    ]
    return [(i, t, "en", f"s{(i or 0) % 3}" if i != 7 else None, None if t is None else len(t)) for i, t in texts]


@pytest.fixture(scope="session")
def make(spark):
    def build(rows, clash=False):
        frame = spark.createDataFrame(rows, SCHEMA)
        if clash:
            frame = frame.selectExpr("*", *[f"'x' AS {c}" for c in CLASHING])
        return frame

    return build


@pytest.fixture(scope="session")
def edges(make):
    return make(edge_rows()).repartition(3).cache()


def rows(frame, *names):
    return sorted((tuple(r) for r in (frame.select(*names) if names else frame).collect()), key=repr)
