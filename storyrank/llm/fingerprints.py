"""Homomorphic multiset fingerprints of documents, summed over paragraphs, in the JVM alone.

A paragraph's vector is wide: ``2 * KEYED`` lanes hashed from the whole paragraph, and 64
counting lanes for each of ``HASHES`` hashes of its word shingles, each holding how many
shingles have that bit set. A document's vector is the sum of its paragraphs' vectors,
modulo 2^32 in every lane: the order of paragraphs does not matter, and adding or
subtracting a paragraph's vector inserts or deletes it. The keyed lanes tell unequal
multisets of paragraphs apart; the counting lanes give the likeness of two documents (a
bit counted against its shingles is a sum of signs, as in an AMS sketch).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyrank.llm.text import bit_count_of, bit_sums, whole, words

KEYED = 4  # hashes of a paragraph, two lanes each
HASHES = 2  # hashes of a shingle, 64 counting lanes each
SHINGLE = 3
PARAGRAPH = "\n"
BLOCK = 64  # ids to a block of the order by id
GROUP = 4096  # blocks to a group
FULL = 1 << 32
NO_ID = -(1 << 63)


def lane_names() -> list[str]:
    return ([f"k{k}_{half}" for k in range(KEYED) for half in ("a", "b")]
            + [f"s{n}_{j}" for n in range(HASHES) for j in range(32)])


def vectors(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys``, ``n`` (shingles) and the lanes of every group of ``keys``; counting lanes
    lie two to a column. Paragraphs are lines; a line of fewer words than a shingle is one
    shingle, a line without words has keyed lanes only. Null text counts as empty."""
    rows = docs.select(*keys, F.explode(F.split(whole(text), PARAGRAPH)).alias("p"))
    rows = rows.withColumn("w", words(F.col("p")))
    last = F.greatest(F.size("w") - SHINGLE, F.lit(0))
    rows = rows.select(*keys, "p", "w", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    gram = F.concat_ws(" ", *[F.get("w", F.col("i") + k) for k in range(SHINGLE)])
    real = F.size("w") > 0
    terms = rows.select(
        *keys, real.cast("long").alias("one"), F.when(real, F.xxhash64(gram)).otherwise(F.lit(0)).alias("h0"),
        *[F.when(F.col("i") == 0, F.xxhash64(F.lit(k), "p")).otherwise(F.lit(0)).alias(f"x{k}") for k in range(KEYED)])
    for n in range(1, HASHES):
        terms = terms.withColumn(f"h{n}", F.when(F.col("one") > 0, F.xxhash64("h0", F.lit(n))).otherwise(F.lit(0)))
    low = F.lit(FULL - 1)
    keyed = [F.sum(half).alias(f"k{k}_{name}") for k in range(KEYED) for name, half in (
        ("a", F.col(f"x{k}").bitwiseAND(low)), ("b", F.shiftrightunsigned(f"x{k}", 32)))]
    counted = [c for n in range(HASHES) for c in bit_sums(F.col(f"h{n}"), f"s{n}_")]
    return terms.groupBy(*keys).agg(F.sum("one").alias("n"), *keyed, *counted).withColumns(
        {c: F.col(c) % FULL for c in lane_names() if c[0] == "k"})


def combined(a: DataFrame, b: DataFrame, keys: list[str], sign: int = 1) -> DataFrame:
    """Vectors of the documents ``a`` with the paragraphs ``b`` inserted (or, with ``sign``
    -1, deleted): lane by lane, modulo 2^32. Keys missing on one side count as zero."""
    names = ["n", *lane_names()]
    right = b.select(*keys, *[F.col(c).alias(f"__{c}") for c in names])
    zero = F.lit(0).cast("long")
    both = a.join(right, keys, "full")
    total = {c: F.coalesce(c, zero) + sign * F.coalesce(f"__{c}", zero) for c in names}
    total |= {c: F.pmod(total[c], F.lit(FULL)) for c in names if c[0] == "k"}
    return both.withColumns(total).drop(*[f"__{c}" for c in names])


def fingerprint(vector: str) -> Column:
    """A struct of lanes as lowercase hex."""
    parts = [F.lpad(F.hex(F.col(f"{vector}.{c}")), 8 if c[0] == "k" else 16, "0") for c in lane_names()]
    return F.lower(F.concat(*parts))


def signs(vector: str) -> Column:
    """The counting lanes as sums of signs."""
    out = []
    for n in range(HASHES):
        for bit in range(64):
            out.append((2 * bit_count_of(f"{vector}.s{n}_", bit) - F.col(f"{vector}.n")).cast("double"))
    return F.array(*out)


def likeness(a: str, b: str, same: Column) -> Column:
    """Shared part of two multisets of shingles, 0 to 1, estimated from columns of signs;
    1 where ``same`` holds. Its error is about one over the root of the number of lanes."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    size = dot(a, a) + dot(b, b)
    rate = F.when(size > 0, 2 * dot(a, b) / size).otherwise(F.lit(0.0))
    return F.when(same, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), rate)))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows with their place in the order by descending id, and the block after each block.

    Ids are cut into blocks of ``BLOCK`` consecutive numbers, so a block never holds more
    different ids than that; blocks are put in order by groups, and only the groups' tops
    by one task. A null id comes last; repeated ids are ordered by their text.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(F.col(text_col)).alias("text"))
    rows = rows.withColumn("o", F.coalesce("doc_id", F.lit(NO_ID).cast("long")))
    rows = rows.withColumn("b", F.floor(F.shiftright("o", BLOCK.bit_length() - 1)))
    inside = Window.partitionBy("b").orderBy(F.desc("o"), F.desc("text"))
    placed = rows.withColumns({"rn": F.row_number().over(inside), "after": F.lead("text").over(inside)})
    blocks = rows.select("b").distinct().withColumn("g", F.shiftright("b", GROUP.bit_length() - 1))
    step = F.lead("b").over(Window.partitionBy("g").orderBy(F.desc("b")))
    tops = blocks.groupBy("g").agg(F.max("b").alias("top"))
    every = Window.orderBy(F.desc("g"))
    tops = tops.select("g", F.coalesce(F.lead("top").over(every), F.first("top").over(every)).alias("below"))
    order = blocks.withColumn("step", step).join(tops, "g").select("b", F.coalesce("step", "below").alias("next_b"))
    return placed, order


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint, that of its edited text, and both likenesses.

    Edited: the last third of the code points is replaced by the first as many of the
    next document in descending id. Texts are shuffled once, by block; sums, order and
    partners stay in that partitioning, and only the first text of each block is joined
    to the block before. Every row gives a row; a single document is its own next.
    """
    placed, order = with_next(docs, id_col, text_col)
    heads = placed.filter("rn = 1").select(F.col("b").alias("next_b"), F.col("text").alias("head"))
    heads = heads.join(order, "next_b").select("b", "head")
    full = placed.join(heads, "b", "left")
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    after = F.coalesce("after", "head")
    edited = F.concat(F.substring("text", F.lit(1), (n - third).cast("int")), F.substring(after, F.lit(1), third))
    pair = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t"), F.lit("").alias("sha")),
                   F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t"), F.sha2("edited", 256).alias("sha")))
    both = full.select("b", "rn", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited")).select(
        "b", "rn", "doc_id", "n_chars", F.inline(pair))
    keys = ["b", "rn", "doc_id", "n_chars", "kind", "sha"]
    lanes = vectors(both, keys, "t").select(*keys, F.struct("n", *lane_names()).alias("v"))
    line = Window.partitionBy("b").orderBy("rn", "kind")
    lanes = lanes.withColumns({"e": F.lead("v", 1).over(line), "x": F.lead("v", 2).over(line),
                               "edited_sha256": F.lead("sha", 1).over(line)}).filter("kind = 0")
    first = vectors(placed.filter("rn = 1").select(F.col("b").alias("next_b"), "text"), ["next_b"], "text")
    first = first.join(order, "next_b").select("b", F.struct("n", *lane_names()).alias("hx"))
    out = lanes.join(first, "b", "left").withColumn("x", F.coalesce("x", "hx"))
    out = out.withColumns({"va": signs("v"), "ve": signs("e"), "vx": signs("x")})
    return out.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint("v").alias("fingerprint"),
        fingerprint("e").alias("edited_fingerprint"),
        likeness("va", "ve", F.col("v") == F.col("e")).alias("near_edited"),
        likeness("va", "vx", F.col("v") == F.col("x")).alias("near_next"))
