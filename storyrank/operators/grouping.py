"""Group-wise helpers that keep a hot group out of any single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyrank.session import ensure_checkpoint_dir


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by ``order``: a partial aggregate, so copies of one
    key are folded in the map tasks and never gathered."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[o if isinstance(o, Column) else F.col(o) for o in order])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("__row"))
    return picked.select(*keys, "__row.*").select(*df.columns)


def last_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[o if isinstance(o, Column) else F.col(o) for o in order])
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("__row"))
    return picked.select(*keys, "__row.*").select(*df.columns)


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "pos") -> DataFrame:
    """First ``n`` rows per key with their position. The rank filter is applied before
    the shuffle as well, so each task ships at most ``n`` rows of a key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def exact_rank(df: DataFrame, keys: list[str], order: list[Column], name: str = "pos") -> DataFrame:
    """``row_number`` per key (or over the whole table) without one task per key.

    Rows are range-partitioned by key and order and kept by a reliable checkpoint, so
    that a range is the same rows whenever it is read again; each range numbers its own
    rows, and the row counts of the earlier ranges of the key are added.
    """
    ensure_checkpoint_dir(df.sparkSession)
    key_cols = [F.col(k) for k in keys]
    ranged = (
        df.repartitionByRange(*key_cols, *order)
        .sortWithinPartitions(*key_cols, *order)
        .withColumn("__pid", F.spark_partition_id())
        .checkpoint()
    )
    before = Window.partitionBy(*keys).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys, "__pid").agg(F.count("*").alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    inside = Window.partitionBy(*keys, "__pid").orderBy(*order)
    numbered = ranged.withColumn("__local", F.row_number().over(inside))
    right = offsets.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
                           F.col("__pid").alias("__rp"), "__before")
    on = F.col("__pid") == F.col("__rp")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return (
        numbered.join(right, on)
        .withColumn(name, (F.col("__local") + F.col("__before")).cast("bigint"))
        .select(*df.columns, name)
    )
