"""Stored tables in hash buckets, changed by merging batches into the buckets they touch.

A table is Parquet below ``path/data/<write>/bucket=<b>`` and a list of commits below
``path/commits``: of each bucket the write that holds it, how many rows, and a number that
rises. A merge finds the batch's buckets, reads and writes only these into a folder of its
own, and then appends one file of commits. Readers follow the commits, so a write that dies
before that file leaves the old table as it is, and running it again does no harm. Files of
other buckets stay where they are. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyrank.operators.tables import upsert
from storyrank.session import stage

BUCKET = "bucket"
COMMITS = "number long, bucket int, write string, n long, buckets int, keys array<string>, schema string"
BUCKETS = 64
FILE_ROWS = 2_000_000  # rows of a bucket's file


class StoredTable:
    """A table of unique keys in the folder ``path``; ``create`` makes it, ``merge`` changes it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, rows: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> StoredTable:
        """The table with ``rows``, one for each key; each bucket of it is committed, empty ones too."""
        table = cls(rows.sparkSession, path)
        table._write(rows, keys, buckets, list(range(buckets)), 0, rows.schema)
        return table

    # --- reading ------------------------------------------------------------------
    def _live(self) -> list:
        """The last commit of each bucket: at most as many rows as buckets."""
        commits = self.spark.read.schema(COMMITS).parquet(f"{self.path}/commits")
        row = F.struct(*[c for c in commits.columns if c != "bucket"])
        return commits.groupBy("bucket").agg(F.max_by(row, "number").alias("c")).select("bucket", "c.*").collect()

    def _read(self, live: list, schema: T.StructType) -> DataFrame:
        folders = [f"{self.path}/data/{r['write']}/{BUCKET}={r['bucket']}" for r in live if r["n"]]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def read(self) -> DataFrame:
        """The committed rows."""
        live = self._live()
        return self._read(live, _schema(live))

    def files(self) -> list[str]:
        """The files that the committed rows lie in."""
        return sorted(self.read().inputFiles())

    def bucket_of(self, keys: list[str], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    # --- writing ------------------------------------------------------------------
    def merge(self, batch: DataFrame, rules: dict[str, str] | None = None, order: list | None = None, insert: bool = True) -> int:
        """``upsert`` of the batch; gives the number of buckets that were written anew."""
        live = self._live()
        return self.change(batch, lambda old, new: upsert(old, new, live[0]["keys"], rules, order, insert), live)

    def change(self, batch: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame], live: list | None = None) -> int:
        """Replaces the rows of the batch's buckets by ``apply(rows of these buckets, batch)``.

        The batch is kept in the shared folder, as it is read twice. ``apply`` must not move a
        key to another bucket.
        """
        live = live or self._live()
        keys, buckets, schema = live[0]["keys"], live[0]["buckets"], _schema(live)
        batch = stage(batch)
        touched = sorted(r[0] for r in batch.select(self.bucket_of(keys, buckets)).distinct().collect())
        if not touched:
            return 0
        old = self._read([r for r in live if r["bucket"] in set(touched)], schema)
        number = max(r["number"] for r in live) + 1
        self._write(apply(old, batch).select(*schema.fieldNames()), keys, buckets, touched, number, schema)
        return len(touched)

    def _write(self, rows: DataFrame, keys: list[str], buckets: int, touched: list[int], number: int, schema: T.StructType) -> None:
        write = f"{number}-{uuid.uuid4().hex}"
        target = f"{self.path}/data/{write}"
        placed = rows.withColumn(BUCKET, self.bucket_of(keys, buckets))
        placed.repartition(BUCKET).write.option("maxRecordsPerFile", FILE_ROWS).partitionBy(BUCKET).parquet(target)
        self._commit(target, write, keys, buckets, touched, number, schema)

    def _commit(self, target: str, write: str, keys: list[str], buckets: int, touched: list[int], number: int, schema: T.StructType) -> None:
        """One file that makes the write visible, put there by Spark's own commit."""
        kept = T.StructType([*[f for f in schema if f.name in keys], T.StructField(BUCKET, T.IntegerType())])
        counted = self.spark.read.schema(kept).parquet(target).groupBy(BUCKET).agg(F.count("*").alias("n"))
        n = {r[BUCKET]: r["n"] for r in counted.collect()}
        strange = set(n) - set(touched)
        if strange:
            raise ValueError(f"rows of buckets {sorted(strange)} that the batch does not touch")
        rows = [(number, b, write, n.get(b, 0), buckets, keys, schema.json()) for b in touched]
        self.spark.createDataFrame(rows, COMMITS).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def vacuum(self) -> int:
        """Deletes the folders of buckets that no commit points to any more, those of writes that
        died too; gives their number. Not while a reader or a writer is at work."""
        live = {f"{r['write']}/{BUCKET}={r['bucket']}" for r in self._live()}
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        store = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        gone = 0
        for write in store.listStatus(root):
            folders = [f for f in store.listStatus(write.getPath()) if f.isDirectory()]
            stay = [f for f in folders if f"{write.getPath().getName()}/{f.getPath().getName()}" in live]
            for folder in folders if stay else [write]:
                if folder not in stay:
                    gone += bool(store.delete(folder.getPath(), True))
        return gone


def _schema(live: list) -> T.StructType:
    return T.StructType.fromJson(json.loads(live[0]["schema"]))


# --- the stored tables of the pipeline --------------------------------------------
def merge_items(table: StoredTable, batch: DataFrame, order: list | None = None) -> int:
    """An item keeps its vector unless the batch brings one."""
    return table.merge(batch, {"embedding": "coalesce"}, order)


def merge_embeddings(table: StoredTable, vecs: DataFrame) -> int:
    """Vectors of known items; unknown ids are ignored."""
    return table.merge(vecs.select("id", "embedding"), {"embedding": "coalesce"}, insert=False)


def merge_stories(stories: StoredTable, members: StoredTable, batch: DataFrame, batch_members: DataFrame) -> tuple[int, int]:
    """Story rows keep their first ``created_at``; the members of a written story are replaced.

    ``members`` lies in buckets of its ``story_id``, so that a story is in one bucket. Its
    commit comes first: if the second one is lost, running the merge again mends it.
    """
    written = stage(batch)
    ids = written.select(F.col("id").alias("story_id")).distinct()
    marked = ids.withColumn("item_id", F.lit(None).cast("string")).unionByName(
        batch_members.select("story_id", "item_id").distinct().join(ids, "story_id", "left_semi"))

    def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
        named = new.select("story_id").distinct()
        return old.join(named, "story_id", "left_anti").unionByName(new.filter(F.col("item_id").isNotNull()))

    moved = members.change(marked, replaced)
    return stories.merge(written, {"created_at": "old"}), moved


def merge_digests(table: StoredTable, batch: DataFrame) -> int:
    """A digest written again keeps its kind, date and first ``created_at``."""
    flags = [F.coalesce(F.col(c), F.lit(False)) for c in ("quiet_day", "quiet_week") if c in batch.columns]
    if flags:
        batch = batch.withColumn("quiet", flags[0] if len(flags) == 1 else flags[0] | flags[1])
    return table.merge(batch, {"kind": "old", "date": "old", "created_at": "old"})
