"""Set-based table maintenance: upserts, replace-a-day, appends, constraints."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyrank import constants as K
from storyrank.functions.text import local_date
from storyrank.operators.grouping import exact_rank, last_per_key


def upsert(
    target: DataFrame,
    batch: DataFrame,
    keys: list[str],
    rules: dict[str, str] | None = None,
    order: list | None = None,
    insert: bool = True,
) -> DataFrame:
    """Rows of ``target`` updated and extended by ``batch``.

    ``rules`` names, per column, which side wins on a match: ``new`` (the default),
    ``old`` or ``coalesce`` (new unless NULL). Several batch rows of one key give one row:
    the last by ``order``, ties and batches without an order by their values as JSON; a
    ``coalesce`` column takes the last value that is not NULL. ``insert=False`` ignores
    unknown keys.
    """
    rules = rules or {}
    batch = _one_per_key(batch, keys, rules, order or [])
    rest = [c for c in target.columns if c not in keys]
    given = [c for c in rest if c in batch.columns]
    old = target.select(*keys, *[F.col(c).alias(f"__o_{c}") for c in rest], F.lit(True).alias("__old"))
    new = batch.select(*keys, *[F.col(c).alias(f"__n_{c}") for c in given], F.lit(True).alias("__new"))
    both = old.join(new, keys, "full_outer" if insert else "left")
    hit, known = F.col("__new").isNotNull(), F.col("__old").isNotNull()

    def pick(c: str) -> Column:
        o = F.col(f"__o_{c}")
        if c not in given:
            return o.alias(c)
        n = F.col(f"__n_{c}")
        rule = rules.get(c, "new")
        if rule == "coalesce":
            return F.coalesce(n, o).alias(c)
        if rule == "old":
            return F.when(known, o).otherwise(n).alias(c)
        return F.when(hit, n).otherwise(o).alias(c)

    picked = {c: pick(c) for c in rest}
    return both.select(*[F.col(c) if c in keys else picked[c] for c in target.columns])


def _one_per_key(batch: DataFrame, keys: list[str], rules: dict[str, str], order: list) -> DataFrame:
    rest = [c for c in batch.columns if c not in keys]
    if not rest:
        return batch.distinct()
    by = F.struct(*order, F.to_json(F.struct(*rest)))
    whole = F.max_by(F.struct(*rest), by).alias("__last")
    filled = [F.max_by(c, F.when(F.col(c).isNotNull(), by)).alias(f"__f_{c}") for c in rest if rules.get(c) == "coalesce"]
    picked = batch.groupBy(*keys).agg(whole, *filled)
    return picked.select(*keys, *[
        (F.col(f"__f_{c}") if rules.get(c) == "coalesce" else F.col(f"__last.{c}")).alias(c) for c in rest])


def upsert_items(target: DataFrame, batch: DataFrame, order: list | None = None) -> DataFrame:
    return upsert(target, batch, ["id"], {"embedding": "coalesce"}, order)


def set_embeddings(items: DataFrame, vecs: DataFrame) -> DataFrame:
    return upsert(items, vecs.select("id", "embedding"), ["id"], {"embedding": "coalesce"}, insert=False)


def upsert_stories(
    stories: DataFrame, story_items: DataFrame, batch: DataFrame, batch_members: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Story rows keep their first ``created_at``; membership of a written story is replaced."""
    rows = upsert(stories, batch, ["id"], {"created_at": "old"})
    written = batch.select(F.col("id").alias("story_id")).distinct()
    kept = story_items.join(written, "story_id", "left_anti")
    fresh = batch_members.select("story_id", "item_id").distinct()
    return rows, kept.select("story_id", "item_id").unionByName(fresh)


def replace_day(stories: DataFrame, day: str, tz: str, new: DataFrame) -> DataFrame:
    """All stories of one local day out, the new set in."""
    keep = ~F.coalesce(local_date("created_at", tz) == F.lit(day).cast("date"), F.lit(False))
    return stories.filter(keep).unionByName(new)


def write_days(stories: DataFrame, path: str, tz: str) -> None:
    """Overwrite just the local days present in ``stories``; other days stay untouched."""
    (
        stories.withColumn("local_date", local_date("created_at", tz))
        .repartition("local_date", F.pmod(F.xxhash64("id"), F.lit(32)))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("local_date").parquet(path)
    )


def save_digests(digests: DataFrame, batch: DataFrame) -> DataFrame:
    rules = {"kind": "old", "date": "old", "created_at": "old"}
    flags = [F.coalesce(F.col(c), F.lit(False)) for c in ("quiet_day", "quiet_week") if c in batch.columns]
    if flags:
        quiet = flags[0] if len(flags) == 1 else flags[0] | flags[1]
        batch = batch.withColumn("quiet", quiet)
    return upsert(digests, batch, ["id"], rules)


def append_feedback(fb: DataFrame, batch: DataFrame) -> DataFrame:
    """The appended rows with ids that go on from the largest id in use."""
    order = [F.col("created_at"), F.col("target_id"), F.col("signal"), F.col("value")]
    last = fb.agg(F.coalesce(F.max(F.col("id").cast("bigint")), F.lit(-1)))
    numbered = exact_rank(batch.drop("id"), [], order, "__n")
    return numbered.withColumn("id", (last.scalar() + F.col("__n")).cast("string")).select(*batch.columns)


def upsert_sources(src: DataFrame, batch: DataFrame) -> DataFrame:
    return upsert(src, batch, ["name"], {"created_at": "old"})


def append_eval(runs: DataFrame, batch: DataFrame) -> DataFrame:
    return runs.unionByName(batch.withColumn("scores", F.to_json("scores")), allowMissingColumns=True)


def save_state(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Key/value rows after the batch: the latest write of a key stays."""
    return last_per_key(state.unionByName(batch), ["key"], ["updated_at", "value"])


# --- constraints ------------------------------------------------------------------
def enum_rules(table: str) -> dict[str, Column]:
    """CHECK-style rules of the stored tables: rule name to the condition that must hold."""

    def within(col, values):
        return F.col(col).isNotNull() & F.col(col).isin(*values)

    return {
        "items": {"family": within("family", K.FAMILIES)},
        "stories": {"family": within("family", K.FAMILIES), "tier": within("tier", K.TIERS)},
        "digests": {"kind": within("kind", K.DIGEST_KINDS), "tier": within("tier", K.TIERS)},
        "feedback": {"signal": within("signal", K.SIGNALS), "target_kind": within("target_kind", K.TARGET_KINDS)},
        "sources": {"family": within("family", K.FAMILIES),
                    "authority": F.col("authority").between(0.0, 1.0)},
    }[table]


def validate_table(df: DataFrame, rules: dict[str, Column], key: str = "id") -> DataFrame:
    """One row per (row, broken rule)."""
    broken = F.array_compact(F.array(*[
        F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()
    ]))
    return df.select(F.col(key), F.explode(broken).alias("rule"))


def orphans(child: DataFrame, fk: str, parent: DataFrame, key: str = "id") -> DataFrame:
    return child.join(parent.select(F.col(key).alias(fk)), fk, "left_anti").filter(F.col(fk).isNotNull())


def cascade_delete(parent_ids: DataFrame, child: DataFrame, fk: str) -> DataFrame:
    return child.join(parent_ids.select(F.col("id").alias(fk)), fk, "left_anti")


def set_null(parent_ids: DataFrame, child: DataFrame, fk: str) -> DataFrame:
    gone = parent_ids.select(F.col("id").alias(fk), F.lit(True).alias("__gone")).distinct()
    joined = child.join(gone, fk, "left")
    return joined.withColumn(fk, F.when(F.col("__gone").isNull(), F.col(fk))).select(*child.columns)


# --- note files -------------------------------------------------------------------
def export_notes(notes: DataFrame, root: str) -> DataFrame:
    """Write one file per note path below ``root``; of several rows for one path the
    last by ``ord`` is written. Returns the paths as they were read back."""
    from pyarrow import fs

    final = notes.groupBy("path").agg(F.max_by("content", "ord").alias("content"))

    def write(rows) -> None:
        files, base = fs.FileSystem.from_uri(root if "://" in root else "file://" + os.path.abspath(root))
        made = set()
        for row in rows:
            target = f"{base}/{row['path']}"
            folder = os.path.dirname(target)
            if folder not in made:
                files.create_dir(folder, recursive=True)
                made.add(folder)
            with files.open_output_stream(target) as out:
                out.write(row["content"].encode("utf-8"))

    final.foreachPartition(write)
    return read_notes(notes.sparkSession, root)


def read_notes(spark: SparkSession, root: str) -> DataFrame:
    whole = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True)
    file = F.col("_metadata.file_path")
    parts = F.split(file, "/")
    return whole.select(
        F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1)).alias("path"),
        F.col("value").alias("content"),
    )
