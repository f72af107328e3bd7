"""Landed records that cannot be read: what can be saved is kept, the rest is listed with its reason.

A line of JSON holds a page of records. One bad record must not cost its page, and one bad line not its
file. ``page_records`` gives every record that can be read; ``json_faults`` and ``xml_faults`` list the rest as
``source, file, reason, raw``:

- ``not_json``: a line that is no JSON (blank lines are nothing),
- ``no_records``: a line without the list of records,
- ``not_an_object``: an entry of that list that is no object,
- ``mistyped``: a record kept with the fields that fit; the others read as NULL,
- ``broken_xml``: a feed file from its first error on; the entries before it are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BAD = "__bad"
KEEP_BAD = {"columnNameOfCorruptRecord": BAD}


def _lines(spark: SparkSession, path: str, steps: list[str], record: str) -> DataFrame:
    """``file, value, page`` of every line that is not blank; the page has the typed list at ``steps``."""
    schema = f"array<struct<{record}>>"
    for step in reversed(steps[1:]):
        schema = f"struct<{step} {schema}>"
    schema = f"{steps[0]} {schema}, {BAD} string"
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return lines.filter(F.trim("value") != "").withColumn("page", F.from_json("value", schema, KEEP_BAD))


def _typed(steps: list[str]) -> Column:
    out = F.col("page")
    for step in steps:
        out = out[step]
    return out


def _entries(steps: list[str]) -> Column:
    """The list at ``steps`` entry by entry, each as it is."""
    return F.try_variant_get(F.try_parse_json("value"), "$." + ".".join(steps), "array<variant>")


def _is_object(entry: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(entry), F.lit("OBJECT")), F.lit(False))


def page_records(spark: SparkSession, path: str, steps: list[str], record: str) -> DataFrame:
    """The records of all lines below ``path``: the objects of the list at ``steps``, with the fields ``record``.

    A page that cannot be typed as a whole is read entry by entry, so that its good records stay.
    """
    saved = F.transform(F.filter(_entries(steps), _is_object), lambda e: F.from_json(F.to_json(e), record))
    lines = _lines(spark, path, steps, record)
    return lines.select(F.explode(F.coalesce(_typed(steps), saved)).alias("r")).filter("r is not null").select("r.*")


def json_faults(spark: SparkSession, path: str, steps: list[str], record: str, source: str) -> DataFrame:
    """What ``page_records`` leaves out, or keeps in part. Sound lines are parsed once and go no further."""
    lines = _lines(spark, path, steps, record)
    odd = lines.filter(F.col(f"page.{BAD}").isNotNull() | _typed(steps).isNull() | F.exists(_typed(steps), lambda r: r.isNull()))
    odd = odd.select("file", "value", F.try_parse_json("value").isNull().alias("broken"), _entries(steps).alias("e"))
    whole = odd.filter("broken or e is null").select(
        "file", F.when(F.col("broken"), "not_json").otherwise("no_records").alias("reason"), F.col("value").alias("raw"))
    each = odd.filter("not broken").select("file", F.explode("e").alias("e")).select(
        "file", F.coalesce(F.to_json("e"), F.lit("null")).alias("raw"), _is_object(F.col("e")).alias("object"))
    read = F.from_json("raw", f"{record}, {BAD} string", KEEP_BAD)[BAD]
    part = each.withColumn("reason", F.when(~F.col("object"), "not_an_object").when(read.isNotNull(), "mistyped"))
    faults = whole.unionByName(part.filter("reason is not null").select("file", "reason", "raw"))
    return faults.select(F.lit(source).alias("source"), "file", "reason", "raw")


def line_faults(spark: SparkSession, path: str, record: str, source: str) -> DataFrame:
    """The same for files with one record a line, which the JSON reader keeps as far as their fields fit."""
    lines = spark.read.text(path).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"))
    odd = lines.filter(F.trim("raw") != "").filter(
        F.from_json("raw", f"{record}, {BAD} string", KEEP_BAD)[BAD].isNotNull())
    entry = F.try_parse_json("raw")
    reason = F.when(entry.isNull(), "not_json").when(_is_object(entry), "mistyped").otherwise("not_an_object")
    return odd.select(F.lit(source).alias("source"), "file", reason.alias("reason"), "raw")


def xml_faults(spark: SparkSession, path: str, tags: dict[str, str], source: str) -> DataFrame:
    """Files below ``path`` with broken entries of one of ``tags`` (row tag to schema), each once."""
    found = None
    for tag, schema in tags.items():
        rows = spark.read.format("xml").option("rowTag", tag).option("columnNameOfCorruptRecord", BAD).schema(
            f"{schema}, {BAD} string").load(path)
        rows = rows.filter(F.col(BAD).isNotNull() & F.col("title").isNull()).select(
            F.col("_metadata.file_path").alias("file"), F.col(BAD).alias("raw"))
        found = rows if found is None else found.unionByName(rows)
    return found.groupBy("file").agg(F.max("raw").alias("raw")).select(
        F.lit(source).alias("source"), "file", F.lit("broken_xml").alias("reason"), "raw")
