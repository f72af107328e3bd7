"""Line dedup: repeated windows of three consecutive lines, later occurrences removed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyrank.llm.text import whole


def remove_repeated_windows(docs: DataFrame, size: int = 3, id_col: str = "doc_id",
                            text_col: str = "text") -> DataFrame:
    """``docs`` with the lines of repeated windows removed, and ``n_lines``, ``n_removed``.

    A line ends at ``\\n`` and counts as it is. The first occurrence of a window is that of
    the smallest (id, position); every line that a later occurrence covers goes, so
    overlapping later occurrences are merged. Texts with fewer than ``size`` lines have no
    window. Null text stays null with 0 lines; rows without id are kept as they are and
    take no part. Repeated rows (same id, same text) count as one text and all stay.
    Windows are told apart by two 64-bit hashes.
    """
    text_hash = F.xxhash64(whole(F.col(text_col)))
    lines = F.split(F.col(text_col), "\n")
    rows = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("d"), text_hash.alias("t"), lines.alias("ls"))
    at = rows.filter(F.size("ls") >= size).select(
        "d", "t", "ls", F.explode(F.sequence(F.lit(0), F.size("ls") - size)).alias("i"))
    parts = [F.get("ls", F.col("i") + k) for k in range(size)]
    windows = at.select("d", "t", "i", F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(7), *parts).alias("b"))
    place = F.struct("d", "i", "t")
    first = windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(
        "first <> last").drop("last")
    later = windows.join(first, ["a", "b"]).filter(place > F.col("first"))
    covered = later.groupBy("d", "t").agg(F.collect_set("i").alias("__starts")).withColumnsRenamed(
        {"d": "__d", "t": "__t"})
    out = docs.withColumn("__hash", text_hash).join(
        covered, (F.col(id_col) == F.col("__d")) & (F.col("__hash") == F.col("__t")), "left")
    gone = F.array_distinct(F.flatten(F.transform("__starts", lambda s: F.sequence(s, s + size - 1))))
    out = out.withColumns({"__lines": lines, "__gone": F.when(F.col("__starts").isNotNull(), gone)})
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone")
    kept = F.concat_ws("\n", F.transform(left, lambda p: F.get("__lines", p)))
    return out.withColumns({
        text_col: F.when(F.col("__gone").isNotNull(), kept).otherwise(F.col(text_col)),
        "n_lines": F.when(F.col("__lines").isNull(), 0).otherwise(F.size("__lines")).cast("long"),
        "n_removed": F.coalesce(F.when(F.col("__gone").isNotNull(), F.size("__gone")), F.lit(0)).cast("long"),
    }).drop("__hash", "__d", "__t", "__starts", "__lines", "__gone")


ORACLE = """
with ls as (
  select doc_id, string_split(text, chr(10)) as lines from documents where doc_id is not null and text is not null),
win as (
  select doc_id, i, lines[i + 1] as x, lines[i + 2] as y, lines[i + 3] as z
  from ls, unnest(range(0, len(lines) - 2)) as u(i) where len(lines) >= 3),
later as (
  select doc_id, i from (
    select *, row_number() over (partition by x, y, z order by doc_id, i) as rn from win) where rn > 1),
gone as (
  select doc_id, list(distinct i + k) as g from later, unnest([0, 1, 2]) as u(k) group by doc_id),
kept as (
  select doc_id, string_agg(lines[p + 1], chr(10) order by p) as text
  from ls join gone using (doc_id), unnest(range(0, len(lines))) as u(p)
  where not list_contains(g, p) group by doc_id)
select d.doc_id,
  case when g.g is null then d.text else coalesce(k.text, '') end as text,
  coalesce(len(string_split(d.text, chr(10))), 0)::bigint as n_lines,
  coalesce(len(g.g), 0)::bigint as n_removed
from documents d left join gone g using (doc_id) left join kept k using (doc_id)
"""
