"""Coverage, gates, grades and run audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from storyrank import constants as K
from storyrank.functions.text import _c
from storyrank.operators.filters import quiet_gate
from storyrank.operators.grouping import top_n


def coverage(
    stories: DataFrame, published: DataFrame, k: int = K.COVERAGE_TOP_K,
    keys: list[str] = ("day",), spine: DataFrame | None = None,
) -> DataFrame:
    """Per day: share of the top ``k`` stories that was published, how many were looked at,
    and the titles left out in rank order. A day of ``spine`` without stories is covered."""
    keys = list(keys)
    title = "title" if "title" in stories.columns else "id"
    ranked = top_n(stories, keys, [F.desc("final_rank"), F.asc("id")], k)
    hits = published.select(*keys, "id", F.lit(True).alias("__hit")).distinct()
    flagged = ranked.join(hits, [*keys, "id"], "left").withColumn("__hit", F.coalesce("__hit", F.lit(False)))
    left_out = F.collect_list(F.when(~F.col("__hit"), F.struct("pos", F.col(title).alias("t"))))
    out = flagged.groupBy(*keys).agg(
        F.round(F.avg(F.col("__hit").cast("double")), 3).alias("coverage"),
        F.count("*").alias("top_k"),
        F.transform(F.array_sort(left_out), lambda e: e["t"]).alias("uncovered_titles"),
    )
    if spine is None:
        return out
    return spine.join(out, keys, "left").select(
        *keys, F.coalesce("coverage", F.lit(1.0)).alias("coverage"),
        F.coalesce("top_k", F.lit(0)).alias("top_k"),
        F.coalesce("uncovered_titles", F.array().cast("array<string>")).alias("uncovered_titles"),
    )


def _messages(*pairs: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), m) for c, m in pairs]))


def recall_gate(
    coverage_col, top_k, missed_titles, quiet_expected, floor: float = K.COVERAGE_FLOOR
) -> Column:
    """Failure messages of a coverage check; none on an expected quiet day."""
    cov, missed = _c(coverage_col), _c(missed_titles)
    low = F.concat(F.lit("top-"), _c(top_k).cast("string"), F.lit(" coverage "), cov.cast("string"),
                   F.lit(f" < floor {floor}"))
    lost = F.concat(F.size(missed).cast("string"), F.lit(" important story(ies) dropped: "),
                    F.array_join(missed, ", "))
    found = _messages((cov < floor, low), (F.size(missed) > 0, lost))
    return F.when(_c(quiet_expected), F.array().cast("array<string>")).otherwise(found)


def golden_gate(
    quiet_expected, quiet_day, quiet_ok, notes, has_breakthrough, total, min_total: float | None = None
) -> Column:
    """Failure messages of one labelled set."""
    expected, quiet = _c(quiet_expected), F.coalesce(_c(quiet_day), F.lit(False))
    on_quiet = _messages(
        (~quiet, F.lit("quiet day expected but the digest is not marked quiet")),
        (~F.coalesce(_c(quiet_ok), F.lit(False)),
         F.concat(F.lit("quiet-day honesty gate failed ("), _c(notes), F.lit(")"))),
    )
    checks = [
        (quiet, F.lit("busy day expected but the digest is marked quiet")),
        (~_c(has_breakthrough), F.lit("busy day expected a BREAKTHROUGH but none surfaced")),
    ]
    if min_total is not None:
        checks.append((_c(total) < min_total, F.concat(
            F.lit("editorial total "), _c(total).cast("string"), F.lit(f" < floor {min_total}"))))
    return F.when(expected, on_quiet).otherwise(_messages(*checks))


def grade(df: DataFrame, total: Column, markdown: str = "md", quiet_expected: str = "quiet_expected") -> DataFrame:
    """Adds total, quiet_ok and notes: a report that breaks the honesty gate is capped."""
    cap = K.QUIET_VIOLATION_CAP
    out = df.withColumn("__gate", quiet_gate(markdown, quiet_expected)).withColumn("__total", total)
    capped = ~F.col("__gate.quiet_ok") & (F.col("__total") > cap)
    return out.select(
        *df.columns,
        F.round(F.when(capped, F.lit(cap)).otherwise(F.col("__total")), 4).alias("total"),
        F.col("__gate.quiet_ok").alias("quiet_ok"),
        F.when(capped, F.concat("__gate.note", F.lit(f"; total capped at {cap} per quiet-day honesty gate")))
        .otherwise(F.col("__gate.note")).alias("notes"),
    )


def pick_winner(
    scores: DataFrame, keys: list[str], criteria: list[str] = tuple(K.RUBRIC_WEIGHTS), given: DataFrame | None = None
) -> DataFrame:
    """Winner per key of the draft scores (keys, idx, criteria): the highest sum, of equals
    the lowest index. A winner named in ``given`` (keys, winner) counts if it is in range.
    Returns the winner with its own score row."""
    total = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in criteria), F.lit(0.0))
    best = scores.groupBy(*keys).agg(
        F.min_by("idx", F.struct(-total, "idx")).alias("winner"), F.max("idx").alias("__last"))
    if given is not None:
        named = given.select(*keys, F.col("winner").alias("__named"))
        best = best.join(named, keys, "left").withColumn(
            "winner",
            F.when(F.col("__named").between(0, F.col("__last")), F.col("__named")).otherwise(F.col("winner")))
    rows = scores.select(*keys, F.col("idx").alias("winner"), *criteria)
    return best.select(*keys, "winner").join(rows, [*keys, "winner"])


class RunAudit:
    """Row counts per stage, gathered while the plan runs: no extra pass over the data."""

    def __init__(self) -> None:
        self._stages: list[tuple[str, Observation]] = []

    def watch(self, df: DataFrame, stage: str, **metrics: Column) -> DataFrame:
        seen = Observation(stage)
        self._stages.append((stage, seen))
        extra = [c.alias(n) for n, c in metrics.items()]
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *extra)

    def table(self, spark: SparkSession) -> DataFrame:
        """(ord, stage, rows_in, kept, dropped), after an action has run the watched plan."""
        rows, before = [], None
        for i, (stage, seen) in enumerate(self._stages):
            kept = seen.get["rows"]
            rows.append((i, stage, kept if before is None else before, kept, 0 if before is None else before - kept))
            before = kept
        return spark.createDataFrame(rows, "ord int, stage string, rows_in long, kept long, dropped long")
