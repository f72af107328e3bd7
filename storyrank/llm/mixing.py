"""Mixing sources to target weights by Poisson replication, in the JVM alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyrank.llm.text import whole
from storyrank.session import stage

TEMPERATURE = 0.5
SEED = "mix-1"
BROADCAST_SOURCES = 5_000  # beyond that the join is left to Spark, which splits a hot source
SPREAD = 10  # the table of the distribution ends so many deviations above its mean


def unit(*parts: Column) -> Column:
    """A number in [0, 1) hashed from the parts: the first 48 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def poisson_cdf(mean: Column) -> Column:
    """``array<double>``: the distribution's values at 0, 1, ... until its tail is below a
    double's precision; the sums run over logarithms, so a large mean does not underflow."""
    top = F.ceil(mean + SPREAD * F.sqrt(mean) + 20).cast("int")
    start = F.struct((-mean).alias("log"), F.exp(-mean).alias("sum"), F.array(F.exp(-mean)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        log = acc["log"] + F.log(mean) - F.log(k.cast("double"))
        total = acc["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(acc["all"], F.array(total)).alias("all"))

    return F.when(mean > 0, F.aggregate(F.sequence(F.lit(1), top), start, step, lambda a: a["all"])).otherwise(
        F.array(F.lit(1.0)))


def source_rates(docs: DataFrame, weights: DataFrame | None = None, temperature: float = TEMPERATURE,
                 epochs: float = 1.0, source_col: str = "source") -> DataFrame:
    """``(source, rate)``: mean copies of a document of each source.

    ``weights`` (source, weight) names target shares, a source without one gets none;
    without it a source's share goes as its count to the power ``temperature``. The
    expected size of the mix is ``epochs`` times that of ``docs``.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        shares = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        w = weights.groupBy("source").agg(F.sum("weight").alias("w")).withColumnRenamed("source", "__s")
        shares = counts.join(w, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s").withColumn(
            "w", F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(0.0)))
    total = shares.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    return shares.join(total, F.lit(True), "left").select(
        "source", F.when(F.col("all_w") > 0, epochs * F.col("all_n") * F.col("w") / F.col("all_w") / F.col("n"))
        .otherwise(F.lit(0.0)).alias("rate"))


def poisson_mix(docs: DataFrame, weights: DataFrame | None = None, temperature: float = TEMPERATURE,
                epochs: float = 1.0, seed: str = SEED, id_col: str = "doc_id",
                source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Every document as often as a Poisson draw of its source's rate says, in global disorder.

    The draw inverts the distribution at a number hashed from the seed and the id, or for a row without
    id the digest of its text, so a rerun gives the same mix and repeated rows get the same
    count each. ``copy`` counts a document's copies from 1 (a column of that name is replaced). Rows are dealt to partitions
    by the hash of id, text and copy and sorted by it inside: that is the shuffled order, and
    no source or id weighs on one partition. A null source is a source of its own, a null
    text counts as empty. Rates ride along as one row for each source.
    """
    rates = source_rates(docs, weights, temperature, epochs, source_col)
    table = rates.select(F.col("source").alias("__source"), F.col("rate").alias("__rate"),
                         poisson_cdf(F.col("rate")).alias("__cdf"))
    table = stage(table)
    if table.count() <= BROADCAST_SOURCES:  # a row is one number and a short table: a few MB at most
        table = F.broadcast(table)
    drawn = docs.drop("copy").join(table, F.col(source_col).eqNullSafe(F.col("__source")))
    u = unit(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("#"), F.md5(whole(text_col)))))
    count = F.size(F.filter("__cdf", lambda c: c <= F.col("__u")))
    laid = (
        drawn.withColumn("__u", u).withColumn("__n", count).filter("__n > 0")
        .drop("__cdf", "__source", "__u", "__rate")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n").cast("long"))))
        .withColumn("__key", F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col), F.col("copy")))
    )
    mixed = laid.repartition(F.col("__key")).sortWithinPartitions("__key")
    return mixed.drop("__n", "__key")


ORACLE = f"""
with c as (select source, count(*) as n from documents group by source),
s as (select source, n, pow(n::double, {TEMPERATURE}) as w from c),
r as (select source, sum(n) over () * w / sum(w) over () / n as rate from s),
k as (
  select source, rate, i, exp(-rate + i * ln(rate) - lgamma(i + 1)) as p
  from r, unnest(range(0, ceil(rate + {SPREAD} * sqrt(rate) + 20)::bigint + 1)) as t(i)),
f as (select source, rate, i, sum(p) over (partition by source order by i) as cdf from k),
d as (
  select row_number() over () as r, doc_id, source, text,
    ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::varchar, '#' || md5(coalesce(text, '')))), 1, 12))::bigint / 281474976710656.0 as u
  from documents),
n as (
  select r, count(*) filter (where f.cdf <= d.u) as copies
  from d join f on d.source is not distinct from f.source group by r)
select doc_id, source, text, copy from n join d using (r), unnest(range(1, copies + 1)) as t(copy)
"""
