"""Plug-in surface: SQL functions, vector aggregates, exploders, plug-in sources and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyrank import fixtures as fx
from storyrank.catalog import q_text
from storyrank.catalog.q_text import sq_squeeze, sq_strip
from storyrank.catalog.registry import query, with_views
from storyrank.functions import registry as R
from storyrank.functions import text as X
from storyrank.functions import vectors as V


@query("UDF-01", """
select 'page-' || cast(page_id as varchar) as title, url from pages where page_id % 4 <> 0""")
def udf_01(spark, d):
    from storyrank.session import scratch
    from storyrank.sources.plugin import register_source

    n = F.col("page_id")
    title = F.when(n % 4 != 0, F.concat(F.lit("page-"), n.cast("string"))).otherwise(F.lit(" "))
    path = scratch(spark, "plugin")
    fx.table(spark, d, "pages").select(
        title.alias("title"), "url", F.col("html").alias("body"),
        F.lit("2024-01-05T00:00:00Z").alias("published_at")).write.json(path)
    register_source(spark)
    out = (spark.read.format("landed_items").option("reader", "json_lines").option("source", "plug")
           .option("family", "meta").load(path))
    return out.select("title", "url")


@query("UDF-02", """
select 'item-' || cast(doc_id as varchar) as id, 64::integer as dim, 1.0::double as norm from documents""")
def udf_02(spark, d):
    from storyrank.operators.inference import HashEmbedder, embed_missing

    docs = fx.items(spark, d).select("id", "title", "raw_text", "embedding")
    out = embed_missing(docs, HashEmbedder(64))
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return out.select("id", F.size("embedding").alias("dim"), F.round(F.sqrt(norm), 3).alias("norm"))


@query("UDF-03", """
with s as (select doc_id, regexp_extract_all(text, '\\S+') as words from documents)
select cast(doc_id as varchar) as prompt_id, coalesce(words[1], '') as takeaway,
  coalesce((len(list_distinct(words)) * 1000 // nullif(len(words), 0)) / 1000.0, 0.0)::double as score from s""")
def udf_03(spark, d):
    from storyrank.operators.inference import EchoModel, infer

    prompts = fx.table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("prompt_id"), F.col("text").alias("prompt"))
    out = infer(prompts, EchoModel({"takeaway": "string", "score": "number"}))
    obj = X.parse_json_obj("response")
    return out.select("prompt_id", F.try_variant_get(obj, "$.takeaway", "string").alias("takeaway"),
                      F.try_variant_get(obj, "$.score", "double").alias("score"))


@query("UDF-04", with_views(f"""
select i.id, sha256(coalesce(lower(nullif({sq_strip('url')}, '')), lower({sq_squeeze('title')}))) as hash, round(engagement, 6) as engagement,
  round(citation, 6) as velocity, authority, round(pow(0.5, epoch(timestamp '2024-01-31 00:00:00' - published_at) / 86400.0 / 14.0), 6) as decay
from item_signals i""", "item_signals"))
def udf_04(spark, d):
    R.register(spark)
    fx.items(spark, d).createOrReplaceTempView("sr_items")
    return spark.sql(f"""
        SELECT id, sr_content_hash(url, title) AS hash,
          round(sr_engagement(metrics), 6) AS engagement,
          round(sr_citation_velocity(metrics, published_at, TIMESTAMP '{fx.AS_OF}'), 6) AS velocity,
          sr_authority(family, source) AS authority,
          round(sr_decay(published_at, TIMESTAMP '{fx.AS_OF}', 14D), 6) AS decay
        FROM sr_items""")


@query("UDF-05", """
with v as (select label, i, embedding[i]::double as x, vec_id from embeddings, range(1, 65) t(i)),
m as (select label, i, avg(x) as a, sum(x * (1 + vec_id % 3)) as s from v group by 1, 2),
n as (select label, sqrt(sum(a * a)) as norm from m group by 1)
select label, i::integer as pos, round(a / norm, 6) as centroid, round(s, 5) as wsum from m join n using (label)""")
def udf_05(spark, d):
    vec = fx.table(spark, d, "embeddings")
    mean = V.centroid(vec, ["label"], "embedding").select(
        "label", F.posexplode("centroid").alias("p", "c")).select("label", (F.col("p") + 1).alias("pos"), "c")
    total = V.vector_sums(vec, ["label"], "embedding", 1 + F.col("vec_id") % 3).select(
        "label", F.posexplode("total").alias("p", "s")).select("label", (F.col("p") + 1).alias("pos"), "s")
    return mean.join(total, ["label", "pos"]).select(
        "label", "pos", F.round("c", 6).alias("centroid"), F.round("s", 5).alias("wsum"))


@query("UDF-06", with_views(f"""
with s as (select doc_id, ground, {q_text.sq_sents('text')} as sents from grounding_pairs),
e as (select doc_id, ground, unnest(sents) as sentence, generate_subscripts(sents, 1) - 1 as pos from s)
select doc_id, pos::integer as pos, sentence, array_to_string({q_text.sq_nums('sentence')}, '|') as nums,
  len({q_text.sq_bad('sentence', 'ground')}) = 0 as grounded from e""", "grounding_pairs"))
def udf_06(spark, d):
    from storyrank.operators.inference import sentence_rows

    rows = sentence_rows(fx.grounding_pairs(spark, d), "text", "ground")
    return rows.select("doc_id", "pos", "sentence", F.array_join("sig_numbers", "|").alias("nums"), "grounded")
