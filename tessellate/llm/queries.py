"""Queries of the operators over the whole tables of a data folder, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_scan import license_scan
from .media import media_table
from .mixing import mixed
from .packing import packed_documents
from .quality import quality_rules
from .shared import documents
from .simhash import simhash_components
from .suffix_dedup import dedup_suffixes
from .token_counts import token_counts
from .token_output import token_output
from .toxicity import held_out, learn, toxicity


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # repeats of 400 bytes; passages of little over fifty words are shorter, so the text goes by 250
    out = dedup_suffixes(documents(spark, sf_dir), min_len=400, passage_len=250)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "passage_bytes", "passage_spans", "text")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), limit=512)


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), end_id=2)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir), width=3, radius=2)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = toxicity(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media_table(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir)).drop("blocks")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_suffix_dedup, op2_packing, op3_token_counts, op4_token_output, op5_simhash, op6_toxicity, op7_media, op8_mixing, op9_quality, op10_license_scan)
}

MIXING_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, source, md5(t) AS digest, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS size, length(t) AS n FROM d),
i AS (SELECT *, (CASE WHEN size >= 50 THEN 1.0::DOUBLE ELSE 0.5 END) * (CASE WHEN n / greatest(size, 1) BETWEEN 4 AND 11 THEN 1.0 ELSE 0.5 END) AS w,
  (CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || digest), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM b),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM i GROUP BY source),
c AS (SELECT *, 3.0::DOUBLE * source_size AS cap, sum(source_size) OVER ()::DOUBLE AS every, sum(weight) OVER () AS total FROM s),
f AS (SELECT *, (every - coalesce(sum(cap) OVER o, 0)) / (total - coalesce(sum(weight) OVER o, 0)) >= cap / weight AS capped FROM c
  WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE weight * ((every - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ()) END AS target FROM f),
k AS (SELECT i.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS epochs,
  row_number() OVER (PARTITION BY i.source, i.doc_id, i.digest) AS copy, coalesce(sum(size) OVER p, 0) AS before FROM i JOIN g ON i.source IS NOT DISTINCT FROM g.source
  WINDOW p AS (PARTITION BY i.source ORDER BY -ln(u) / w, doc_id NULLS FIRST, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * (epochs + CASE WHEN size > 0 AND floor((target - epochs * source_size - before) / size + 0.5) >= 1 THEN 1 ELSE 0 END))::BIGINT AS taken FROM k
"""

ORACLE: dict[str, str] = {"op8_mixing": MIXING_SQL}
