"""The corpus pipeline: its stages in order, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessellate.llm.mixing import mixed_documents
from tessellate.llm.near_dedup import without_near_copies
from tessellate.llm.packing import packed_documents
from tessellate.llm.queries import vocabulary
from tessellate.llm.shared import documents, written
from tessellate.llm.suffix_dedup import without_repeats
from tessellate.llm.toxicity import learn, without_toxic

#: Bytes of a repeated passage that goes: passages of over fifty words are longer, chance repeats shorter.
REPEAT_BYTES = 250


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the conditional random field rejects go."""
    return without_toxic(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words, similarity 0.8."""
    return without_near_copies(docs, width=5, similarity=0.8)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand elsewhere too leave the texts; documents stay."""
    return without_repeats(docs, min_len=REPEAT_BYTES)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights; a row stands as often as the mix takes it."""
    return mixed_documents(docs, weights=(1, 2, 3), limit=3)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All tokens of the mix in bins of several lengths."""
    return packed_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("near-copies", drop_near_copies), ("repeats", drop_repeats), ("mixing", mix), ("packing", pack)]
#: SQL can't express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


__all__ = ["STAGES", "ORACLE_SQL", "run"]
