"""A corpus pipeline over documents: quality, line dedup, near-dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last keep the columns of docs. Extra columns pass through; null texts count as
empty; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import bpe, decontam, linedup, neardup, quality, tables
from lamina.llm.queries import labels, public_file


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier does not reject (score 0.3 or more)."""
    model = quality.train(docs, labels(spark, sf_dir))
    return quality.accepted(docs, model, cut=0.3)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier line resembles; documents of which nothing is left go."""
    had = "had"
    while had in map(str.lower, docs.columns):
        had += "_"
    out = linedup.deduplicate(docs.withColumn(had, F.col("text").isNotNull() & (F.trim("text") != "")))
    return out.filter(~F.col(had) | (F.trim("text") != "")).drop(had)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the smallest doc_id."""
    return neardup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less than a twentieth of whose words are in benchmark windows."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them."""
    return bpe.encode_decode(docs, public_file("byte_bpe_50k.json")).drop("same")


STAGES = [("quality", quality_filter), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("bpe", tokens)]

#: No SQL can express the classifier or BPE; the pipeline is tested against its parts' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = tables.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
