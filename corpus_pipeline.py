"""Training corpus in five stages: quality rules, line dedup, near-dedup, decontamination, tokenizing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. `run` writes every stage as
Parquet into the shared folder of the cluster and rereads it, so that a lost executor never costs an earlier stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrearium.llm import bpe, decontaminate, line_dedup, near_dedup, quality_rules
from arrearium.llm.common import shared_folder, small_batches, table
from arrearium.llm.queries import tokenizer


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table rejects go."""
    row = docs.select(F.struct("*").alias("__row"), "text", "lang")  # metrics can't take the place of own columns
    return quality_rules.quality_rules(row).filter("kept").select("__row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go, but for its first page with them; so do pages with nothing else."""
    row = docs.select(F.struct("*").alias("__row"), "doc_id", "source", "text")
    out = line_dedup.line_dedup(row).filter("not emptied")
    now = {"text": F.col("text"), "n_chars": F.length("text").cast("bigint")}
    return out.select(*[now.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the smallest doc_id stays."""
    small_batches(spark)
    return near_dedup.drop_near_copies(docs).select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    small_batches(spark)
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return decontaminate.decontaminate(docs, items).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it again."""
    small_batches(spark)
    return bpe.tokenize(docs, *tokenizer())


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("byte_level_bpe", token_stage),
]

#: Near-duplicate groups and byte-pair merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{out}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
