"""A training-data pipeline: quality rules, near-duplicates, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and gives a table; ``run`` writes every
stage's table to the shared folder and gives the next stage what it reads back.
All but the last stage return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lakesight.llm import decontamination, mixing, near_duplicates, quality_rules, token_output
from lakesight.llm.queries import TOKENIZER
from lakesight.session import materialise, scratch_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with their whole texts; shared lines only count against their documents.

    Null and empty texts are rejected as too short; repeated rows are judged alike; empty tables stay empty.
    """
    return quality_rules.kept(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id; rows without an id only if their whole group has none.

    Null and empty texts are one group; of repeated rows one stays; columns may have any names.
    """
    return near_duplicates.one_of_each_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark passage contaminates; null and empty texts stay, repeated rows are judged alike."""
    found = decontamination.find_benchmark_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("NOT contaminated").select(*[f"`{c}`" for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as the mix begins it. The token stage orders them by id, so the mix's own order ends here.

    Texts without words are never begun and go; a null source is one of its own; repeated rows each take their part.
    """
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and a row per document read back from them.

    A null text has the end id alone; repeats of a document each have their ids; an empty mix has no rows.
    """
    files = scratch_folder(spark)
    token_output.write_tokens(docs, files, public_tokenizers.path(TOKENIZER))
    return token_output.read_documents(spark, files)


STAGES = [
    ("quality rules", quality_stage),
    ("SimHash near-duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
    ("token output", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs


# XXH64 fingerprints and the tokenizer are beyond SQL; tests/llm compares the stages with plain Python
ORACLE_SQL = None
