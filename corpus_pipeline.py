"""The corpus pipeline: each stage works on all documents its predecessor kept, written as Parquet in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridtide.llm import op1_tree_bpe, op3_bm25_decontamination, op4_line_spread, op5_toxic_spans, op10_token_groups
from gridtide.session import working_dir

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("toxicity", op5_toxic_spans.stage),
    ("line dedup", op4_line_spread.stage),
    ("n-gram Jaccard join", op10_token_groups.stage),
    ("benchmark decontamination", op3_bm25_decontamination.stage),
    ("BPE encoding", op1_tree_bpe.stage),
]

#: A trained tagger and a tokenizer take part, so SQL cannot express it; tests/llm holds it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = working_dir(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
