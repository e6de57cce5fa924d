"""From raw documents to token ids: five stages, each a table for the next.

Stages reject rows by their place in the stage's table, so equal ids and rows without one are told apart.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from orbitframe.llm.decontaminate import drop_contaminated
from orbitframe.llm.ngram_jaccard import keep_one_of_each
from orbitframe.llm.pii import redact_stage
from orbitframe.llm.runtime import scratch
from orbitframe.llm.sentencepiece_lattice import encode_stage
from orbitframe.llm.toxicity import reject_toxic

STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("pii", redact_stage),
    ("sentencepiece", encode_stage),
]

#: Learnt scores, similarity classes and encodings have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over what the one before kept, each written as Parquet and read again."""
    folder = f"{scratch(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
