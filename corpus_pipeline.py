"""A training-corpus pipeline over ``documents``.

Every stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as the
next stage's ``docs``. All but the last return the columns of ``documents``.

1. quality: rows that the rule ensemble scores under 0.7 go.
2. near_dedup: of texts whose five-word shingles are alike to 0.8 or more, one row stays.
3. decontaminate: rows that contain 0.8 or more of a benchmark item's shingles go.
4. secrets: reported secrets are masked in the text; no row goes.
5. tokens: each text's SentencePiece ids.

Nulls, empty texts, repeated rows, empty tables and further columns are treated as each operator's
module says; further columns pass through the first four stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.common import shared_dir
from quillspark.llm.decontaminate import decontaminate
from quillspark.llm.pieces import encode_pieces
from quillspark.llm.quality import keep_quality
from quillspark.llm.secrets import redact_secrets
from quillspark.llm.simhash import keep_one


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_pieces(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("secrets", secrets_stage),
    ("tokens", tokens_stage),
]

#: The learned quality model and the similarity search have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
