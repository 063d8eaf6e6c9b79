"""A corpus pipeline: documents in a language, one of each group of near copies, free of benchmark
passages and personal data, encoded to tokens. Each stage is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelight.llm import bpe, decontaminate, language_id, near_duplicates, pii
from tidelight.llm.store import new_folder, table

STAGES = [
    ("language_id", language_id.stage),
    ("near_duplicates", near_duplicates.stage),
    ("decontaminate", decontaminate.stage),
    ("pii", pii.stage),
    ("byte_bpe", bpe.stage),
]

#: Language models, MinHash and BPE are not SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
