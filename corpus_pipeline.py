"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns documents; the last returns the
pieces of packed sequences. A stage works on all that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import stages
from quarry.llm.key_counts import Scratch

STAGES = [
    ("quality_rules", stages.quality),
    ("ngram_jaccard", stages.near_duplicates),
    ("decontamination", stages.contaminated),
    ("secret_scans", stages.secrets),
    ("packing", stages.packing),
]

#: Neither fertility, nor the forest, nor packing can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each keeps is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: Scratch | None = None
    for _, stage in STAGES[:-1]:
        kept = Scratch(stage(spark, docs, sf_dir))
        if before:
            before.drop()
        before, docs = kept, kept.df
    return STAGES[-1][1](spark, docs, sf_dir)
