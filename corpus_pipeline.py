"""The corpus pipeline: quality, exact and near duplicates, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and is written as Parquet in the shared folder before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evispark.llm.bpe import bpe_stage
from evispark.llm.exact_dedup import exact_dedup_stage
from evispark.llm.mixing import mixing_stage
from evispark.llm.near_dedup import near_dedup_stage
from evispark.llm.quality import quality_stage
from evispark.llm.scratch import Scratch, written

STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("minhash near-dedup", near_dedup_stage),
    ("mixing to target weights", mixing_stage),
    ("byte-level bpe", bpe_stage),
]

#: A trained network, signatures and token ids are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; the tables between them are removed, the last one stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for name, stage in STAGES:
            made = stage(spark, docs, sf_dir)
            docs = written(made) if name == STAGES[-1][0] else scratch.table(made)
    return docs


QUERY = (run, ORACLE_SQL)
