"""The corpus pipeline: quality rules, near copies, mixing by source, token pieces.

Each stage takes (spark, docs, sf_dir) and its result is written as Parquet and read again as the next stage's
documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meshweave.llm.jaccard import dedup_stage
from meshweave.llm.mixing import mixing_stage
from meshweave.llm.pieces import pieces_stage
from meshweave.llm.quality import quality_stage
from meshweave.plans.lineage import materialize

STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", dedup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding", pieces_stage),
]

#: The last stage is not SQL-expressible; the whole is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0])
    return docs
