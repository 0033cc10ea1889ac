"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, personal data, pieces.

Each stage takes all documents that its predecessor kept. Toxicity rejects documents, near-dedup keeps one
document of each group, decontamination rejects documents with benchmark windows, the personal-data stage
masks what it finds in the texts, and the last stage encodes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reclink.llm.common import stored, table
from reclink.llm.decontaminate import decontamination_stage
from reclink.llm.near_dedup import near_dedup_stage
from reclink.llm.pieces import pieces_stage
from reclink.llm.pii import pii_stage
from reclink.llm.toxicity import clean_stage

STAGES = [
    ("toxicity", clean_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("pieces", pieces_stage),
]

#: Training a chain and sampling segmentations are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
