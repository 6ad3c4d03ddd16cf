"""The corpus pipeline: each stage takes what its predecessor kept.

Quality rules drop documents, the Jaccard join keeps one document of each class, substring
deduplication takes repeated passages out of the texts, mixing repeats documents (or leaves them
out) to meet the sources' targets, and BPE encoding gives the tokens.  All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loglathe.llm import bpe, jaccard, mixing, quality, substring
from loglathe.llm.common import read_table, stored

STAGES = [
    ("quality rules", quality.stage),
    ("n-gram Jaccard join", jaccard.stage),
    ("substring dedup", substring.stage),
    ("mixing sources to target weights", mixing.stage),
    ("BPE encoding and decoding", bpe.stage),
]

#: SQL cannot express the last stage; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
