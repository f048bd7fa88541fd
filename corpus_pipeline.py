"""The training-data pipeline over ``documents``; each stage calls one operator
of ``ledgerline.llm``.

1. quality rules: documents that the rules reject go;
2. SimHash near-dedup: one document of each group stays;
3. benchmark decontamination: benchmark passages are cut out of the texts;
4. mixing: the documents are written in the order of the mix;
5. token ids: the texts are written as token files in that order, and the
   digest of every document is read back from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import decontaminate, mixing, quality, simhash, token_files
from ledgerline.llm.common import documents, stash

ORACLE_SQL = None  # fingerprints, schedules and token files have no SQL form; tests hold it against brute force


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, documents(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, shingle=3, max_distance=3)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contamination(docs, documents(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows come in the order in which the mix was written: by the number
    of the part file, then by the row's place in it."""
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1)
    return token_files.query(docs, order=[F.lpad(part, 10, "0"), F.col("_metadata.file_name"), F.col("_metadata.row_index")])


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
    ("token-ID / binary output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, f"stage{k + 1}")
    return docs
