"""A training corpus from raw documents: quality, toxicity, near copies, benchmark leaks, then the mix of sources.

Each stage reads all that its predecessor wrote. All but the last return the columns of `documents`; the last adds how
many words of a document the mix takes. No stage is expressible in SQL as a whole (learned models, fingerprints, latent
vectors), so ORACLE_SQL is None and tests hold the stages against brute force.

Each row is judged as a row: null ids, repeated ids and repeated rows go through every stage. A null or empty text counts
as a text without words (one of all such rows stays in the near-dedup stage), other columns are kept as they are, and an
empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tellur.llm import decontaminate, mixing, quality, simhash, toxicity
from tellur.llm.common import read, shared_folder


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (operator 7)."""
    return quality.good(docs, read(spark, sf_dir, "labels"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic (operator 8)."""
    return toxicity.clean(docs, read(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more (operator 1)."""
    return simhash.one_of_each(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage (operator 10), each row judged by its own text."""
    return decontaminate.untouched(docs, read(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the words that the mix takes of each (operator 6)."""
    return mixing.mixed(docs)


STAGES = [("quality", good_quality), ("toxicity", not_toxic), ("near-dedup", without_copies), ("decontamination", without_leaks), ("mixing", source_mix)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet in the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{i}-{name}")
        docs = spark.read.parquet(path)
    return docs
