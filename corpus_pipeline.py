"""From raw documents to packed training sequences.

Each stage reads what its predecessor kept and returns documents with the same columns, the
last one packed pieces. Rows with a NULL id are kept as one document after all others; a NULL
text is an empty one from the third stage on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stallwise.llm.common import cut
from stallwise.llm.decontaminate import decontaminated
from stallwise.llm.oddsketch import without_near_duplicates
from stallwise.llm.packing import pack
from stallwise.llm.suffixes import dedup_passages
from stallwise.llm.toxicity import without_toxic


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model finds toxic go; it learns from a bounded sample of ``labels``."""
    return without_toxic(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the smallest id stays."""
    return without_near_duplicates(docs, k=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more are cut but for their first copy; ``n_chars`` follows the text."""
    done = dedup_passages(docs, length=50)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of ``benchmark`` go."""
    return decontaminated(docs, _table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens in which each source has its share of the corpus."""
    return pack(docs, length=2048)


STAGES = [
    ("toxicity", toxicity),
    ("minhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", benchmarks),
    ("packing", packing),
]

# Trained models, hash sketches and tokenizers are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
