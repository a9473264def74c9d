"""Example pipeline over ``documents``: classify, deduplicate, decontaminate, pack.

``STAGES`` are (name, function) in order; a function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and read again as the next
one's docs.  Every stage works on all that its predecessor kept; all but the last
return the columns of ``documents``.

Defined cases are those of the operators: null and empty texts pass every filter
that doesn't judge them (the classifier scores a null text as an empty one), rows with a null id
are never near-duplicates, rows that repeat an id are judged by their own text, and extra
columns of any name are carried along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.llm.boosting import quality_filter
from pathweave.llm.decontamination import decontaminate
from pathweave.llm.minhash import drop_near_duplicates
from pathweave.llm.packing import pack
from pathweave.llm.substring_dedup import remove_repeats
from pathweave.session import table_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier predicts to be of low quality."""
    return quality_filter(docs, _table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates."""
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut 50-word passages that an earlier document has; ``n_chars`` follows the text."""
    cut = remove_repeats(docs)
    if "n_chars" in cut.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of the benchmark."""
    return decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into training sequences: one row for each piece."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: A trained classifier and a tokenizer are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared checkpoint folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    base = table_path(spark, f"pipeline/{uuid.uuid4().hex}")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{number}")
        docs = spark.read.parquet(f"{base}/{number}")
    return docs
