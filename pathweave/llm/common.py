"""Small helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts`` (null id: null)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only ``doc_id`` and ``text``, under those names; other columns can't clash with an operator's own."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def small_batches(df: DataFrame) -> DataFrame:
    """Have Spark send texts to Python workers 4 MB at a time: 10,000 rows of long texts would be many times that, on both sides."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return df


def give_back() -> None:
    """Return memory that a task no longer uses to the system: Python workers wait for their next task with all they ever held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # the C library may not have it
        trim(0)


def arrow_map(df: DataFrame, body: Callable, schema) -> DataFrame:
    """``mapInArrow`` where ``body`` takes one record batch and yields record batches."""
    def run(batches):
        for batch in batches:
            yield from body(batch)
        give_back()
    return small_batches(df).mapInArrow(run, schema)


def text_key(text: Column | str = "text") -> Column:
    """Fingerprint of the text, which with ``doc_id`` names a row when a table repeats ids."""
    return F.coalesce(F.xxhash64(text), F.lit(0))


def drop_tables(*frames: DataFrame) -> None:
    """Delete tables that ``cut_lineage`` wrote and that nothing lazy reads any more, on whatever store they are."""
    for df in frames:
        files = df.inputFiles()
        if files:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
