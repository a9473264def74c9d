"""Registries: one Spark builder and (where SQL can say it) one DuckDB oracle each.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs an operator over the whole
adapter views of the driver tables; ``ORACLES[name]`` is an independent SQL
statement over the raw tables that must return the same rows.  Doubles are
rounded to 6 digits on both sides and every column is aliased identically.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double (and float) column; leave the rest untouched."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
