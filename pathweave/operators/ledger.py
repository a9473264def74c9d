"""Run ledger on plain files (L1-L7): insert-or-ignore, upsert and updates as set operations.

There is no in-place update: new rows and updates are appended, and the
current state is a latest-per-key reduction done with ``max_by`` (one kept
value per key, partial aggregation, so a hot key never lands whole in one
task).  ``compact`` writes the reduced state back out, which also cuts the
lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .manifest import OUTCOME_COLUMNS


def latest_per_key(df: DataFrame, key: list[str], *order_cols: str) -> DataFrame:
    """The row with the greatest ``order_cols`` per key (full ties: any one of them)."""
    cols = [c for c in df.columns if c not in key]
    g = df.groupBy(*key).agg(F.max_by(F.struct(*cols), F.struct(*order_cols)).alias("_r"))
    return g.select(*key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "scenario_id") -> DataFrame:
    """L1: on key conflict the incoming row replaces every column."""
    old = existing.withColumn("_v", F.lit(0))
    new = incoming.select(*existing.columns).withColumn("_v", F.lit(1))
    return latest_per_key(old.unionByName(new), [key], "_v").drop("_v")


def first_per_key(df: DataFrame, key: str, ordinal: str | None = None) -> DataFrame:
    """The first row of each key: the one with the least ``ordinal`` (a batch position, dropped).

    Without an ordinal, rows of a key count as equal and their position in the
    plan decides; a batch whose repeats conflict needs the ordinal.
    """
    if ordinal is None:
        ordinal, df = "_at", df.withColumn("_at", F.monotonically_increasing_id())
    cols = [c for c in df.columns if c not in (key, ordinal)]
    return (df.groupBy(key).agg(F.min_by(F.struct(*cols), F.col(ordinal)).alias("_r"))
            .select(*[F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in df.columns if c != ordinal]))


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, key: str, ordinal: str | None = None, within: list[str] | None = None) -> DataFrame:
    """L2/L3: rows of ``incoming`` whose key is new (first row per key within the batch, by ``ordinal``).

    Returns only the rows to append; the caller appends them to the table.  ``within`` may
    name columns that the key determines (a run's scenario), by which both tables are
    partitioned alike; then the two meet in one aggregation and no row is shuffled.
    """
    if within:
        at = ordinal or "_at"
        cols = [c for c in existing.columns if c not in (key, *within)]
        batch = incoming.select(*existing.columns, *([ordinal] if ordinal else []), F.lit(False).alias("_old"))
        batch = batch if ordinal else batch.withColumn(at, F.monotonically_increasing_id())
        old = existing.filter(F.col(key).isNotNull()).withColumn("_old", F.lit(True)).withColumn(at, F.lit(None).cast(batch.schema[at].dataType))
        g = batch.unionByName(old).groupBy(*within, key).agg(F.max("_old").alias("_old"), F.min_by(F.struct(*cols, F.lit(1).alias("_one")), F.col(at)).alias("_r"))
        return g.filter(~F.col("_old")).select(*[F.col(f"_r.{c}").alias(c) if c in cols else F.col(c) for c in existing.columns])
    batch = incoming.select(*existing.columns, *([ordinal] if ordinal else []))
    return first_per_key(batch, key, ordinal).join(existing.select(key), key, "left_anti").select(*existing.columns)


def current_state(manifest: DataFrame, updates: DataFrame, ts_col: str = "ts", tie_col: str | None = None) -> DataFrame:
    """L4: manifest with its latest update applied.

    An update replaces status and *all* outcome columns (a field that is unset, or
    whose column the updates don't have, becomes NULL) and stamps its time; of updates
    with one time the greatest ``tie_col`` counts; runs without updates keep
    their manifest row.
    """
    kinds = {**{f.name: f.dataType for f in manifest.schema}, **{f.name: f.dataType for f in updates.schema}}
    outcome_cols = [c for c in OUTCOME_COLUMNS if c != "timestamp" and c in kinds]
    payload = F.struct(F.col("status").alias("status"),
                       *[(F.col(c) if c in updates.columns else F.lit(None).cast(kinds[c])).alias(c) for c in outcome_cols],
                       F.col(ts_col).alias("timestamp"))
    order = F.struct(*[c for c in (ts_col, tie_col) if c])
    last = updates.groupBy("run_id").agg(F.max_by(payload, order).alias("_u"))
    j = manifest.join(last, "run_id", "left")
    out = j.withColumn("status", F.coalesce(F.col("_u.status"), F.col("status")))
    for c in outcome_cols + ["timestamp"]:
        if c in manifest.columns:
            out = out.withColumn(c, F.when(F.col("_u").isNotNull(), F.col(f"_u.{c}")).otherwise(F.col(c)))
        else:
            out = out.withColumn(c, F.col(f"_u.{c}"))
    return out.drop("_u")


def count_by_status(runs: DataFrame, status_col: str = "status") -> DataFrame:
    """L5."""
    return runs.groupBy(status_col).agg(F.count(F.lit(1)).alias("n"))


def status_share(runs: DataFrame, status_col: str = "status") -> DataFrame:
    """``100 * n / total`` per status (the window runs over the few status rows only)."""
    c = count_by_status(runs, status_col)
    return c.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def all_runs_ordered(runs: DataFrame, key: str = "run_id") -> DataFrame:
    """Every run, sorted by id (range-partitioned distributed sort)."""
    return runs.orderBy(key)


def compact(df: DataFrame, path: str) -> DataFrame:
    """Write the reduced state as Parquet and read it back (new lineage root)."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
