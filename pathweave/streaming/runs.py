"""Structured Streaming over run-completion events (ST1-ST4).

The live side of an experiment — runs finishing one by one, updates arriving
twice, drift during the run window — as streaming jobs:

* ``idempotent_ingest``   ST1  watermark + ``dropDuplicatesWithinWatermark``
* ``live_status``         ST2  latest status per run: each micro-batch is reduced
                               and merged into a versioned ledger by ``foreachBatch``
* ``windowed_rates``      ST3  tumbling or sliding event-time windows
* ``provider_drift``      ST4  windowed counts per (provider, version)
* ``late_rows``                rows that come after their window is final, in a table of their own

ST3 and ST4 run in append mode: a window is written once, when the watermark has
passed its end, and leaves the state store; no batch touches earlier output.

``run_available_now`` drives a query to completion with
``trigger(availableNow=True)``; sinks and checkpoints live under the shared
``spark.checkpoint.dir``, so a restarted job resumes from its checkpoint and
micro-batches are written idempotently (overwrite per batch id).
"""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ledger import latest_per_key
from ..session import table_path


def file_stream(spark: SparkSession, directory: str, schema: T.StructType, glob: str = "*.parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet file stream (new files under ``directory`` matching ``glob``)."""
    r = spark.readStream.format("parquet").schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(directory)


def write_arrivals(df: DataFrame, arrival_col: str, directory: str, files: int = 1) -> None:
    """Write ``df`` as a feed: one folder of ``files`` files for each value of ``arrival_col``, in order, one after the other.

    A file stream takes files by age, so with ``max_files_per_trigger=files`` each
    arrival is a micro-batch.  ``arrival_col`` isn't written.
    """
    for r in df.select(arrival_col).distinct().orderBy(arrival_col).collect():  # one value a batch
        part = df.filter(F.col(arrival_col) == r[0]).drop(arrival_col)
        part.repartition(files).write.parquet(os.path.join(directory, f"arrival-{r[0]:09d}"))


def as_event_time(df: DataFrame, col: str = "ts") -> DataFrame:
    """Watermarks need ``timestamp`` (not ``timestamp_ntz``); the session zone is UTC."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


def idempotent_ingest(stream: DataFrame, key: str = "event_id", ts: str = "ts",
                      watermark: str = "40 days") -> DataFrame:
    """ST1: insert-or-ignore by id for a stream (duplicates within the watermark dropped)."""
    return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])


def latest_status(events: DataFrame, run_col: str = "run_id", ts: str = "ts",
                  payload: tuple[str, ...] = ("status",)) -> DataFrame:
    """ST2: per run, the payload of its latest event in a batch."""
    s = F.struct(*[F.col(c) for c in payload], F.col(ts).alias(ts))
    g = events.groupBy(run_col).agg(F.max_by(s, F.col(ts)).alias("_u"))
    return g.select(run_col, *[F.col(f"_u.{c}").alias(c) for c in payload], F.col(f"_u.{ts}").alias(ts))


def windowed_rates(stream: DataFrame, group_cols: list[str], value_col: str = "value", ts: str = "ts",
                   size: str = "1 day", slide: str | None = None, watermark: str = "40 days") -> DataFrame:
    """ST3: counts and mean value per event-time window (tumbling, or sliding with ``slide``)."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return (stream.withWatermark(ts, watermark).groupBy(w.alias("window"), *group_cols)
            .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(value_col).cast("double")).alias("mean_value")))


def provider_drift(stream: DataFrame, provider_col: str = "provider", version_col: str = "version",
                   ts: str = "ts", size: str = "1 day", watermark: str = "40 days") -> DataFrame:
    """ST4: calls per (window, provider, version) — the input for a pinning / drift check."""
    return (stream.withWatermark(ts, watermark)
            .groupBy(F.window(ts, size).alias("window"), provider_col, version_col)
            .agg(F.count(F.lit(1)).alias("n")))


def late_rows(stream: DataFrame, name: str, ts: str = "ts", size: str = "1 day", slide: str | None = None,
              watermark: str = "40 days", base: str | None = None) -> DataFrame:
    """Rows of a stream that ``windowed_rates`` with the same settings leaves out: (window, the row's columns).

    A batch's rows are late for a window that ends at or before the watermark of the batch
    before it: the greatest time seen up to two batches ago, less the delay.  That is the
    engine's own rule for dropping rows, so final windows, open windows and this table
    together hold every row.  Each batch leaves its greatest time (one row) and its late
    rows in folders of its own, so a replayed batch overwrites itself.
    """
    spark = stream.sparkSession
    root = base or table_path(spark, f"streams/{name}-{uuid.uuid4().hex[:12]}")
    tops, sink = os.path.join(root, "tops"), os.path.join(root, "late")
    window = F.window(ts, size, slide) if slide else F.window(ts, size)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.agg(F.max(ts).alias("top")).coalesce(1).write.mode("overwrite").parquet(os.path.join(tops, f"batch={batch_id}"))
        seen = spark.read.schema("top timestamp, batch long").parquet(tops).filter(F.col("batch") <= batch_id - 2)
        mark = seen.agg((F.max("top") - F.expr(f"INTERVAL '{watermark}'")).alias("mark")).first()["mark"]
        if mark is not None:
            (batch.select(window.alias("window"), *batch.columns).filter(F.col("window.end") <= F.lit(mark))
             .write.mode("overwrite").parquet(os.path.join(sink, f"batch={batch_id}")))

    q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", os.path.join(root, "_checkpoint"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    out = _table_if_any(spark, sink)
    if out is None:
        return _empty_like(spark, stream.select(window.alias("window"), *stream.columns))
    return out.drop("batch")


def _empty_like(spark: SparkSession, df: DataFrame) -> DataFrame:
    return spark.createDataFrame([], df.schema)


def _table_if_any(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame | None:
    """The table at ``path``, or None if nothing has been written there yet; any other failure is raised."""
    try:
        return spark.read.format(fmt).load(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def run_available_now(df: DataFrame, name: str, mode: str = "append", base: str | None = None,
                      progress: list | None = None) -> DataFrame:
    """Run a streaming query over everything available, then return its output as a table.

    Each micro-batch is written by ``foreachBatch``: appended under a per-batch
    folder (append/update) or as the whole result (complete), so a replayed
    batch overwrites itself instead of duplicating rows.  A rerun without new
    files returns the table as it is.  ``progress`` is given the engine's report of each batch.
    """
    spark = df.sparkSession
    root = base or table_path(spark, f"streams/{name}-{uuid.uuid4().hex[:12]}")
    sink = os.path.join(root, "out")

    def write(batch: DataFrame, batch_id: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(sink)
        else:
            batch.write.mode("overwrite").parquet(os.path.join(sink, f"batch={batch_id}"))

    q = (df.writeStream.outputMode(mode).foreachBatch(write)
         .option("checkpointLocation", os.path.join(root, "_checkpoint"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if progress is not None:
        progress.extend(q.recentProgress)
    out = _table_if_any(spark, sink)
    if out is None:
        return _empty_like(spark, df)
    return out.drop("batch") if "batch" in out.columns else out


def live_status(stream: DataFrame, name: str, run_col: str = "run_id", ts: str = "ts",
                payload: tuple[str, ...] = ("status",), buckets: int = 64, root: str | None = None) -> DataFrame:
    """ST2: keep a ledger of each run's latest status current as events stream in.

    The stream itself is stateless: ``foreachBatch`` reduces a micro-batch to the
    latest event of each run and merges it into the ledger, which is the only state.
    The ledger is hash-bucketed on the run id; a batch rewrites only the buckets
    it touches into a folder of its own, and a map of ``buckets`` rows names each
    bucket's current folder.  Every batch writes a new version of the map (one file, so it is
    there whole or not at all); a restart resumes from the newest.  A batch costs the
    size of the buckets it touches, and a replayed batch overwrites its own folder.
    """
    spark = stream.sparkSession
    base = root or table_path(spark, f"streams/{name}-{uuid.uuid4().hex[:12]}")
    maps = os.path.join(base, "maps")
    current: dict[int, str] = {}
    known = _table_if_any(spark, maps) if root is not None else None
    if known is not None:
        newest = known.agg(F.max("version")).first()[0]
        current = {r.bucket: r.path for r in known.filter(F.col("version") == newest).collect()}  # at most ``buckets``
    bucket = F.pmod(F.hash(F.col(run_col)), F.lit(buckets))

    def merge(batch: DataFrame, batch_id: int) -> None:
        merged = latest_status(batch, run_col, ts, payload)
        touched = sorted(r._b for r in merged.select(bucket.alias("_b")).distinct().collect())  # at most ``buckets``
        old = [current[k] for k in touched if k in current]
        if old:
            merged = latest_per_key(spark.read.parquet(*old).unionByName(merged), [run_col], ts)
        out = os.path.join(base, "ledger", f"v{batch_id:09d}")
        merged.withColumn("_b", bucket).write.mode("overwrite").partitionBy("_b").parquet(out)
        for k in touched:
            current[k] = os.path.join(out, f"_b={k}")
        spark.createDataFrame(sorted(current.items()), "bucket int, path string").coalesce(1) \
            .write.mode("overwrite").parquet(os.path.join(maps, f"version={batch_id}"))

    q = (stream.writeStream.foreachBatch(merge)
         .option("checkpointLocation", os.path.join(base, "_checkpoint"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if not current:
        return _empty_like(spark, latest_status(stream, run_col, ts, payload))
    return spark.read.parquet(*current.values())
