"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that change results or plans; everything else is left to the cluster.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "pathweave", **conf: str) -> SparkSession:
    """Build (or reuse) a session with the library's required settings.

    ``master`` is only set when given, so on a cluster the launcher decides.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


_OWN_DIRS: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there (required: a machine-local folder
    would not survive executor loss); only in local mode with the setting
    unset (tests) do we create one of our own for this application.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        app = spark.sparkContext.applicationId
        configured = _OWN_DIRS.get(app)
        if configured is None:
            configured = _OWN_DIRS[app] = tempfile.mkdtemp(prefix="pathweave-ckpt-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame, name: str = "lineage", rows_per_file: int = 0) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    One job computes the rows once (``Dataset.checkpoint`` would compute them
    twice unless cached); the files are the new lineage root, so a lost
    executor re-reads them instead of recomputing the plan.  ``rows_per_file`` (0: no limit)
    keeps files small where few bytes are much work, so that small tables are read by many tasks.
    """
    path = table_path(df.sparkSession, f"{name}/{uuid.uuid4().hex}")
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)  # no job to find the schema out


def table_path(spark: SparkSession, name: str) -> str:
    """Location for an intermediate table under the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    return os.path.join(base.rstrip("/"), "tables", name)
