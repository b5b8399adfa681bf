"""Spark session helpers.

Cluster runs get their settings from the launcher; these helpers only fill in
what is missing, so the same code runs in tests on ``local[*]``.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job of the library relies on.  AQE re-plans joins from real
# shuffle sizes (broadcast conversion behind a size check, partition
# coalescing, skew splitting).
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app_name: str = "flowsmith", extra: dict | None = None) -> SparkSession:
    """Return a session; on a fresh local JVM apply the defaults above."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("FLOWSMITH_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the launcher sets it to a shared file system.  Only when it is
    unset (tests, a laptop) a scratch folder is created and registered.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not path:
        path = tempfile.mkdtemp(prefix="flowsmith-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df, to: str | None = None, **options):
    """Write ``df`` once as a table in the shared checkpoint folder and read it
    back: the lineage is cut and later branches read the written files.

    For intermediate tables read by several branches of a plan (value counts,
    weights, guide tables, scores): without it each branch would re-scan and
    re-shuffle the base tables.  The files live on the cluster's shared
    storage (``spark.checkpoint.dir``), so a lost executor does not lose them.
    An explicit write computes the plan once (an eager ``checkpoint()`` of an
    unpersisted plan computes it twice) and gives the planner real sizes.
    ``options`` are the writer's.  ``to`` names the folder, for tables that ``delete_path`` deletes after their last use.
    """
    spark = df.sparkSession
    path = to or scratch_path(spark, "table")
    df.write.mode("overwrite").options(**options).parquet(path)
    # the schema is known: reading it back needs no footer-inference job
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Has the driver collect what is left of finished jobs, upon which Spark's cleaner deletes their shuffle files.

    For long chains of steps over much data: the cleaner acts when the driver's JVM collects, and by default the driver asks for that
    every 30 minutes only (``spark.cleaner.periodicGC.interval``)."""
    spark._jvm.System.gc()


def _file_system(spark: SparkSession, path: str):
    """(file system, path) of any URI that Spark can read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a table or folder of the library's own; nothing happens if it is not there."""
    fs, p = _file_system(spark, path)
    fs.delete(p, True)
