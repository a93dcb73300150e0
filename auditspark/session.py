"""Session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

#: Jobs that ``together`` gives to Spark at a time.
AT_ONCE = 4


def build_session(app_name: str = "auditspark", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the engine is designed for.

    Partition counts and memory belong to the cluster, so only semantics and
    adaptive execution are set here; ``extra`` adds or overrides settings
    (underscores in names stand for dots).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("_", "."): v for k, v in extra.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str | None:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is used, but only for a
    local master; a cluster without the setting has no shared folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        cached = getattr(spark.sparkContext, "_auditspark_dir", None)
        if cached is None:
            cached = tempfile.mkdtemp(prefix="auditspark-")
            spark.sparkContext._auditspark_dir = cached
        return cached
    return None


def scratch_root(spark: SparkSession) -> str:
    """This application's own folder below the shared folder."""
    base = shared_dir(spark)
    if base is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return f"{base}/auditspark/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's folder."""
    return f"{scratch_root(spark)}/{uuid.uuid4().hex}/{name}"


def drop_scratch(spark: SparkSession) -> None:
    """Remove what this application stored, once its results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut the lineage of a table that several outputs read.

    Written as Parquet in the shared folder, so later readers prune columns and
    a lost executor costs no recomputation. A cluster without a shared folder is
    an error: behaviour never depends on the setting.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 2)


def together(spark: SparkSession, *steps: Callable[[], object]) -> list:
    """Results of independent steps, in their order.  Their jobs run side by side, so
    that the last tasks and small stages of one leave no cores idle."""
    inherit = inheritable_thread_target(spark)
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return [f.result() for f in [pool.submit(inherit(step)) for step in steps]]
