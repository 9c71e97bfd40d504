"""Session defaults and tables written to the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from multiprocessing.pool import ThreadPool
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

Made = TypeVar("Made")

#: Model fits that run side by side; each holds its own training rows in executor storage.
FITS_AT_ONCE = 5


def build_session(app: str = "parcelgrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.parquet.filterPushdown", "true")
        .config("spark.sql.legacy.javaCharsets", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def broadcast_by_measured_size(spark: SparkSession) -> None:
    """Let only sides whose rows were counted in bytes be broadcast, none by the size of its files.

    Files of repetitive rows hold a small part of what the rows take in
    memory, and an explode is not counted at all: a table of a few MB on disk
    can reach the driver as several GB. Adaptive execution still broadcasts a
    side whose shuffled rows take at most 10 MB.
    """
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10m")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own: on a cluster a
    machine-local path would lose the table together with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="spark-parcelgrid-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the scratch folder and read it back.

    Cuts lineage and pins values that a second evaluation could compute
    differently; a lost executor re-reads files instead of re-running the plan.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._durable_path = path
    return back


def release(df: DataFrame) -> None:
    """Delete the files behind a table that ``durable`` wrote."""
    path = getattr(df, "_durable_path", None)
    if path is None:
        return
    jvm = df.sparkSession.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    p.getFileSystem(conf).delete(p, True)


def side_by_side(spark: SparkSession, makers: list[Callable[[], Made]], *, tasks: int | None = None) -> list[Made]:
    """Results of independent makers in their order, at most ``FITS_AT_ONCE`` at a time.

    Makers known to run ``tasks`` tasks at a time may be more, until they fill the cores.

    A boosted fit is a long row of short jobs, most of it waiting; fits that do
    not depend on each other fill the executors together, as Spark's own
    cross-validator does it.
    """
    if not makers:
        return []
    at_once = max(FITS_AT_ONCE, spark.sparkContext.defaultParallelism // tasks) if tasks else FITS_AT_ONCE
    with ThreadPool(min(at_once, len(makers))) as pool:
        return pool.map(lambda make: make(), [inheritable_thread_target(spark)(make) for make in makers])
