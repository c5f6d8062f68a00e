"""Session helpers: a tuned builder and lineage cutting for iterative jobs."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, StringType


def build_session(app_name: str = "tablescope", master: str | None = None, **conf: str) -> SparkSession:
    """Session with AQE, skew-join handling and UTC; every value can be overridden."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Functions that run there import it, and workers know neither ``sys.path`` of the driver nor,
    on other machines, its folders. A package that came as a zip file was sent with the job.
    """
    folder = os.path.dirname(os.path.abspath(__file__))
    if spark.sparkContext.applicationId in _SHIPPED or not os.path.isdir(folder):
        return
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="tablescope-")), "tablescope.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for at, _, names in os.walk(folder):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(folder)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(spark.sparkContext.applicationId)


# Applications whose workers have the package.
_SHIPPED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Where that setting is empty, a folder of our own: on one machine a temporary one, on a
    cluster one in the warehouse, which its machines share, after trying it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return _checked(spark, folder)
    folder = spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not _one_process(spark):
        return _tried(spark, os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "tablescope-steps"))
    folder = tempfile.mkdtemp(prefix="tablescope-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def _one_process(spark: SparkSession) -> bool:
    """Whether tasks run inside the driver; ``local-cluster`` has executors of its own."""
    return re.match(r"local(\[|$)", spark.sparkContext.master) is not None


def _checked(spark: SparkSession, folder: str) -> str:
    """``folder``, unless what executors write there does not reach the driver.

    Without a scheme the default file system decides; if that is the local one, the folder may
    be a mount all machines share or each machine's own disk. On a cluster a few rows written by
    as many tasks as there are cores, and read back, tell which: once per application and folder.
    """
    if _one_process(spark) or ":/" in folder:
        return folder
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() != "file":
        return folder
    return _tried(spark, folder)


def _tried(spark: SparkSession, folder: str) -> str:
    """``folder`` after ``_try_folder``, once per application and folder."""
    tried = (spark.sparkContext.applicationId, folder)
    if tried not in _SHARED:
        _try_folder(spark, folder)
        _SHARED.add(tried)
    return folder


# (application, folder) whose rows came back.
_SHARED: set[tuple[str, str]] = set()


def _try_folder(spark: SparkSession, folder: str) -> None:
    """Raise unless a row written by each task is listed by the driver and read by the executors."""
    tasks = max(spark.sparkContext.defaultParallelism, 8)
    path = os.path.join(folder, f"step-{uuid.uuid4().hex}")
    lost = f"rows written to {folder} do not come back; set spark.checkpoint.dir to a folder all machines share"
    spark.range(0, tasks, 1, tasks).write.parquet(path)
    try:
        back = spark.read.schema("id bigint").parquet(path).agg(F.count("id")).first()[0]
    except PySparkException as exc:  # a part is missing on the machine that reads it
        raise ValueError(lost) from exc
    if back < tasks:
        raise ValueError(lost)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage, survives lost executors, and unlike an RDD checkpoint keeps
    column pruning and filter pushdown for whatever reads the result.
    """
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), f"step-{uuid.uuid4().hex}")
    df.write.parquet(path)
    if written := getattr(_WRITTEN, "paths", None):
        written[-1].append(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._step = path
    return stored


# Steps written by this thread since each call of ``settled`` began.
_WRITTEN = threading.local()


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """``materialize(make())`` less the steps written on the way, which nothing may read any more."""
    if not hasattr(_WRITTEN, "paths"):
        _WRITTEN.paths = []
    _WRITTEN.paths.append([])
    try:
        out = materialize(make())
    finally:
        paths = _WRITTEN.paths.pop()
    _remove(out.sparkSession, [p for p in paths if p != out._step])
    if _WRITTEN.paths:
        _WRITTEN.paths[-1].append(out._step)
    return out


def discard(df: DataFrame) -> None:
    """Remove the step of a table from ``materialize`` that has been used up."""
    _remove(df.sparkSession, [df._step])


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


# Types that come back from Arrow as they were; null structs and vectors do not.
_PLAIN = (NumericType, StringType, BooleanType, DateType)


def small(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """A table known to be small, marked for broadcast after its size was checked.

    Fetches at most ``max_rows`` + 1 rows. A larger table is returned as it is and Spark
    picks a shuffle join for it. Plain columns go both ways as Arrow: a table made of Python
    rows starts Python workers of its own on the executors, which keep their memory for a minute.
    """
    few = df.limit(max_rows + 1)
    rows = few.toArrow() if all(isinstance(f.dataType, _PLAIN) for f in df.schema) else few.collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
