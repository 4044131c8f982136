"""Helpers that make jobs run alike on one machine and on a cluster."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package's Python files, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(), f"{root.name}.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share.  What is written there stays.

    Only on one machine (as in tests) a local folder is set where the session names none; on a cluster that is an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = sc.getCheckpointDir()
    if not base and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="varloom-")
        sc.setCheckpointDir(base)
    # with its scheme, for readers that don't know the cluster's default file system
    path = sc._jvm.org.apache.hadoop.fs.Path(base)
    whole = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"{whole.rstrip('/')}/varloom-{uuid.uuid4().hex}"


#: Lets Spark give up a query's shuffle files when the query is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, folder: str, name: str, clean: bool = False, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage is cut there, and a
    lost executor costs no recomputation of what came before.

    With ``clean`` what was shuffled for the table goes when the table stands, so a job of many tables holds one table's shuffles
    at a time.  ``codec`` is the table's compression, if not the session's.
    """
    path, conf = f"{folder}/{name}", df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    if clean:
        conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path, compression=codec)
    finally:
        if clean:
            conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, folder: str, *names: str) -> None:
    """Delete tables of :func:`materialize` that nothing reads any more."""
    for name in names:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
