"""A session with the settings this library is designed for."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "gleanline", master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config(map={**SETTINGS, **more})
    return (builder.master(master) if master else builder).getOrCreate()


class NoSharedFolder(RuntimeError):
    """The session names no folder that all nodes can read."""


def shared_base(spark: SparkSession) -> str:
    """The folder all nodes share: what ``spark.checkpoint.dir`` names, else the one set on the context.

    Only a local session, whose single machine shares everything, gets a temporary folder of
    its own; on a cluster a machine-local folder would lose data, so that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if named is None and current.isEmpty() and not (sc.master == "local" or sc.master.startswith("local[")):
        raise NoSharedFolder("set spark.checkpoint.dir to a folder that all nodes can read and write")
    if current.isEmpty():
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="gleanline-checkpoint-"))
    return (named or sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for a table that goes when the application ends (results are lazy, so not before)."""
    path = f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    # a path is remembered for deletion only once it is there
    files.mkdirs(target)
    files.deleteOnExit(target)
    files.delete(target, True)
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a table written to the shared folder that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Deletes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_apart(df: DataFrame, path: str) -> None:
    """Write ``df``, which nothing reads again, and delete the shuffle files it needed."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget its lineage."""
    shared_base(df.sparkSession)
    return df.checkpoint(eager=True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable on all executors, once per application."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="gleanline-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, str(file.relative_to(package.parent)))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(application)
