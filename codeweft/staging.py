"""Writing intermediate results to the folder that driver and executors share, and removing them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders written by staged() and fresh_path() that are still there, by the application that wrote them.
_WRITTEN: dict[str, list[str]] = {}
#: With this setting Spark removes the shuffle files of a finished write at once.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset a temporary folder, in local mode only: elsewhere no other machine could read it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: intermediate results need a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='codeweft-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder's path inside the shared one; sweep() removes it."""
    path = f"{shared_folder(spark)}/codeweft-{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def staged(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """df, written once as Parquet and read again: cuts the lineage and survives lost executors.

    instead_of is a result of staged() that nothing needs any more once df is written; its folder is removed.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    if instead_of is not None:
        discard(instead_of)
    out = spark.read.schema(df.schema).parquet(path)
    out._codeweft_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Removes the folder of a result of staged(); df can't be read afterwards."""
    path = df._codeweft_path
    _remove(df.sparkSession, path)
    _WRITTEN.get(df.sparkSession.sparkContext.applicationId, [path]).remove(path)


def keep(df: DataFrame) -> DataFrame:
    """df, a result of staged(), whose folder sweep() leaves alone from now on."""
    _WRITTEN.get(df.sparkSession.sparkContext.applicationId, [df._codeweft_path]).remove(df._codeweft_path)
    return df


def sweep(spark: SparkSession) -> int:
    """Removes all intermediate folders of this application but those kept, how many; results not yet written elsewhere can't be read afterwards."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _remove(spark, path)
    return len(paths)
