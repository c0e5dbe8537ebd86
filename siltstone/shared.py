"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Only a local session without one gets a temporary folder, as in tests; on a
    cluster that would lose data in silence, so it is an error there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def _files(spark: SparkSession, path: str):  # noqa: ANN202  Hadoop's file system and path
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def scratch_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one; it is removed when the application ends."""
    path, context = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}", spark.sparkContext
    if getattr(context, "_siltstone_scratch", None) != path:
        files, target = _files(spark, path)
        files.mkdirs(target)
        files.deleteOnExit(target)
        context._siltstone_scratch = path
    return path


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` as a table in the shared folder: it is computed once and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._siltstone_path = path
    return made


def drop_written(*tables: DataFrame | None) -> None:
    """Removes tables made by ``written`` that no later job reads."""
    for df in tables:
        path = getattr(df, "_siltstone_path", None)
        if path:
            files, target = _files(df.sparkSession, path)
            files.delete(target, True)
            df._siltstone_path = None


def keep_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    keep_checkpoints(df.sparkSession)
    return df.checkpoint()
