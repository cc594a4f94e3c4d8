"""Small results written once in a folder that all executors share, so that later steps know their size and survive
lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``; where that is unset, below the warehouse.

    On a cluster one of them has to name a store that executors share: a warehouse on the driver's own disk is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir")
        own_disk = folder.startswith(("file:", "/")) or "://" not in folder
        if own_disk and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return f"{folder.rstrip('/')}/lodeglass-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, folder: str | None = None) -> str:
    """A folder that nothing has been written to."""
    return f"{(folder or shared_folder(spark)).rstrip('/')}/stage-{uuid.uuid4().hex}"


def stage(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` as a written table in ``folder``; :func:`release` deletes it."""
    spark = df.sparkSession
    path = new_folder(spark, folder)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(staged: DataFrame) -> None:
    """Delete what :func:`stage` wrote; nothing may read it any more."""
    spark = staged.sparkSession
    folders = {str(spark._jvm.org.apache.hadoop.fs.Path(file).getParent()) for file in staged.inputFiles()}
    for folder in folders:
        if not folder.rsplit("/", 1)[-1].startswith("stage-"):
            raise ValueError(f"{folder} was not staged")
        _delete(spark, folder)


def release_all(spark: SparkSession) -> None:
    """Delete all that this application has staged; nothing may read it any more."""
    _delete(spark, shared_folder(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
