"""The folder that driver and executors share, for what a job writes and reads again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where none is set and one machine does all."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    master = spark.sparkContext.master
    if not re.match(r"local(\[[^]]*\])?$", master):
        raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
    found = tempfile.mkdtemp(prefix="spark-shared-")
    spark.sparkContext.setCheckpointDir(found)
    return found


def own_dir(spark: SparkSession) -> str:
    """The part of the shared folder that is this application's."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def fresh(spark: SparkSession, name: str) -> str:
    """A path that nothing has been written to."""
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read again: what follows doesn't repeat the work, and a lost executor costs its
    running tasks."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Remove all that this application wrote to the shared folder; what came of it can't be read afterwards."""
    delete(spark, own_dir(spark))
