"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; without one, as in tests, a temporary folder that becomes the session's."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def passing(spark: SparkSession, name: str) -> str:
    """A folder for one call in the shared one; it goes when the session's JVM ends."""
    where = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return where


def kept(df: DataFrame) -> DataFrame:
    """df as written to the shared folder and read again, for what reads it more than once; deleted when the session's JVM ends."""
    spark = df.sparkSession
    where = passing(spark, "kept")
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)
