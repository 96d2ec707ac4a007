"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from flintglass.sources.shared import shared_dir


def unused(df: DataFrame, name: str) -> str:
    """name, lengthened until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Scratch:
    """Written tables of one call; those no longer needed can be dropped early, all others go when the session's JVM ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        """df as written to Parquet and read again."""
        if not self.n:
            fs, base = self._file(self.base)
            fs.deleteOnExit(base)
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.kept_at = path
        return out

    def _file(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables of keep() that nothing reads any more."""
        for df in frames:
            fs, p = self._file(df.kept_at)
            fs.delete(p, True)
