"""Incremental scans: each artifact is looked at once, the checkpoint remembering which were."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flintglass.plans.scan import Options, scan
from flintglass.sources.artifacts import ArtifactSource


def scan_table_stream(spark: SparkSession, source: str, schema, detect: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Applies a stateless detector to the new files of a Parquet folder and appends its rows to sink."""
    found = detect(spark.readStream.schema(schema).parquet(source))
    return found.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scan_folder_stream(spark: SparkSession, folder: str, sink: str, checkpoint: str, options: Options | None = None, **source) -> StreamingQuery:
    """Scans the new and changed files of a folder in micro-batches and appends their findings to sink; empty and hidden files arrive like others, of any size."""
    spark.dataSource.register(ArtifactSource)
    files = spark.readStream.format("artifacts").options(path=folder, log=f"{checkpoint}/files", **{k: str(v) for k, v in source.items()}).load()

    def one(batch: DataFrame, number: int) -> None:
        scan(batch, options).findings.withColumn("batch", F.lit(number)).write.mode("append").parquet(sink)

    return files.writeStream.foreachBatch(one).option("checkpointLocation", f"{checkpoint}/query").trigger(availableNow=True).start()


def next_run(now: Column, hour: int, minute: int) -> Column:
    """The next time of day: today's, or tomorrow's if it has come."""
    today = F.date_trunc("day", now) + F.make_dt_interval(F.lit(0), F.lit(hour), F.lit(minute))
    return F.when(today <= now, today + F.make_dt_interval(F.lit(1))).otherwise(today)
