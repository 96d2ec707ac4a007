"""From findings to verdicts, summaries and rankings."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flintglass.functions import signatures as S
from flintglass.functions.rules import rank
from flintglass.sources.shared import kept


def file_verdicts(files: DataFrame, findings: DataFrame, key: str = "path") -> DataFrame:
    """For each file: is_safe (nothing critical or high), max_severity (null without findings), n_findings, max_confidence."""
    per = findings.groupBy(key).agg(F.min(rank(F.col("severity"))).alias("worst"), F.count("*").alias("n_findings"), F.max("confidence").alias("max_confidence"))
    worst = F.try_element_at(F.array(*map(F.lit, S.SEVERITIES)), F.col("worst") + 1)
    return files.join(per, key, "left").withColumns({"is_safe": F.coalesce(F.col("worst") > 1, F.lit(True)), "max_severity": worst, "n_findings": F.coalesce("n_findings", F.lit(0)), "max_confidence": F.coalesce("max_confidence", F.lit(0.0))}).drop("worst")


def of_findings(findings: Column) -> dict[str, Column]:
    """The columns of file_verdicts() from a row's own array of findings."""
    worst = F.array_min(F.transform(findings, lambda f: rank(f["severity"])))
    return {
        "is_safe": F.coalesce(worst > 1, F.lit(True)),
        "max_severity": F.try_element_at(F.array(*map(F.lit, S.SEVERITIES)), worst + 1),
        "n_findings": F.size(findings).cast("bigint"),
        "max_confidence": F.coalesce(F.array_max(F.transform(findings, lambda f: f["confidence"])), F.lit(0.0)),
    }


def by_severity(findings: DataFrame, dense: bool = True) -> DataFrame:
    """n of each severity; dense: also of those that don't occur."""
    counts = findings.groupBy("severity").agg(F.count("*").alias("n"))
    if not dense:
        return counts
    every = findings.sparkSession.createDataFrame([(s,) for s in S.SEVERITIES], "severity string")
    return every.join(F.broadcast(counts), "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def by_format(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("format").agg(F.count("*").alias("files"), F.count_if("is_safe").alias("safe"), F.count_if(~F.col("is_safe")).alias("unsafe"), F.sum("length").alias("bytes"))


def by_confidence(findings: DataFrame) -> DataFrame:
    """n of each level of confidence, UNANALYZED being those without one."""
    return findings.groupBy(F.coalesce("level", F.lit("UNANALYZED")).alias("level")).agg(F.count("*").alias("n"))


def report_order(verdicts: DataFrame, pieces: int = 256) -> DataFrame:
    """Unsafe files first: by severity, then confidence, then path; safe files by path.

    The order is cut into ranges at the quantiles of a bounded sample (16 rows a piece), so that no task numbers
    all files; positions are exact whatever the sample is, as a range starts after the counted rows of those before it.
    The verdicts are written once, as the sample, the counts and the rows read them.
    """
    safe = F.col("is_safe")
    place = F.struct(F.when(safe, 9).otherwise(rank(F.col("max_severity"))).alias("part"), F.when(safe, F.lit(0.0)).otherwise(-F.col("max_confidence")).alias("conf"), F.col("path"))
    marked = kept(verdicts.withColumn("place", place))
    sample = sorted(tuple(r["place"]) for r in marked.select("place", F.xxhash64("path").alias("h")).orderBy("h", "place").limit(16 * pieces).select("place").collect())
    cuts = [dict(zip(("part", "conf", "path"), sample[len(sample) * k // pieces], strict=True)) for k in range(1, pieces)] if sample else []
    bounds = F.from_json(F.lit(json.dumps(cuts)), f"array<{marked.schema['place'].dataType.simpleString()}>")  # one constant
    ranged = marked.withColumn("piece", F.size(F.filter(bounds, lambda b: b <= F.col("place"))))
    sizes = ranged.groupBy("piece").agg(F.count("*").alias("size"))
    offsets = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("size")
    within = Window.partitionBy("piece").orderBy("place")
    return ranged.join(F.broadcast(offsets), "piece").withColumn("position", F.row_number().over(within) + F.col("before")).drop("piece", "place", "before")


def ranked(findings: DataFrame, key: str = "path") -> DataFrame:
    """Findings of each file numbered by severity, then order of emission."""
    return findings.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(rank(F.col("severity")), "ordinal")))


def evaluation(results: DataFrame, by: str) -> DataFrame:
    """For each value of by: samples, detected, expected, right, and the shares of false alarms and misses."""
    wrong = F.count_if(F.col("detected") & ~F.col("expected")), F.count_if(~F.col("detected") & F.col("expected"))
    return results.groupBy(by).agg(F.count("*").alias("samples"), F.count_if("detected").alias("n_detected"), F.count_if("expected").alias("n_expected"), wrong[0].alias("false_positives"), wrong[1].alias("false_negatives"), F.round(F.avg((F.col("detected") == F.col("expected")).cast("double")), 6).alias("accuracy"))
