"""How far a job is, and what it counted on its way."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from flintglass.functions.signatures import SEVERITIES

LEVELS = ("HIGH", "MEDIUM", "LOW", "UNANALYZED")


@contextmanager
def progress(spark: SparkSession, say: Callable[[int, int], None], every: float = 0.5):
    """While the block runs, say(tasks done, tasks known) of the jobs it starts, at most so often, and once at its end."""
    sc, group = spark.sparkContext, f"scan-{uuid.uuid4().hex}"
    ended, most = threading.Event(), [0, 0]

    def look() -> None:
        tracker = sc.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup(group) if (info := tracker.getJobInfo(j)) for s in info.stageIds}
        infos = [i for s in stages if (i := tracker.getStageInfo(s))]
        now = [sum(i.numCompletedTasks for i in infos), sum(i.numTasks for i in infos)]
        most[:] = [max(most[0], now[0]), max(most[1], now[1])]
        say(*most)

    def watch() -> None:
        while not ended.wait(every):
            look()

    sc.setJobGroup(group, "scan")
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        yield
    finally:
        ended.set()
        watcher.join()
        look()
        sc.setLocalProperty("spark.jobGroup.id", None)


def counts() -> dict[str, Column]:
    """What a row of a scan adds to the totals of its report."""
    found = F.coalesce("findings", F.array())
    severities, levels = F.transform(found, lambda f: f["severity"]), F.transform(found, lambda f: F.coalesce(f["level"], F.lit("UNANALYZED")))
    size = lambda values, value: F.size(F.filter(values, lambda v: v == value)).cast("long")
    safe = ~F.exists(found, lambda f: f["severity"].isin("critical", "high"))
    out = {"total": F.lit(1).cast("long"), "safe": safe.cast("long"), "unsafe": (~safe).cast("long"), "bytes": F.coalesce("length", F.lit(0)).cast("long")}
    out |= {f"severity.{s}": size(severities, s) for s in SEVERITIES}
    return out | {f"level.{v}": size(levels, v) for v in LEVELS}


def observed(rows: DataFrame, observation: Observation) -> DataFrame:
    """rows of a scan, whose totals the observation has as soon as something has run over them."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in counts().items()]
    return rows.observe(observation, *sums, F.coalesce(F.round(F.sum("scan_ms"), 3), F.lit(0.0)).alias("scan_ms"))


def totals(got: dict) -> dict:
    """Totals of a report's head from counts."""
    part = lambda kind: {k.split(".")[1]: v for k, v in got.items() if k.startswith(f"{kind}.")}
    plain = {k: v for k, v in got.items() if "." not in k}
    levels = dict.fromkeys(LEVELS, 0) | part("level")
    return dict.fromkeys(("total", "safe", "unsafe", "bytes"), 0) | plain | {"by_severity": {k: v for k, v in part("severity").items() if v}, "by_confidence": levels}
