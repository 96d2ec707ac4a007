"""Command line: scan, info, tools, config, version. The exit code of scan is 1 if any file is unsafe."""

from __future__ import annotations

import argparse
import json
import shutil
import sys

from pyspark.sql import Observation, SparkSession

from flintglass import __version__, config
from flintglass.operators import validators, verdicts
from flintglass.plans import reports
from flintglass.plans.progress import observed, progress
from flintglass.plans.progress import totals as summed
from flintglass.plans.scan import Options, ScanFrames, scan_directory

SHOWN = 200


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="flintglass")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan")
    s.add_argument("path")
    s.add_argument("--no-recursive", action="store_true")
    s.add_argument("--extensions")
    s.add_argument("--no-hash", action="store_true")
    s.add_argument("--no-context", action="store_true")
    s.add_argument("--strict", action="store_true")
    s.add_argument("--confidence-threshold", type=float)
    s.add_argument("--entropy-threshold", type=float, help="bits a byte from which content counts as encrypted")
    s.add_argument("--retain-days", type=int, help="age at which reports are removed")
    s.add_argument("--json", action="store_true", help="summary as JSON")
    s.add_argument("--verbose", action="store_true", help="also informational findings")
    s.add_argument("--no-external-validation", action="store_true", help="don't ask external tools")
    s.add_argument("--progress", action="store_true", help="tasks done so far, on the error output")
    s.add_argument("--report-dir")
    s.add_argument("--report-formats", default="")
    s.add_argument("--config")
    sub.add_parser("info").add_argument("--config")
    c = sub.add_parser("config")
    c.add_argument("--config")
    c.add_argument("--init", action="store_true", help="write the settings to the file, if there is none")
    c.add_argument("--set", action="append", default=[], metavar="SECTION.KEY=VALUE", help="change a setting in the file")
    for name in ("tools", "version"):
        sub.add_parser(name)
    a = p.parse_args(args)
    if a.command == "version":
        print(__version__)
        return 0
    settings = config.load(getattr(a, "config", None))
    if a.command == "config":
        if a.init or a.set:
            settings = config.change(a.config, a.set)
        print(json.dumps(settings, indent=2))
        return 0
    if a.command == "tools":
        print(json.dumps({v.name: shutil.which(v.tool) is not None for v in validators.STANDARD}, indent=2))
        return 0
    if a.command == "info":
        from flintglass.functions.signatures import EXTENSIONS

        print(json.dumps({"formats": EXTENSIONS}, indent=2))
        return 0
    spark = spark or SparkSession.builder.appName("flintglass").config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()
    threshold = a.confidence_threshold if a.confidence_threshold is not None else settings["scan"]["confidence_threshold"]
    source = {"recursive": not a.no_recursive, "hash": not a.no_hash} | ({"extensions": a.extensions} if a.extensions else {})
    entropy = a.entropy_threshold if a.entropy_threshold is not None else settings["scan"]["entropy_threshold"]
    tools = () if a.no_external_validation or a.no_context else tuple(v for v in validators.STANDARD if shutil.which(v.tool))
    frames = scan_directory(spark, a.path, Options(a.strict, threshold, not a.no_context, entropy, validators=tools), **source)
    frames = ScanFrames(frames.rows.persist())
    say = (lambda done, known: print(f"\r{done} of {known} tasks", end="", file=sys.stderr)) if a.progress else lambda done, known: None
    with progress(spark, say):
        if a.report_dir:
            wanted = [f for f in a.report_formats.split(",") if f] or settings["reports"]["formats"]
            made, totals = reports.save(frames, a.report_dir, wanted, a.path)
        else:
            observation = Observation("scan")
            observed(frames.rows, observation).write.format("noop").mode("overwrite").save()
            made, totals = [], summed(observation.get)
    if a.json:
        print(json.dumps(totals, default=str))
    else:
        shown = frames.findings if a.verbose else frames.findings.filter("severity <> 'info'")
        n = shown.count()
        verdicts.ranked(shown).orderBy("path", "position").select("path", "severity", "adjusted_severity", "message", "recommendation").show(SHOWN, truncate=100)
        if n > SHOWN:
            print(f"shown: the first {SHOWN} of {n} findings; reports have all")
        print(f"{totals['total']} files, {totals['unsafe']} unsafe")
    if made:
        print("\n".join(made))
        reports.prune(a.report_dir, settings["reports"]["retention_days"] if a.retain_days is None else a.retain_days)
    frames.rows.unpersist()
    return 1 if totals["unsafe"] else 0


if __name__ == "__main__":
    sys.exit(main())
