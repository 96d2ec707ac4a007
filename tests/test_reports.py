"""Reports as single documents, external tools, other analyzers, progress and settings."""

import csv
import json
import os
import stat

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from flintglass import cli, config
from flintglass.operators import context, validators
from flintglass.plans import reports
from flintglass.plans.progress import observed, progress, totals
from flintglass.plans.scan import Options, ScanFrames, scan_directory
from flintglass.sources.sink import ReportSink, ReportWriter
from tests.test_scan import CALL, PNG

SCRIPT = b"<svg><script>var a = 1;</script></svg>"


@pytest.fixture(scope="module")
def few(tmp_path_factory):
    d = tmp_path_factory.mktemp("few")
    for n, b in (("a.pkl", CALL), ("b.pkl", b"\x80\x04N."), ("c.svg", SCRIPT), ('odd, "name".pkl', CALL), ("zip.png", PNG + bytes(20) + b"PK\x03\x04" + bytes(40)), ("clean.png", PNG)):
        (d / n).write_bytes(b)
    return d


@pytest.fixture(scope="module")
def frames(spark, few):
    rows = scan_directory(spark, str(few)).rows.persist()
    rows.count()
    return ScanFrames(rows)


def test_one_job_makes_documents_and_totals(spark, frames, tmp_path):
    for folder in (str(tmp_path / "p"), f"file://{tmp_path}/u"):
        before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
        made, got = reports.save(frames, folder, ["json", "csv"], "few")
        after = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
        assert len(set(after) - set(before)) <= 1
        where = folder.removeprefix("file://")
        assert sorted(x.split(".", 1)[1] for x in os.listdir(where)) == ["csv", "json", "summary.json"]
        with open(made[0].removeprefix("file://")) as f:
            whole = json.load(f)
        assert len(whole["results"]) == 6 == got["total"] and whole["report_type"] == "security_scan"
        assert {os.path.basename(r["path"]): r["is_safe"] for r in whole["results"]} == {os.path.basename(r.path): r.is_safe for r in frames.files.collect()}
        with open(made[1].removeprefix("file://")) as f:
            lines = list(csv.DictReader(f))
        by = {}
        for line in lines:
            by.setdefault(os.path.basename(line["File Path"]), []).append(line)
        assert {n: len(x) for n, x in by.items()} == {os.path.basename(r["path"]): max(1, len(r["findings"])) for r in whole["results"]}
        assert got["unsafe"] == sum(not r["is_safe"] for r in whole["results"]) and got["by_severity"] == {k: v for k, v in got["by_severity"].items() if v == sum(x["severity"] == k for r in whole["results"] for x in r["findings"])}
    assert reports.summary(frames.files, frames.findings)["by_confidence"] == got["by_confidence"]


def test_failed_tasks_leave_no_report(spark, tmp_path):
    spark.dataSource.register(ReportSink)
    bad = spark.range(4).select(F.when(F.col("id") < 3, F.lit("{}")).otherwise(F.raise_error(F.lit("no"))).alias("json"), F.array(F.array(F.lit("x"))).alias("csv"), F.create_map(F.lit("total"), F.lit(1).cast("long")).alias("counts"))
    with pytest.raises(Exception, match="no"):
        bad.write.format("scan_report").mode("append").options(path=f"{tmp_path}/r", formats="json,csv", head="{}", columns='["A"]').save()
    assert [n for n in os.listdir(tmp_path) if ".parts-" not in n] == []  # a task that was still running may leave its part
    (tmp_path / "r.parts-0").mkdir(exist_ok=True)
    (tmp_path / "other").mkdir()
    os.utime(tmp_path / "r.parts-0", (0, 0))
    reports.prune(str(tmp_path), 30)
    assert "r.parts-0" not in os.listdir(tmp_path) and "other" in os.listdir(tmp_path)


def test_an_empty_report(tmp_path):
    writer = ReportWriter({"path": f"{tmp_path}/r", "formats": "json,csv", "head": "{}", "columns": '["A"]'})
    writer.commit([writer.write(iter([]))])
    assert json.loads((tmp_path / "r.json").read_text()) == {"summary": {}, "results": []} and (tmp_path / "r.csv").read_text() == "A\n" and sorted(os.listdir(tmp_path)) == ["r.csv", "r.json", "r.summary.json"]


def test_pages_show_the_worst_of_each_file(spark, tmp_path):
    """Many notes of one file don't hide the threats of another, and what isn't shown is said."""
    note = b"".join(b"ccollections\nOrderedDict\n)\x81" for _ in range(30)) + b"."
    (tmp_path / "a.pkl").write_bytes(note + b"")
    (tmp_path / "z.pkl").write_bytes(CALL)
    frames = scan_directory(spark, str(tmp_path))
    for kind in ("txt", "html"):
        made, _ = reports.save(frames, str(tmp_path / "out"), [kind], "x", limit=2)
        text = open(made[0]).read()
        assert "os.system" in text and "and 10 more" in text
    assert "os.system" in open(reports.write(frames.files, frames.findings, str(tmp_path / "out"), ["txt"], "x", limit=2)[0]).read()


def tool(folder, name: str, body: str) -> str:
    path = folder / name
    path.write_text(f"#!/bin/sh\n{body}\n")
    path.chmod(path.stat().st_mode | stat.S_IXUSR)
    return str(path)


def test_tools_judge_findings(spark, few, tmp_path):
    """A tool that finds nothing lowers a finding in the scan and its reports; one that is missing, fails or hangs changes nothing."""
    quiet = validators.MetadataFields(tool=tool(tmp_path, "quiet", """echo '[{"Comment": "hello", "n": 1}]'"""))
    loud = validators.MetadataFields(tool=tool(tmp_path, "loud", """echo '[{"User Comment": "<script>x</script>"}]'"""))
    fails, hangs = validators.MetadataFields(tool=tool(tmp_path, "fails", "echo oops >&2; exit 3")), validators.MetadataFields(tool=tool(tmp_path, "hangs", "exec sleep 30"), timeout=0.5)
    plain = {r.rule: r for r in scan_directory(spark, str(few)).findings.collect() if r.path.endswith("c.svg")}["svg.script_tag"]
    assert plain.level in ("MEDIUM", "HIGH") and plain.external is None and plain.override is False
    for validator, status, lowered in ((quiet, "not_confirmed", True), (loud, "confirmed", False), (fails, "validation_error", False), (hangs, "validation_error", False), (validators.MetadataFields(tool="no-such-tool"), "tool_unavailable", False)):
        frames = scan_directory(spark, str(few), Options(validators=(validator,)))
        found = {(r.path.rpartition("/")[2], r.rule): r for r in frames.findings.collect()}
        r = found["c.svg", "svg.script_tag"]
        assert (r.external.tool, r.external.status, r.override) == ("exiftool", status, lowered)
        assert r.adjusted_severity == ("critical-LOW" if lowered else plain.adjusted_severity) and r.severity == plain.severity
        assert all(x.external is None for (p, _), x in found.items() if p == "a.pkl")
    made, _ = reports.save(scan_directory(spark, str(few), Options(validators=(quiet,))), str(tmp_path / "out"), ["csv", "json"], "few")
    assert "critical-LOW" in open(made[0]).read() and '"not_confirmed"' in open(made[1]).read()


def test_answers_of_tools():
    archives = validators.ArchiveSignatures()
    table = "DECIMAL HEX DESCRIPTION\n-----\n"
    assert archives.verdict(table)[0] == "not_confirmed" and archives.verdict(table + "0 0x0 StuffIt zip archive\n")[0] == "not_confirmed" and archives.verdict(table + "7 0x7 Zip archive data, v2\n")[0] == "skipped"
    fields = validators.MetadataFields()
    assert fields.verdict("[]")[0] == "not_confirmed" and fields.verdict('[{"Make": "eval("}]')[0] == "not_confirmed" and fields.verdict(json.dumps([{"Make": "x" * 100 + "eval("}]))[0] == "confirmed"


def test_the_router_takes_the_first_that_can(spark):
    names = ["svg_script_tag", "archive_in_image", "metadata_archive", "extension_mismatch"]
    got = {r.n: r.v for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", validators.router(F.col("n")).alias("v")).collect()}
    assert got == {"svg_script_tag": "exiftool", "archive_in_image": "binwalk", "metadata_archive": "exiftool", "extension_mismatch": None}


def always(data, at, name, kind, bits, generated):
    return F.lit(0.95)


def test_another_analyzer(spark, few):
    r = {r.rule: r for r in scan_directory(spark, str(few), Options(analyzer=always)).findings.collect() if r.path.endswith("zip.png")}["polyglot.archive_in_image"]
    assert (r.confidence, r.level, r.action, r.adjusted_severity) == (0.95, "HIGH", "QUARANTINE", "critical-HIGH")


def test_archive_headers(spark):
    """A local header with a sane version is an archive, one with an impossible version isn't; neither is one that is cut off."""
    head = b"PK\x03\x04" + (20).to_bytes(2, "little") + bytes(20) + (5).to_bytes(2, "little") + bytes(2) + b"a.txt"
    rows = [(0, head), (1, head[:4] + b"\xff\xff" + head[6:]), (2, head[:32]), (3, b"xx"), (4, bytes.fromhex("377ABCAF271C")), (5, b"\x1f\x8b" + bytes(8)), (6, b"\x1f\x8b")]
    got = {r.i: r.v for r in spark.createDataFrame([(i, bytearray(d)) for i, d in rows], "i int, d binary").select("i", context.valid_archive(F.col("d"), F.lit(0).cast("long")).alias("v")).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False, 4: True, 5: True, 6: False}


def test_progress_and_observed_totals(spark, frames):
    said = []
    observation = Observation("scan")
    with progress(spark, lambda done, known: said.append((done, known)), every=0.05):
        observed(frames.rows, observation).write.format("noop").mode("overwrite").save()
    assert said[-1][0] == said[-1][1] > 0 and said == sorted(said)
    got = totals(observation.get)
    assert {k: got[k] for k in ("total", "safe", "unsafe", "bytes", "by_confidence")} == {k: v for k, v in reports.summary(frames.files, frames.findings).items() if k in ("total", "safe", "unsafe", "bytes", "by_confidence")}


def test_settings_are_written(spark, few, tmp_path, capsys):
    path = str(tmp_path / "new" / "c.toml")
    assert cli.main(["config", "--config", path, "--init"]) == 0 and config.load(path) == config.DEFAULTS
    assert cli.main(["config", "--config", path, "--set", "scan.strict=true", "--set", "reports.folder=here", "--set", "scan.confidence_threshold=1"]) == 0
    assert config.load(path)["scan"]["strict"] is True and config.load(path)["reports"]["folder"] == "here"
    for bad in ("scan.nothing=1", "scan.strict=maybe", "none.x=1"):
        with pytest.raises(ValueError, match="setting|value"):
            config.change(path, [bad])
    assert cli.main(["tools"]) == 0 and cli.main(["scan", str(few), "--progress", "--json"], spark) == 1
    assert '"total": 6' in capsys.readouterr().out
