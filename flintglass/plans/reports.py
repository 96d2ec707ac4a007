"""Reports: CSV, JSON, text and HTML, their catalogue, and how long they are kept."""

from __future__ import annotations

import html
import json
import os
import re
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flintglass import __version__
from flintglass.functions.rules import contains_any
from flintglass.operators import verdicts
from flintglass.plans.progress import counts, totals
from flintglass.sources.sink import ReportSink, place, put

NAME = r"^(.+)_report_(\d{8}_\d{6})\.(txt|json|html|csv)$"
#: Findings of a file that a page shows.
PER_FILE = 20
# The columns of the CSV report, in order.
CSV_COLUMNS = ["File Path", "Format", "Status", "File Size", "SHA-256", "Scan Time (ms)", "Finding Severity", "Adjusted Severity", "Confidence", "Confidence Level", "Finding Message", "Recommended Action"]


def status(is_safe: Column) -> Column:
    return F.when(is_safe, "SAFE").otherwise("THREATS DETECTED")


def csv_rows(files: DataFrame, findings: DataFrame) -> DataFrame:
    """One row for each finding, and one for each file without any."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    percent = F.coalesce(F.concat(F.floor(F.col("confidence") * 100), F.lit("%")), F.lit(""))
    joined = files.select("path", "format", "length", "sha256", "is_safe", *(["scan_ms"] if "scan_ms" in files.columns else [])).join(findings.select("path", "severity", "adjusted_severity", "confidence", "level", "message", "recommendation"), "path", "left")
    cols = [F.col("path"), F.col("format"), status(F.col("is_safe")), F.col("length"), text("sha256"), text("scan_ms") if "scan_ms" in files.columns else F.lit(""), text("severity"), text("adjusted_severity"), percent, text("level"), text("message"), text("recommendation")]
    return joined.select(*[c.alias(n) for c, n in zip(cols, CSV_COLUMNS, strict=True)])


def json_rows(files: DataFrame, findings: DataFrame) -> DataFrame:
    """One JSON text for each file, its findings in order of emission."""
    keep = ["severity", "message", "location", "technique", "cve", "recommendation", "confidence", "level"]
    listed = findings.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", *keep))), lambda f: F.struct(*[f[k].alias(k) for k in keep])).alias("findings"))
    return files.join(listed, "path", "left").select("path", F.to_json(F.struct("path", "format", "length", "sha256", "is_safe", "max_severity", F.coalesce("findings", F.array()).alias("findings"))).alias("json"))


def summary(files: DataFrame, findings: DataFrame) -> dict:
    """Totals for a report's head: a few numbers."""
    timed = [F.round(F.sum("scan_ms"), 3).alias("scan_ms")] if "scan_ms" in files.columns else []
    f = files.agg(*timed, F.count("*").alias("total"), F.count_if("is_safe").alias("safe"), F.count_if(~F.col("is_safe")).alias("unsafe"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    levels = {"HIGH": 0, "MEDIUM": 0, "LOW": 0, "UNANALYZED": 0} | {r["level"]: r["n"] for r in verdicts.by_confidence(findings).collect()}
    return f.asDict() | {"by_severity": {r["severity"]: r["n"] for r in verdicts.by_severity(findings).collect()}, "by_confidence": levels}


def size_text(n: int) -> str:
    size = float(n)
    for unit in ("B", "KB", "MB", "GB"):
        if size < 1024:
            return f"{size:.1f} {unit}"
        size /= 1024
    return f"{size:.1f} TB"


#: Words of a message, in the order they are looked for, and the recipe they call for.
RECIPE_WORDS = [("eval", ["eval"]), ("exec", ["exec", "system", "passthru"]), ("asp", ["asp"]), ("php", ["php"]), ("archive", ["archive", "zip", "rar"]), ("pickle", ["pickle", "dangerous import"])]
#: What to run, and what its output tells; {path} and {at} are put in.
RECIPES = {
    "eval": ("strings -t d '{path}' | grep -i 'eval *('", "A call with a readable argument is code; a lone word among random bytes is chance."),
    "exec": ("strings -t d '{path}' | grep -iE '(exec|system|passthru) *('", "A call with a readable argument is code; a lone word among random bytes is chance."),
    "asp": ("strings -t d '{path}' | grep -iE '<%|response[.]'", "Server pages have closing marks and statements between them."),
    "php": ("strings -t d '{path}' | grep -iE '<[?]php|[$]_'", "Scripts have an opening mark with statements after it."),
    "archive": ("binwalk '{path}'; xxd -s {at} -l 64 '{path}'", "A real archive has a sane version and sizes and lists its members."),
    "pickle": ("python -m pickletools '{path}' | grep -E 'GLOBAL|REDUCE'", "Imports of system modules run code on loading; ask for a tensor-only format."),
    "default": ("file '{path}'; xxd -s {at} -l 256 '{path}'", "Look for readable code around the place."),
}


def recipe_kind(message: Column) -> Column:
    """Which recipe a finding's message calls for."""
    low, chain = F.lower(message), None
    for kind, words in RECIPE_WORDS:
        hit = contains_any(low, words)
        chain = F.when(hit, kind) if chain is None else chain.when(hit, kind)
    return chain.otherwise("default")


def check_recipe(kind: str, path: str, at: int | None) -> tuple[str, str]:
    """How a reader can look at a finding without loading the file, and what to make of it."""
    command, meaning = RECIPES[kind]
    return command.format(path=path.replace("'", "'\\''"), at=at or 0), meaning


def sink_rows(rows: DataFrame) -> DataFrame:
    """What ReportSink takes, from the rows of a scan."""
    verdict = verdicts.of_findings(F.col("findings"))
    keep = ["severity", "message", "location", "technique", "cve", "recommendation", "confidence", "level", "adjusted_severity", "override", "external"]
    listed = F.transform("findings", lambda f: F.struct(*[f[k].alias(k) for k in keep]))
    document = F.to_json(F.struct("path", "format", "length", "sha256", verdict["is_safe"].alias("is_safe"), verdict["max_severity"].alias("max_severity"), listed.alias("findings")))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    first = [F.col("path"), F.col("format"), status(verdict["is_safe"]), F.col("length"), F.col("sha256"), F.col("scan_ms")]
    percent = lambda f: F.concat(F.floor(f["confidence"] * 100).cast("string"), F.lit("%"))
    line = lambda f: F.array(*map(text, [*first, f["severity"], f["adjusted_severity"], percent(f), f["level"], f["message"], f["recommendation"]]))
    alone = F.array(F.array(*map(text, [*first, *[F.lit("")] * 6])))
    lines = F.when(F.size("findings") > 0, F.transform("findings", line)).otherwise(alone)
    added = F.create_map(*[x for n, c in counts().items() for x in (F.lit(n), c)])
    return rows.select(document.alias("json"), lines.alias("csv"), added.alias("counts"))


def save(frames, folder: str, formats: list[str], source: str, limit: int = 10_000, now: datetime | None = None) -> tuple[list[str], dict]:
    """Reports of a scan as documents, in a folder of any store, and the totals: one job makes the JSON document, the CSV file and the totals.

    txt and html are pages of the worst limit files, from the rows that this job left.
    """
    spark = frames.rows.sparkSession
    when = now or datetime.now()
    base = f"{folder.rstrip('/')}/scan_report_{when.strftime('%Y%m%d_%H%M%S')}"
    head = {"report_type": "security_scan", "version": __version__, "source": source, "date": when.isoformat()}
    documents = [k for k in ("json", "csv") if k in formats]
    pages = [k for k in formats if k not in documents]
    rows = frames.rows.persist() if pages else frames.rows
    try:
        spark.dataSource.register(ReportSink)
        sink_rows(rows).write.format("scan_report").mode("append").options(path=base, formats=",".join(documents) or "none", head=json.dumps(head), columns=json.dumps(CSV_COLUMNS)).save()
        fs, inner = place(f"{base}.summary.json")
        with fs.open_input_stream(inner) as f:
            got = totals(json.loads(f.read())["summary"])
        for kind in pages:
            put(f"{base}.{kind}", page(type(frames)(rows), kind, source, got, limit).encode())
    finally:
        if pages:
            rows.unpersist()
    return [f"{base}.{k}" for k in formats], got


def page(frames, kind: str, source: str, totals: dict, limit: int) -> str:
    """The worst limit files with the first PER_FILE findings of each, by severity."""
    worst = verdicts.report_order(frames.files).filter(F.col("position") <= limit).orderBy("position").collect()
    by: dict[str, list] = {}
    if worst:
        paths = frames.rows.sparkSession.createDataFrame([(r["path"],) for r in worst], "path string")
        shown = verdicts.ranked(frames.findings.join(F.broadcast(paths), "path")).filter(F.col("position") <= PER_FILE)
        for r in shown.withColumn("recipe", recipe_kind(F.col("message"))).orderBy("path", "position").collect():
            by.setdefault(r["path"], []).append(r)
    return (page_html if kind == "html" else page_text)(source, totals, worst, by)


def write(files: DataFrame, findings: DataFrame, folder: str, formats: list[str], source: str, limit: int = 10_000, now: datetime | None = None) -> list[str]:
    """Reports of a scan: csv and json as distributed tables, txt and html as pages of the worst limit files with the first PER_FILE findings of each."""
    stamp = (now or datetime.now()).strftime("%Y%m%d_%H%M%S")
    base = os.path.join(folder, f"scan_report_{stamp}")
    out = []
    for kind in formats:
        path = f"{base}.{kind}"
        if kind == "csv":
            csv_rows(files, findings).write.option("header", True).csv(path)
        elif kind == "json":
            json_rows(files, findings).select(F.col("json").alias("value")).write.text(path)
            Path(f"{base}.summary.json").write_text(json.dumps({"report_type": "security_scan", "version": __version__, "source": source, "date": (now or datetime.now()).isoformat(), "summary": summary(files, findings)}, default=str))
        else:
            worst = verdicts.report_order(files).filter(F.col("position") <= limit).orderBy("position").collect()
            shown = findings.join(F.broadcast(files.sparkSession.createDataFrame([(r["path"],) for r in worst], "path string")), "path") if worst else findings.limit(0)
            by: dict[str, list] = {}
            for r in verdicts.ranked(shown).filter(F.col("position") <= PER_FILE).withColumn("recipe", recipe_kind(F.col("message"))).orderBy("path", "position").collect():
                by.setdefault(r["path"], []).append(r)
            Path(path).write_text((page_html if kind == "html" else page_text)(source, summary(files, findings), worst, by))
        out.append(path)
    return out


def page_text(source: str, totals: dict, files: list, findings: dict) -> str:
    lines = ["SECURITY SCAN REPORT", f"Scanned: {source}", f"Files: {totals['total']} ({size_text(totals['bytes'])}), safe {totals['safe']}, unsafe {totals['unsafe']}"]
    lines += [f"Shown: the worst {len(files)} files; the CSV and JSON reports have all"] * (len(files) < totals["total"]) + [""]
    for f in files:
        lines.append(f"[{'SAFE' if f['is_safe'] else 'THREATS DETECTED'}] {f['path']} ({f['format']})")
        for x in findings.get(f["path"], []):
            command, meaning = check_recipe(x["recipe"], f["path"], x["location"])
            lines += [f"  {x['severity'].upper()}: {x['message']}", f"    {x['recommendation']}", f"    check: {command}", f"           {meaning}"]
        if left := f["n_findings"] - len(findings.get(f["path"], [])):
            lines.append(f"  and {left} more of no greater severity; the CSV and JSON reports have all")
    return "\n".join(lines) + "\n"


#: The page's rows can be limited to a severity, a level of confidence and a word.
_FILTER = """<script>
const f = () => { const s = sev.value, l = lev.value, w = word.value.toLowerCase();
document.querySelectorAll('tbody tr').forEach(r => r.hidden = (s && r.dataset.s !== s) || (l && r.dataset.l !== l) || (w && !r.textContent.toLowerCase().includes(w))); };
for (const x of [sev, lev, word]) x.oninput = f;
</script>"""


def page_html(source: str, totals: dict, files: list, findings: dict) -> str:
    """A row for each finding, with its check, and one for each file without any."""
    e = html.escape
    rows = []
    for f in files:
        label = "SAFE" if f["is_safe"] else "THREATS DETECTED"
        for x in findings.get(f["path"], [None]):
            what = check = ""
            if x is not None:
                command, meaning = check_recipe(x["recipe"], f["path"], x["location"])
                what = f"{e(x['severity'])}: {e(x['message'])}<br>{e(x['recommendation'])}"
                check = f"<details><summary>check</summary><code>{e(command)}</code><br>{e(meaning)}</details>"
            severity, level = (x["severity"], x["level"] or "UNANALYZED") if x is not None else ("", "")
            rows.append(f"<tr data-s='{e(severity)}' data-l='{e(level)}'><td>{label}<td>{e(f['path'])}<td>{e(f['format'])}<td>{what}<td>{check}</tr>")
        if left := f["n_findings"] - len(findings.get(f["path"], [])):
            rows.append(f"<tr data-s='' data-l=''><td>{label}<td>{e(f['path'])}<td>{e(f['format'])}<td>and {left} more of no greater severity; the CSV and JSON reports have all<td></tr>")
    choice = lambda name, values: f"<select id='{name}'><option value=''>all</option>{''.join(f'<option>{v}</option>' for v in values)}</select>"
    head = f"<!doctype html><meta charset='utf-8'><title>Scan report</title><h1>Scan of {e(source)}</h1><p>{totals['total']} files ({size_text(totals['bytes'])}), {totals['unsafe']} unsafe"
    head += f"; shown are the worst {len(files)}, the CSV and JSON reports have all</p>" if len(files) < totals["total"] else "</p>"
    return f"{head}<p>severity {choice('sev', totals['by_severity'])} confidence {choice('lev', totals['by_confidence'])} <input id='word' placeholder='word'></p><table><thead><tr><th>Verdict<th>File<th>Format<th>Finding<th>Check</tr></thead><tbody>{''.join(rows)}</tbody></table>{_FILTER}"


def catalogue(names: DataFrame, name: str = "name", summaries: DataFrame | None = None) -> DataFrame:
    """Reports of each time, newest first: formats there are and their number, and the summary's columns where there is one; names that aren't reports are left out.

    summaries: a column stamp, one row for each at most, and others.
    """
    got = names.select(F.regexp_extract(name, NAME, 2).alias("stamp"), F.regexp_extract(name, NAME, 3).alias("format")).filter("stamp <> ''")
    out = got.groupBy("stamp").agg(F.array_join(F.array_sort(F.collect_set("format")), ",").alias("formats"), F.count("*").alias("n"))
    return out if summaries is None else out.join(summaries, "stamp", "left")


def read_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """stamp, total and unsafe of the JSON summaries in a folder of reports."""
    kind = "summary struct<total:bigint,unsafe:bigint>"
    rows = spark.read.schema(kind).option("wholetext", "true").option("multiLine", "true").json(f"{folder}/*_report_*.summary.json")
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), r"_report_(\d{8}_\d{6})[.]summary[.]json$", 1).alias("stamp"), "summary.total", "summary.unsafe")


def expired(names: DataFrame, now: Column, days: int, mtime: str = "mtime") -> DataFrame:
    """Reports last changed more than days ago."""
    return names.filter(F.col(mtime) < now - F.make_dt_interval(F.lit(days)))


def prune(folder: str, days: int, now: datetime | None = None) -> list[str]:
    """Removes reports older than days, and parts that failed ones left, from a folder of any store, and nothing else."""
    from pyarrow.fs import FileSelector, FileType

    cutoff = ((now or datetime.now()) - timedelta(days=days)).timestamp()
    fs, inner = place(folder)
    known = re.compile(NAME.removesuffix("(txt|json|html|csv)$") + r"(txt|summary\.json|json|html|csv)$")
    for i in fs.get_file_info(FileSelector(inner)):
        if re.search(r"\.parts-[0-9a-f]+$", i.base_name) and i.type == FileType.Directory and i.mtime_ns / 1e9 < cutoff:
            fs.delete_dir(i.path)
    gone = [i for i in fs.get_file_info(FileSelector(inner)) if known.match(i.base_name) and i.type == FileType.File and i.mtime_ns / 1e9 < cutoff]
    for i in gone:
        fs.delete_file(i.path)
    return sorted(f"{folder.rstrip('/')}/{i.base_name}" for i in gone)
