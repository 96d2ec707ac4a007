"""Scans of files written byte by byte; nothing is ever loaded or run."""

import base64
import csv
import json
import os
import pickle
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from flintglass import cli, config
from flintglass.operators import containers, context, pickles, verdicts
from flintglass.operators.obfuscation import entropy_of
from flintglass.plans import reports
from flintglass.plans.scan import scan_directory, walk, with_external
from flintglass.sources.artifacts import from_directory

CALL = b"\x80\x04\x95" + (30).to_bytes(8, "little") + b"\x8c\x02os\x94\x8c\x06system\x94\x93\x94\x8c\x02ls\x94\x85\x94R\x94."
PNG = b"\x89PNG\r\n\x1a\n" + bytes(40) + b"IEND\xaeB`\x82"


def safetensors(header: dict, data: bytes = b"") -> bytes:
    h = json.dumps(header).encode()
    return len(h).to_bytes(8, "little") + h + data


def gguf(key: str, value: str, version: int = 3, tensors: int = 1) -> bytes:
    k, v = key.encode(), value.encode()
    return b"GGUF" + version.to_bytes(4, "little") + tensors.to_bytes(8, "little") + (1).to_bytes(8, "little") + len(k).to_bytes(8, "little") + k + (8).to_bytes(4, "little") + len(v).to_bytes(8, "little") + v


def zipped(path, names: dict[str, bytes], tail: bytes = b""):
    with zipfile.ZipFile(path, "w") as z:
        for n, d in names.items():
            z.writestr(n, d)
    with open(path, "ab") as f:
        f.write(tail)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("models")
    files = {
        "safe.pkl": b"\x80\x04}.", "call.pkl": CALL, "global.pkl": b"cos\nsystem\np0\n(S'ls'\ntR.", "sys.pkl": b"csys\nexit\n.", "nested.pkl": b"cpickle\nloads\n.",
        "bad.pkl": b"\x80\x04\xff\xff\xff", "empty.pkl": b"", ".hidden.pkl": b"\x80\x04N.", "_under.pkl": b"\x80\x04N.",
        "seven.bin": bytes.fromhex("377ABCAF271C") + bytes(26) + CALL,
        "good.safetensors": safetensors({"__metadata__": {"a": "b"}, "t": {"dtype": "F32", "shape": [1], "data_offsets": [0, 4]}}, bytes(4)),
        "eval.safetensors": safetensors({"__metadata__": {"x": "eval(1)", "y": base64.b64encode(CALL[:30]).decode()}}),
        "short.safetensors": safetensors({"t": {"data_offsets": [0, 400]}}, bytes(4)),
        "odd.safetensors": safetensors({"t": {"data_offsets": [3, 1]}, "u": {"data_offsets": ["a", 1]}, "v": 7}, bytes(4)),
        "size.safetensors": (500_000_000).to_bytes(8, "little") + b"{}",
        "ok.gguf": gguf("tokenizer.chat_template", "{{ message }}"), "bad.gguf": gguf("tokenizer.chat_template", "{{ x.__class__.__mro__ }}"), "magic.gguf": b"\xef\xbe\xad\xde", "many.gguf": gguf("a", "b", 9, 1 << 63),
        "up.onnx": b"\x08\x07\x12\x08onnx.ai\x01../../etc/passwd\x01", "etc.onnx": b"\x08\x07\x01/etc/shadow.conf\x01",
        "lambda.h5": b"\x89HDF\r\n\x1a\n" + bytes(8) + b'{"class_name": "Lambda", "function": "eval(x)"}', "plain.h5": b"\x89HDF\r\n\x1a\n" + bytes(8),
        "evil.yaml": b"a: !!python/object/apply:os.system\nb: 1\n", "fine.yaml": b"model: x\ntraining: y\n", "prose.yaml": b"just words",
        "flow.json": json.dumps({"last_node_id": 2, "links": [], "nodes": [{"id": 1, "type": "HueAdjust", "widgets_values": ["eval (1)", 3]}]}).encode(),
        "data.json": b'{"a": 1}', "broken.json": b"{", "latin.json": b"\xff\xfe{",
        "pic.png": PNG, "zip.png": PNG + bytes(20) + b"PK\x03\x04" + bytes(40), "pickle.png": PNG + bytes(20) + CALL, "fake.jpg": CALL, "model.pkl.png": PNG,
        "script.svg": b"<svg><script>var a = 1;</script></svg>", "clean.svg": b"<svg></svg>",
        "clip.mp4": bytes(200) + b"7z\xbc\xaf\x27\x1c" + bytes(50), "code.mp4": bytes(200) + b"<?php $a = eval($x); ?>",
        "doc.pdf": b"%PDF-1.4 ... %%EOF\n", "strange.weights": CALL, "strange.xyz": b"nothing known here",
    }
    for n, b in files.items():
        (d / n).write_bytes(b)
    zipped(d / "model.pt", {"archive/data.pkl": CALL, "archive/version": b"3"})
    zipped(d / "tail.zip", {"notes.txt": b"x"}, CALL)
    zipped(d / "slip.zip", {"../up.pkl": b"\x80\x04N."})
    (d / "sub").mkdir()
    (d / "sub" / "deep.pkl").write_bytes(CALL)
    return d


@pytest.fixture(scope="module")
def scanned(spark, folder):
    frames = scan_directory(spark, str(folder), extensions="*")
    by: dict[str, list] = {}
    for r in frames.findings.collect():
        by.setdefault(os.path.relpath(r.path, folder), []).append(r)
    return {os.path.relpath(r.path, folder): r for r in frames.files.collect()}, by


EXPECTED = {
    "safe.pkl": True, "call.pkl": False, "global.pkl": False, "sys.pkl": False, "nested.pkl": False, "bad.pkl": True, "empty.pkl": True, "seven.bin": False,
    "good.safetensors": True, "eval.safetensors": False, "short.safetensors": True, "odd.safetensors": False, "size.safetensors": False,
    "ok.gguf": True, "bad.gguf": False, "magic.gguf": False, "many.gguf": False, "up.onnx": False, "etc.onnx": False, "lambda.h5": False, "plain.h5": True,
    "evil.yaml": False, "fine.yaml": True, "prose.yaml": True, "flow.json": False, "data.json": True, "broken.json": True, "latin.json": True,
    "pic.png": True, "zip.png": False, "pickle.png": False, "fake.jpg": False, "model.pkl.png": True, "script.svg": False, "clean.svg": True,
    "clip.mp4": False, "code.mp4": False, "doc.pdf": True, "strange.weights": False, "strange.xyz": True, "model.pt": False, "tail.zip": False, "slip.zip": False, "sub/deep.pkl": False,
}


def test_verdicts(scanned):
    files, _ = scanned
    assert {n: files[n].is_safe for n in EXPECTED} == EXPECTED
    assert {".hidden.pkl", "_under.pkl", "empty.pkl"} <= set(files)


RULES = {
    "call.pkl": ("pickle.known_call", "critical"), "sys.pkl": ("pickle.module", "high"), "nested.pkl": ("pickle.nested", "high"), "bad.pkl": ("pickle.invalid", "medium"), "empty.pkl": ("pickle.invalid", "medium"),
    "seven.bin": ("archive.7z_pickle", "critical"), "eval.safetensors": ("metadata.base64", "critical"), "short.safetensors": ("safetensors.truncated", "medium"), "odd.safetensors": ("safetensors.tensor", "high"), "size.safetensors": ("safetensors.error", "high"),
    "ok.gguf": ("template.present", "info"), "bad.gguf": ("template.__mro__ access", "critical"), "magic.gguf": ("gguf.error", "critical"), "many.gguf": ("gguf.tensors", "high"),
    "up.onnx": ("onnx.traversal", "critical"), "etc.onnx": ("onnx.path", "high"), "lambda.h5": ("keras.lambda_layer", "high"), "evil.yaml": ("yaml_tag.Python function application", "critical"), "fine.yaml": ("yaml.ml_config", "info"), "prose.yaml": ("yaml.not_yaml", "info"),
    "flow.json": ("workflow.node", "critical"), "data.json": ("workflow.other", "info"), "broken.json": ("workflow.invalid", "info"), "zip.png": ("polyglot.archive_in_image", "critical"), "pickle.png": ("polyglot.pickle_in_image", "critical"), "fake.jpg": ("polyglot.pickle_as_media", "critical"),
    "model.pkl.png": ("polyglot.double_extension", "medium"), "script.svg": ("svg.script_tag", "critical"), "clip.mp4": ("polyglot.archive_in_video", "critical"), "code.mp4": ("video_metadata.php_code", "critical"),
    "tail.zip": ("archive.trailing_pickle", "critical"), "slip.zip": ("archive.zipslip", "critical"), "model.pt": ("archive.summary", "info"), "strange.xyz": ("file.unknown", "info"),
}


@pytest.mark.parametrize("name", sorted(RULES))
def test_rule(scanned, name):
    assert RULES[name] in {(r.rule, r.severity) for r in scanned[1][name]}


def test_advice_context_and_duplicates(scanned):
    _, by = scanned
    assert all(r.recommendation for found in by.values() for r in found)
    assert all(r.confidence is not None and r.adjusted_severity.startswith(r.severity) for r in by["script.svg"] if r.severity in ("critical", "high"))
    assert all(r.confidence is None for r in by["call.pkl"])
    assert [r.rule for r in by["model.pt"]].count("pickle.known_call") == 1
    assert by["call.pkl"][0].recommendation.startswith("DO NOT LOAD")


def test_two_members_give_their_own_findings(spark, tmp_path):
    zipped(tmp_path / "two.pt", {"a.pkl": CALL, "b/data.pkl": CALL, "c.pkl": CALL + b"x"})
    found = [r for r in scan_directory(spark, str(tmp_path)).findings.collect() if r.rule == "pickle.known_call"]
    data = (tmp_path / "two.pt").read_bytes()
    assert {r.member for r in found} == {"a.pkl", "b/data.pkl", "c.pkl"} and all(data[r.location : r.location + 1] == b"\x93" for r in found)


def test_a_member_too_large_is_said(monkeypatch, tmp_path):
    zipped(tmp_path / "m.pt", {"data.pkl": b"N" * 1000 + CALL})
    monkeypatch.setattr(containers.members, "__defaults__", (100,))
    found, _ = walk("m.pt", "pickle", (tmp_path / "m.pt").read_bytes())
    assert [(f["severity"], f["member"]) for f in found if f["rule"] == "archive.unscanned"] == [("high", "data.pkl")]


def test_one_pass(spark, folder):
    """A view scans the source once, without a shuffle; its code compiles."""
    frames = scan_directory(spark, str(folder), extensions="*")
    for view in (frames.files, frames.findings):
        plan = view._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BatchScan") == 1 and "Exchange" not in plan and "Join" not in plan


def test_lines_versions_and_external_verdicts(spark, scanned):
    _, by = scanned
    assert [r.lines for r in by["evil.yaml"] if r.rule.startswith("yaml_tag")][0] == [1]
    assert "ONNX IR version: 7" in {r.message for r in by["up.onnx"]}
    frames = spark.createDataFrame([("p", "svg.x", "critical", "HIGH", "critical-HIGH"), ("q", "svg.x", "critical", "HIGH", "critical-HIGH"), ("r", "pickle.y", "high", None, None)], "path string, rule string, severity string, level string, adjusted_severity string")
    external = spark.createDataFrame([("p", "svg.x", "not_confirmed"), ("q", "svg.x", "confirmed"), ("r", "pickle.y", "not_confirmed")], "path string, rule string, status string")
    assert {(r.path, r.adjusted_severity, r.override) for r in with_external(frames, external).collect()} == {("p", "critical-LOW", True), ("q", "critical-HIGH", False), ("r", None, False)}


def test_window_entropy(spark):
    data = [bytes(1000), bytes(range(256)) * 4, b"", os.urandom(700), b"abcabd"]
    got = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "i int, d binary").select("i", context.window_entropy(F.col("d")).alias("e")).collect()
    assert all(abs(r.e - entropy_of(data[r.i])) < 1e-8 for r in got)


def test_report_order_is_exact(spark):
    rows = [(f"p{i * 7919 % 500:03d}", i % 5 > 0, "critical" if i % 10 == 0 else "high" if i % 5 == 0 else None, (i % 3) / 2) for i in range(500)]
    files = spark.createDataFrame(rows, "path string, is_safe boolean, max_severity string, max_confidence double")
    got = {r.path: r.position for r in verdicts.report_order(files, pieces=7).collect()}
    want = sorted(rows, key=lambda r: (r[1], {"critical": 0, "high": 1}.get(r[2], 9), 0 if r[1] else -r[3], r[0]))
    assert [got[r[0]] for r in want] == list(range(1, 501))
    assert verdicts.report_order(files.limit(0)).count() == 0


def test_strict_keeps_repeats(folder):
    data = (folder / "model.pt").read_bytes()
    count = lambda both: sum(i["module"] == "os" for s in both[1] for i in s["imports"])
    assert count(walk("m", "pickle", data, strict=True)) == 2 and count(walk("m", "pickle", data)) == 1


def test_source_options(spark, folder):
    names = lambda df: {os.path.basename(r.path) for r in df.select("path").collect()}
    assert "deep.pkl" not in names(from_directory(spark, str(folder), recursive=False))
    assert names(from_directory(spark, str(folder), extensions=".gguf")) == {"ok.gguf", "bad.gguf", "magic.gguf", "many.gguf"}
    assert from_directory(spark, str(folder), columns="path,length").columns == ["path", "length"]
    row = from_directory(spark, str(folder / "missing")).first()
    assert row.read_error.startswith("Directory not found")


def test_reports_and_cli(spark, folder, tmp_path, capsys):
    assert cli.main(["scan", str(folder / "sub"), "--json", "--report-dir", str(tmp_path), "--report-formats", "txt,html,csv,json"], spark) == 1
    made = sorted(p.name.split(".", 1)[1] for p in tmp_path.iterdir())
    assert made == ["csv", "html", "json", "summary.json", "txt"]
    whole = json.loads(next(tmp_path.glob("*[0-9].json")).read_text())
    assert whole["summary"]["total"] == whole["summary"]["unsafe"] == 1 and [r["is_safe"] for r in whole["results"]] == [False] and whole["results"][0]["findings"]
    text = next(tmp_path.glob("*.txt")).read_text()
    assert "THREATS DETECTED" in text and "os.system" in text and "strings -t d" in text
    page = next(tmp_path.glob("*.html")).read_text()
    assert "<details>" in page and "data-s='critical'" in page
    kept = reports.read_summaries(spark, str(tmp_path)).collect()
    assert [(r.total, r.unsafe) for r in kept] == [(1, 1)] and cli.main(["version"]) == 0
    with open(next(tmp_path.glob("*.csv"))) as f:
        lines = list(csv.reader(f))
    assert lines[0] == reports.CSV_COLUMNS and len(lines) == 1 + len(whole["results"][0]["findings"]) and {x[2] for x in lines[1:]} == {"THREATS DETECTED"}
    old = tmp_path / "scan_report_20200101_000000.txt"
    old.write_text("x")
    os.utime(old, (0, 0))
    assert reports.prune(str(tmp_path), 30) == [str(old)]
    assert cli.main(["info"]) == 0 and cli.main(["config"]) == 0
    (tmp_path / "c.toml").write_text("[scan]\nstrict = true\n")
    assert config.load(str(tmp_path / "c.toml"))["scan"] == {**config.DEFAULTS["scan"], "strict": True}


def test_stream_sees_each_file_once(spark, tmp_path):
    from flintglass.streaming.incremental import scan_folder_stream

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.pkl").write_bytes(CALL)
    go = lambda: scan_folder_stream(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    go()
    first = spark.read.parquet(str(tmp_path / "out")).count()
    (src / "b.pkl").write_bytes(b"csys\nexit\n.")
    go()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.filter("path like '%a.pkl'").count() == first > 0 and out.filter("path like '%b.pkl'").count() > 0


def test_opcodes_of_large_streams():
    blob = b"\x80\x04" + b"\x8e" + (2 << 20).to_bytes(8, "little") + bytes(2 << 20) + b"0" + CALL[11:]
    m = pickles.Imports()
    assert [f for n, a, _ in pickles.opcodes(blob) if (f := m.feed(n, a))] == [("os", "system")]


def test_memoised_names():
    data = b"\x80\x04\x8c\x02os\x94\x8c\x06system\x940" + b"0" + b"h\x00h\x01\x93."
    m = pickles.Imports()
    assert [f for n, a, _ in pickles.opcodes(data) if (f := m.feed(n, a))] == [("os", "system")]


def test_entropy_and_regions():
    assert entropy_of(bytes(1000)) == 0.0 and entropy_of(bytes(range(256)) * 4) == 8.0 and entropy_of(b"") == 0.0
    packed = zlib.compress(b"a" * (8 << 20))
    assert containers.compressed_regions(b"__" + packed)[0][:2] == ("zlib_default2", 2)
    assert containers.pickle_starts(CALL, 0) and not containers.pickle_starts(b"\x80\x04\x95" + bytes(20), 0)


def test_long_lines_of_large_streams_are_read():
    for line in (b"V" + b"x" * 5000 + b"\n", b"L" + b"1" * 5000 + b"L\n"):
        data = line + b"0cos\nsystem\n" + b"B" + (1 << 20).to_bytes(4, "little") + bytes(1 << 20) + b"."
        assert len(data) > pickles.LARGE
        assert pickles.facts(data)["imports"] == [{"module": "os", "name": "system", "pos": len(line) + 1}]


def test_streams_are_walked_once_as_genops_reads_them(monkeypatch):
    """The facts and errors of genops, by one walk; a number of thousands of digits hides nothing behind it."""
    import pickletools

    long = b"\x8b" + (4000).to_bytes(4, "little") + b"\x11" * 4000
    streams = [b"cos\nsystem\n(S'ls'\ntR.", b"cos\\x41\nsystem\nR.", b"cos\xff\nsystem\nR.", b"cos\nsystem", b"(ios\nsystem\n.", b"NN\xff.", b"N", b"0c\n\nR.", b"I1\nI01\nFx\n."]
    streams += [pickle.dumps(x, p) for x in ([1, "x", (2.5, None)], {"a": os.path.join}, 10**50) for p in range(6)]
    for data in streams:
        want, why = [], None
        try:
            for op, arg, pos in pickletools.genops(data):
                want.append((op.name, None if arg is None else str(arg), pos))
        except Exception as e:  # noqa: BLE001
            why = f"Parse error: {e}"
        assert list(pickles.opcodes(data)) == want
        machine = pickles.Imports()
        imports = [{"module": f[0], "name": f[1], "pos": pos} for name, arg, pos in want if (f := machine.feed(name, arg))]
        made = pickles.facts(data)
        assert (made["defect"], made["imports"], made["calls"]) == (why, imports, sum(name == "REDUCE" for name, _, _ in want))
    assert pickles.facts(long + b"0cos\nsystem\nR.")["imports"] == [{"module": "os", "name": "system", "pos": 4006}]
    monkeypatch.setattr(pickletools, "genops", None)
    assert pickles.facts(b"cos\nsystem\nRcos\nsystem\nR.", once=True) == {"defect": None, "imports": [{"module": "os", "name": "system", "pos": 0, "n": 2}], "ops": [], "calls": 2, "first_call": 11}


def test_batches_count_what_walks_found():
    """A small stream can have far more findings than bytes: they count towards the size at which a batch ends."""
    from flintglass.plans.scan import _bytes_of, _one

    row = {"path": "a.pkl", "suffix": ".pkl", "format": "pickle", "length": 0, "sha256": None, "read_error": None, "head": b"c", "tail": None}
    assert _bytes_of(_one(row | {"content": b"cos\nsystem\n" * 1000 + b"."}, False)) > 200_000 > _bytes_of(_one(row | {"content": b"."}, False))
