"""Large files, stores, listings and streams: the same findings by every way, at constant memory."""

import base64
import gzip
import json
import os
import random
import re
import struct
import subprocess
import sys
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from flintglass.functions import signatures as S
from flintglass.functions.rules import latin1
from flintglass.operators import containers, large, obfuscation
from flintglass.plans.scan import scan, scan_directory
from flintglass.sources import artifacts
from flintglass.sources.ranged import Forward, Ranged
from tests.test_scan import CALL, PNG, folder, gguf, safetensors, zipped  # noqa: F401 - folder is a fixture

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def rows(frames, root="") -> set:
    return {(r.path.removeprefix("file://").removeprefix(str(root)), r.rule, r.severity, r.message, r.location, r.hits, r.member, tuple(r.lines or ()), r.confidence, r.adjusted_severity) for r in frames.findings.collect()}


@pytest.fixture(scope="module")
def more(folder):  # noqa: F811
    """The files of the scan's tests, and some whose rules look at the whole content."""
    words = "\n".join(f"w{i}: value {i}" for i in range(300))
    files = {
        "long.yaml": f"{words}\r\nscript: |\r\n  é eval\r\nv: $(date)\r\nx: !!python/name:y\r\ncommand: 'ls'\n", "ml.yaml": "model: a\ntraining: b\n", "datasets.yaml": "- x\n",
        "many.json": json.dumps({"nodes": [{"id": i, "type": "HueAdjust" if i % 7 == 0 else "Plain", "widgets_values": ["eval (x)" if i % 5 == 0 else "é", 3]} for i in range(40)], "links": [1], "last_node_id": 40}),
        "list.json": "[1, 2]", "numbers.json": '{"nodes": 3, "links": []}',
    }
    for n, t in files.items():
        (folder / n).write_text(t)
    (folder / "layers.h5").write_bytes(b"\x89HDF\r\n\x1a\n" + bytes(3000) + b'{"Lambda": "function", "custom_objects": "eval (x) __import__"}' + os.urandom(100))
    (folder / "refs.onnx").write_bytes(b"\x08\x07" + b"".join(b"\x01" + r for r in (b"weights/a.bin", b"../up.data", b"plain words here", b"/home/u/.ssh/id_rsa", b"/=zT[=v", b"C:\\tmp\\secret", b"--.-.")) + b"\x01")
    (folder / "seven.png").write_bytes(PNG + bytes(2000) + bytes.fromhex("377ABCAF271C") + b"<?php eval($x); ?>" + bytes(300))
    (folder / "tail.jpg").write_bytes(b"\xff\xd8\xff" + bytes(30) + b"\xff\xd9" + bytes(40))
    (folder / "tail.gif").write_bytes(b"GIF89a" + bytes(30) + b";" + b"PK\x03\x04" + bytes(40))
    (folder / "stack.pdf").write_bytes(b"%PDF-1.4 x %%EOF\n\n" + CALL)
    (folder / "big.pkl").write_bytes(b"B" + (9 << 17).to_bytes(4, "little") + bytes(9 << 17) + b"0cos\nsystem\n(S'ls'\ntR.")
    zipped(folder / "weights.pt", {"data.pkl": CALL, "weights": os.urandom(9 << 17)})
    return folder


@pytest.fixture(scope="module")
def by_path(spark, more):
    return rows(scan_directory(spark, str(more), extensions="*"), more)


def test_files_that_are_no_column_get_the_same_findings(spark, more, by_path):
    found = rows(scan_directory(spark, str(more), extensions="*", max_content=10), more)
    # the entropy, encodings and generated media of a file's first bytes are found either way
    assert found == by_path and not any(r[1] == "file.unscanned" for r in found)
    assert {"/many.json", "/layers.h5", "/refs.onnx", "/seven.png", "/stack.pdf", "/big.pkl", "/weights.pt"} <= {r[0] for r in found if r[2] in ("critical", "high")}


def test_files_behind_a_scheme(spark, more, by_path):
    """By URL the same files, empty and hidden ones too, give the same findings; so do files that are no column."""
    assert rows(scan_directory(spark, f"file://{more}", extensions="*"), more) == by_path
    assert rows(scan_directory(spark, f"file://{more}", extensions="*", max_content=10), more) == by_path
    assert scan_directory(spark, "file:///no/such/folder").files.first().path == "file:///no/such/folder"


def test_forms_of_a_url(tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / ".a.pkl").write_bytes(b"N.")
    for root in (f"file://{tmp_path}", f"file:{tmp_path}", f"file://{tmp_path}/"):
        found = artifacts.Folder(root)
        assert found.kind() == "folder" and [f.path for f in found.walk()] == [f"file://{tmp_path}/d/.a.pkl"]
        one = artifacts.Folder(f"file://{tmp_path}/d/.a.pkl")
        assert one.kind() == "file" and [f.length for f in one.walk()] == [2]


def test_a_store_that_only_spark_reaches(spark, tmp_path, monkeypatch):
    (tmp_path / "call.pkl").write_bytes(CALL)

    def none(root):
        raise ValueError("Unrecognized filesystem type")

    monkeypatch.setattr(artifacts, "store", none)
    assert {os.path.basename(r.path): r.is_safe for r in scan_directory(spark, f"file://{tmp_path}").files.collect()} == {"call.pkl": False}


def test_what_cannot_be_reached_is_never_safe():
    from flintglass.plans.scan import _one

    for path, fmt in (("nosuch://host/a.pkl", "pickle"), ("/no/such/file.pkl", "pickle"), ("nosuch://host/a.png", "image"), ("nosuch://host/a.yaml", "yaml")):
        row = {"path": path, "suffix": os.path.splitext(path)[1], "format": fmt, "length": 10, "sha256": None, "read_error": None, "head": None, "tail": None, "content": None}
        assert [(f["rule"], f["severity"]) for f in _one(row, False)["walked"]] == [("file.unscanned", "high")]


def test_a_tree_listed_by_executors(spark, tmp_path, monkeypatch):
    for i in range(40):
        d = tmp_path / f"d{i % 4}" / f"e{i % 3}"
        d.mkdir(parents=True, exist_ok=True)
        (d / f"f{i}.pkl").write_bytes(CALL if i % 2 else b"")
        (d / f"g{i}.other").write_bytes(b"x")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "_x.pkl").write_bytes(b"\x80\x04N.")
    want = rows(scan_directory(spark, str(tmp_path)))
    assert len(want) > 40
    monkeypatch.setattr(artifacts, "PROBE", 5)
    for root in (str(tmp_path), f"file://{tmp_path}"):
        made = artifacts.from_directory(spark, root)
        assert "MapInArrow" in made._jdf.queryExecution().executedPlan().toString()
        assert rows(scan(made)) == want
    listed = artifacts.listed_by_executors(spark, str(tmp_path))
    assert listed.count() == 41 and artifacts.listed_by_executors(spark, str(tmp_path), extensions="*").count() == 81
    assert artifacts.read_listed(listed, columns="path,length").columns == ["path", "length"]
    assert artifacts.from_directory(spark, str(tmp_path), recursive=False).count() == 0


def test_filters_reach_the_reader(spark, more):
    df = artifacts.from_directory(spark, str(more), extensions="*", columns="path,length,content")
    only = df.filter("path like '%.gguf' and length > 5")
    assert {os.path.basename(r.path) for r in only.collect()} == {"ok.gguf", "bad.gguf", "many.gguf"}
    plan = only._jdf.queryExecution().executedPlan().toString()
    assert "EndsWith" not in plan.partition("BatchScan")[0]  # Spark doesn't look at the path again
    from pyspark.sql.datasource import GreaterThan, IsNotNull, StringEndsWith

    reader = artifacts.FilteringReader({"path": str(more), "extensions": "*"}, ["path", "content"])
    left = list(reader.pushFilters([StringEndsWith(("path",), ".gguf"), GreaterThan(("length",), 5), IsNotNull(("path",))]))
    assert [type(f).__name__ for f in left] == ["GreaterThan", "IsNotNull"]
    assert {os.path.basename(f.path) for p in reader.partitions() for f in p.files} == {"ok.gguf", "bad.gguf", "many.gguf"}


def test_stream_sees_each_version_once(spark, tmp_path):
    from flintglass.streaming.incremental import scan_folder_stream

    src = tmp_path / "in"
    src.mkdir()
    for n, b in (("a.pkl", CALL), (".h.pkl", b"csys\nexit\n."), ("empty.pkl", b"")):
        (src / n).write_bytes(b)
    for root in (str(src), f"file://{src}"):
        where = tmp_path / root[:4].strip("/").replace(":", "")
        go = lambda: scan_folder_stream(spark, root, str(where / "out"), str(where / "cp"), max_files=2).awaitTermination()  # noqa: B023, E731
        for _ in range(3):
            go()
        seen = {(r.path.rpartition("/")[2], r.rule): r.n for r in spark.read.parquet(str(where / "out")).groupBy("path", "rule").count().withColumnRenamed("count", "n").collect()}
        assert {"a.pkl", ".h.pkl", "empty.pkl"} == {p for p, _ in seen} and set(seen.values()) == {1}
        go()
        before = spark.read.parquet(str(where / "out")).count()
        (src / "b.pkl").write_bytes(b"csys\nexit\n.")
        os.utime(src / "empty.pkl", (1e9, 1e9 + len(root)))
        go()
        go()
        fresh = spark.read.parquet(str(where / "out"))
        assert fresh.count() > before and fresh.filter("path like '%b.pkl'").count() > 0 and fresh.filter("path like '%empty.pkl'").count() == 2
        (src / "b.pkl").unlink()


def test_ranges_are_like_bytes(monkeypatch):
    from flintglass.sources import ranged

    monkeypatch.setattr(ranged, "WINDOW", 64)
    monkeypatch.setattr(ranged, "BLOCK", 256)
    rnd = random.Random(1)
    for _ in range(60):
        data = bytes(rnd.choice(b"ab\n") for _ in range(rnd.randrange(900)))
        r = Ranged.of(data)
        for _ in range(20):
            a, b = rnd.randrange(-5, 950), rnd.randrange(-5, 950)
            mark = bytes(rnd.choice(b"ab\n") for _ in range(rnd.randrange(1, 9)))
            assert r[a:b] == data[a:b] and r.find(mark, max(0, a)) == data.find(mark, max(0, a)) and r.rfind(mark, max(0, a)) == data.rfind(mark, max(0, a))
            assert r.part(max(0, a), max(0, b))[:] == data[max(0, a) :][: max(0, b)]
        for f in (Forward.over(data), Forward(iter([data[i : i + 37] for i in range(0, len(data), 37)]))):
            at = 0
            while at < len(data):
                n = rnd.randrange(1, 100)
                if rnd.random() < 0.3:
                    assert f.peek(n) == data[at : at + n]
                elif rnd.random() < 0.5:
                    assert f.take(n) == data[at : at + n]
                    at = min(len(data), at + n)
                elif f.skip(n):
                    at += n
                else:
                    break
            assert f.rest() == data[-16:]


def test_block_search_equals_a_search_of_the_whole(monkeypatch):
    monkeypatch.setattr(large, "OVERLAP", 64)
    monkeypatch.setattr(large, "STEP", 200)
    rnd = random.Random(5)
    bits = ["eval (", "exec\n(", "lambda :", "__import__", " os.system", "xx", "\n", "python: |\n", " é", "\r\n", "\r", "command: 'ls'", "$(a b)", "custom_objects", "Lambda function", ": ", "- a\n", "\\x41"]
    for _ in range(150):
        raw = "".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 120))).encode()
        for rules, utf8, flags in ((S.KERAS_PATTERNS, False, 0), (S.YAML_BLOCKS + S.YAML_SHELL, True, re.M), (S.INPUT_PATTERNS, True, 0)):
            made = [large.Rule(*r, flags) for r in rules]
            large.search(large.texts(Ranged.of(raw), utf8), made)
            text = raw.decode().replace("\r\n", "\n").replace("\r", "\n") if utf8 else raw.decode("latin-1")
            for r, (_, _, pattern) in zip(made, rules, strict=True):
                found = list(re.compile(pattern, re.A | flags).finditer(text))
                assert (r.n, r.at) == (len(found), found[0].start() if found else None)
                assert r.lines == [text.count("\n", 0, m.start()) + 1 for m in found[:10]]


def test_encoded_content_is_found_in_whole_files(spark, tmp_path):
    """Behind the first MiB, in a run over many blocks, and of a file that is no column."""
    code = base64.b64encode(b"import os; os.system('ls')")
    escape, packed, hexed = rb"\x41" * 12, zlib.compress(b"z" * 40_000 + random.Random(1).randbytes(100_000)), b"exec".hex().encode() * 12
    plain = b"words of a text, and " * 60_000
    for name, rest in (("a.dat", code), ("c.dat", escape), ("d.dat", packed), ("e.dat", base64.b64encode(b"x" * 200_001 + b"subprocess")), ("f.dat", random.Random(2).randbytes(8 << 20)), ("g.dat", b"")):
        (tmp_path / name).write_bytes(plain + rest)
    (tmp_path / "b.pkl").write_bytes(b"\x80\x02X" + (len(plain) + 98).to_bytes(4, "little") + plain + b"'" + hexed + b"'.")
    want = {"/a.dat": "base64", "/b.pkl": "hex", "/c.dat": "escapes", "/d.dat": "compressed", "/e.dat": "base64", "/f.dat": "entropy"}
    for more in ({}, {"max_content": 1000}):
        found = rows(scan_directory(spark, str(tmp_path), extensions="*", **more), tmp_path)
        kinds = {(p, r.split(".")[1]) for p, r, *_ in found if r.startswith("obfuscation.")}
        assert kinds - {("/f.dat", "compressed")} == set(want.items())


def test_runs_over_blocks_are_like_those_of_the_whole(spark, monkeypatch):
    made = random.Random(5)
    parts = [lambda: base64.b64encode(made.randbytes(made.randrange(60)) + made.choice([b"", b"import ", b"__"]) + made.randbytes(made.randrange(9))).rstrip(b"=") + b"=" * made.randrange(4), lambda: made.choice([b"exec", b"os.", b"no"]).hex().encode() * made.randrange(3, 30) + b"a" * made.randrange(2), lambda: rb"\x4f" * made.randrange(30), lambda: rb"\u004f" * made.randrange(12), lambda: rb"\101" * made.randrange(30), lambda: made.choice([b" ", b"\\", b"\n=", b"", b"\xe9"])]
    texts = [b"".join(made.choice(parts)() for _ in range(made.randrange(1, 60))) for _ in range(150)]
    shown = spark.createDataFrame(list(enumerate(texts)), "i int, data binary")
    want = {r.i: [(f["rule"], f["severity"], f["message"], f["hits"]) for f in r.f] for r in shown.select("i", obfuscation.rollup(latin1(F.col("data"))).alias("f")).collect()}
    for step in (1, 7, 64, 1000):
        monkeypatch.setattr(large, "STEP", step)
        for i, t in enumerate(texts):
            assert [(f["rule"], f["severity"], f["message"], f["hits"]) for f in large.coded(Ranged.of(t))] == want[i], (i, step)
    assert {f[0] for w in want.values() for f in w} == {"obfuscation.base64", "obfuscation.hex", "obfuscation.escapes"}


def test_streams_of_any_length_are_found_by_blocks(monkeypatch):
    long = zlib.compress(random.Random(3).randbytes(300_000), 9)
    data = b"_" * 9 + long + b"x\x9c" + zlib.compress(b"a" * 50) + gzip.compress(b"b" * (9 << 20), mtime=0)
    want = containers.compressed_regions(data)
    assert [(k, n) for k, _, n in want] == [("zlib_default2", 50), ("zlib_best", 300_000), ("gzip", 9 << 20)]
    for size in (1, 2, 3, 1000):
        monkeypatch.setattr(Ranged.blocks, "__defaults__", (0, size))
        assert containers.compressed_regions(Ranged.of(data if size > 3 else data[-500:])) == (want if size > 3 else containers.compressed_regions(data[-500:]))
    assert containers.compressed_regions(long[:-1]) == []


def test_every_literal_is_in_every_match():
    for table in (S.KERAS_PATTERNS, S.YAML_TAGS, S.YAML_BLOCKS, S.YAML_SHELL, S.INPUT_PATTERNS, S.IMAGE_PATTERNS, S.SVG_PATTERNS):
        assert all(large.literal(p) for _, _, p in table)
    assert large.literal("ab?cd") == "cd" and large.literal("a|b") == "" and large.literal(r"x\.y(z|w)") == "x.y" and large.literal("ab*") == "a"


MEASURED = """
import resource, sys
sys.path.insert(0, {repo!r})
from flintglass.operators import containers
from flintglass.plans.scan import _searched, walk
data = containers.content_of({path!r}, 1 << 30, None)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
found = {call}
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before, sorted({{f["rule"] for f in found}}))
"""


def measured(path, call: str) -> tuple[int, str]:
    """MB of memory that a walk adds, and its rules."""
    out = subprocess.run([sys.executable, "-c", MEASURED.format(repo=REPO, path=str(path), call=call)], capture_output=True, text=True, check=True, timeout=300).stdout
    kb, _, rules = out.partition(" ")
    return int(kb) // 1024, rules


def sparse(path, *parts: tuple[int, bytes], size: int) -> None:
    with open(path, "wb") as f:
        f.truncate(size)
        for at, b in parts:
            f.seek(at)
            f.write(b)


def test_memory_of_whole_content_rules(tmp_path):
    size = 300 << 20
    sparse(tmp_path / "m.onnx", (0, b"\x08\x07"), (size - 100, b"\x01../../etc/passwd\x01"), size=size)
    sparse(tmp_path / "m.h5", (0, b"\x89HDF\r\n\x1a\n"), ((4 << 20) - 3, b"eval (x)"), (size - 100, b"Lambda function"), size=size)
    sparse(tmp_path / "m.png", (0, PNG), (size - 200, CALL), size=size)
    for name, fmt, rule in (("m.onnx", "onnx", "[]"), ("m.h5", "keras", "keras.eval() call"), ("m.png", "image", "polyglot.pickle_in_image")):
        mb, rules = measured(tmp_path / name, f"_searched('m', '.{name[2:]}', '{fmt}', data)[0]")
        assert mb < 100 and rule in rules, (name, mb, rules)
    excerpt = large.onnx_excerpt(Ranged(*_opened(tmp_path / "m.onnx")))
    assert excerpt == b"\x08\x07\x01../../etc/passwd"


def _opened(path):
    from flintglass.sources.ranged import opened

    data = opened(str(path))
    return data.read, len(data)


def test_memory_of_large_members(tmp_path):
    """A stored member of 1 GiB and a packed one of 300 MiB, each with an import at its end."""
    name, size = b"archive/data.pkl", 1 << 30
    head = b"PK\x03\x04" + bytes(10) + struct.pack("<IIIHH", 1, size, size, len(name), 0) + name
    entry = b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 20, 20, 0, 0, 0, 0, 1, size, size, len(name), 0, 0, 0, 0, 0, 0) + name
    at, end = len(head), b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 1, 1, len(entry), len(head) + size, 0)
    late = b"0cos\nsystem\n(S'ls'\ntR."
    first = b"\x80\x02B" + (size - 7 - len(late)).to_bytes(4, "little")
    sparse(tmp_path / "stored.pt", (0, head + first), (at + size - len(late), late + entry + end), size=at + size + len(entry) + len(end))
    with zipfile.ZipFile(tmp_path / "packed.pt", "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z, z.open("data.pkl", "w", force_zip64=True) as f:
        f.write(b"\x80\x04\x8e" + (300 << 20).to_bytes(8, "little"))
        for _ in range(300):
            f.write(bytes(1 << 20))
        f.write(late)
    for file in ("stored.pt", "packed.pt"):
        mb, names = measured(tmp_path / file, "[{'rule': i['name']} for s in walk('m.pt', 'pytorch', data)[1] for i in s['imports']]")
        assert mb < 100 and names.strip() == "['system']", (file, mb, names)


def test_repeated_and_lying_members(tmp_path):
    """Members whose sizes lie, whose checksum is wrong or that end early never end a scan."""
    from flintglass.plans.scan import walk

    zipped(tmp_path / "m.pt", {"data.pkl": CALL})
    data = bytearray((tmp_path / "m.pt").read_bytes())
    for cut in range(0, len(data), 7):
        walk("m.pt", "pytorch", bytes(data[:cut]))
    for at in range(0, len(data), 5):
        broken = bytes(data[:at]) + bytes([data[at] ^ 0xFF]) + bytes(data[at + 1 :])
        walk("m.pt", "pytorch", broken)
    assert safetensors({}) and gguf("a", "b")
