"""Artifacts as rows.

The data source `artifacts` lists a folder that every executor sees, by path or by the URL of a store that pyarrow reaches, keeps empty,
hidden and underscore files, and packs files into partitions by size, largest first. It reads only the windows
that the requested columns need: asking for no content reads none. Filters on path, length and mtime reach it
(spark.sql.python.filterPushdown.enabled, which from_directory sets), so files they leave out aren't opened. As a stream it gives each version of a file once.

The trees of more than PROBE files are listed by the executors, level by level, and read from the table so made: no list of paths is
on the driver. Stores that only Spark's own reader reaches are read by `from_binary_files`.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith

from flintglass.functions.signatures import FORMAT_OF
from flintglass.sources.ranged import opened, store
from flintglass.sources.shared import kept

SCHEMA = "path string, length bigint, mtime double, head binary, tail binary, content binary, sha256 string, read_error string"
HEAD, TAIL = 1 << 20, 1 << 16
#: Files up to so many bytes come with their content; those of others are searched where they lie.
MAX_CONTENT = 64 << 20
PARTITION_BYTES = 128 << 20
PROBE = 10_000
#: Formats that only byte walks look into: over LAZY bytes their files are walked where they lie, and content is null.
LAZY, WALKED_ONLY = 1 << 20, ("pickle", "archive", "gguf", "safetensors")


class Found(NamedTuple):
    path: str
    length: int
    mtime: float


class Folder:
    """The files below a folder, or one file; root is a path, or a URL, in whose form paths are given."""

    def __init__(self, root: str):
        self.root, self.fs = root, None
        if "://" in root or root.startswith("file:"):
            self.fs, inner = store(root)
            self.before, _, after = root.rpartition(inner.strip("/"))
            self.after = after if after.startswith("?") else ""  # what a URL says of its store
            if inner.startswith("/"):
                self.before = self.before.removesuffix("/")
            if root.startswith("file:"):
                self.before, self.root = "file://", f"file://{inner}"
        self.is_store = self.fs is not None

    def url(self, inner: str) -> str:
        return f"{self.before}{inner}{self.after}"

    def inner(self, url: str) -> str:
        path = url.removeprefix(self.before)
        return path.removesuffix(self.after) if self.after else path

    def level(self, folder: str) -> tuple[list[str], list[Found]]:
        """Folders and files directly in a folder; links to folders aren't followed."""
        if not self.is_store:
            below, files = [], []
            with os.scandir(folder) as entries:
                for e in entries:
                    try:
                        if e.is_dir(follow_symlinks=False):
                            below.append(e.path)
                        elif e.is_file():
                            s = e.stat()
                            files.append(Found(e.path, s.st_size, s.st_mtime))
                    except OSError:
                        files.append(Found(e.path, 0, 0.0))
            return below, files
        from pyarrow.fs import FileSelector, FileType

        infos = self.fs.get_file_info(FileSelector(self.inner(folder), recursive=False))
        return [self.url(i.path) for i in infos if i.type == FileType.Directory], [Found(self.url(i.path), i.size or 0, i.mtime_ns / 1e9 if i.mtime_ns else 0.0) for i in infos if i.type == FileType.File]

    def kind(self) -> str | None:
        """file, folder or null for none of these."""
        if not self.is_store:
            return "file" if os.path.isfile(self.root) else "folder" if os.path.isdir(self.root) else "other" if os.path.exists(self.root) else None
        from pyarrow.fs import FileType

        return {FileType.File: "file", FileType.Directory: "folder", FileType.NotFound: None}.get(self.fs.get_file_info(self.inner(self.root)).type, "other")

    def one(self) -> Found:
        if not self.is_store:
            s = os.stat(self.root)
            return Found(self.root, s.st_size, s.st_mtime)
        i = self.fs.get_file_info(self.inner(self.root))
        return Found(self.root, i.size or 0, i.mtime_ns / 1e9 if i.mtime_ns else 0.0)

    def walk(self, recursive: bool = True) -> Iterator[Found]:
        if self.kind() == "file":
            yield self.one()
            return
        todo = [self.root]
        while todo:
            try:
                below, files = self.level(todo.pop())
            except OSError:
                continue
            yield from files
            if recursive:
                todo += below


def known_kinds(extensions: str | None) -> set[str] | None:
    """Extensions to look at; null for all."""
    return None if extensions == "*" else {e.strip() for e in extensions.split(",")} if extensions else set(FORMAT_OF)


def of_kind(path: str, extensions: set[str] | None) -> bool:
    return extensions is None or os.path.splitext(path)[1] in extensions


def read_file(path: str, names: list[str], hashed: bool = True, max_content: int = MAX_CONTENT, lazy: bool = True, found: Found | None = None) -> tuple:
    """The columns names of one file; each byte that they don't need stays where it is."""
    row = dict.fromkeys(names)
    row["path"] = path
    try:
        if not {"head", "tail", "content", "sha256"} & set(names) and found is not None:
            row["length"], row["mtime"] = found.length, found.mtime
            return tuple(row[n] for n in names)
        data = opened(path)
        size = len(data)
        row["length"], row["mtime"] = size, found.mtime if found is not None else None
        walked = lazy and size > LAZY and FORMAT_OF.get(os.path.splitext(path)[1].lower()) in WALKED_ONLY
        whole = bool({"content", "sha256"} & set(names)) and size <= max_content and not walked
        content = data.read(0, size) if whole else b""
        row["content"] = content if whole else None
        if "head" in names:
            row["head"] = content[:HEAD] if whole else data.read(0, min(HEAD, size))
        if "tail" in names:
            row["tail"] = content[-TAIL:] if whole else data.read(max(0, size - TAIL), min(TAIL, size))
        if hashed and "sha256" in names:
            digest = hashlib.sha256(content)
            for block in () if whole else data.blocks():
                digest.update(block)
            row["sha256"] = digest.hexdigest()
    except OSError as e:
        row["read_error"] = f"Cannot access file: {e.strerror or e}"
    return tuple(row[n] for n in names)


def packed(files: list[Found]) -> list[list[Found]]:
    """Files in lists of about PARTITION_BYTES, largest first."""
    parts: list[list] = []
    room = -1
    for f in sorted(files, key=lambda f: (-f.length, f.path)):
        if room < f.length and parts or not parts:
            parts.append([])
            room = PARTITION_BYTES
        parts[-1].append(f)
        room -= max(f.length, 1 << 16)
    return parts


@dataclass
class Files(InputPartition):
    files: list


class ArtifactSource(DataSource):
    """Options: path; recursive (true); extensions (comma-separated, default all known; * for any); hash (true); columns (comma-separated, default all); max_content; lazy (true: no content of large files that are only walked).

    filters (true where that setting is on). As a stream also: log, a folder for the lists of files by batch; max_files, of a batch.
    """

    @classmethod
    def name(cls) -> str:
        return "artifacts"

    def schema(self) -> str:
        wanted = self.options.get("columns")
        names = [c.strip() for c in wanted.split(",")] if wanted else None
        return ", ".join(c for c in SCHEMA.split(", ") if names is None or c.split()[0] in names)

    def reader(self, schema):
        return (FilteringReader if self.options.get("filters") == "true" else ArtifactReader)(self.options, schema.names)

    def streamReader(self, schema):
        return ArtifactStream(self.options, schema.names)


class _Reader:
    def __init__(self, options: dict, names: list[str]):
        self.root, self.names = options["path"], names
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.extensions = known_kinds(options.get("extensions"))
        self.hash = options.get("hash", "true").lower() == "true"
        self.max_content = int(options.get("max_content", MAX_CONTENT))
        self.lazy = options.get("lazy", "true").lower() == "true"

    def listed(self) -> Iterator[Found]:
        folder = Folder(self.root)
        named = folder.kind() == "file"
        return (f for f in folder.walk(self.recursive) if named or of_kind(f.path, self.extensions))

    def read(self, partition: Files) -> Iterator[tuple]:
        for f in partition.files:
            yield read_file(f.path, self.names, self.hash, self.max_content, self.lazy, f)


_COMPARED = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}
_MATCHED = {StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: str.__contains__}


class ArtifactReader(_Reader, DataSourceReader):
    filters: tuple[Filter, ...] = ()

    def wanted(self, file: Found) -> bool:
        return all((_MATCHED | _COMPARED)[type(f)](getattr(file, f.attribute[0]), f.value) for f in self.filters)

    def partitions(self) -> list[Files]:
        return [Files(p) for p in packed([f for f in self.listed() if self.wanted(f)])] or [Files([])]


class FilteringReader(ArtifactReader):
    """Spark accepts a reader of filters only where spark.sql.python.filterPushdown.enabled is set."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes those on what a listing tells; lengths and times are compared again by Spark, as files change."""
        for f in filters:
            column = getattr(f, "attribute", ("",))[0]
            taken = column == "path" and type(f) in (_MATCHED | _COMPARED) or column in ("length", "mtime") and type(f) in _COMPARED
            if taken:
                self.filters += (f,)
            if not taken or column != "path":
                yield f


class ArtifactStream(_Reader, DataSourceStreamReader):
    """Versions of files (path, length and time) in the order they are met. An offset is the number of a list in the log; what a list has was given."""

    def __init__(self, options: dict, names: list[str]):
        super().__init__(options, names)
        self.log, self.most = options["log"], int(options.get("max_files", 10_000))
        self.store = Folder(self.log)
        self.seen: set[Found] | None = None
        self.last = 0

    def _path(self, n: int) -> str:
        return f"{self.log}/{n:012d}.json"

    def _get(self, n: int) -> list[Found]:
        data = opened(self._path(n))
        return [Found(*f) for f in json.loads(data.read(0, len(data)))]

    def _put(self, n: int, files: list[Found]) -> None:
        """Written whole under another name first."""
        data = json.dumps(files).encode()
        if not self.store.is_store:
            os.makedirs(self.log, exist_ok=True)
            with open(f"{self.log}/new", "wb") as f:
                f.write(data)
            os.replace(f"{self.log}/new", self._path(n))
            return
        self.store.fs.create_dir(self.store.inner(self.log))
        with self.store.fs.open_output_stream(self.store.inner(f"{self.log}/new")) as f:
            f.write(data)
        self.store.fs.move(self.store.inner(f"{self.log}/new"), self.store.inner(self._path(n)))

    def initialOffset(self) -> dict:
        return {"list": 0}

    def latestOffset(self) -> dict:
        if self.seen is None:
            names = sorted(f.path for f in self.store.walk(False)) if self.store.kind() == "folder" else []
            numbers = [int(n) for p in names if (n := os.path.basename(p).removesuffix(".json")).isdigit()]
            self.last = max(numbers, default=0)
            self.seen = {f for n in numbers for f in self._get(n)}
        new = sorted(islice((f for f in self.listed() if f not in self.seen), self.most), key=lambda f: (f.mtime, f.path))
        if new:
            self._put(self.last + 1, new)
            self.last += 1
            self.seen |= set(new)
        return {"list": self.last}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        files = [f for n in range(start["list"] + 1, end["list"] + 1) for f in self._get(n)]
        return [Files(p) for p in packed(files)] or [Files([])]

    def commit(self, end: dict) -> None:
        """Nothing: the lists stay, as they say what was given."""


def listed_by_executors(spark: SparkSession, root: str, recursive: bool = True, extensions: str | None = None) -> DataFrame:
    """path, length and mtime of the files below a folder: each level of folders is a table, listed by tasks and written."""
    kinds = known_kinds(extensions)

    def level(batches):
        for b in batches:
            for folder in b.column("path").to_pylist():
                try:
                    below, files = Folder(root).level(folder)
                except OSError:
                    continue
                rows = [(p, None, None) for p in below if recursive] + [tuple(f) for f in files if of_kind(f.path, kinds)]
                for at in range(0, len(rows), 10_000):
                    paths, lengths, times = zip(*rows[at : at + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(lengths, pa.int64()), pa.array(times, pa.float64())], names=["path", "length", "mtime"])

    out, folders = None, spark.createDataFrame([(root,)], "path string")
    while True:
        found = kept(folders.repartition(spark.sparkContext.defaultParallelism, "path").mapInArrow(level, "path string, length bigint, mtime double"))
        files = found.filter("length is not null")
        out = files if out is None else out.union(files)
        folders = found.filter("length is null").select("path")
        if not recursive or folders.isEmpty():
            return out


def read_listed(files: DataFrame, columns: str | None = None, hash: bool = True, max_content: int = MAX_CONTENT, lazy: bool = True) -> DataFrame:
    """Artifacts of a table of path, length and mtime, dealt out by path into partitions of PARTITION_BYTES on average."""
    schema = ", ".join(c for c in SCHEMA.split(", ") if columns is None or c.split()[0] in {x.strip() for x in columns.split(",")})
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    types = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    def run(batches):
        for b in batches:
            for f in b.to_pylist():
                row = read_file(f["path"], names, hash, max_content, lazy, Found(**f))
                yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, types, strict=True)], schema=types)

    total, n = files.agg(F.coalesce(F.sum(F.greatest("length", F.lit(1 << 16))), F.lit(0)), F.count("*")).first()
    parts = max(1, min(n, -(-total // PARTITION_BYTES)))
    return files.select("path", "length", "mtime").repartition(parts, "path").mapInArrow(run, schema)


def from_directory(spark: SparkSession, path: str, **options) -> DataFrame:
    """Artifacts of a folder, by path or URL; one that is missing or no folder gives one row that says so."""
    try:
        folder = Folder(path)
    except (ValueError, OSError, ImportError):  # pyarrow has no file system of that scheme
        return from_binary_files(spark, path, int(options.get("max_content", MAX_CONTENT)))
    kind = folder.kind()
    if kind not in ("file", "folder"):
        why = "Directory not found" if kind is None else "Not a directory"
        return spark.createDataFrame([(path, 0, None, b"", b"", b"", "", f"{why}: {path}")], SCHEMA)
    recursive = options.get("recursive", True) in (True, "true")
    if kind == "folder" and len(list(islice(folder.walk(recursive), PROBE + 1))) > PROBE:
        read = {k: options[k] for k in ("columns", "hash", "max_content", "lazy") if k in options}
        return read_listed(listed_by_executors(spark, path, recursive, options.get("extensions")), **read)
    spark.dataSource.register(ArtifactSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("artifacts").options(path=path, filters="true", **{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}).load()


def from_binary_files(spark: SparkSession, path: str, max_content: int = MAX_CONTENT) -> DataFrame:
    """The same columns by Spark's own reader, for stores that only it reaches; it leaves out empty, hidden and underscore files.

    Files over max_content come without their bytes: a scan says that it didn't read them.
    """
    data = F.col("content")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    known = ["path", "length", F.col("modificationTime").cast("double").alias("mtime")]
    read = files.filter(F.col("length") <= max_content).select(*known, F.substring(data, 1, HEAD).alias("head"), F.substring(data, -TAIL, TAIL).alias("tail"), "content", F.sha2(data, 256).alias("sha256"), F.lit(None).cast("string").alias("read_error"))
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("head", "binary"), ("tail", "binary"), ("content", "binary"), ("sha256", "string"), ("read_error", "string"))]
    return read.union(files.filter(F.col("length") > max_content).select(*known, *none))
