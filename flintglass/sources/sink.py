"""A sink that makes single documents of distributed rows: all of a report appears at once, or nothing of it.

Each task writes its part and counts; when all are there, the driver joins the parts, block by block, under another name, which then becomes the
report's. Failed tasks leave no report; a part that a task wrote after the failure goes when reports are pruned. Paths are local, or URLs of stores that pyarrow reaches.
"""

from __future__ import annotations

import csv
import io
import json
import os
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from flintglass.sources.ranged import store

BLOCK = 1 << 20


def place(path: str):
    """The file system of a path or URL, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return store(path)
    from pyarrow import fs

    return fs.LocalFileSystem(), os.path.abspath(path)


def put(path: str, data: bytes) -> None:
    """Writes a small file whole, or not at all."""
    fs, inner = place(path)
    fs.create_dir(inner.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(f"{inner}.new") as f:
        f.write(data)
    fs.move(f"{inner}.new", inner)


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int
    counts: dict


class ReportSink(DataSource):
    """Options: path, without its extension; formats (json, csv); head, the JSON of the document's first fields; columns, the JSON list of the CSV's header.

    Rows have json, a text for each file; csv, its lines as an array of arrays of text; and counts, a map that is added up into the document's summary.
    """

    @classmethod
    def name(cls) -> str:
        return "scan_report"

    def writer(self, schema, overwrite):
        return ReportWriter(self.options)


class ReportWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.formats = options["path"], options["formats"].split(",")
        self.head, self.columns = json.loads(options["head"]), json.loads(options["columns"])
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Part:
        fs, inner = place(self.parts)
        fs.create_dir(inner, recursive=True)
        name, rows, counts = uuid.uuid4().hex, 0, Counter()
        files = {kind: fs.open_output_stream(f"{inner}/{name}.{kind}") for kind in self.formats}
        try:
            for r in iterator:
                if "json" in files:
                    files["json"].write(b",\n" * (rows > 0) + r["json"].encode())
                if "csv" in files:
                    text = io.StringIO()
                    csv.writer(text, lineterminator="\n").writerows(r["csv"])
                    files["csv"].write(text.getvalue().encode())
                rows += 1
                counts.update({k: v for k, v in r["counts"].items() if v})
        finally:
            for f in files.values():
                f.close()
        return Part(name, rows, dict(counts))

    def _joined(self, fs, inner: str, kind: str, messages: list[Part], before: bytes, between: bytes, after: bytes) -> None:
        path = place(f"{self.path}.{kind}")[1]
        with fs.open_output_stream(f"{path}.new") as out:
            out.write(before)
            for k, m in enumerate(messages):
                out.write(between * (k > 0))
                with fs.open_input_stream(f"{inner}/{m.name}.{kind}") as part:
                    while block := part.read(BLOCK):
                        out.write(block)
            out.write(after)
        fs.move(f"{path}.new", path)

    def commit(self, messages: list) -> None:
        fs, inner = place(self.parts)
        messages = [m for m in messages if m is not None and m.rows]
        totals = sum((Counter(m.counts) for m in messages), Counter())
        summary = self.head | {"summary": dict(sorted(totals.items()))}
        if "json" in self.formats:
            self._joined(fs, inner, "json", messages, json.dumps(summary)[:-1].encode() + b', "results": [\n', b",\n", b"\n]}\n")
        if "csv" in self.formats:
            text = io.StringIO()
            csv.writer(text, lineterminator="\n").writerow(self.columns)
            self._joined(fs, inner, "csv", messages, text.getvalue().encode(), b"", b"")
        put(f"{self.path}.summary.json", json.dumps(summary).encode())
        self._clean(fs, inner)

    def abort(self, messages: list) -> None:
        self._clean(*place(self.parts))

    def _clean(self, fs, inner: str) -> None:
        from pyarrow.fs import FileType

        if fs.get_file_info(inner).type == FileType.Directory:
            fs.delete_dir(inner)
