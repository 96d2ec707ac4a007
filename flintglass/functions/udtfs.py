"""The byte walks as table functions for SQL: one row of bytes gives rows to be judged by the rules.

    register(spark)
    spark.sql("SELECT a.path, i.* FROM artifacts a, LATERAL pickle_imports(a.content) i")

Null bytes give no rows; broken ones give what could be read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from flintglass.operators import containers, pickles


@udtf(returnType="pos bigint, op string, arg string")
class PickleOpcodes:
    def eval(self, content: bytes) -> Iterator[tuple]:
        for op, arg, pos in pickles.opcodes(bytes(content or b"")):
            yield pos, op, arg


@udtf(returnType="module string, name string, pos bigint")
class PickleImports:
    def eval(self, content: bytes) -> Iterator[tuple]:
        for i in pickles.facts(bytes(content))["imports"] if content is not None else ():
            yield i["module"], i["name"], i["pos"]


@udtf(returnType=pickles.STREAM)
class PickleStream:
    """One row for a stream, in the form that pickles.stream_rules judges."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        if content is not None:
            f = pickles.facts(bytes(content))
            yield f["defect"], [tuple(i.values()) for i in f["imports"]], [tuple(o.values()) for o in f["ops"]], f["calls"], f["first_call"]


@udtf(returnType="name string, crc bigint, stored bigint, start bigint")
class ArchiveMembers:
    """The local headers of an archive."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        for name, crc, stored, start, _ in containers.local_headers(bytes(content or b"")):
            yield name, crc, stored, start


@udtf(returnType="kind string, key string, value string")
class TensorPairs:
    """Keys and values of a GGUF or safetensors file, the chat template and the header."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        from flintglass.plans.scan import pairs_of

        data = bytes(content or b"")
        if data:
            for p in pairs_of("gguf" if data.startswith(b"GGUF") else "safetensors", data):
                yield p["kind"], p["key"], p["value"]


@udtf(returnType="tensor string, error string")
class TensorErrors:
    """What is wrong with the offsets of a safetensors file."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        data = bytes(content or b"")
        read = containers.safetensors(data)
        if read["header"] is not None:
            yield from containers.tensor_errors(read["header"], len(data) - 8 - read["header_size"])


FUNCTIONS = {"pickle_opcodes": PickleOpcodes, "pickle_imports": PickleImports, "pickle_stream": PickleStream, "archive_members": ArchiveMembers, "tensor_pairs": TensorPairs, "tensor_errors": TensorErrors}


def register(spark: SparkSession) -> None:
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
