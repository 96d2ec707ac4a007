"""Verdicts of external tools on findings: which tool is asked, how, and what its answer means.

A Validator is a name, the command it needs, words of the findings that it can judge and two methods, command and verdict. Any
object with these can be put into Options(validators=...); the first that takes a finding's name is asked. Tools run on the executors, a few
at a time in each task, each once a file, killed after their timeout; nothing is extracted. Without the command the status is
tool_unavailable, and the finding stays as it was.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import subprocess
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flintglass.functions import signatures as S
from flintglass.functions.rules import contains_any
from flintglass.operators import context

# The status of an answer.
CONFIRMED, NOT_CONFIRMED, UNAVAILABLE, FAILED, SKIPPED = "confirmed", "not_confirmed", "tool_unavailable", "validation_error", "skipped"
POOL = 4
Answer = tuple[str, str]


class Validator(Protocol):
    name: str
    tool: str
    words: tuple[str, ...]
    timeout: float

    def command(self, path: str) -> list[str]:
        """What to run on a file."""

    def verdict(self, output: str) -> Answer:
        """Status and details from what the tool printed."""


@dataclass(frozen=True)
class MetadataFields:
    """Whether a picture's own metadata fields hold code: text fields, and any of 100 characters or more."""

    name: str = "exiftool"
    tool: str = "exiftool"
    words: tuple[str, ...] = tuple(S.METADATA_TOOL_WORDS)
    timeout: float = 30

    def command(self, path: str) -> list[str]:
        return [self.tool, "-json", "-all", "-unknown", path]

    def verdict(self, output: str) -> Answer:
        fields = (json.loads(output) or [{}])[0]
        known = tuple(f.lower() for f in S.TEXT_FIELDS)
        bad = [n for n, v in fields.items() if isinstance(v, str) and (len(v) >= 100 or any(k in n.lower() for k in known)) and any(re.search(p, v) for p in S.THREAT_PATTERNS)]
        return (CONFIRMED, f"code in fields: {', '.join(bad)}") if bad else (NOT_CONFIRMED, "no field holds code")


@dataclass(frozen=True)
class ArchiveSignatures:
    """Whether there is an archive at all. One that is there would have to be unpacked to be confirmed, which isn't done: the finding stays."""

    name: str = "binwalk"
    tool: str = "binwalk"
    words: tuple[str, ...] = tuple(S.ARCHIVE_TOOL_WORDS)
    timeout: float = 60

    def command(self, path: str) -> list[str]:
        return [self.tool, "-B", path]

    def verdict(self, output: str) -> Answer:
        parts = [line.split(None, 2) for line in output.splitlines() if line.strip() and not line.startswith(("DECIMAL", "-"))]
        found = [p[2] for p in parts if len(p) == 3 and p[0].isdigit()]
        real = [d for d in found if any(a in d.lower() for a in S.ARCHIVE_KINDS) and not any(f in d.lower() for f in S.ARCHIVE_CHANCES)]
        return (SKIPPED, f"a signature, not unpacked: {real[0][:100]}") if real else (NOT_CONFIRMED, "no signature of an archive")


STANDARD: tuple[Validator, ...] = (MetadataFields(), ArchiveSignatures())


def router(name: Column, validators: tuple[Validator, ...] = STANDARD) -> Column:
    """The first validator that takes findings of a name; null if none does."""
    low = F.lower(name)
    return F.coalesce(*[F.when(contains_any(low, v.words), v.name) for v in validators], F.lit(None).cast("string"))


def asked(path: str, validator: Validator) -> Answer:
    """A validator's answer on a file, whatever happens."""
    if shutil.which(validator.tool) is None:
        return UNAVAILABLE, f"{validator.tool} is not installed"
    path = path.removeprefix("file://").removeprefix("file:")
    if not os.path.exists(path):
        return FAILED, f"no such file: {path}"
    try:
        done = subprocess.run(validator.command(path), capture_output=True, text=True, errors="replace", timeout=validator.timeout, stdin=subprocess.DEVNULL)
        return (FAILED, f"{validator.name} ended with {done.returncode}: {done.stderr[:200]}") if done.returncode else validator.verdict(done.stdout)
    except subprocess.TimeoutExpired:
        return FAILED, f"{validator.name} took over {validator.timeout:g} s"
    except Exception as e:  # noqa: BLE001 - a tool or what it prints never ends a scan
        return FAILED, f"{validator.name}: {type(e).__name__}: {e}"


def _answers(validators: tuple[Validator, ...]):
    by_name = {v.name: v for v in validators}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(POOL) as pool:
            for b in batches:
                paths, wanted = b.column("path").to_pylist(), b.column("asked").to_pylist()
                keys = {(p, n) for p, names in zip(paths, wanted, strict=True) for n in names or () if n}
                got = dict(zip(keys, pool.map(lambda k: asked(k[0], by_name[k[1]]), keys), strict=True))
                rows = [[dict(zip(("status", "details"), got.get((p, n), (None, None)), strict=True)) for n in names or ()] for p, names in zip(paths, wanted, strict=True)]
                answers = pa.array(rows, pa.list_(pa.struct([("status", pa.string()), ("details", pa.string())])))
                yield pa.RecordBatch.from_arrays([*b.columns, answers], names=[*b.schema.names, "answers"])

    return run


def validated(rows: DataFrame, validators: tuple[Validator, ...]) -> DataFrame:
    """rows with what tools say of each finding whose confidence is MEDIUM or HIGH; one that isn't confirmed is adjusted to LOW, and override says so."""
    name = lambda f: F.coalesce(f["technique"], F.substring(f["message"], 1, 50))
    ask = F.transform("findings", lambda f: F.when(f["level"].isin("MEDIUM", "HIGH"), router(name(f), validators)))
    schema = rows.schema.simpleString().removeprefix("struct<").removesuffix(">")
    told = rows.withColumn("asked", ask).mapInArrow(_answers(validators), f"{schema},asked:array<string>,answers:array<struct<status:string,details:string>>")

    def after(f: Column, i: Column) -> Column:
        answer = F.col("answers")[i]
        now = context.with_verdict(f["level"], f["adjusted_severity"], answer["status"])
        external = F.when(answer["status"].isNotNull(), F.struct(F.col("asked")[i].alias("tool"), answer["status"].alias("status"), answer["details"].alias("details")))
        return f.withField("override", F.coalesce(~now.eqNullSafe(f["adjusted_severity"]), F.lit(False))).withField("adjusted_severity", now).withField("external", external)

    return told.withColumn("findings", F.transform("findings", after)).drop("asked", "answers")
