"""Rules as Column expressions: every detector is an array of findings over one row, so a table is read once.

Positions count characters of the text a rule runs on; bytes are matched on their Latin-1 text, where
a character is a byte. Classes such as \\w and \\s are ASCII. Patterns are literals, so Spark compiles
each once.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from flintglass.functions.signatures import DEFAULT_ADVICE, RECOMMENDATIONS, SEVERITIES

FINDING = "struct<rule:string,severity:string,message:string,location:bigint,technique:string,cve:array<string>,hits:bigint,member:string,lines:array<int>>"
Rule = tuple[str, str, str]


def latin1(data: Column) -> Column:
    """Bytes as text of one character each."""
    return F.decode(data, "ISO-8859-1")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value being computed once however often it is used: expressions that name it repeat it otherwise."""
    return F.try_element_at(F.transform(F.array(value), use), F.lit(1))


def finding(rule: str | Column, severity: str | Column, message: str | Column, location: Column | None = None, technique: str | Column | None = None, cve: list[str] | Column | None = None, hits: Column | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    cves = cve if isinstance(cve, Column) else F.array(*map(F.lit, cve)).cast("array<string>") if cve else F.lit(None)
    return F.struct(
        lit(rule).alias("rule"),
        lit(severity).alias("severity"),
        lit(message).alias("message"),
        (F.lit(None) if location is None else location).cast("bigint").alias("location"),
        lit(technique).cast("string").alias("technique"),
        cves.cast("array<string>").alias("cve"),
        (F.lit(None) if hits is None else hits).cast("bigint").alias("hits"),
        F.lit(None).cast("string").alias("member"),
        F.lit(None).cast("array<int>").alias("lines"),
    )


def matches(text: Column, rules: list[Rule], prefix: str, message: str, technique: str = "", only: Column | None = None, cves: dict[str, list[str]] | None = None) -> Column:
    """An array with one finding for each (name, severity, pattern) that matches, with its first position and number of matches.

    What a finding says is looked up in one constant, for the rules that match.
    """
    table = [{"rule": f"{prefix}.{n}", "severity": s, "message": message.format(n), "technique": technique.format(n) if technique else None, "cve": (cves or {}).get(n), "pattern": p} for n, s, p in rules]
    said = F.from_json(F.lit(json.dumps(table)), "array<struct<rule:string,severity:string,message:string,technique:string,cve:array<string>,pattern:string>>")
    hits = F.array_compact(F.array(*[F.when(text.rlike(p), i) for i, (_, _, p) in enumerate(rules, 1)]))

    def made(r: Column) -> Column:
        return finding(r["rule"], r["severity"], r["message"], F.regexp_instr(text, r["pattern"]) - 1, r["technique"], r["cve"], F.regexp_count(text, r["pattern"]))

    out = F.transform(hits, lambda i: let(F.element_at(said, i), made)).cast(f"array<{FINDING}>")
    return out if only is None else F.when(only, out).otherwise(F.array().cast(f"array<{FINDING}>"))


def contains_any(text: Column, words: list[str] | tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def collected(*rules: Column) -> Column:
    """The findings there are, in the order of the rules."""
    return F.array_compact(F.array(*rules)) if rules else F.array().cast(f"array<{FINDING}>")


def rank(severity: Column) -> Column:
    """0 for critical to 4 for info."""
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int") - 1


def advice(message: Column, severity: Column) -> Column:
    """The recommendation of the first fixed substring of the message, else that of the severity."""
    table = F.from_json(F.lit(json.dumps([{"part": p, "text": t} for p, t in RECOMMENDATIONS])), "array<struct<part:string,text:string>>")
    low = F.lower(message)
    first = F.try_element_at(F.filter(table, lambda r: F.contains(low, r["part"])), F.lit(1))["text"]
    of_severity = F.from_json(F.lit(json.dumps(DEFAULT_ADVICE)), "map<string,string>")
    return F.coalesce(first, F.try_element_at(of_severity, severity), F.lit("Verify model source."))


def find(hexed: Column, magic: str, start: int = 0) -> Column:
    """Byte position of a signature in upper-case hexadecimal text, from byte start on; null if it isn't there.

    A match must begin at a whole byte, which the pattern's pairs from the start ensure.
    """
    pattern = f"^(?:..){{{start},}}?(?={magic})"
    got = F.regexp_extract(hexed, pattern, 0)
    return F.when(hexed.rlike(pattern), (F.length(got) / 2).cast("bigint"))


def pickle_at(hexed: Column, at: Column) -> Column:
    """Whether a pickle of protocol 2 to 5 plausibly starts at byte at.

    Protocols 4 and 5: a frame of 1 to 100,000,000 bytes, then one of eight opening opcodes.
    Protocols 2 and 3: a GLOBAL whose module ends in a newline within 255 bytes of names.
    """
    here = F.substring(hexed, F.lit(1) + at.cast("int") * 2, F.lit(530))
    frame = F.conv(F.concat(*[F.substring(here, 7 + 2 * i, 2) for i in reversed(range(8))]), 16, 10).cast("decimal(20,0)")
    framed = here.rlike("^80(04|05)95.{16}(63|7D|5D|29|28|8C|89|81)") & (frame >= 1) & (frame <= 100_000_000)
    named = here.rlike("^80(02|03)63(?:2[EF]|3[0-9]|4[1-9A-F]|5[0-9AF]|6[1-9A-F]|7[0-9A]){0,254}0A") & (F.length(here) > 20)
    return F.coalesce(framed | named, F.lit(False))
