"""Confidence of a finding from the bytes around it.

Steps apply in a fixed order, as factors and lower bounds mix: entropy, archive structure, code
structure, printable density, signs of generated media, and checks by the finding's name.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flintglass.functions import signatures as S
from flintglass.functions.rules import contains_any, latin1, let

ENTROPY, DENSITY = 7.0, 0.65


def window(data: Column, at: Column, before: int, after: int) -> Column:
    """Bytes from before the position to after it, within the data."""
    low = F.greatest(at - before, F.lit(0))
    return F.substring(data, (low + 1).cast("int"), (at + after - low).cast("int"))


def ascii_density(data: Column) -> Column:
    """Part of printable characters, tabs and line ends; 0 for nothing."""
    text = latin1(data)
    return F.when(F.octet_length(data) > 0, F.regexp_count(text, F.lit(r"[\x20-\x7e\t\n\r]")) / F.octet_length(data)).otherwise(F.lit(0.0))


def code_structure(text: Column) -> Column:
    out = F.lit(False)
    for p in S.CODE_PATTERNS:
        out = out | text.rlike(p)
    return out


def isolated_keyword(text: Column) -> Column:
    out = F.lit(False)
    for p in S.TRIGGERS:
        out = out | text.rlike("(?i)" + p)
    return out


def ai_metadata(text: Column) -> Column:
    """Signs of generated media in the first 64 KiB."""
    head = F.substring(text, 1, 1 << 16)
    out = contains_any(head, S.AI_TOOLS)
    for p in S.AI_FIELDS:
        out = out | head.rlike(p)
    return out


def valid_archive(data: Column, at: Column) -> Column:
    """Whether an archive header stands there: a sane and complete local header of a ZIP, a RAR or 7z signature, or a whole gzip header.

    A ZIP's name can always be read, by UTF-8 or else by code page 437, and its end record may lie outside of what is visible, so neither is asked for.
    """
    left = F.octet_length(data) - at

    def of(here: Column) -> Column:
        number = lambda pos: F.conv(F.concat(F.substring(here, pos * 2 + 3, 2), F.substring(here, pos * 2 + 1, 2)), 16, 10).cast("int")
        sane = (F.length(here) >= 60) & (number(4) <= 100) & (number(8) <= 99) & (number(26) <= 1024) & (left >= 30 + number(26) + number(28))
        other = here.rlike(f"^({S.ARCHIVE_MAGIC['7z']}|{S.ARCHIVE_MAGIC['rar']}00|{S.ARCHIVE_MAGIC['rar5']})") | (here.startswith("1F8B") & (left >= 10))
        return F.when(here.startswith(S.ARCHIVE_MAGIC["zip"]), sane).otherwise(other)

    return F.coalesce(let(F.hex(window(data, at, 0, 30)), of), F.lit(False))


def window_entropy(data: Column) -> Column:
    """Bits a byte of a small binary, to 9 digits; 0 for nothing."""

    def of(text: Column) -> Column:
        n = F.length(text)
        counts = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda b: n - F.length(F.replace(text, F.chr(b), F.lit(""))))
        return F.aggregate(F.filter(counts, lambda c: c > 0), F.lit(0.0), lambda total, c: total - c / n * F.log2(c / n))

    return F.round(F.coalesce(let(latin1(data), of), F.lit(0.0)), 9)


def factor(data: Column, at: Column, name: Column) -> Column:
    """The modifier by the finding's name."""
    low = F.lower(name)
    asp = let(F.lower(latin1(window(data, at, 50, 200))), lambda around: sum((F.contains(around, F.lit(w)).cast("int") for w in S.ASP_WORDS), F.lit(0)))
    call = F.when(latin1(window(data, at, 100, 100)).rlike(S.REAL_CALL), 2.5).otherwise(0.2)
    by_call = F.when(contains_any(low, S.CALL_WORDS), call).otherwise(F.lit(1.0))
    return F.when(F.contains(low, F.lit("asp")), let(asp, lambda asp: F.when(asp >= 2, 2.0).when(asp == 0, 0.3).otherwise(by_call))).otherwise(by_call)


def score(data: Column, at: Column, name: Column, kind: Column, bits: Column, generated: Column) -> Column:
    """0 to 1. bits: entropy of the 1 KiB around; kind: image, video or unknown; generated: of ai_metadata()."""
    archive = contains_any(F.lower(name), S.ARCHIVE_WORDS)

    def of(x: Column) -> Column:
        """The steps in order; a lower bound of 0.9 is above anything before it, so it stands in for the value."""
        high, around = x["bits"] > ENTROPY, x["around"]
        c = F.when(high, 0.5 * 0.2).otherwise(0.5)
        c = F.when(archive, F.when(valid_archive(data, at), 0.9).otherwise(c * 0.1)).otherwise(c)
        c = F.when(code_structure(around), 0.9).otherwise(c * F.when(high & isolated_keyword(around), 0.1).otherwise(1.0))
        c = c * F.when(high & (ascii_density(window(data, at, 256, 256)) < DENSITY), 0.5).otherwise(1.0)
        return c * F.when(kind.isin("image", "video") & generated, 0.15).otherwise(1.0)

    c = let(F.struct(latin1(window(data, at, 1024, 1024)).alias("around"), bits.alias("bits")), of)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c * factor(data, at, name))), 9)


def level(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "HIGH").when(confidence >= 0.5, "MEDIUM").otherwise("LOW")


def action(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "QUARANTINE").when(confidence >= 0.5, "INVESTIGATE").otherwise("REVIEW")


def threatening(field: Column, value: Column) -> Column:
    """Whether a metadata field that holds text, or any of 100 characters or more, has code in it."""
    out = F.lit(False)
    for p in S.THREAT_PATTERNS:
        out = out | value.rlike(p)
    return out & (contains_any(F.lower(field), [f.lower() for f in S.TEXT_FIELDS]) | (F.length(value) >= 100))


def with_verdict(level_now: Column, adjusted: Column, status: Column) -> Column:
    """Adjusted severity after an external verdict: only MEDIUM and HIGH findings that weren't confirmed become LOW."""
    return F.when(level_now.isin("MEDIUM", "HIGH") & (status == "not_confirmed"), F.regexp_replace(adjusted, "-(HIGH|MEDIUM|LOW)$", "-LOW")).otherwise(adjusted)
