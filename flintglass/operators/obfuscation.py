"""Encoded, escaped and high-entropy content."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from flintglass.functions import signatures as S
from flintglass.functions.rules import collected, contains_any, finding, latin1
from flintglass.operators.textrules import strict_base64
from flintglass.sources.ranged import Ranged


#: Bits a byte from which content counts as encrypted.
HIGH_ENTROPY = 7.5
BLOCK = 1 << 20


def entropy_of(data: bytes | Ranged) -> float:
    """Bits a byte of all of it, to 9 digits."""
    counts = np.zeros(256, np.int64)
    for block in data.blocks(0, BLOCK) if isinstance(data, Ranged) else (data[at : at + BLOCK] for at in range(0, len(data), BLOCK)):
        counts += np.bincount(np.frombuffer(block, np.uint8), minlength=256)
    if not counts.any():
        return 0.0
    p = counts[counts > 0] / counts.sum()
    return round(float(-(p * np.log2(p)).sum()) + 0.0, 9)


@F.pandas_udf(DoubleType())
def entropy(data: pd.Series) -> pd.Series:
    """Bits a byte of each binary: those of many rows are counted at once, a row's values being numbers of their own."""
    sizes = data.map(lambda x: 0 if x is None else len(x)).to_numpy(np.int64)
    out, lo = np.zeros(len(data)), 0
    while lo < len(data):
        hi = max(lo + 1, int(np.searchsorted(np.cumsum(sizes[lo:]), BLOCK)) + lo)
        if hi == lo + 1:
            out[lo] = entropy_of(bytes(data.iloc[lo] or b""))
        else:
            own = np.frombuffer(b"".join(x or b"" for x in data.iloc[lo:hi]), np.uint8)
            counts = np.bincount(np.repeat(np.arange(hi - lo) * 256, sizes[lo:hi]) + own, minlength=(hi - lo) * 256).reshape(-1, 256)
            p = counts / np.maximum(1, sizes[lo:hi])[:, None]
            out[lo:hi] = np.round(-(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1) + 0.0, 9)
        lo = hi
    return pd.Series(out)


def base64_regions(text: Column) -> Column:
    """Texts of 20 or more base64 characters that decode, after padding, to ten bytes or more."""
    found = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9+/]{20,}={0,2}"), F.lit(0))
    padded = F.transform(found, lambda s: F.concat(s, F.repeat(F.lit("="), F.pmod(-F.length(s), F.lit(4)).cast("int"))))
    return F.filter(padded, lambda s: F.octet_length(strict_base64(s)) >= 10)


def suspicious_base64(region: Column) -> Column:
    return contains_any(latin1(strict_base64(region)), S.BASE64_WORDS)


def hex_regions(text: Column) -> Column:
    """Runs of 40 or more hexadecimal digits of even length."""
    return F.filter(F.regexp_extract_all(text, F.lit("[0-9a-fA-F]{40,}"), F.lit(0)), lambda s: F.length(s) % 2 == 0)


def suspicious_hex(region: Column) -> Column:
    return contains_any(latin1(F.try_to_binary(region, F.lit("hex"))), S.HEX_WORDS)


def escape_regions(text: Column) -> Column:
    """Number of long runs of each kind of escape sequence."""
    return F.struct(*[F.regexp_count(text, F.lit(p)).cast("bigint").alias(n) for n, p in S.ESCAPES])


def rollup(text: Column, entropy_bits: Column | None = None, threshold: float = HIGH_ENTROPY) -> Column:
    """The findings on encoded content of Latin-1 text (a null gives none but that on entropy); compressed regions come from the byte walks."""
    b64 = F.size(F.filter(base64_regions(text), suspicious_base64))
    hexes = F.filter(hex_regions(text), suspicious_hex)
    esc = escape_regions(text)
    escapes = esc["hex_escape"] + esc["unicode_escape"] + esc["octal_escape"]
    rules = [
        F.when(b64 > 0, finding("obfuscation.base64", S.H, F.concat(F.lit("Suspicious base64-encoded payload detected ("), b64, F.lit(" region(s))")), hits=b64)),
        F.when(F.size(hexes) > 0, finding("obfuscation.hex", S.H, F.concat(F.lit("Suspicious hex-encoded payload detected ("), F.size(hexes), F.lit(" region(s))")), hits=F.size(hexes))),
        F.when(escapes > 0, finding("obfuscation.escapes", S.M, F.concat(F.lit("Unicode escape obfuscation detected ("), escapes, F.lit(" region(s))")), hits=escapes)),
    ]
    if entropy_bits is not None:
        high = finding("obfuscation.entropy", S.M, F.concat(F.lit("Very high entropy ("), F.format_number(entropy_bits, 2), F.lit(") - possible encryption")))
        rules.insert(0, F.when(entropy_bits > threshold, high))
    return collected(*rules)


