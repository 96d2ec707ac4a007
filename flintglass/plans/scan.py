"""One pass over artifacts: format, detectors, context, advice, verdicts.

1. Formats come from the path and the first bytes.
2. One Arrow pass makes the byte walks of the formats that need them, and passes on only those bytes that
   expressions read afterwards: streams and tensors don't come back.
3. One projection gives each artifact its findings as an array, with their context and advice, and the verdict.

Files and findings are views of these rows. Nothing is joined, grouped or shuffled, and a view scans the
source once; persist rows to use both.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flintglass.functions import signatures as S
from flintglass.functions.rules import FINDING, advice, finding, latin1, let
from flintglass.operators import containers, context, large, pickles, textrules, validators, verdicts
from flintglass.operators import obfuscation as obf
from flintglass.operators.context import score
from flintglass.operators.formats import detected, media_kind, suffix_of
from flintglass.sources.artifacts import from_directory
from flintglass.sources.ranged import Ranged

WALKED = ("pickle", "archive", "gguf", "safetensors", "keras", "pytorch", "7z_archive")
OBFUSCATED = ("pickle", "onnx", "keras", "unknown")
#: Formats whose whole content is read by expressions; that of media files is, too.
COLUMNED = ("yaml", "json", "onnx", "keras")
#: Of formats whose contents may hide encoded content, those of up to so many bytes are judged by expressions, longer ones by blocks.
FIRST = 1 << 20
#: A batch of walked artifacts ends at so many bytes or rows.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 500
_NONE = f"array<{FINDING}>"


@dataclass(frozen=True)
class Options:
    """strict: also keep what repeats (members met twice) and leave archives of unknown extension alone.

    analyzer: what gives a finding its confidence, a function of Columns with the parameters of context.score. validators: external
    tools that are asked about findings of MEDIUM or HIGH confidence, as in operators.validators.
    """

    strict: bool = False
    confidence_threshold: float = 0.0
    context: bool = True
    entropy_threshold: float = obf.HIGH_ENTROPY
    analyzer: Callable[..., Column] = score
    validators: tuple[validators.Validator, ...] = ()


@dataclass
class ScanFrames:
    """rows: an artifact each, findings an array; files: its verdict; findings: a finding each."""

    rows: DataFrame

    @property
    def files(self) -> DataFrame:
        return self.rows.select("path", "format", "length", "sha256", "scan_ms", *[c.alias(n) for n, c in verdicts.of_findings(F.col("findings")).items()])

    @property
    def findings(self) -> DataFrame:
        return self.rows.select("path", F.inline("findings"))


def with_format(artifacts: DataFrame) -> DataFrame:
    head = F.hex(F.substring("head", 1, 512))
    return _fixed(artifacts, suffix=suffix_of(F.col("path")), format=detected(F.col("path"), head))


def _fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once: projections are merged into what reads them, a generator isn't."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _or_none(found: Column) -> Column:
    return F.coalesce(found, F.array().cast(_NONE))


def _some(*found: Column) -> Column:
    return F.array_compact(F.array(*found))


def media_rules() -> Column:
    """The detectors for files that are two things at once."""
    fmt, suffix = F.col("format"), F.col("suffix")
    hexed, tail = F.col("hexed"), F.col("hexed_tail")
    head = F.substring("hexed_head", 1, 64)
    image = suffix.isin(*S.IMAGE_EXTENSIONS) & (suffix != ".svg")
    video = suffix.isin(*S.VIDEO_EXTENSIONS)
    every = _some(textrules.double_extension(F.col("path")), textrules.extension_mismatch(suffix, head))
    pictures = _some(textrules.embedded_archive(hexed), textrules.embedded_pickle(hexed, 8, "Pickle data embedded in image", "pickle_in_image"), textrules.trailing_data(suffix, hexed))
    meta = _some(textrules.embedded_pickle(F.substring("hexed_head", 1, 1 << 17), 20, "Pickle signature in image metadata", "metadata_pickle"))
    video_tail = _some(textrules.archive_in_video(tail, F.col("length")), textrules.embedded_pickle(tail, 0, "Pickle data appended to video", "pickle_in_video", F.col("length") - F.octet_length("tail")))
    return F.concat(
        every,
        _or_none(F.when(image & (fmt == "image"), F.concat(pictures, meta, textrules.image_metadata(F.col("raw_head"))))),
        _or_none(F.when(suffix == ".svg", textrules.svg(F.replace(F.make_valid_utf8(F.col("head").cast("string")), F.lit("�"), F.lit(""))))),
        _or_none(F.when(suffix == ".pdf", _some(textrules.trailing_data(suffix, hexed)))),
        _or_none(F.when(video, F.concat(video_tail, F.when(F.col("length") >= 100, textrules.video_metadata(F.col("raw_head"), suffix)).otherwise(F.array().cast(_NONE))))),
    )


def content_rules(entropy_threshold: float) -> Column:
    """The detectors for texts and graphs, and what can be said of files that can't be looked into."""
    fmt, text, raw = F.col("format"), F.col("body"), F.col("raw")
    error = F.when(F.col("read_error").isNotNull(), F.array(finding("file.error", S.M, F.col("read_error"))))
    unknown = F.when((fmt == "unknown") & F.col("read_error").isNull(), F.array(finding("file.unknown", S.I, F.concat(F.lit("Unknown format: "), fmt))))
    whole = F.col("whole")  # of others, large.py searched the content, or made an excerpt of it
    no_magic = _some(F.when(~F.col("hexed_head").startswith(S.HDF5_MAGIC), finding("keras.no_magic", S.M, "File does not have HDF5 magic number", F.lit(0))))
    by_format = (
        F.when((fmt == "yaml") & whole, textrules.yaml(F.col("path"), text))
        .when(fmt == "json", F.filter(textrules.workflow(text), lambda f: whole | ~f["rule"].startswith("workflow.deep")))
        .when(fmt == "onnx", textrules.onnx(F.coalesce(latin1(F.col("excerpt")), raw)))
        .when(fmt == "keras", F.concat(no_magic, textrules.very_large(F.col("length")), _or_none(F.when(whole, textrules.keras_config(raw)))))
    )
    coded = F.when(fmt.isin(*OBFUSCATED), obf.rollup(F.when(F.col("columned"), raw), F.col("bits"), entropy_threshold))
    return F.concat(*map(_or_none, (error, by_format, unknown, coded)))


def pair_rules() -> Column:
    """The detectors for the keys, values and headers that the walks of tensor files give."""

    def rules(p: Column) -> Column:
        key, value = p["key"], p["value"]
        return (
            F.when(p["kind"] == "template", textrules.gguf_template(value))
            .when(p["kind"] == "gguf", textrules.gguf_metadata(key, value))
            .when(p["kind"] == "safetensors", textrules.tensor_metadata(key, value))
            .otherwise(textrules.header(value))
        )

    return F.flatten(F.transform("pairs", rules))


def streams_found() -> Column:
    """The findings of an artifact's streams, at their places in it."""
    placed = lambda s: F.transform(pickles.stream_rules(s), lambda f: f.withField("member", s["member"]).withField("location", f["location"] + s["base"]))
    return F.flatten(F.transform("streams", placed))


def walk(path: str, fmt: str, data: bytes | Ranged, strict: bool = False) -> tuple[list[dict], list[dict]]:
    """Findings of the byte walks for one artifact, and the facts of its streams, which pickles.stream_rules judges. Locations count from the start of the artifact or, in a member that is packed, of the member.

    Unless strict, a member met twice is inspected once, and findings that agree in all but their number are one.
    """
    out: list[dict] = []
    streams: list[dict] = []

    def add(rule: str, severity: str, message: str, location: int | None = None, **more) -> None:
        out.append({"rule": rule, "severity": severity, "message": message, "location": location, **more})

    seen: set = set()

    def stream(size: int | None, base: int, member: str | None) -> None:
        if (member, base) in seen and not strict:
            return
        seen.add((member, base))
        streams.append(pickles.facts(containers.part(data, base, size)) | {"base": base, "member": member})

    if data.startswith(containers.SEVEN_ZIP):
        add("archive.7z", S.H, "7z archive detected - potential nullifAI bypass (CVE-2025-1716)", 0, cve=["CVE-2025-1716"])
        places = containers.embedded_pickles(data, 32)
        if places:
            add("archive.7z_pickle", S.C, f"Pickle data found inside 7z archive at {len(places)} location(s)", places[0], cve=["CVE-2025-1716"], hits=len(places))
            stream(None, places[0], "7z")
    elif data.startswith((b"PK\x03\x04", b"PK\x05\x06")):
        zeroed = [n for n, crc, size, _, _ in containers.local_headers(data) if crc == 0 and size > 0]
        if zeroed:
            add("archive.zero_crc", S.H, f"ZIP archive has zeroed CRC values (CVE-2025-10156 bypass): {', '.join(zeroed[:3])}", None, cve=["CVE-2025-10156"], hits=len(zeroed))
        for name, _, size, start, content in containers.local_headers(data):
            if content[:1] == b"\x80" and len(content) > 1 and content[1] <= 5:
                stream(size, start, name)
        listed, why = containers.directory(data)
        if why is not None:
            add("archive.invalid", S.M, f"Invalid ZIP archive: {why}")
        else:
            if any(".." in n or n.startswith("/") for n, _ in listed):
                add("archive.zipslip", S.C, "Path traversal detected in ZIP archive (ZipSlip)")
            end = containers.end_of_zip(data)
            if end is not None and end < len(data):
                if rest := containers.embedded_pickles(data, end):
                    add("archive.trailing_pickle", S.C, f"Pickle data appended after ZIP archive at offset {rest[0]} (CVE-2025-1889 bypass)", rest[0], cve=["CVE-2025-1889"])
                    stream(None, rest[0], "trailing")
                else:
                    add("archive.trailing", S.M, f"Suspicious trailing data after ZIP archive: {len(data) - end} bytes", end)
            n = sum(containers.holds_pickle(name) for name, _ in listed)
            add("archive.summary", S.I, f"PyTorch ZIP archive with {n} pickle file(s)", hits=n)
            again = (lambda name, start: False) if strict else lambda name, start: (name, start) in seen
            for name, found in containers.members(data, pickles.facts, again):
                if found is None:
                    add("archive.unscanned", S.H, f"Archive member too large to be scanned: {name}", member=name)
                else:
                    streams.append(found | {"base": 0, "member": name})
    elif fmt == "pickle":
        stream(None, 0, None)
    elif fmt == "gguf":
        g = containers.gguf(data)
        if g["error"]:
            add("gguf.error", S.C if "magic" in g["error"].lower() else S.M, f"GGUF parse error: {g['error']}", 0)
        if g["version"] is not None and g["version"] not in (1, 2, 3):
            add("gguf.version", S.M, f"Unknown GGUF version: {g['version']}", 4)
        if (g["tensors"] or 0) > 100_000:
            add("gguf.tensors", S.H, f"Unusually high tensor count: {int(g['tensors']):,}", 8)
        if (g["pairs"] or 0) > 10_000:
            add("gguf.pairs", S.H, f"Unusually high metadata count: {int(g['pairs']):,}", 16)
    elif fmt == "safetensors":
        s = containers.safetensors(data)
        if s["error"]:
            add("safetensors.error", S.H if "size" in s["error"].lower() else S.M, f"Header parse error: {s['error']}", 0)
        else:
            if s["header_size"] > 1_000_000:
                add("safetensors.large", S.M, f"Unusually large header: {s['header_size']:,} bytes")
            errors = containers.tensor_errors(s["header"], len(data) - 8 - s["header_size"])
            short = [e for e in errors if "exceeds data size" in e[1]]
            if short:
                add("safetensors.truncated", S.M, f"Truncated file: {len({n for n, _ in short})} tensor(s) exceed file size")
            for name, why in errors:
                if "exceeds data size" not in why:
                    add("safetensors.tensor", S.H, f"Invalid tensor '{name}': {why}")
    elif fmt == "keras":
        places = [p for m in S.KERAS_PICKLE_MARKERS for p in _all(data, m)]
        if places:
            add("keras.pickle", S.H, f"Embedded pickle data detected ({len(places)} region(s))", places[0], hits=len(places))
            for p in places[:5]:
                end = data.find(b".", p, p + 10_000_000)
                stream(end + 1 - p if end >= 0 else 65536, p, f"offset {p}")
    if fmt in OBFUSCATED and (regions := containers.compressed_regions(data)):
        add("obfuscation.compressed", S.M, f"Embedded compressed data detected ({len(regions)} region(s))", regions[0][1], hits=len(regions))
    return (out if strict else list({(f["rule"], f["location"], f["message"], f.get("member")): f for f in reversed(out)}.values())[::-1]), streams


def _all(data: bytes | Ranged, mark: bytes) -> list[int]:
    out, at = [], data.find(mark)
    while at >= 0:
        out.append(at)
        at = data.find(mark, at + 1)
    return out


def pairs_of(fmt: str, data: bytes | Ranged) -> list[dict]:
    """kind, key and value of what expressions look at in GGUF and safetensors files: the template, the pairs, the header."""
    if fmt == "gguf":
        meta = containers.gguf(data)["metadata"]
        template = containers.chat_template(meta)
        rows = [] if template is None else [("template", "", template)]
        rows += [("gguf", key, v if isinstance(v, str) else "") for key, v in meta.items()]
    else:
        header = containers.safetensors(data)["header"] or {}
        metadata = header.get("__metadata__")
        rows = [("safetensors", str(key), v) for key, v in (metadata.items() if isinstance(metadata, dict) else ()) if isinstance(v, str)]
        rows.append(("header", "", data[8 : 8 + int.from_bytes(data[:8], "little")].decode("latin-1")))
    return [dict(zip(("kind", "key", "value"), r, strict=True)) for r in rows]


_FOUND = pa.struct([("rule", pa.string()), ("severity", pa.string()), ("message", pa.string()), ("location", pa.int64()), ("technique", pa.string()), ("cve", pa.list_(pa.string())), ("hits", pa.int64()), ("member", pa.string()), ("lines", pa.list_(pa.int32()))])
_PAIR = pa.struct([("kind", pa.string()), ("key", pa.string()), ("value", pa.string())])
_STREAM = pa.struct([
    ("defect", pa.string()), ("imports", pa.list_(pa.struct([("module", pa.string()), ("name", pa.string()), ("pos", pa.int64())]))), ("ops", pa.list_(pa.struct([("op", pa.string()), ("pos", pa.int64())]))),
    ("calls", pa.int64()), ("first_call", pa.int64()), ("base", pa.int64()), ("member", pa.string()),
])
_WALKED = pa.schema([
    ("path", pa.string()), ("suffix", pa.string()), ("format", pa.string()), ("length", pa.int64()), ("sha256", pa.string()), ("read_error", pa.string()),
    ("head", pa.binary()), ("tail", pa.binary()), ("content", pa.binary()), ("excerpt", pa.binary()), ("windows", pa.map_(pa.int64(), pa.binary())), ("whole", pa.bool_()), ("columned", pa.bool_()), ("bits", pa.float64()), ("scan_ms", pa.float64()),
    ("walked", pa.list_(_FOUND)), ("streams", pa.list_(_STREAM)), ("pairs", pa.list_(_PAIR)),
])
_WALKED_DDL = f"path string, suffix string, format string, length bigint, sha256 string, read_error string, head binary, tail binary, content binary, excerpt binary, windows map<bigint,binary>, whole boolean, columned boolean, bits double, scan_ms double, walked {_NONE}, streams array<struct<{pickles.STREAM.replace(' ', ':').replace(',:', ',')},base:bigint,member:string>>, pairs array<struct<kind:string,key:string,value:string>>"


def _searched(path: str, suffix: str, fmt: str, data: Ranged) -> tuple[list[dict], bytes | None]:
    """Findings of the rules over the whole content of a file that is no column, and the excerpt that expressions judge."""
    if fmt == "yaml":
        return large.yaml(path, data), None
    if fmt == "json":
        excerpt, found = large.workflow(data)
        return found, excerpt.encode()
    if fmt == "keras":
        return large.keras(data), None
    if fmt == "onnx":
        excerpt = large.onnx_excerpt(data)
        many = [{"rule": "file.unscanned", "severity": S.H, "message": "Too many external references to be looked at"}] * (excerpt is None)
        return many, excerpt or b""
    return large.media(suffix, data), None


def _opened(path: str, length: int, content: bytes | None) -> bytes | Ranged:
    """The artifact's bytes; an OSError where they can't be reached, as in a store that only Spark reads."""
    try:
        return containers.content_of(path, length, content)
    except (ValueError, ImportError) as e:
        raise OSError(str(e)) from e


def _one(row: dict, strict: bool) -> dict:
    """An artifact after its walk, with the bytes that expressions read; one that fails gives a finding, never ends the scan."""
    fmt, content, head = row["format"], row["content"], row["head"] or b""
    began = time.perf_counter()
    found, streams, pairs, excerpt, around = [], [], [], None, []
    media, coded = row["suffix"] in S.MEDIA_EXTENSIONS, fmt in OBFUSCATED
    ziplike = head[:4] == b"PK\x03\x04"
    left_alone = strict and fmt in ("pytorch", "7z_archive") and not ziplike
    searched = content is None and (media or fmt in COLUMNED)
    columned = content is not None and (fmt in COLUMNED or len(content) <= FIRST)  # the encoded content in it is found by expressions
    bits, said = None, head if content is None else content  # of what can't be opened, the head is judged
    if row["read_error"] is None and not left_alone and (ziplike or searched or fmt in WALKED or coded):
        try:
            said = data = _opened(row["path"], row["length"] or 0, content)
            if ziplike or fmt in WALKED or coded:
                found, streams = walk(row["path"], fmt, data, strict)
            if fmt in ("gguf", "safetensors"):
                pairs = pairs_of(fmt, data)
            if searched:
                data = data if isinstance(data, Ranged) else Ranged.of(data)
                more, excerpt = _searched(row["path"], row["suffix"], fmt, data)
                found += more
                around = large.windows(data, more) if media else []
        except (OSError, MemoryError) as e:
            found = [{"rule": "file.unscanned", "severity": S.H, "message": f"File not scanned: {type(e).__name__}: {e}"}]
        except Exception as e:  # noqa: BLE001 - isolation of hostile inputs
            found = [{"rule": "scan.error", "severity": S.M, "message": f"Scan error: {type(e).__name__}: {e}"}]
    if coded:
        try:
            bits, more = obf.entropy_of(said), [] if columned else large.coded(said if isinstance(said, Ranged) else Ranged.of(said))
            found = [*found, *more]
        except (OSError, MemoryError) as e:
            if not any(f["rule"] == "file.unscanned" for f in found):
                found = [*found, {"rule": "file.unscanned", "severity": S.H, "message": f"File not scanned: {type(e).__name__}: {e}"}]
    return row | {
        "head": head if media else head[:64],
        "tail": row["tail"] if media else None,
        "content": content if content is not None and (media or fmt in COLUMNED) else excerpt if fmt == "json" else (head if content is None else content)[:FIRST] if coded else None,
        "excerpt": excerpt if fmt == "onnx" else None,
        "windows": around,
        "whole": content is not None,
        "columned": columned,
        "bits": bits,
        "scan_ms": round((time.perf_counter() - began) * 1000, 3),
        "walked": found,
        "streams": streams,
        "pairs": pairs,
    }


def _bytes_of(row: dict) -> int:
    """About what a walked row takes: its bytes, and what its walk found."""
    blobs = sum(len(row[n] or b"") for n in ("head", "tail", "content", "excerpt")) + sum(len(w) for _, w in row["windows"])
    facts = 200 * (len(row["walked"]) + sum(len(x["imports"]) + len(x["ops"]) for x in row["streams"]))
    return blobs + facts + sum(len(p["key"]) + len(p["value"]) for p in row["pairs"])


def walked(df: DataFrame, strict: bool) -> DataFrame:
    """The Arrow pass, with the columns of _WALKED."""

    def run(batches):
        for b in batches:
            held, size = [], 0
            for k in range(b.num_rows):
                held.append(_one({n: b.column(n)[k].as_py() for n in b.schema.names}, strict))
                size += _bytes_of(held[-1])
                if size > BATCH_BYTES or len(held) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(held, schema=_WALKED)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=_WALKED)

    return df.select("path", "suffix", "format", "length", "sha256", "read_error", "head", "tail", "content").mapInArrow(run, _WALKED_DDL)


def judged(found: Column, options: Options) -> Column:
    """The findings with their number, confidence, level, action, adjusted severity and recommendation.

    Confidence is for critical and high findings of the media detectors; of a file that is no column, the bytes around
    a finding come from its windows, tail or head.
    """
    whole, tail_at = F.col("whole"), F.col("length") - F.octet_length("tail")
    none = F.lit(None)

    def one(f: Column, i: Column) -> Column:
        at = F.coalesce(f["location"], F.lit(0))
        late = F.coalesce(~whole & (at >= tail_at), F.lit(False))
        near = F.try_element_at("windows", at)
        data = F.when(whole, F.col("content")).when(near.isNotNull(), near).when(late, F.col("tail")).otherwise(F.col("head"))
        at = F.when(~whole & near.isNotNull(), F.least(at, F.lit(large.AROUND[0]))).when(late, at - tail_at).otherwise(at)
        name = F.coalesce(f["technique"], F.substring(f["message"], 1, 50))
        wanted = f["rule"].rlike("^(polyglot|svg|image_metadata|video_metadata)") & f["severity"].isin(S.C, S.H)
        place = F.struct(data.alias("data"), F.least(at, F.octet_length(data).cast("bigint")).alias("at"))
        scored = lambda d: options.analyzer(d["data"], d["at"], name, media_kind(F.col("suffix")), context.window_entropy(context.window(d["data"], d["at"], 512, 512)), F.col("generated"))
        score = F.when(wanted, let(place, scored)) if options.context else none.cast("double")
        fields = [f[n].alias(n) for n in ("rule", "severity", "message", "location", "technique", "cve", "hits", "member", "lines")]
        return F.struct(i.alias("ordinal"), *fields, score.alias("confidence"))

    def more(f: Column) -> Column:
        c = f["confidence"]
        if_scored = lambda x: F.when(c.isNotNull(), x)
        level = context.level(c)
        out = f.withField("level", if_scored(level)).withField("action", if_scored(context.action(c))).withField("adjusted_severity", if_scored(F.concat(f["severity"], F.lit("-"), level)))
        none_yet = F.lit(None).cast("struct<tool:string,status:string,details:string>")
        return out.withField("recommendation", advice(f["message"], f["severity"])).withField("override", F.lit(False)).withField("external", none_yet)

    scored = F.transform(found, one)
    if options.confidence_threshold > 0:
        scored = F.filter(scored, lambda f: f["confidence"].isNull() | (f["confidence"] >= options.confidence_threshold))
    return F.transform(scored, more)


@lru_cache(maxsize=8)
def _built(application: str, options: Options) -> dict[str, Column]:
    """The rules' expressions, which name columns only, so that any scan of an application can use them: building them takes thousands of calls."""
    once = (lambda found: found) if options.strict else F.array_distinct
    return {
        "by_content": content_rules(options.entropy_threshold),
        "by_media": media_rules(),
        "by_streams": once(streams_found()),
        "found": F.concat("by_content", "by_media", "walked", "by_streams", once(pair_rules())),
        "findings": judged(F.col("found"), options),
    }


def scan(artifacts: DataFrame, options: Options | None = None) -> ScanFrames:
    """Scan of a table with the columns of the source artifacts."""
    options = options or Options()
    fmt, suffix = F.col("format"), F.col("suffix")
    media = suffix.isin(*S.MEDIA_EXTENSIONS)
    ready = _fixed(
        walked(with_format(artifacts), options.strict),
        body=F.when(fmt == "yaml", textrules.one_newline(F.make_valid_utf8(F.col("content").cast("string")))).when(fmt == "json", F.make_valid_utf8(F.col("content").cast("string"))),
        raw=F.when(fmt.isin("onnx", "keras", *OBFUSCATED), latin1(F.coalesce("content", "head"))),
        raw_head=F.when(media, latin1(F.col("head"))),
        hexed=F.when((fmt == "image") | (suffix == ".pdf"), F.hex("content")),
        hexed_head=F.when(media, F.hex("head")).otherwise(F.hex(F.substring("head", 1, 32))),
        hexed_tail=F.when(suffix.isin(*S.VIDEO_EXTENSIONS), F.hex("tail")),
        generated=F.coalesce(F.when(media, context.ai_metadata(latin1(F.substring(F.coalesce("content", "head"), 1, 1 << 16)))), F.lit(False)),
    )
    rules = _built(artifacts.sparkSession.sparkContext.applicationId, options)
    for name in ("by_content", "by_media", "by_streams", "found", "findings"):
        ready = _fixed(ready, **{name: rules[name]})
    rows = ready.select("path", "format", "length", "sha256", "scan_ms", "findings")
    return ScanFrames(validators.validated(rows, options.validators) if options.validators else rows)


def with_external(findings: DataFrame, external: DataFrame) -> DataFrame:
    """findings with the verdicts of external tools: a table of path, rule and status, one row for each.

    Findings of level MEDIUM or HIGH that a tool did not confirm are adjusted to LOW; override says so.
    """
    statuses = external.groupBy("path", "rule").agg(F.min("status").alias("external_status"))
    joined = findings.join(statuses, ["path", "rule"], "left")
    after = context.with_verdict(F.col("level"), F.col("adjusted_severity"), F.col("external_status"))
    return joined.withColumns({"override": F.coalesce(~after.eqNullSafe(F.col("adjusted_severity")), F.lit(False)), "adjusted_severity": after})


def scan_directory(spark: SparkSession, path: str, options: Options | None = None, **source) -> ScanFrames:
    """Scan of a folder, or of one file whatever its extension."""
    return scan(from_directory(spark, path, **source), options)
