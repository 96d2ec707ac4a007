"""Detectors on text: each gives the findings of one row as an array Column."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from flintglass.functions import signatures as S
from flintglass.functions.rules import collected, contains_any, find, finding, let, matches, pickle_at
from flintglass.operators.formats import name_of


def multiline(rules):
    """Line anchors that know only the newline as a line end."""
    return [(n, s, "(?md)" + p) for n, s, p in rules]


def header(text: Column) -> Column:
    """Suspicious patterns of a safetensors header."""
    return matches(text, S.HEADER_PATTERNS, "header", "Suspicious pattern in header: {}")


def svg(text: Column) -> Column:
    """Scripts and handlers in the first megabyte of vector graphics."""
    head = F.substring(text, 1, 1 << 20)
    rules = matches(head, S.SVG_PATTERNS, "svg", "SVG contains {}", "svg_{}")
    return F.transform(rules, lambda f: f.withField("message", F.concat(f["message"], F.lit(": "), f["hits"], F.lit(" occurrence(s)"))))


def image_metadata(text: Column) -> Column:
    """Code in the first 64 KiB of an image."""
    return matches(F.substring(text, 1, 1 << 16), S.IMAGE_PATTERNS, "image_metadata", "Suspicious pattern in image metadata: {}", "metadata_{}")


def video_metadata(text: Column, suffix: Column) -> Column:
    """Code in the first megabyte of mp4, m4v and mov; attachments of mkv."""
    head = F.substring(text, 1, 1 << 20)
    rules = matches(head, S.VIDEO_PATTERNS, "video_metadata", "Suspicious pattern in video metadata: {}", "video_metadata_{}", suffix.isin(".mp4", ".m4v", ".mov"))
    attachment = F.lit(bytes.fromhex(S.MKV_ATTACHMENT).decode("latin-1"))
    at = F.locate(bytes.fromhex(S.MKV_ATTACHMENT).decode("latin-1"), head)
    attached = F.when((suffix == ".mkv") & F.contains(head, attachment), finding("video_metadata.mkv_attachments", S.M, "MKV file contains attachments - review manually", at - 1, "mkv_attachments"))
    return F.concat(rules, collected(attached))


def yaml_like(text: Column) -> Column:
    out = F.lit(False)
    for p in S.YAML_SHAPES:
        out = out | text.rlike("(?md)" + p)
    return out


def ml_words(text: Column) -> Column:
    """The indicators of a machine-learning configuration that the text has."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.rlike(w), F.lit(w)) for w in S.ML_WORDS]))


def shell_expected(path: Column) -> Column:
    """Whether commands are normal there: continuous integration and dataset files."""
    low = F.lower(path)
    return contains_any(low, S.GITHUB_PATHS) | contains_any(low, S.CI_PATHS) | contains_any(low, S.DATASET_PATHS)


def line_numbers(text: Column, pattern: str | Column, most: int = 10) -> Column:
    """Lines, from 1, of the first matches.

    Matches are cut out one after the other: the text is split at them, and newlines are counted in the
    pieces before each and in the matches between.
    """
    pattern = pattern if isinstance(pattern, Column) else F.lit(pattern)
    pieces = F.split(text, pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    lines = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))

    def of(both: Column) -> Column:
        pieces, found = both["pieces"], both["found"]
        before = F.transform(F.sequence(F.lit(1), F.least(F.size(found), F.lit(most))), lambda i: F.aggregate(F.slice(pieces, 1, i), F.lit(1), lambda a, x: a + lines(x)) + F.aggregate(F.slice(found, 1, i - 1), F.lit(0), lambda a, x: a + lines(x)))
        return F.when(F.size(found) > 0, before).otherwise(F.array().cast("array<int>"))

    return let(F.struct(pieces.alias("pieces"), found.alias("found")), of)


_YAML = [*[("yaml_tag", n, s, p) for n, s, p in S.YAML_TAGS], *[("yaml_block", n, s, p) for n, s, p in multiline(S.YAML_BLOCKS)], *[("yaml_shell", n, s, p) for n, s, p in multiline(S.YAML_SHELL)]]


def one_newline(text: Column) -> Column:
    """The text with the newline as its only line end."""
    return F.regexp_replace(text, "\r\n?", "\n")


def yaml(path: Column, body: Column) -> Column:
    """Tags, code and commands in a text of one_newline(), with the lines of the first matches of each."""
    cves = {n: ["CVE-2025-50460"] for n, _, p in S.YAML_TAGS if "python/object" in p}
    tags = matches(body, S.YAML_TAGS, "yaml_tag", "Dangerous YAML pattern: {}", cves=cves)
    free = ~shell_expected(path)
    blocks = matches(body, multiline(S.YAML_BLOCKS), "yaml_block", "Code execution pattern: {}", only=free)
    shell = matches(body, multiline(S.YAML_SHELL), "yaml_shell", "Shell command pattern: {}", only=free)
    patterns = F.from_json(F.lit(json.dumps({f"{kind}.{n}": p for kind, n, _, p in _YAML})), "map<string,string>")
    found = F.transform(F.concat(tags, blocks, shell), lambda f: f.withField("lines", line_numbers(body, F.element_at(patterns, f["rule"]))))
    quiet = collected(F.when(F.size(ml_words(body)) >= 2, finding("yaml.ml_config", S.I, "ML configuration file detected - no unsafe patterns found")))
    judged = let(found, lambda found: F.when(F.size(found) > 0, found).otherwise(quiet))
    return F.when(yaml_like(body), judged).otherwise(F.array(finding("yaml.not_yaml", S.I, "File does not appear to be valid YAML")))


def gguf_template(template: Column) -> Column:
    """Injection in a chat template: with an exploit word every pattern is critical, without one plain template syntax is normal."""
    exploit = contains_any(F.lower(template), S.TEMPLATE_EXPLOITS)
    rules = []
    for name, opening, closing in S.TEMPLATE_PATTERNS:
        there = F.contains(template, F.lit(opening))
        if closing:
            there = there & F.contains(template, F.lit(closing))
        bad = finding(f"template.{name}", S.C, f"Potential Jinja injection in chat template: {name}", cve=["CVE-2024-34359"])
        odd = finding(f"template.{name}", S.M, f"Suspicious pattern in chat template: {name}")
        rules.append(F.when(there & exploit, bad) if closing else F.when(there, F.when(exploit, bad).otherwise(odd)))
    return collected(F.when(template.isNotNull(), finding("template.present", S.I, "Chat template present (review for Jinja injection - CVE-2024-34359)")), *rules)


def gguf_metadata(key: Column, value: Column) -> Column:
    """Suspicious keys, very long values and code in values."""
    rules = [F.when(contains_any(F.lower(key), S.GGUF_KEY_WORDS), finding("gguf.key", S.M, F.concat(F.lit("Suspicious metadata key: "), key)))]
    rules.append(F.when(F.length(value) > 1_000_000, finding("gguf.large", S.M, F.concat(F.lit("Unusually large metadata value for key '"), key, F.lit("': "), F.format_number(F.length(value), 0), F.lit(" bytes")))))
    for code in S.GGUF_CODE:
        rules.append(F.when(F.contains(value, F.lit(code)), finding(f"gguf.code.{code}", S.H, F.concat(F.lit("Code pattern in metadata key '"), key, F.lit(f"': {code}")))))
    return collected(*rules)


def strict_base64(value: Column) -> Column:
    """The bytes that strict decoding gives; null where it fails."""
    ok = (F.length(value) % 4 == 0) & value.rlike(r"^[A-Za-z0-9+/]*={0,2}$")
    return F.when(ok, F.try_to_binary(value, F.lit("base64")))


def tensor_metadata(key: Column, value: Column) -> Column:
    """Pickles, plain or in base64, and code in safetensors metadata."""
    raw = F.when(value.startswith("\\x80") | value.startswith("\x80"), finding("metadata.pickle", S.C, F.concat(F.lit("Possible embedded pickle in metadata key: "), key)))
    decoded = F.hex(strict_base64(value))
    coded = F.when((F.length(value) > 20) & decoded.rlike("^80(02|03|04|05)"), finding("metadata.base64", S.C, F.concat(F.lit("Base64-encoded pickle in metadata key: "), key)))
    low = F.lower(value)
    words = [F.when(F.contains(low, F.lit(p)), finding(f"metadata.{p}", S.H, F.concat(F.lit("Suspicious pattern in metadata key '"), key, F.lit(f"': {n}")))) for n, p in S.METADATA_STRINGS]
    large = F.when(F.length(value) > 100_000, finding("metadata.large", S.M, F.concat(F.lit("Unusually large metadata value for key '"), key, F.lit("': "), F.format_number(F.length(value), 0), F.lit(" bytes"))))
    return collected(raw, coded, *words, large)


def very_large(length: Column) -> Column:
    """Of a model configuration: files over 10 GiB."""
    return collected(F.when(length > 10 << 30, finding("keras.large", S.M, "Very large file - scanning may be incomplete")))


def keras_config(text: Column) -> Column:
    lambda_layer = F.when(F.contains(text, F.lit("Lambda")) & F.contains(text, F.lit("function")), finding("keras.lambda_layer", S.H, "Keras Lambda layer detected (executes arbitrary code)", F.locate("Lambda", text) - 1))
    return F.concat(collected(lambda_layer), matches(text, S.KERAS_PATTERNS, "keras", "Suspicious pattern: {}"))


def printable_strings(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[\x20-\x7e]{4,}"), F.lit(0))


def plausible_path(s: Column) -> Column:
    """Mostly letters and digits, a run of three of them, and nothing that paths don't have."""
    plain = F.length(F.regexp_replace(s, r"[^A-Za-z0-9._-]", ""))
    return (F.length(s) >= 4) & (plain / F.length(s) >= 0.7) & s.rlike(r"[a-zA-Z0-9_]{3,}") & s.rlike(r"^[A-Za-z0-9/\\._-]+$")


def external_refs(strings: Column) -> Column:
    return F.filter(strings, lambda s: plausible_path(s) & (s.contains("/") | s.contains("\\") | s.rlike(r"\.(bin|weight|data)$")))


def traversal(refs: Column) -> Column:
    return F.filter(refs, lambda s: s.contains("../") | s.contains("..\\"))


def onnx(text: Column) -> Column:
    word = lambda s: F.coalesce(*[F.when(F.contains(F.lower(s), F.lit(p)), F.lit(n)) for n, p in S.ONNX_PATH_WORDS])

    def of(refs: Column) -> Column:
        named = F.filter(F.transform(refs, word), lambda w: w.isNotNull())
        suspects = F.transform(named, lambda w: finding("onnx.path", S.H, F.concat(F.lit("Suspicious external data path: "), w)))
        rest = F.size(refs) - F.size(traversal(refs))
        first = collected(F.when(F.size(traversal(refs)) > 0, finding("onnx.traversal", S.C, "Path traversal in external data reference (CVE-2024-27318)", cve=["CVE-2024-27318"])))
        last = collected(F.when(rest > 0, finding("onnx.external", S.I, F.concat(F.lit("Model uses "), rest.cast("string"), F.lit(" external data file(s)")))))
        return F.concat(first, suspects, last)

    return F.concat(let(external_refs(printable_strings(text)), of), version_of(text))


def ir_version(text: Column) -> Column:
    """The first field, a small number, of a graph's Latin-1 text; null without one."""
    return F.when(text.rlike(r"^\x08[\x01-\x7f]"), F.ascii(F.substring(text, 2, 1)))


def version_of(text: Column) -> Column:
    return collected(F.when(ir_version(text).isNotNull(), finding("onnx.ir_version", S.I, F.concat(F.lit("ONNX IR version: "), ir_version(text).cast("string")))))


def producer(strings: Column) -> Column:
    """The first string that names a known producer."""
    return F.try_element_at(F.filter(strings, lambda s: contains_any(F.lower(s), S.ONNX_PRODUCERS)), F.lit(1))


WORKFLOW = "struct<nodes:array<string>,links:string,groups:string,last_node_id:string>"


def workflow_parts(text: Column) -> Column:
    """nodes (as JSON texts), and how many of the four keys of a workflow graph there are."""
    made = F.from_json(text, WORKFLOW)
    keys = F.json_object_keys(text)
    return F.struct(made["nodes"].alias("nodes"), F.size(F.array_intersect(keys, F.array(*map(F.lit, ("nodes", "links", "groups", "last_node_id"))))).alias("keys"), keys.isNotNull().alias("is_object"))


def graph_nodes(parts: Column) -> Column:
    """The nodes, if the parts are those of a workflow graph."""
    return F.when(parts["nodes"].isNotNull() & (parts["keys"] >= 2), parts["nodes"])


def is_workflow(text: Column) -> Column:
    return F.coalesce(let(workflow_parts(text), graph_nodes).isNotNull(), F.lit(False))


def node_type(node: Column) -> Column:
    return F.get_json_object(node, "$.type")


def node_advisory(node: Column) -> Column:
    """The finding of a vulnerable type, which is read once; the id of those only."""
    cves = F.from_json(F.lit(json.dumps({kind: cve for kind, cve, _ in S.NODE_TYPES if cve})), "map<string,string>")

    def made(kind: Column) -> Column:
        cve = F.try_element_at(cves, kind)
        return F.when(kind.isin(*[t for t, _, _ in S.NODE_TYPES]), finding("workflow.node", S.C, F.concat(F.lit("Vulnerable node type: "), kind), F.get_json_object(node, "$.id").try_cast("bigint"), cve=F.when(cve.isNotNull(), F.array(cve))))

    return let(node_type(node), made)


def widget_texts(node: Column) -> Column:
    """The string widgets of a node; other values are left out."""
    none = F.array().cast("array<string>")
    return let(F.get_json_object(node, "$.widgets_values"), lambda raw: F.when(raw.isNotNull(), F.coalesce(F.from_json(raw, "array<string>"), none)).otherwise(none))


def widget_finding(value: Column) -> Column:
    """The first pattern that matches."""
    chain = None
    for name, severity, pattern in S.INPUT_PATTERNS:
        made = finding(f"workflow.input.{name}", severity, f"Suspicious pattern in node input: {name}")
        chain = F.when(value.rlike(pattern), made) if chain is None else chain.when(value.rlike(pattern), made)
    return chain


def workflow(text: Column) -> Column:
    def of(parts: Column) -> Column:
        nodes = F.coalesce(parts["nodes"], F.array().cast("array<string>"))
        advisories = F.array_compact(F.transform(nodes, node_advisory))
        widgets = F.array_compact(F.transform(F.flatten(F.transform(nodes, widget_texts)), widget_finding))
        deep = matches(text, S.INPUT_PATTERNS, "workflow.deep", "Suspicious pattern in workflow: {}")
        plain = F.array(F.when(parts["is_object"], finding("workflow.other", S.I, "File does not appear to be a ComfyUI workflow")).otherwise(finding("workflow.invalid", S.I, "Invalid JSON")))
        return F.when(F.coalesce(parts["nodes"].isNotNull() & (parts["keys"] >= 2), F.lit(False)), F.concat(advisories, widgets, deep)).otherwise(plain)

    return let(workflow_parts(text), of)


def double_extension(path: Column) -> Column:
    name = F.lower(name_of(path))
    parts = F.split(name, r"\.")
    inner = F.try_element_at(parts, F.lit(-2))
    return F.when((F.size(parts) > 2) & inner.isin(*S.INNER_EXTENSIONS), finding("polyglot.double_extension", S.M, F.concat(F.lit("Double extension detected: "), name, F.lit(" (inner: ."), inner, F.lit(")")), technique="double_extension"))


def actual_format(hexed: Column) -> Column:
    """What the first bytes say, of at least eight."""
    chain = F.when(F.length(hexed) < 16, F.lit(None).cast("string")).when(hexed.rlike("^800[0-5]"), "pickle")
    for name, magic in {**S.ARCHIVE_MAGIC, **S.IMAGE_MAGIC, "webp": "52494646.{8}57454250"}.items():
        chain = chain.when(hexed.rlike(f"^{magic}"), name)
    return chain


def extension_mismatch(suffix: Column, hexed: Column) -> Column:
    return let(actual_format(hexed), lambda real: _mismatch(suffix, real))


def _mismatch(suffix: Column, real: Column) -> Column:
    media = suffix.isin(*S.MEDIA_EXTENSIONS)
    return (
        F.when(media & (real == "pickle"), finding("polyglot.pickle_as_media", S.C, F.concat(F.lit("Disguised pickle file: extension is "), suffix, F.lit(" but file is pickle format")), F.lit(0), "extension_mismatch", ["CVE-2025-1889"]))
        .when(media & real.isin("zip", "zip_empty", "7z", "rar", "rar5"), finding("polyglot.archive_as_media", S.H, F.concat(F.lit("Disguised archive: extension is "), suffix, F.lit(" but file is "), real, F.lit(" format")), F.lit(0), "extension_mismatch"))
        .when(suffix.isin(*S.MODEL_EXTENSIONS) & (real == "7z"), finding("polyglot.7z_as_model", S.H, "7z archive with model extension (potential nullifAI bypass)", F.lit(0), "extension_mismatch", ["CVE-2025-1716"]))
    )


def _place(hexed: Column, magic: Column, start: int) -> Column:
    """Byte position of a signature from byte start on; null if it isn't there."""
    upto = F.regexp_substr(hexed, F.concat(F.lit(f"^(?:..){{{start},}}?"), magic))
    return ((F.length(upto) - F.length(magic)) / 2).cast("bigint")


def _first_of(hexed: Column, start: int, kinds: dict[str, str]) -> Column:
    """Name n and position p of the first of the kinds, in their order, that is there; null without any."""
    table = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(m).alias("m")) for n, m in kinds.items()])
    places = F.transform(table, lambda k: F.struct(k["n"].alias("n"), _place(hexed, k["m"], start).alias("p")))
    return F.try_element_at(F.filter(places, lambda k: k["p"].isNotNull()), F.lit(1))


def embedded_archive(hexed: Column) -> Column:
    """An archive after the first 8 bytes of an image; xz isn't looked for."""

    def of(first: Column) -> Column:
        name, at = first["n"], first["p"]
        text = F.when(name == "7z", F.concat(F.lit("7z archive embedded in image at offset "), at, F.lit(" (CVE-2025-1716)"))).when(name == "rar", F.concat(F.lit("RAR archive embedded in image at offset "), at))
        text = F.coalesce(text, F.concat(F.lit("Archive embedded in image: "), F.upper(name), F.lit(" at offset "), at))
        return F.when(name.isNotNull(), finding("polyglot.archive_in_image", S.C, text, at, "archive_in_image", F.when(name == "7z", F.array(F.lit("CVE-2025-1716")))))

    return let(_first_of(hexed, 8, {k: v for k, v in S.ARCHIVE_MAGIC.items() if k != "xz"}), of)


def embedded_pickle(hexed: Column, start: int, where: str, technique: str, shift: Column | None = None) -> Column:
    """The first protocol, in order, whose first marker from byte start on is a plausible pickle."""
    places = F.transform(F.array(*map(F.lit, S.PICKLE_MAGIC)), lambda magic: _place(hexed, magic, start))
    at = F.try_element_at(F.filter(places, lambda p: p.isNotNull() & pickle_at(hexed, p)), F.lit(1))
    at = at if shift is None else at + shift
    return let(at, lambda at: F.when(at.isNotNull(), finding(f"polyglot.{technique}", S.C, F.concat(F.lit(f"{where} at offset "), at), at, technique)))


def trailing_start(suffix: Column, hexed: Column) -> Column:
    """Where data after the end of an image or document starts; null if nothing follows."""
    size = (F.length(hexed) / 2).cast("bigint")
    last = lambda magic: F.when(hexed.rlike(f"^(?:..)+{magic}"), (F.length(F.regexp_extract(hexed, f"^((?:..)+){magic}", 1)) / 2).cast("bigint"))
    pdf = F.length(F.regexp_extract(hexed, "^((?:..)+2525454F46(?:0D|0A|20)*)", 1)) / 2
    end = (
        F.when((suffix == ".png") & hexed.rlike("^89504E47"), find(hexed, "49454E44", 1) + 12)
        .when(suffix.isin(".jpg", ".jpeg") & hexed.rlike("^FFD8"), last("FFD9") + 2)
        .when((suffix == ".gif") & hexed.rlike("^47494638"), last("3B") + 1)
        .when((suffix == ".pdf") & hexed.rlike("^25504446"), F.when(pdf > 0, pdf.cast("bigint")))
    )
    return F.when((size >= 16) & (end < size), end)


def trailing_data(suffix: Column, hexed: Column) -> Column:
    def of(at: Column) -> Column:
        left = (F.length(hexed) / 2).cast("bigint") - at
        rest = F.substring(hexed, F.coalesce(at, F.lit(0)).cast("int") * 2 + 1, F.lit(32))
        bad = rest.rlike(f"^({'|'.join(S.ARCHIVE_MAGIC.values())})") | (rest.rlike("^800[2-5]") & pickle_at(hexed, F.coalesce(at, F.lit(0))))
        return F.when(left > 16, finding("polyglot.trailing_data", F.when(bad, S.C).otherwise(S.M), F.concat(F.lit("Trailing data after image end: "), left, F.lit(" bytes")), at, "trailing_data"))

    return let(trailing_start(suffix, hexed), of)


def archive_in_video(hexed_tail: Column, size: Column) -> Column:
    """An archive in the last 64 KiB of a video of at least 100 bytes."""

    def of(first: Column) -> Column:
        name, at = first["n"], first["p"]
        place = size - (F.length(hexed_tail) / 2).cast("bigint") + at
        return F.when((size >= 100) & name.isNotNull(), finding("polyglot.archive_in_video", S.C, F.concat(F.lit("Archive appended to video: "), F.upper(name), F.lit(" at offset "), place), place, "archive_in_video"))

    return let(_first_of(hexed_tail, 0, S.ARCHIVE_MAGIC), of)
