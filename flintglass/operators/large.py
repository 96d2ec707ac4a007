"""The rules over whole contents for files that are no column: blocks are searched as they are read, at constant memory.

Rules come from the same tables as the Column rules of textrules. Each has a literal that any match must hold; a block without it isn't
searched. The end of a block is searched again with the next one, so what lies across an edge is found, matches of up to
OVERLAP characters in any case. Positions, counts and lines are those of the file as one text.

Graphs and workflows are cut down to what their rules depend on (excerpt), which the Column rules then judge.
"""

from __future__ import annotations

import json
import re
from binascii import a2b_base64
from collections.abc import Iterator

from flintglass.functions import signatures as S
from flintglass.operators import containers
from flintglass.sources.ranged import Ranged

OVERLAP, STEP = 1 << 16, 4 << 20
EXCERPT = 64 << 20
AROUND = (1024, 1 << 17)
_CLASS = re.compile(r"\\[sSwWdDbB]|\[(?:\\.|[^\]])*\]|[.^$]")


def literal(pattern: str) -> str:
    """The longest run of plain characters outside of groups that every match has; empty if there is none."""
    body = re.sub(r"^\(\?[a-z]+\)", "", pattern)
    runs, now, i, depth = [], "", 0, 0
    while i < len(body):
        token = _CLASS.match(body, i)
        one = body[i + 1] if body[i] == "\\" and not token else body[i]
        width = len(token[0]) if token else 2 if body[i] == "\\" else 1
        if body[i] == "|" and not depth:
            return ""
        plain = not token and (body[i] == "\\" or body[i] not in "()|?*+{}")
        if not depth and plain and body[i + width : i + width + 1] not in ("?", "*", "{"):
            now += one
        else:
            runs.append(now)
            now = ""
        depth += (body[i] == "(") - (body[i] == ")") if not token and width == 1 else 0
        i += width
    return max([*runs, now], key=len)


class Rule:
    """A pattern, and what was found of it: first position, number of matches, lines of the first ten."""

    def __init__(self, name: str, severity: str | None, pattern: str, flags: int = 0, once: bool = False):
        self.name, self.severity, self.once = name, severity, once
        self.regex = re.compile(pattern.replace("(?md)", "(?m)"), flags | re.ASCII)
        folded = self.regex.flags & re.IGNORECASE
        self.folded, self.literal = bool(folded), literal(pattern).lower() if folded else literal(pattern)
        self.at, self.n, self.lines, self.done = None, 0, [], 0


def texts(data: Ranged, utf8: bool) -> Iterator[str]:
    """Blocks of the text: bytes as characters, or UTF-8 with the newline as its only line end, cut behind a line where there is one."""
    if not utf8:
        yield from (b.decode("latin-1") for b in data.blocks(0, STEP))
        return
    held = b""
    for block in data.blocks(0, STEP):
        held += block
        cut = held.rfind(b"\n") + 1
        if not cut:  # no line end: not within a character, nor between \r and \n
            cut = len(held) - 1
            while cut > max(0, len(held) - 4) and held[cut] & 0xC0 == 0x80:
                cut -= 1
        yield held[:cut].decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
        held = held[cut:]
    yield held.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")


def search(blocks: Iterator[str], rules: list[Rule]) -> None:
    """Fills the rules in."""
    text, base, line, start = "", 0, 1, 0  # text begins at base, in that line; matches from start on are new
    ended = False
    while not ended:
        block = next(blocks, None)
        ended = block is None
        text += block or ""
        limit = len(text) + 1 if ended else max(start, len(text) - OVERLAP)
        low = text.lower() if any(r.folded for r in rules) else ""
        for r in rules:
            if r.once and r.n or r.literal and r.literal not in (low if r.folded else text):
                continue
            for m in r.regex.finditer(text, max(start, r.done - base)):
                if m.start() >= limit:
                    break
                if r.at is None:
                    r.at = base + m.start()
                if len(r.lines) < 10:
                    r.lines.append(line + text.count("\n", 0, m.start()))
                r.n += 1
                r.done = base + max(m.end(), m.start() + 1)
                if r.once:
                    break
        cut = max(0, min(limit, len(text)) - 1)  # a character more, for what looks at the start of a line
        base, line, text, start = base + cut, line + text.count("\n", 0, cut), text[cut:], min(limit, len(text)) - cut


def _found(rules: list[Rule], prefix: str, message: str, cves: dict[str, list[str]] | None = None, lines: bool = False) -> list[dict]:
    more = lambda r: {"cve": (cves or {}).get(r.name)} | ({"lines": r.lines} if lines else {})
    return [{"rule": f"{prefix}.{r.name}", "severity": r.severity, "message": message.format(r.name), "location": r.at, "hits": r.n} | more(r) for r in rules if r.n]


def keras(data: Ranged) -> list[dict]:
    patterns = [Rule(*r) for r in S.KERAS_PATTERNS]
    layer, code = Rule("Lambda", None, "Lambda"), Rule("function", None, "function", 0, True)
    search(texts(data, False), [*patterns, layer, code])
    first = [{"rule": "keras.lambda_layer", "severity": S.H, "message": "Keras Lambda layer detected (executes arbitrary code)", "location": layer.at}] if layer.n and code.n else []
    return first + _found(patterns, "keras", "Suspicious pattern: {}")


def yaml(path: str, data: Ranged) -> list[dict]:
    low = path.lower()
    expected = any(w in low for w in (*S.GITHUB_PATHS, *S.CI_PATHS, *S.DATASET_PATHS))
    tags = [Rule(*r) for r in S.YAML_TAGS]
    blocks, shell = ([] if expected else [Rule(*r, re.MULTILINE) for r in rules] for rules in (S.YAML_BLOCKS, S.YAML_SHELL))
    shapes = [Rule("", None, p, re.MULTILINE, True) for p in S.YAML_SHAPES]
    words = [Rule(w, None, w, re.IGNORECASE, True) for w in S.ML_WORDS]
    search(texts(data, True), [*tags, *blocks, *shell, *shapes, *words])
    if not any(r.n for r in shapes):
        return [{"rule": "yaml.not_yaml", "severity": S.I, "message": "File does not appear to be valid YAML"}]
    cves = {n: ["CVE-2025-50460"] for n, _, p in S.YAML_TAGS if "python/object" in p}
    found = _found(tags, "yaml_tag", "Dangerous YAML pattern: {}", cves, True) + _found(blocks, "yaml_block", "Code execution pattern: {}", None, True) + _found(shell, "yaml_shell", "Shell command pattern: {}", None, True)
    if not found and sum(r.n > 0 for r in words) >= 2:
        return [{"rule": "yaml.ml_config", "severity": S.I, "message": "ML configuration file detected - no unsafe patterns found"}]
    return found


#: Runs of printable characters that have nothing but what paths have.
_PATH = re.compile(r"(?<![\x20-\x7e])[A-Za-z0-9/\\._-]{4,}(?![\x20-\x7e])")


_PRINTABLE = "".join(map(chr, range(0x20, 0x7F)))


def onnx_excerpt(data: Ranged) -> bytes | None:
    """The first two bytes and, between control characters, those strings that may be references; null if they are too long together.

    Strings of OVERLAP characters or more aren't references.
    """
    out, size = [data[:2]], 2
    held, skipping = "", False
    for block in _and_end(texts(data, False)):
        if skipping:
            block = block.lstrip(_PRINTABLE)
            skipping = not block
        text = held + block
        edge = len(text.rstrip(_PRINTABLE))  # a string at the end may go on in the next block
        held = text[edge:]
        if len(held) >= OVERLAP:
            held, skipping = "", True
        for m in _PATH.finditer(text, 0, edge):
            s = m[0]
            if "/" in s or "\\" in s or s.endswith((".bin", ".weight", ".data")):
                out.append(s.encode())
                size += len(s) + 1
                if size > EXCERPT:
                    return None
    return b"\x01".join(out)


def _and_end(blocks: Iterator[str]) -> Iterator[str]:
    yield from blocks
    yield "\0"


_MARKS = re.compile(r'["\\{}\[\]]')


class Workflow:
    """A JSON text from front to back: its top-level keys, and the elements of the array nodes."""

    def __init__(self) -> None:
        self.depth, self.string, self.escaped, self.valid = 0, False, False, True
        self.word: list[str] | None = None
        self.key, self.keys = None, set()
        self.node: list[str] | None = None
        self.kind: str | None = None
        self.nodes: list[dict] = []
        self.started = self.over = self.listed = False

    def feed(self, text: str) -> None:
        at = 0  # what comes before it went into the key or node being read
        for m in _MARKS.finditer(text):
            i, c = m.start(), m[0]
            if self.string:
                if self.escaped is not False and self.escaped == i:
                    self.escaped = False
                    continue
                if c == "\\":
                    self.escaped = i + 1
                elif c == '"':
                    self.string = False
                    if self.word is not None:
                        self.word.append(text[at:i])
                        self.key, self.word = "".join(self.word), None
                continue
            if not self.started and text[:i].strip():
                self.valid = False
            if c == '"':
                self.string = True
                between = text[max(0, i - 64) : i].rstrip()
                if self.depth == 1 and self.node is None and (not between or between[-1] in "{,"):
                    self.word, at = [], i + 1
            elif c in "{[":
                if not self.started:
                    self.started, self.valid = True, self.valid and c == "{"
                elif self.depth == 1 and self.key is not None:
                    self.keys.add(self.key)
                    self.listed |= self.key == "nodes" and c == "["
                elif self.depth == 2 and self.key == "nodes" and self.listed and c == "{":
                    self.node, at = [], i
                self.depth += 1
            elif c in "}]":
                self.depth -= 1
                if self.node is not None and self.depth == 2:
                    self.node.append(text[at : i + 1])
                    self.keep("".join(self.node))
                    self.node = None
                if self.depth < 0:
                    self.valid = False
        for held in (self.word, self.node):
            if held is not None:
                held.append(text[at:])
        if self.escaped is not False:
            self.escaped -= len(text)

    def keep(self, text: str) -> None:
        """Of a node what its rules look at, if any of them would find something."""
        try:
            node = json.loads(text)
        except ValueError:
            return
        widgets = node.get("widgets_values")
        texts = [w for w in (widgets if isinstance(widgets, list) else [widgets]) if isinstance(w, str)]
        bad = [w for w in texts if any(p.search(w) for p in _INPUTS)]
        if bad or node.get("type") in _NODES:
            self.nodes.append({"id": node.get("id"), "type": node.get("type"), "widgets_values": bad})


_INPUTS = [re.compile(p, re.ASCII) for _, _, p in S.INPUT_PATTERNS]
_NODES = frozenset(kind for kind, _, _ in S.NODE_TYPES)
#: Top-level keys of a workflow whose values may be plain numbers, too.
_KEYS = ("nodes", "links", "groups", "last_node_id")


def workflow(data: Ranged) -> tuple[str, list[dict]]:
    """An excerpt with the same keys and only those nodes that rules find something in, and the findings of the patterns over the whole text."""
    reader, deep = Workflow(), [Rule(*r) for r in S.INPUT_PATTERNS]
    numbers = [Rule(k, None, rf'"{k}"\s*:', 0, True) for k in _KEYS]

    def fed() -> Iterator[str]:
        for text in texts(data, True):
            reader.feed(text)
            yield text

    search(fed(), [*deep, *numbers])
    if not (reader.started and reader.valid and reader.depth == 0 and not reader.string):
        return "", []
    keys = {k: [] for k in _KEYS if k in reader.keys} | ({"last_node_id": 0} if numbers[3].n else {})
    if "nodes" in keys:
        keys["nodes"] = reader.nodes
        if not reader.listed:
            del keys["nodes"]
    is_workflow = "nodes" in keys and len(keys) >= 2
    return json.dumps(keys or {"other": 0}), _found(deep, "workflow.deep", "Suspicious pattern in workflow: {}") if is_workflow else []


def _end_of_media(suffix: str, data: Ranged) -> int | None:
    """Where data after the end of an image or document starts."""
    if suffix == ".png" and data.startswith(b"\x89PNG"):
        at = data.find(b"IEND", 1)
        return at + 12 if at >= 0 else None
    if suffix in (".jpg", ".jpeg") and data.startswith(b"\xff\xd8"):
        at = data.rfind(b"\xff\xd9", 1)
        return at + 2 if at >= 0 else None
    if suffix == ".gif" and data.startswith(b"GIF8"):
        at = data.rfind(b";", 1)
        return at + 1 if at >= 0 else None
    if suffix == ".pdf" and data.startswith(b"%PDF"):
        at = data.rfind(b"%%EOF", 1)
        if at >= 0:
            at += 5
            while data[at : at + 1] in (b"\r", b"\n", b" "):
                at += 1
            return at
    return None


def media(suffix: str, data: Ranged) -> list[dict]:
    """Archives and streams in an image, and what follows the end of an image or document."""
    out: list[dict] = []

    def add(kind: str, severity: str, message: str, at: int, **more) -> None:
        out.append({"rule": f"polyglot.{kind}", "severity": severity, "message": message, "location": at, "technique": kind, **more})

    if suffix in S.IMAGE_EXTENSIONS and suffix != ".svg":
        for name, magic in S.ARCHIVE_MAGIC.items():
            at = data.find(bytes.fromhex(magic), 8) if name != "xz" else -1
            if at >= 0:
                texts = {"7z": f"7z archive embedded in image at offset {at} (CVE-2025-1716)", "rar": f"RAR archive embedded in image at offset {at}"}
                add("archive_in_image", S.C, texts.get(name, f"Archive embedded in image: {name.upper()} at offset {at}"), at, cve=["CVE-2025-1716"] if name == "7z" else None)
                break
        for magic in containers.MAGICS:
            at = data.find(magic, 8)
            if at >= 0 and containers.pickle_starts(data, at):
                add("pickle_in_image", S.C, f"Pickle data embedded in image at offset {at}", at)
                break
    end = _end_of_media(suffix, data)
    if end is not None and len(data) - end > 16:
        rest = data[end : end + 16]
        bad = rest.startswith(tuple(bytes.fromhex(m) for m in S.ARCHIVE_MAGIC.values())) or (rest.startswith(tuple(containers.MAGICS)) and containers.pickle_starts(data, end))
        add("trailing_data", S.C if bad else S.M, f"Trailing data after image end: {len(data) - end} bytes", end)
    return out


class Run:
    """Runs of at least so many units, however long and over however many blocks: what closed() says of them, counted.

    reach: how many bytes behind a run decide how it ends. decoded: of the bytes of whole groups of units, the text that words are looked for in.
    """

    def __init__(self, unit: bytes, size: int, least: int, reach: int, words: list[str] | None = None, group: int = 1):
        self.regex, self.more = re.compile(b"(?:%s){%d,}" % (unit, least)), re.compile(b"(?:%s)*" % unit)
        self.keep, self.reach, self.group = size * least, reach, group
        self.words = None if words is None else [w.encode() for w in words]
        self.longest = max(map(len, self.words or [b""]))
        self.held, self.open, self.n = b"", False, 0
        self.size, self.rest, self.last, self.hit = 0, b"", b"", False

    def decoded(self, text: bytes) -> bytes:
        return text

    def closed(self, behind: bytes) -> bool:
        """Whether a run, of which size, rest and hit are known, counts; behind: the bytes that follow."""
        return True

    def looked(self, plain: bytes) -> None:
        text = self.last + plain
        self.hit = self.hit or any(w in text for w in self.words)
        self.last = text[-self.longest :]

    def add(self, text: bytes) -> None:
        self.size += len(text)
        if self.words is not None:
            text = self.rest + text
            cut = len(text) - len(text) % self.group
            self.rest = text[cut:]
            self.looked(self.decoded(text[:cut]))

    def feed(self, block: bytes, last: bool) -> None:
        text = self.held + block
        at = 0
        while True:
            m = self.more.match(text, at) if self.open else self.regex.search(text, at)
            if m is None:
                break
            self.add(m[0])
            at = m.end()
            self.open = not last and len(text) - at < self.reach
            if self.open:
                self.held = text[at:]
                return
            self.n += self.closed(text[at : at + self.reach])
            self.size, self.rest, self.last, self.hit = 0, b"", b"", False
        self.held = text[max(at, len(text) - self.keep) :]


class Base64(Run):
    """Texts that decode strictly, after padding, to bytes with a word."""

    def decoded(self, text: bytes) -> bytes:
        return a2b_base64(text)

    def closed(self, behind: bytes) -> bool:
        signs = 2 if behind[:2] == b"==" else int(behind[:1] == b"=")
        if signs + -(self.size + signs) % 4 > 2:
            return False
        self.looked(a2b_base64(self.rest + b"=" * (-len(self.rest) % 4)))
        return self.hit


class Hex(Run):
    """Digits of even number that decode to bytes with a word."""

    def decoded(self, text: bytes) -> bytes:
        return bytes.fromhex(text.decode())

    def closed(self, behind: bytes) -> bool:
        return not self.rest and self.hit


_UNITS = {"hex_escape": rb"\\x[0-9a-fA-F]{2}", "unicode_escape": rb"\\u[0-9a-fA-F]{4}", "octal_escape": rb"\\[0-7]{3}"}


def coded(data: Ranged) -> list[dict]:
    """The findings on encoded content that obfuscation.rollup gives, but that on entropy, of all of the file."""
    b64 = Base64(rb"[A-Za-z0-9+/]", 1, 20, 2, S.BASE64_WORDS, 4)
    hexes = Hex(rb"[0-9a-fA-F]", 1, 40, 1, S.HEX_WORDS, 2)
    escapes = [Run(_UNITS[n], size, least, size) for n, size, least in (("hex_escape", 4, 10), ("unicode_escape", 6, 5), ("octal_escape", 4, 10))]
    runs = [b64, hexes, *escapes]
    for block in data.blocks(0, STEP):
        for r in runs:
            r.feed(block, False)
    for r in runs:
        r.feed(b"", True)
    n = sum(r.n for r in escapes)
    said = [
        ("base64", S.H, "Suspicious base64-encoded payload detected", b64.n),
        ("hex", S.H, "Suspicious hex-encoded payload detected", hexes.n),
        ("escapes", S.M, "Unicode escape obfuscation detected", n),
    ]
    return [{"rule": f"obfuscation.{kind}", "severity": severity, "message": f"{text} ({hits} region(s))", "hits": hits} for kind, severity, text, hits in said if hits]


def windows(data: Ranged, found: list[dict]) -> list[tuple[int, bytes]]:
    """For the places of findings the bytes around them, as far as confidence looks."""
    return [(at, data[max(0, at - AROUND[0]) : at + AROUND[1]]) for at in {f["location"] for f in found if f.get("location") is not None}]
