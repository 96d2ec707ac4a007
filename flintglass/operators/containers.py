"""Archives and headers: walks over bytes that no Column expression can make."""

from __future__ import annotations

import io
import json
import lzma
import struct
import zipfile
import zlib
from decimal import Decimal

from flintglass.functions import signatures as S
from flintglass.sources.ranged import Forward, Ranged, opened

PICKLE_SUFFIXES = (".pkl", ".pickle", ".pt", ".pth", ".bin")
#: Packed members are unpacked up to so many bytes; stored ones of more than PROVED are read without a check of their checksum.
MEMBER_BYTES, PROVED = 64 << 30, 64 << 20
MAGICS = [bytes.fromhex(m) for m in S.PICKLE_MAGIC]
SEVEN_ZIP = bytes.fromhex(S.ARCHIVE_MAGIC["7z"])
FIRST_OPCODES = frozenset(b"c}])(\x8c\x89\x81")


def content_of(path: str, length: int, content: bytes | None) -> bytes | Ranged:
    """The content or, for files that were too large to be a column, the file itself."""
    if content is not None or not length:
        return Ranged.of(content) if len(content or b"") > 1 << 20 else content or b""
    data = opened(path)
    return data if len(data) > 1 << 20 else data[:]


def part(data: bytes | Ranged, start: int, size: int | None = None) -> bytes | Ranged:
    """size bytes from start on, or all; of a Ranged nothing is copied."""
    size = len(data) - start if size is None else size
    return data.part(start, size) if isinstance(data, Ranged) else data[start : start + size]


def pickle_starts(data: bytes, at: int) -> bool:
    """Whether a stream of protocol 2 to 5 plausibly starts there."""
    if at + 2 >= len(data):
        return False
    if data[at + 1] >= 4:
        if data[at + 2] != 0x95 or at + 11 >= len(data):
            return False
        return 1 <= int.from_bytes(data[at + 3 : at + 11], "little") <= 100_000_000 and data[at + 11] in FIRST_OPCODES
    if data[at + 2] != 0x63 or at + 10 >= len(data):
        return False
    line = data[at + 3 : at + 258].partition(b"\n")
    return bool(line[1]) and all(0x2E <= b <= 0x39 or 0x41 <= b <= 0x5A or b == 0x5F or 0x61 <= b <= 0x7A for b in line[0])


def holds_pickle(name: str) -> bool:
    return name.lower().endswith(PICKLE_SUFFIXES) or "data.pkl" in name


def local_headers(data: bytes):
    """(name, crc, stored size, content offset, first two bytes) of each local file header; stops at one that runs past the end."""
    at = data.find(b"PK\x03\x04")
    while at >= 0 and at + 30 <= len(data):
        flags, crc, stored, _, n, extra = struct.unpack("<6xH6xIIIHH", data[at : at + 30])
        start = at + 30 + n + extra
        if start > len(data) or start + stored > len(data):
            return
        yield data[at + 30 : at + 30 + n].decode("utf-8" if flags & 0x800 else "cp437", "replace").rstrip("\0"), crc, stored, start, data[start : start + min(2, stored)]
        at = data.find(b"PK\x03\x04", start + stored)


def _archive(data: bytes | Ranged) -> zipfile.ZipFile:
    return zipfile.ZipFile(data.file() if isinstance(data, Ranged) else io.BytesIO(data))


def directory(data: bytes | Ranged) -> tuple[list[tuple[str, int]], str | None]:
    """Names and sizes of the members by the central directory, or why there is none."""
    try:
        with _archive(data) as z:
            return [(i.filename, i.file_size) for i in z.infolist()], None
    except (zipfile.BadZipFile, ValueError, OSError, NotImplementedError) as e:
        return [], str(e)


class TooLarge(Exception):
    """A member unpacks to more than was to be read."""


def _unpacked(file, most: int):
    """Blocks of a packed member, at most so many bytes of it."""
    while block := file.read(1 << 20):
        most -= len(block)
        if most < 0:
            raise TooLarge
        yield block


def members(data: bytes | Ranged, read, known=lambda name, start: False, most: int = MEMBER_BYTES):
    """Name and read(content) of each member that may hold a stream; None for one over most bytes.

    read is given a Forward of a member that is unpacked as it is read, or a Ranged of a stored one. Unreadable members are
    passed over, as are stored ones that known(name, start) says were read before.
    """
    try:
        with _archive(data) as z:
            for i in z.infolist():
                if not holds_pickle(i.filename):
                    continue
                try:
                    n, extra = struct.unpack("<HH", data[i.header_offset + 26 : i.header_offset + 30])
                    start = i.header_offset + 30 + n + extra
                    stored = i.compress_type == zipfile.ZIP_STORED and not i.flag_bits & 1
                    if stored and known(i.filename, start):
                        continue
                    if stored and i.compress_size > PROVED and start + i.compress_size <= len(data):
                        yield i.filename, read(part(data, start, i.compress_size))
                        continue
                    with z.open(i) as f:
                        stream = Forward(_unpacked(f, most))
                        made = read(stream)
                        stream.rest()  # the checksum is compared at the end
                    yield i.filename, made
                except TooLarge:
                    yield i.filename, None
                except (zipfile.BadZipFile, zlib.error, lzma.LZMAError, struct.error, RuntimeError, NotImplementedError, OSError, EOFError):
                    continue
    except (zipfile.BadZipFile, ValueError, OSError, NotImplementedError):
        return


def end_of_zip(data: bytes) -> int | None:
    """Where the archive with its comment ends, by the last end record of the last 64 KiB."""
    low = max(0, len(data) - 65557)
    at = data.rfind(b"PK\x05\x06", low)
    if at < 0 or at + 22 > len(data):
        return None
    return at + 22 + int.from_bytes(data[at + 20 : at + 22], "little")


def embedded_pickles(data: bytes, start: int) -> list[int]:
    """Positions of plausible streams from start on, by protocol and then position."""
    out = []
    for magic in MAGICS:
        at = data.find(magic, start)
        while at >= 0:
            if pickle_starts(data, at):
                out.append(at)
            at = data.find(magic, at + 1)
    return out


GGUF_TYPES = {0: ("<B", 1), 1: ("<b", 1), 2: ("<H", 2), 3: ("<h", 2), 4: ("<I", 4), 5: ("<i", 4), 6: ("<f", 4), 7: ("<?", 1), 10: ("<Q", 8), 11: ("<q", 8), 12: ("<d", 8)}
GGUF_STRING, GGUF_ARRAY = 10_000_000, 1_000_000
GGUF_KEYS = 1000


class _Reader:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("Unexpected end of file")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, kind: str, size: int):
        return struct.unpack(kind, self.take(size))[0]

    def string(self) -> str:
        n = self.number("<Q", 8)
        if n > GGUF_STRING:
            raise ValueError(f"String too long: {n}")
        return self.take(n).decode("utf-8", "replace")

    def value(self, kind: int, depth: int = 0):
        if kind in GGUF_TYPES:
            return self.number(*GGUF_TYPES[kind])
        if kind == 8:
            return self.string()
        if kind == 9 and depth < 8:
            inner, n = self.number("<I", 4), self.number("<Q", 8)
            if n > GGUF_ARRAY:
                raise ValueError(f"Array too long: {n}")
            return [self.value(inner, depth + 1) for _ in range(n)]
        raise ValueError(f"Unknown value type: {kind}")


def gguf(data: bytes) -> dict:
    """version, tensors, pairs, metadata and error; what was read before an error is kept."""
    out = {"version": None, "tensors": None, "pairs": None, "metadata": {}, "error": None}
    if len(data) < 4:
        return out | {"error": "File too small" if data else "Empty file"}
    if data[:4] != b"GGUF":
        return out | {"error": f"Invalid magic number: 0x{int.from_bytes(data[:4], 'little'):08X}"}
    r = _Reader(data, 4)
    try:
        out["version"] = r.number("<I", 4)
        out["tensors"], out["pairs"] = Decimal(r.number("<Q", 8)), Decimal(r.number("<Q", 8))
        for _ in range(min(int(out["pairs"]), GGUF_KEYS)):
            key = r.string()
            out["metadata"][key] = r.value(r.number("<I", 4))
    except ValueError as e:
        out["error"] = str(e)
    return out


def chat_template(metadata: dict) -> str | None:
    return next((metadata[k] for k in ("tokenizer.chat_template", "chat_template") if isinstance(metadata.get(k), str)), None)


def safetensors(data: bytes, size: int | None = None) -> dict:
    """header_size, header (object), and error."""
    size = len(data) if size is None else size
    out = {"header_size": None, "header": None, "error": None}
    if size < 8:
        return out | {"error": "File too small to contain header"}
    n = int.from_bytes(data[:8], "little")
    out["header_size"] = n
    if n > size - 8:
        return out | {"error": f"Header size {n} exceeds file size"}
    if n > 100_000_000:
        return out | {"error": f"Header size {n} exceeds limit"}
    if len(data) < 8 + n:
        return out | {"error": "Truncated header"}
    try:
        header = json.loads(data[8 : 8 + n].decode())
    except UnicodeDecodeError as e:
        return out | {"error": f"Header is not valid UTF-8: {e}"}
    except ValueError as e:
        return out | {"error": f"Invalid JSON in header: {e}"}
    return out | ({"header": header} if isinstance(header, dict) else {"error": "Header is not a JSON object"})


def tensor_errors(header: dict, data_size: int) -> list[tuple[str, str]]:
    """(tensor, error) for each thing wrong with the offsets."""
    out = []
    for name, t in header.items():
        if name == "__metadata__":
            continue
        offsets = t.get("data_offsets") if isinstance(t, dict) else None
        if not isinstance(t, dict):
            out.append((name, "not an object"))
        elif offsets is None:
            out.append((name, "missing data_offsets"))
        elif not (isinstance(offsets, list) and len(offsets) == 2 and all(isinstance(x, int) and not isinstance(x, bool) for x in offsets)):
            out.append((name, "invalid data_offsets"))
        else:
            start, end = offsets
            if start > data_size:
                out.append((name, f"start offset {start} exceeds data size {data_size}"))
            if end > data_size:
                out.append((name, f"end offset {end} exceeds data size {data_size}"))
            if start > end:
                out.append((name, f"start offset {start} after end offset {end}"))
    return out


def _inflated(data: bytes | Ranged, at: int, bits: int) -> int | None:
    """Bytes that the stream at a place gives, read to its end but not held; null if it is broken or ends early."""
    machine, made, step = zlib.decompressobj(bits), 0, 1 << 12
    try:
        while not machine.eof:
            packed = machine.unconsumed_tail
            if not packed:
                packed = data[at : at + step]
                at, step = at + len(packed), min(step * 4, 1 << 18)
            part = len(machine.decompress(packed, 1 << 20))
            if not packed and not part:
                return None
            made += part
    except zlib.error:
        return None
    return made


def _places(data: bytes | Ranged, marks: list[bytes]):
    """Each mark and place where it stands, in one reading."""
    held, base, keep = b"", 0, max(map(len, marks)) - 1
    for block in data.blocks() if isinstance(data, Ranged) else [data]:
        text = held + block
        for mark in marks:
            at = text.find(mark, max(0, len(held) - len(mark) + 1))
            while at >= 0:
                yield mark, base + at
                at = text.find(mark, at + 1)
        cut = max(0, len(text) - keep)
        held, base = text[cut:], base + cut


def compressed_regions(data: bytes | Ranged) -> list[tuple[str, int, int | None]]:
    """Kind, position and decompressed size of zlib streams of any length that give over 20 bytes, and the first gzip header, whose size is null if no gzip stream follows."""
    kinds, gzip = {magic: kind for kind, magic in S.ZLIB_HEADERS}, b"\x1f\x8b\x08"
    found, first = {kind: [] for kind in kinds.values()}, None
    for mark, at in _places(data, [*kinds, gzip]):
        if mark == gzip:
            first = at if first is None else first
        elif (made := _inflated(data, at, zlib.MAX_WBITS)) is not None and made > 20:
            found[kinds[mark]].append((kinds[mark], at, made))
    last = [] if first is None else [("gzip", first, _inflated(data, first, 16 + zlib.MAX_WBITS))]
    return [*(r for regions in found.values() for r in regions), *last]
