"""Serialized-object streams: their opcodes and what they import, by a walk; and the rules over these facts. Nothing is ever loaded."""

from __future__ import annotations

import io
import json
import pickletools
from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from flintglass.functions import signatures as S
from flintglass.functions.rules import FINDING, collected, finding
from flintglass.sources.ranged import Forward, Ranged

LARGE = 1 << 20
STRINGS = {"SHORT_BINUNICODE", "BINUNICODE", "BINUNICODE8", "SHORT_BINSTRING", "BINSTRING", "UNICODE", "STRING"}
CREATORS = {"INST", "OBJ", "NEWOBJ", "NEWOBJ_EX"}
_OPENERS = CREATORS | {"BUILD"}
_CODES = {ord(o.code): o for o in pickletools.opcodes}


def _unknown(stream: io.BytesIO) -> None:
    at = stream.tell() - 1
    stream.seek(at)
    raise ValueError(f"at position {at}, opcode {stream.read(1)!r} unknown")


#: Name of each opcode and what reads its argument.
_READ: list[tuple[str, Callable | None]] = [(o.name, o.arg and o.arg.reader) if (o := _CODES.get(c)) else ("", _unknown) for c in range(256)]
_GLOBAL = _CODES[ord("c")].arg.reader

_SIZED = {
    "SHORT_BINBYTES": 1, "SHORT_BINUNICODE": 1, "SHORT_BINSTRING": 1, "BINBYTES": 4, "BINUNICODE": 4, "BINSTRING": 4, "LONG1": 1, "LONG4": 4,
    "BINBYTES8": 8, "BINUNICODE8": 8, "BYTEARRAY8": 8,
}
_FIXED = {"PROTO": 1, "FRAME": 8, "BININT": 4, "BININT1": 1, "BININT2": 2, "BINFLOAT": 8, "BINGET": 1, "BINPUT": 1, "LONG_BINGET": 4, "LONG_BINPUT": 4, "EXT1": 1, "EXT2": 2, "EXT4": 4}
_LINES = {"GLOBAL": 2, "INST": 2, "INT": 1, "LONG": 1, "FLOAT": 1, "STRING": 1, "UNICODE": 1, "GET": 1, "PUT": 1, "PERSID": 1}


#: What pairs of lines are decoded to, as one text and as module and name: streams name the same few over and over.
_PAIRS: dict[bytes, tuple[str, tuple[str, str]]] = {}


def _pair(lines: bytes) -> tuple[str, tuple[str, str]]:
    arg = pickletools.read_stringnl_noescape_pair(io.BytesIO(lines))
    module, _, attr = arg.partition(" ")
    if len(lines) <= 256:
        if len(_PAIRS) >= 1 << 16:
            _PAIRS.clear()
        _PAIRS[lines] = arg, (module, attr)
    return arg, (module, attr)


def _text(arg: object) -> str | None:
    try:
        return None if arg is None else str(arg)
    except ValueError:  # a number of thousands of digits
        return hex(arg)


def _decoded(data: bytes) -> Iterator[tuple[str, str | None, int]]:
    """Name, argument and position of each opcode as pickletools.genops gives them, with its errors."""
    pos, n, find, pairs, stream = 0, len(data), data.find, _PAIRS, None
    while pos < n:
        name, reader = _READ[data[pos]]
        if reader is None:
            yield name, None, pos
            if name == "STOP":
                return
            pos += 1
        elif reader is _GLOBAL and (end := find(b"\n", find(b"\n", pos + 1) + 1 or n) + 1):
            lines = data[pos + 1 : end]
            yield name, (pairs.get(lines) or _pair(lines))[0], pos
            pos = end
        else:
            stream = stream or io.BytesIO(data)
            stream.seek(pos + 1)
            arg = reader(stream)
            yield name, _text(arg), pos
            pos = stream.tell()
    raise ValueError("pickle exhausted before seeing STOP")


def opcodes(data: bytes | Ranged | Forward) -> Iterator[tuple[str, str | None, int]]:
    """Name, argument and position of each opcode up to STOP or the first error.

    Streams of LARGE bytes or more, and those read from front to back, are walked without decoding payloads: long strings
    and blobs are passed over, of lines the first 4096 bytes are kept, and a byte that is no opcode is passed over.
    """
    if not isinstance(data, Forward) and len(data) < LARGE:
        try:
            yield from _decoded(data[:])
        except Exception:  # noqa: BLE001 - any malformed stream ends the walk
            return
        return
    stream = data if isinstance(data, Forward) else Forward.over(data)
    while (code := stream.byte()) is not None:
        op = _CODES.get(code)
        if op is None:
            continue
        here, arg = stream.at - 1, None
        if op.name in _SIZED:
            length = int.from_bytes(stream.take(_SIZED[op.name]), "little")
            if op.name in STRINGS and length < 1024:
                arg = stream.take(length).decode("utf-8", "replace")
            else:
                stream.skip(length)
        elif op.name in _LINES:
            parts = []
            for _ in range(_LINES[op.name]):
                line = stream.line()
                if line is None:
                    return
                parts.append(line.decode("utf-8", "replace"))
            arg = " ".join(parts)
        else:
            given = stream.take(_FIXED.get(op.name, 0))
            if op.name in ("BINGET", "BINPUT", "LONG_BINGET", "LONG_BINPUT"):
                arg = str(int.from_bytes(given, "little"))
        if op.name not in ("PROTO", "FRAME"):
            yield op.name, arg, here
        if op.name == "STOP":
            return


#: Opcodes without an argument that put a value of no interest on the stack.
_NOTHING = frozenset(c for c, o in _CODES.items() if o.name in {"NONE", "NEWTRUE", "NEWFALSE", "EMPTY_DICT", "EMPTY_LIST", "EMPTY_TUPLE", "EMPTY_SET"})


class Imports:
    """Finds module and name of each import from a stack of what is known of its items.

    Memoised values are followed, so a name fetched from the memo is known. The model is lenient: an
    opcode that needs more items than there are takes what there is.
    """

    PUSH = {"NONE", "NEWTRUE", "NEWFALSE", "BININT", "BININT1", "BININT2", "BINFLOAT", "EMPTY_DICT", "EMPTY_LIST", "EMPTY_TUPLE", "EMPTY_SET", "INT", "LONG", "LONG1", "LONG4", "FLOAT", "SHORT_BINBYTES", "BINBYTES", "BINBYTES8", "BYTEARRAY8", "PERSID"}
    TAKE = {"TUPLE1": 1, "TUPLE2": 2, "TUPLE3": 3, "REDUCE": 2, "NEWOBJ": 2, "NEWOBJ_EX": 3}

    def __init__(self) -> None:
        self.stack: list[str | None] = []
        self.memo: dict[str, str | None] = {}

    def to_mark(self) -> None:
        while self.stack and self.stack.pop() != "\0mark":
            pass

    def feed(self, name: str, arg: str | None) -> tuple[str, str] | None:
        s, found = self.stack, None
        if name in self.PUSH:
            s.append(None)
        elif name in ("GLOBAL", "INST"):
            module, _, attr = (arg or "").partition(" ")
            found = (module, attr)
            if name == "INST":
                self.to_mark()
            s.append(None)
        elif name in self.TAKE:
            del s[-self.TAKE[name] :]
            s.append(None)
        elif name in STRINGS:
            s.append(arg or "")
        elif name == "STACK_GLOBAL":
            if len(s) >= 2:
                attr, module = s.pop(), s.pop()
                found = (module or "<value>", attr or "<value>")
            else:
                found = ("<stack>", "<stack>")
            s.append(None)
        elif name == "MARK":
            s.append("\0mark")
        elif name in ("TUPLE", "LIST", "DICT", "FROZENSET", "OBJ"):
            self.to_mark()
            s.append(None)
        elif name in ("APPENDS", "SETITEMS", "ADDITEMS", "POP_MARK"):
            self.to_mark()
        elif name in ("APPEND", "BUILD", "POP"):
            del s[-1:]
        elif name == "SETITEM":
            del s[-2:]
        elif name == "DUP":
            s += s[-1:]
        elif name in ("MEMOIZE", "PUT", "BINPUT", "LONG_BINPUT"):
            self.memo[str(len(self.memo)) if name == "MEMOIZE" else str(arg)] = s[-1] if s else None
        elif name in ("GET", "BINGET", "LONG_BINGET"):
            s.append(self.memo.get(str(arg)))
        return found


def _opening(head: bytes) -> str | None:
    if not head:
        return "Empty file"
    if head[0] == 0x80:
        if len(head) < 2:
            return "Truncated pickle header"
        if head[1] > 5:
            return f"Unknown pickle protocol: {head[1]}"
    return None


def _closing(tail: bytes) -> str | None:
    return None if 0x2E in tail else "Missing STOP opcode"


def defect(data: bytes) -> str | None:
    """Why the bytes are no complete stream; null if they are one."""
    if (why := _opening(data[:2])) is not None:
        return why
    if len(data) > LARGE:
        return _closing(data[-16:])
    try:
        last = None
        for op, _, _ in pickletools.genops(io.BytesIO(data)):
            last = op.name
    except Exception as e:  # noqa: BLE001 - the text of any error is the answer
        return f"Parse error: {e}"
    return None if last == "STOP" else "Missing STOP opcode"


def _runs(data: bytes, stack: list, places: dict[tuple, list[int]]) -> Iterator[tuple[str, str | None, int]]:
    """What _decoded gives, but for opcodes of which a stream can have millions: they act on stack and places as Imports and facts would."""
    pos, n, find, pairs, stream = 0, len(data), data.find, _PAIRS, None
    while pos < n:
        code = data[pos]
        if code == 0x63 and (end := find(b"\n", find(b"\n", pos + 1) + 1 or n) + 1):
            lines = data[pos + 1 : end]
            found = (pairs.get(lines) or _pair(lines))[1]
            stack.append(None)
            if (at := places.get(found)) is None:
                places[found] = [pos]
            else:
                at.append(pos)
            pos = end
        elif code in _NOTHING:
            stack.append(None)
            pos += 1
        elif code == 0x30:
            del stack[-1:]
            pos += 1
        else:
            name, reader = _READ[code]
            if reader is None:
                yield name, None, pos
                if code == 0x2E:
                    return
                pos += 1
            else:
                stream = stream or io.BytesIO(data)
                stream.seek(pos + 1)
                arg = reader(stream)
                yield name, _text(arg), pos
                pos = stream.tell()
    raise ValueError("pickle exhausted before seeing STOP")


def facts(data: bytes | Ranged | Forward, once: bool = False) -> dict:
    """What the rules look at in one stream: why it is none, its imports, what creates or changes objects, and how often and where first it calls.

    All comes from one walk. A Forward, and what is longer than LARGE, is read once from front to back at constant memory.
    once: equal imports and equal opcodes are one, at their first place, with their number n.
    """
    if not isinstance(data, Forward):
        data = Forward.over(data) if len(data) > LARGE else data[:]
    elif len(head := data.peek(LARGE + 1)) <= LARGE:
        data = head
    forward = isinstance(data, Forward)
    why = _opening(data.peek(2) if forward else data[:2])
    machine = Imports()
    places: dict[tuple, list[int]] = {}
    opened: dict[str, list[int]] = {}
    calls, first = 0, None
    held = not forward and len(data) < LARGE
    try:
        for name, arg, pos in _runs(data, machine.stack, places) if held else opcodes(data):
            if found := machine.feed(name, arg):
                places.setdefault(found, []).append(pos)
            if name == "REDUCE":
                calls += 1
                if first is None:
                    first = pos
            elif name in _OPENERS:
                opened.setdefault(name, []).append(pos)
    except Exception as e:  # noqa: BLE001 - the text of any error is the answer
        why = why or f"Parse error: {e}"
    if why is None and not held:
        why = _closing(data.rest()) if forward else defect(data)
    if once:
        imports = [{"module": m, "name": n, "pos": at[0], "n": len(at)} for (m, n), at in places.items()]
        ops = [{"op": o, "pos": at[0], "n": len(at)} for o, at in opened.items()]
    else:
        imports = [{"module": m, "name": n, "pos": p} for p, m, n in sorted((p, m, n) for (m, n), at in places.items() for p in at)]
        ops = [{"op": o, "pos": p} for p, o in sorted((p, o) for o, at in opened.items() for p in at)]
    return {"defect": why, "imports": imports, "ops": ops, "calls": calls, "first_call": first}


STREAM = "defect string, imports array<struct<module:string,name:string,pos:bigint>>, ops array<struct<op:string,pos:bigint>>, calls bigint, first_call bigint"
_KNOWN = [f"{module} {name}" for module, name in S.KNOWN_CALLS]


def _top(module: Column, names: list[str]) -> Column:
    """Whether a module is one of the names or below one."""
    return module.rlike(rf"^(?:{'|'.join(names)})(?:\.|$)")


def is_known(i: Column) -> Column:
    return F.concat(i["module"], F.lit(" "), i["name"]).isin(*_KNOWN)


def is_dangerous(i: Column) -> Column:
    """Whether an import raises the calls of its stream."""
    return (i["module"] != "<stack>") & (is_known(i) | _top(i["module"], S.DANGEROUS_MODULES) | i["name"].isin(*S.DANGEROUS_FUNCTIONS))


def import_rules(i: Column, only: tuple[str, ...] = ("stack_global", "known_call", "module", "function")) -> Column:
    """The findings of one import: a known call, or else what its module and its name say. only: the rules that are wanted."""
    module, at = i["module"], i["pos"]
    full = F.concat_ws(".", module, F.nullif(i["name"], F.lit("")))
    top = F.when(_top(module, S.DANGEROUS_MODULES), finding("pickle.module", F.when(_top(module, S.CRITICAL_MODULES), S.C).otherwise(S.H), F.concat(F.lit("Dangerous import: "), full), at))
    function = F.when(i["name"].isin(*S.DANGEROUS_FUNCTIONS), finding("pickle.function", S.H, F.concat(F.lit("Dangerous function: "), full), at))
    by_value = finding("pickle.stack_global", S.M, "STACK_GLOBAL opcode found (dynamic import)", at)
    known = finding("pickle.known_call", S.C, F.concat(F.lit("Known malicious call: "), full), at)
    none = F.array().cast(f"array<{FINDING}>")
    one = lambda rule, found: F.array(found) if rule in only else none
    others = [found for rule, found in (("module", top), ("function", function)) if rule in only]
    return F.when(module == "<stack>", one("stack_global", by_value)).when(is_known(i), one("known_call", known)).otherwise(collected(*others))


def opcode_rule(o: Column) -> Column:
    """The finding of an opcode that creates or changes objects."""
    build = finding("pickle.build", S.M, "BUILD opcode found (may trigger __setstate__)", o["pos"])
    made = finding("pickle.object", S.M, F.concat(F.lit("Object creation opcode: "), o["op"]), o["pos"])
    return F.when(o["op"] == "BUILD", build).otherwise(made)


def call_rules(s: Column) -> Column:
    """The finding of a stream's calls, which its imports can raise."""
    severity = F.when(F.exists(s["imports"], is_dangerous), S.H).otherwise(S.M)
    calls = F.concat(F.lit("REDUCE opcode found "), s["calls"].cast("string"), F.lit(" time(s) (function calls)"))
    found = F.array(finding("pickle.reduce", severity, calls, s["first_call"], hits=s["calls"]))
    return F.when(s["calls"] > 0, found).otherwise(F.array().cast(f"array<{FINDING}>"))


def nested_rules(imports: Column) -> Column:
    """The finding of the first import of a pickle module."""
    inner = F.try_element_at(F.filter(imports, lambda i: i["module"].isin("pickle", "_pickle")), F.lit(1))
    return collected(F.when(inner.isNotNull(), finding("pickle.nested", S.H, "Nested pickle import detected (potential multi-stage attack)", inner["pos"])))


def stream_rules(s: Column) -> Column:
    """The findings of one stream, in the order: format, imports, opcodes, calls, nesting."""
    broken = collected(F.when(s["defect"].isNotNull(), finding("pickle.invalid", S.M, F.concat(F.lit("Invalid pickle format: "), s["defect"]), F.lit(0))))
    imports = F.flatten(F.transform(s["imports"], lambda i: import_rules(i)))
    return F.concat(broken, imports, F.transform(s["ops"], opcode_rule), call_rules(s), nested_rules(s["imports"]))
