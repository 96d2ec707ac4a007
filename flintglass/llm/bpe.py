"""Byte-level BPE encoding by a lazily determinised transducer, and streaming UTF-8 decoding.

After every byte of a piece there is exactly one last token that the merge order gives to the prefix
read so far, and a token t may follow a last token s iff encoding their joined bytes gives [s, t].
So the transducer keeps, for every position from which some token could still be in progress, the
place in the vocabulary's trie that the bytes read since then lead to, and which of the tokens below it
the last token before the position rules out. Such sets are the states; each has the last token of the
prefixes that lead to it, and they and their transitions are made when first met. Where few tokens are
below a place, those ruled out are listed, so all contexts that rule out the same ones share a state;
elsewhere the last token itself stands for them. States are dropped together when there are too many,
so memory is bounded however varied the texts are.

Tokens are read back from the last tokens of prefixes. All positions in progress have such a way back, and
where these ways meet, everything before is certain and is emitted: the lookahead is bounded by the
vocabulary, not by the piece.

Inputs: null and empty texts have no tokens. Pieces of a text beyond STREAM characters are encoded, hashed and
decoded in runs of RUN, so round_trip and lengths hold no more of it than the text itself. Rows
are independent, so ties and repeated rows need no rule; an empty table gives an empty table. Columns
of the input other than the named ones are kept, and an output column replaces one of its name.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MAX_STATES = 120_000
LISTED = 16
SETTLE = 4096
#: Pieces in each of a memo's two generations: about 100 MB together, or 25 MB beside other work.
MEMO, SMALL_MEMO = 300_000, 60_000
MEMO_CHARS = 48
STREAM, RUN = 1 << 20, 1 << 16


class Transducer:
    """Encodes pieces by the ranks of a byte-level BPE vocabulary: bytes of a token -> id."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"not a byte-level vocabulary: no token for byte {missing[0]}")
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.size = {i: len(b) for b, i in ranks.items()}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.lefts: dict[int, list[tuple[int, int]]] = {}
        self.rights: dict[int, list[tuple[dict[int, int], int]]] = {}
        self.joins: dict[int, dict[int, int]] = {}
        self._grow()
        self.moves: dict[int, int] = {}
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple[tuple[int, int], ...]] = []
        self.last: list[int] = []
        self.ruled: list[frozenset[int]] = []
        self.ruled_ids: dict[frozenset[int], int] = {}
        self.contexts: dict[tuple[int, int], int] = {}
        self.reset()

    def _grow(self) -> None:
        """The trie: (node << 8 | byte) -> node; a node's token or -1, its depth, and its tokens' range in order of bytes."""
        self.order = [self.ranks[b] for b in sorted(self.ranks)]
        self.kids: dict[int, int] = {}
        self.token, self.depth, self.low, self.high = [-1], [0], [0], [len(self.order)]
        path, before = [0], b""
        for k, t in enumerate(self.order):
            text = self.bytes_of[t]
            same = next((n for n, (x, y) in enumerate(zip(text, before, strict=False)) if x != y), min(len(text), len(before)))
            for node in path[same + 1 :]:
                self.high[node] = k
            del path[same + 1 :]
            for byte in text[same:]:
                self.kids[path[-1] << 8 | byte] = len(self.token)
                path.append(len(self.token))
                for column, value in ((self.token, -1), (self.depth, len(path) - 1), (self.low, k), (self.high, len(self.order))):
                    column.append(value)
            self.token[path[-1]] = t
            before = text
        self.inner = {x >> 8 for x in self.kids}

    def reset(self) -> None:
        for kept in (self.moves, self.ids, self.states, self.last, self.ruled, self.ruled_ids, self.contexts):
            kept.clear()
        self._state(((0, self._listed(frozenset())),), -1)

    def merged(self, text: bytes, until: int = 1) -> list[int]:
        """By applying the lowest-ranked merge again and again, stopping at that many parts; the definition of the encoding."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > until:
            rank, at = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte."""
        if token not in self.parts:
            text = self.bytes_of[token]
            if len(text) == 1:
                self.parts[token] = None
            else:
                made = self.merged(text, 2)
                if len(made) != 2 or max(made) >= token:
                    raise ValueError(f"token {token} isn't made by merges of lower ranks")
                self.parts[token] = (made[0], made[1])
        return self.parts[token]

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens on the left (0) or right (1) edge of a token's merge tree, each with the rank of the merge that takes it away."""
        out, gone = [], 1 << 60
        while True:
            out.append((token, gone))
            if (p := self.split(token)) is None:
                return out
            token, gone = p[side], token

    def _after(self, token: int) -> dict[int, int]:
        """The tokens that this one merges with when they come next, and the rank of the merge."""
        made = self.joins.get(token)
        if made is None:
            node, n, made = 0, self.size[token], {}
            for byte in self.bytes_of[token]:
                node = self.kids[node << 8 | byte]
            for k in range(self.low[node], self.high[node]):
                rest = self.ranks.get(self.bytes_of[self.order[k]][n:])
                if rest is not None:
                    made[rest] = self.order[k]
            self.joins[token] = made
        return made

    def follows(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their joined bytes are encoded.

        Merges come in order of rank, so the tokens at the seam are those on the right edge of one
        merge tree and the left edge of the other; the seam closes if two of them merge before the
        merges that take them away.
        """
        edge = self.lefts.get(right)
        if edge is None:
            edge = self.lefts[right] = self._edge(right, 0)
        seam = self.rights.get(left)
        if seam is None:
            seam = self.rights[left] = [(after, gone) for token, gone in self._edge(left, 1) if (after := self._after(token))]
        for after, a_gone in seam:
            for b, b_gone in edge:
                if b in after and after[b] < a_gone and after[b] <= b_gone:
                    return False
        return True

    def _listed(self, ruled: frozenset[int]) -> int:
        """The context, a negative number, that rules out these tokens, given by their places in order."""
        number = self.ruled_ids.get(ruled)
        if number is None:
            number = self.ruled_ids[ruled] = len(self.ruled)
            self.ruled.append(ruled)
        return ~number

    def _context(self, node: int, before: int) -> int:
        """What a context of the node's parent comes to at the node."""
        if before == -1:
            return before
        known = self.contexts.get((node, before))
        if known is None:
            low, high = self.low[node], self.high[node]
            if before < 0:
                known = self._listed(frozenset(k for k in self.ruled[~before] if low <= k < high))
            elif high - low > LISTED:
                known = before
            else:
                known = self._listed(frozenset(k for k in range(low, high) if not self.follows(before, self.order[k])))
            self.contexts[node, before] = known
        return known

    def _allowed(self, node: int, before: int) -> bool:
        return self.low[node] not in self.ruled[~before] if before < 0 else self.follows(before, self.token[node])

    def _state(self, live: tuple[tuple[int, int], ...], last: int) -> int:
        number = self.ids.get((live, last))
        if number is None:
            number = self.ids[live, last] = len(self.states)
            self.states.append(live)
            self.last.append(last)
        return number

    def _step(self, at: int, byte: int) -> int:
        """A transition met for the first time."""
        if len(self.states) >= self.max_states:
            now = [(node, before, before < 0 and self.ruled[~before]) for node, before in self.states[at]]
            self.reset()
            at = self._state(tuple((node, before if ruled is False else self._listed(ruled)) for node, before, ruled in now), -1)
        live, last = [], -1
        for node, before in self.states[at]:
            node = self.kids.get(node << 8 | byte)
            if node is not None:
                if last < 0 and self.token[node] >= 0 and self._allowed(node, before):
                    last = self.token[node]
                if node in self.inner:
                    live.append((node, self._context(node, before)))
        live.append((0, last))
        to = self.moves[at << 8 | byte] = self._state(tuple(live), last)
        return to

    def _read_back(self, track: list[int], end: int) -> list[int]:
        """The tokens of the first bytes, given the last token at each byte."""
        out, size = [], self.size
        while end:
            token = track[end - 1]
            out.append(token)
            end -= size[token]
        out.reverse()
        return out

    def _settled(self, track: list[int], at: int) -> int:
        """Where the ways back from all positions in progress meet."""
        ends = {len(track) - self.depth[node] for node, _ in self.states[at]}
        while len(ends) > 1:
            end = max(ends)
            ends.remove(end)
            ends.add(end - self.size[track[end - 1]])
        return ends.pop()

    def encode(self, piece: bytes) -> list[int]:
        out: list[int] = []
        track: list[int] = []
        at, get, last, add = 0, self.moves.get, self.last, track.append
        for lo in range(0, len(piece), SETTLE):
            if lo:
                end = self._settled(track, at)
                out += self._read_back(track, end)
                del track[:end]
            for byte in piece[lo : lo + SETTLE]:
                to = get(at << 8 | byte)
                at = self._step(at, byte) if to is None else to
                add(last[at])
        return out + self._read_back(track, len(track))


#: Ranges of first bytes: bytes that follow, and the range of the first of these.
_LEADS = ((0x00, 0x7F, 0, 0, 0), (0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F))


class Utf8Decoder:
    """Incremental UTF-8: a state is the number of bytes still due and the range of the next one.

    feed() gives the text completed so far; a byte that can't follow becomes U+FFFD, once for each
    maximal wrong sequence, and an unfinished sequence does when finish() is called.
    """

    FIRST = [next(((n, lo, hi) for a, b, n, lo, hi in _LEADS if a <= x <= b), None) for x in range(256)]

    def __init__(self) -> None:
        self.due, self.low, self.high, self.held = 0, 0x80, 0xBF, bytearray()

    def feed(self, data: bytes) -> str:
        out = []
        for x in data:
            if self.due:
                if self.low <= x <= self.high:
                    self.held.append(x)
                    self.due, self.low, self.high = self.due - 1, 0x80, 0xBF
                    if not self.due:
                        out.append(self.held.decode())
                        self.held.clear()
                    continue
                out.append(self.finish())
            if (first := self.FIRST[x]) is None:
                out.append("�")
            elif first[0] == 0:
                out.append(chr(x))
            else:
                self.due, self.low, self.high = first
                self.held.append(x)
        return "".join(out)

    def finish(self) -> str:
        """What is due for an unfinished sequence; the decoder is then as new."""
        out = "�" if self.due else ""
        self.due, self.low, self.high = 0, 0x80, 0xBF
        self.held.clear()
        return out


#: Texts whose characters all lie below this one are split by the standard library's faster matcher.
NARROW = 0x250


def _narrow(pattern: str):
    """The pattern for texts below NARROW, its classes spelled out, and the test for other texts; None if it has classes other than these."""
    import regex

    spelled = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        inside, out = regex.compile(name).fullmatch, []
        for on, run in itertools.groupby(range(NARROW), lambda i: bool(inside(chr(i)))):  # noqa: B023
            if on:
                run = list(run)
                out.append(f"{re.escape(chr(run[0]))}-{re.escape(chr(run[-1]))}")
        spelled[name] = "".join(out)
    rest, parts, inner = pattern, [], False
    while rest:
        name = next((n for n in (r"\p{L}", r"\p{N}", r"\S", r"\s") if rest.startswith(n)), rest[0])
        if name == "\\" or inner and name == r"\S":
            return None, None
        inner = name == "[" or inner and name != "]"
        both = spelled.get(name.lower() if name == r"\S" else name)
        parts.append(name if both is None else both if inner else f"[^{both}]" if name == r"\S" else f"[{both}]")
        rest = rest[len(name) :]
    return re.compile("".join(parts)), re.compile(f"[^\0-{chr(NARROW - 1)}]").search


class Codec:
    """A vocabulary with its splitting pattern."""

    def __init__(self, path: str, pattern: str, memo: int = MEMO):
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.machine = Transducer(ranks)
        self.general, self.narrow, self.wide = regex.compile(pattern), *_narrow(pattern)
        self.most = memo
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.table[i] = b
        self.whole: list[str | None] = [None] * len(self.table)
        for i, b in enumerate(self.table):
            if b is not None:
                try:
                    self.whole[i] = b.decode()
                except UnicodeDecodeError:
                    pass

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, of a long one in runs."""
        matcher = self.general if self.narrow is None or self.wide(text) else self.narrow
        if len(text) <= STREAM:
            yield matcher.findall(text)
        else:
            yield from map(list, itertools.batched((m.group() for m in matcher.finditer(text)), RUN))

    def piece(self, text: str) -> tuple[int, ...]:
        """The ids of a piece that isn't in the memo, which keeps what was asked for since it was last full or the time before."""
        out = self.older.get(text)
        if out is None:
            out = tuple(self.machine.encode(text.encode()))
        if len(text) <= MEMO_CHARS:
            if len(self.memo) >= self.most:
                self.memo, self.older = {}, self.memo
            self.memo[text] = out
        return out

    def runs(self, text: str | None) -> Iterator[list[tuple[int, ...]]]:
        """The ids of each piece, of a long text in runs."""
        for pieces in self.pieces(text or ""):
            get, piece = self.memo.get, self.piece
            yield [get(x) or piece(x) for x in pieces]

    def __call__(self, text: str | None) -> list[int]:
        return [i for run in self.runs(text) for ids in run for i in ids]

    def count(self, text: str | None) -> int:
        return sum(sum(map(len, run)) for run in self.runs(text))

    def decode(self, ids: Iterable[int], stream: Utf8Decoder) -> str:
        """The text that the ids complete; tokens that hold whole characters pass while the decoder holds nothing."""
        whole = [self.whole[i] for i in ids]
        if None not in whole and not stream.due:
            return "".join(whole)
        return "".join([stream.feed(self.table[i]) if text is None or stream.due else text for i, text in zip(ids, whole, strict=True)])

    def text(self, ids: list[int]) -> str:
        stream = Utf8Decoder()
        return self.decode(ids, stream) + stream.finish()


@lru_cache(maxsize=4)
def codec(path: str, pattern: str, memo: int = MEMO) -> Codec:
    return Codec(path, pattern, memo)


def _replaced(df: DataFrame, fields: list[T.StructField]) -> T.StructType:
    names = {f.name for f in fields}
    return T.StructType([f for f in df.schema.fields if f.name not in names] + fields)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """df with the ids of each text."""
    schema = _replaced(df, [T.StructField(ids, T.ArrayType(T.IntegerType()))])
    kept = schema.names[:-1]

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                p = b.slice(k, 256)
                made = pa.array([c(x) for x in p.column(text).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(p.column(n) for n in kept), made], names=schema.names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "token_ids", text: str = "text") -> DataFrame:
    """df with the text of each list of ids; a null list is an empty text."""
    schema = _replaced(df, [T.StructField(text, T.StringType())])
    kept = schema.names[:-1]

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                p = b.slice(k, 256)
                made = pa.array([c.text(x or []) for x in p.column(ids).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(p.column(n) for n in kept), made], names=schema.names)

    return df.mapInArrow(run, schema)


def encode_decode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids", size: str = "n_tokens") -> DataFrame:
    """df with the ids of each text, their number, and the text as decoded from them; one pass, so one vocabulary a worker.

    A null text has no ids, the number 0, and stays null. Columns of df named as ids or size are replaced, all others kept.
    """
    schema = _replaced(df, [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(size, T.LongType())])
    kept = schema.names[:-2]

    def run(batches):
        c = codec(path, pattern, SMALL_MEMO)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                p = b.slice(k, 256)
                made = [c(x) for x in p.column(text).to_pylist()]
                back = pa.array([c.text(x) if known else None for x, known in zip(made, p.column(text).is_valid().to_pylist(), strict=True)], pa.string())
                cols = [back if n == text else p.column(n) for n in kept]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(made, pa.list_(pa.int32())), pa.array([len(x) for x in made], pa.int64())], names=schema.names)

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each text: key, n_tokens, SHA-256 of the ids joined by spaces, and of the bytes decoded from them."""
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        c = codec(path, pattern)
        names = [str(i) for i in range(len(c.table))]
        for b in batches:
            counts, ids_sha, text_sha = [], [], []
            for x in b.column(text):
                n, of_ids, of_text, stream = 0, hashlib.sha256(), hashlib.sha256(), Utf8Decoder()
                for run in c.runs(x.as_py()):
                    ids = list(itertools.chain.from_iterable(run))
                    of_ids.update((" " * (n > 0) + " ".join([names[i] for i in ids])).encode())
                    of_text.update(c.decode(ids, stream).encode())
                    n += len(ids)
                of_text.update(stream.finish().encode())
                counts.append(n)
                ids_sha.append(of_ids.hexdigest())
                text_sha.append(of_text.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)


def lengths(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """One row n_tokens for each text."""

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            made = np.fromiter((c.count(x.as_py()) for x in b.column(text)), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(made)], names=["n_tokens"])

    return df.select(text).mapInArrow(run, "n_tokens long")
