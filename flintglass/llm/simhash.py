"""Near-duplicate documents by SimHash fingerprints, compared bit-sliced.

A fingerprint has 64 bits; bit j is 1 if it is set in over half of the hashes of a text's 3-word
shingles, repeats included (XXH64, seed 42). Documents are linked if their fingerprints differ in at
most RADIUS bits.

1. Equal fingerprints form a class, represented by its least id: copies never meet in pairs.
2. Fingerprints within two bits of each other agree in two of four 16-bit quarters, so they meet
   under one of six keys. The rows of a key that more than LANES classes hold are dealt again: the bits that the
   key leaves open are cut in three, of which one agrees as well, until at most log2(LANES) bits are open. So no key has more
   than LANES fingerprints, however many near copies a document has, and nothing is left out.
3. A task packs neighbouring keys into blocks of up to LANES fingerprints and stores a block
   vertically: 64 bit planes, 64 fingerprints in each word of a plane. Fingerprints are compared with the
   whole block at once: each plane gives a word of differences, and carry-save counters of two
   bits and an overflow add them up. A fingerprint is done with a block as soon as all of it exceeds the radius.
4. Each block gives a spanning forest of its links, not all pairs; the components of these are the answer.

Null and empty texts, and texts without words, have the fingerprint zero and are linked like others.
Rows that repeat an id are one document, linked by each of its fingerprints. Rows with a null id have a
fingerprint, no links and a null component_id. An empty table gives an empty table. Columns other
than the two named ones aren't read. Long texts are hashed in pieces of PIECE bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from flintglass.llm.components import components
from flintglass.llm.store import Scratch
from flintglass.llm.words import mix

WIDTH, SEED, RADIUS = 3, 42, 2
LANES, SMALL = 4096, 512
PIECE = 1 << 20
_SPACE = re.compile(rb"[ \t-\r]")
_U = np.uint64
_QUARTERS = [0xFFFF << (16 * q) for q in range(4)]
_MASKS = [a | b for i, a in enumerate(_QUARTERS) for b in _QUARTERS[i + 1 :]]


def word_lists(data: bytes) -> Iterator[list[bytes]]:
    """The lower-cased words of a text, in pieces that end behind white space; each but the first begins with the last WIDTH - 1 words before it."""
    held: list[bytes] = []
    at = 0
    while at < len(data):
        gap = _SPACE.search(data, at + PIECE)
        to = gap.start() if gap else len(data)
        words = held + data[at:to].lower().split()
        if to == len(data) or len(words) >= WIDTH:
            yield words
            words = words[len(words) - WIDTH + 1 :]
        held, at = words, to


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of each run of WIDTH words, joined by spaces."""
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    line = b" ".join(words)
    starts = [0, *(e + 1 for e in ends)]
    return np.frombuffer(b"".join([xxh64_digest(line[a:b], SEED) for a, b in zip(starts, ends[WIDTH - 1 :], strict=False)]), ">u8")


def fingerprint(data: bytes) -> int:
    ones, n = np.zeros(64, np.int64), 0
    for words in word_lists(data):
        if n == 0 and 0 < len(words) < WIDTH:
            return int.from_bytes(xxh64_digest(b" ".join(words), SEED), "big")
        h = shingle_hashes(words)
        n += len(h)
        for lo in range(0, len(h), 4096):
            ones += np.unpackbits(h[lo : lo + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def children(mask: int) -> list[int]:
    """The three masks that add a third of the open bits to mask."""
    left = [b for b in range(64) if not mask >> b & 1]
    cuts = [0, -(-len(left) // 3), -(-2 * len(left) // 3), len(left)]
    return [mask | sum(1 << b for b in left[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]


def levels() -> list[list[int]]:
    """The masks of each level, as long as more than LANES fingerprints may share a key of it."""
    out = [_MASKS]
    while 64 - min(m.bit_count() for m in out[-1]) > LANES.bit_length() - 1:
        out.append([c for m in out[-1] for c in children(m)])
    return out


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """64 rows, one for each bit; in each, one bit for each fingerprint, padded to whole words with zeros."""
    bits = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    lanes = np.zeros((64, -(-len(prints) // 64) * 64), np.uint8)
    lanes[:, : len(prints)] = bits.T
    return np.packbits(lanes, axis=1, bitorder="little").view("<u8")


def near(queries: np.ndarray, planes: np.ndarray, over: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of those queries that have fingerprints within two bits in a block, and for each of them these as bits.

    ones and twos count differences modulo 4 in each lane, over remembers a count of 4 (and, from the start, lanes
    not to compare with); a count of 3 or more never falls below 3 again, so a query is given up when all lanes have one.
    """
    active = np.arange(len(queries))
    ones, twos = (np.zeros((len(queries), planes.shape[1]), np.uint64) for _ in range(2))
    for b in range(0, 64, 2):
        bit = [(-((queries[active] >> _U(b + i)) & _U(1)).view(np.int64)).view(np.uint64)[:, None] for i in (0, 1)]
        first, second = planes[b] ^ bit[0], planes[b + 1] ^ bit[1]
        half = ones ^ first
        carry = (ones & first) | (half & second)
        ones = half ^ second
        over |= twos & carry
        twos ^= carry
        if b % 8 == 6:
            alive = ((over | (ones & twos)) != ~_U(0)).any(axis=1)
            if not alive.all():
                active, ones, twos, over = active[alive], ones[alive], twos[alive], over[alive]
                if not len(active):
                    break
    return active, ~(over | (ones & twos))


def links(prints: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of a block within the radius."""
    n = len(prints)
    planes = bit_planes(prints)
    rows: dict[int, np.ndarray] = {}
    left = np.packbits(np.arange(planes.shape[1] * 64) < n, bitorder="little").view("<u8").copy()
    step = max(1, (1 << 15) // planes.shape[1])
    for lo in range(0, n, step):
        own = np.arange(lo, min(n, lo + step))
        over = np.tile(~left, (len(own), 1))
        over[own - lo, own >> 6] |= _U(1) << (own & 63).astype(np.uint64)
        found, hits = near(prints[own], planes, over)
        linked = hits.any(axis=1)
        rows |= zip(own[found[linked]].tolist(), hits[linked], strict=True)
    out = []
    for start in rows:
        if not int(left[start >> 6]) >> (start & 63) & 1:
            continue
        left[start >> 6] &= ~(_U(1) << _U(start & 63))
        queue = [start]
        while queue:
            x = queue.pop()
            fresh = rows[x] & left
            left ^= fresh
            met = np.flatnonzero(np.unpackbits(fresh.view(np.uint8), bitorder="little")).tolist()
            queue += met
            out += [(x, y) for y in met]
    return out


def _key(prints: np.ndarray, mask: int) -> np.ndarray:
    return mix(mix(prints & _U(mask)) + _U(mask)).view(np.int64)


def _keyed(masks: list[int], parents: bool):
    """For each class, or each class that came under a mask, its keys under masks or under those that follow from the one it came under."""
    follow = {m: children(m) for m in masks} if parents else {}

    def run(batches):
        for b in batches:
            reps, prints = np.asarray(b.column("rep")), np.asarray(b.column("print")).view(np.uint64)
            came = np.asarray(b.column("mask")).view(np.uint64) if parents else None
            for mask in masks:
                own = slice(None) if came is None else came == _U(mask)
                for m in follow.get(mask, [mask]):
                    p = prints[own]
                    if len(p):
                        yield pa.RecordBatch.from_arrays([pa.array(_key(p, m)), pa.array(reps[own]), pa.array(p.view(np.int64)), pa.array(np.full(len(p), m, np.uint64).view(np.int64))], names=["key", "rep", "print", "mask"])

    return run


def _blocks(batches):
    """Links within blocks of keys; rows come sorted by key, each key of at most LANES fingerprints. The last key's rows wait for the next batch."""
    none = np.zeros(0, np.int64)
    held = [none] * 3

    def within(keys, reps, prints):
        new = np.append(True, keys[1:] != keys[:-1])
        size = np.diff(np.append(np.flatnonzero(new), len(keys)))
        shared = np.repeat(size > 1, size)
        reps, prints, ends = reps[shared], prints[shared].view(np.uint64), np.cumsum(size[size > 1])
        lo = 0
        while lo < len(reps):
            first = int(np.searchsorted(ends, lo, side="right"))
            hi = int(ends[max(first, int(np.searchsorted(ends, lo + SMALL, side="right")) - 1)])
            own, at = np.unique(prints[lo:hi], return_index=True)
            made = np.array(links(own), np.int64).reshape(-1, 2)
            ids = reps[lo:hi][at]
            yield pa.RecordBatch.from_arrays([pa.array(ids[made[:, 0]]), pa.array(ids[made[:, 1]])], names=["a", "b"])
            lo = hi

    for b in batches:
        rows = [np.append(h, np.asarray(b.column(c))) for h, c in zip(held, ("key", "rep", "print"), strict=True)]
        if b.num_rows:
            whole = int(np.searchsorted(rows[0], rows[0][-1]))
            held = [r[whole:] for r in rows]
            if whole:
                yield from within(*(r[:whole] for r in rows))
    if len(held[0]):
        yield from within(*held)


def _prints(docs: DataFrame, key: str, text: str) -> DataFrame:
    def run(batches):
        for b in batches:
            prints = np.fromiter((fingerprint(t.as_py() or b"") for t in b.column(text).cast(pa.binary())), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(key).cast(pa.int64()), pa.array(prints.view(np.int64))], names=["id", "print"])

    return docs.select(key, text).mapInArrow(run, "id long, print long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """For each row: key, fingerprint (16 hex digits) and component_id, the least id reachable over links."""
    scratch = scratch or Scratch(docs.sparkSession)
    prints = scratch.keep(_prints(docs, key, text))
    known = prints.filter("id is not null")
    classes = scratch.keep(known.groupBy("print").agg(F.min("id").alias("rep")))

    edges, deep = [], levels()
    rows = classes.mapInArrow(_keyed(_MASKS, False), "key long, rep long, print long, mask long")
    for level, masks in enumerate(deep):
        if level + 1 == len(deep):
            fit, hot = rows, None
        else:
            rows = scratch.keep(rows)
            hot = scratch.keep(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > LANES).select("key"))
            crowded = not hot.isEmpty()
            fit = rows.join(hot, "key", "left_anti") if crowded else rows
        sorted_rows = fit.select("key", "rep", "print").repartition("key").sortWithinPartitions("key")
        edges.append(scratch.keep(sorted_rows.mapInArrow(_blocks, "a long, b long").distinct()))
        if hot is None or not crowded:
            break
        rows = rows.join(hot, "key", "left_semi").select("rep", "print", "mask").mapInArrow(_keyed(masks, True), "key long, rep long, print long, mask long")

    several = known.groupBy("id").agg(F.min("print").alias("low"), F.max("print").alias("high")).filter("low <> high").select("id")
    same = known.join(several, "id", "left_semi").distinct().join(classes, "print").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    all_edges = same
    for e in edges:
        all_edges = all_edges.union(e)
    found = components(all_edges, scratch)
    classed = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("print", F.coalesce("component", "rep").alias("component"))
    out = prints.join(classed, "print", "left")
    return out.select(
        F.col("id").alias(key),
        F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"),
    )
