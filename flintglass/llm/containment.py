"""Size-partitioned MinHash containment search: short test items inside long documents.

Items are partitioned by the size of their shingle set. An item of a partition whose largest set has u
shingles is indexed under its m lowest shingle hashes (a bottom-m MinHash sketch), m being one more
than the shingles that a match may lack at size u. A document that holds the wanted part of an item
then holds at least one of them, so no match is lost, however long the document is: its shingles are
probed against the index, and candidates are verified on the item's whole set.

Items shorter than a shingle are one shingle of their own width and are found as such runs of words.
Null or empty items and texts match nothing. Repeated documents and items each give their own rows.
The index is broadcast only when its checked size is within a bound, and joined by hash otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flintglass.llm.store import Scratch
from flintglass.llm.words import SHINGLE, shingles, words

MAX_BROADCAST_SHINGLES = 2_000_000
FILTER_BITS = 22


def _needed(size: int, threshold: float) -> int:
    return max(1, math.ceil(size * threshold - 1e-9))


def partition_bound(size: int) -> int:
    """The largest set size in the size's partition; bounds grow by about a quarter."""
    bound = 4
    while bound < size:
        bound = max(bound + 1, bound * 5 // 4)
    return bound


def sketch_length(size: int, threshold: float) -> int:
    bound = partition_bound(size)
    return min(size, bound - _needed(bound, threshold) + 1)


def item_sets(items: DataFrame, item: str, text: str) -> DataFrame:
    """item, width, n, and the set as one binary of sorted hashes; items without words have no row."""
    kind = items.schema[item].dataType
    schema = T.StructType([T.StructField("item", kind), T.StructField("width", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("hashes", T.BinaryType())])

    def run(batches):
        for b in batches:
            ids = b.column(item).to_pylist()
            out = []
            for lo, w in words(b.column(text)):
                for i in range(len(w)):
                    h = w.hash[w.ptr[i] : w.ptr[i + 1]]
                    if len(h):
                        s = np.unique(shingles(h))
                        out.append((ids[lo + i], min(SHINGLE, len(h)), len(s), s.tobytes()))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=pa.schema([("item", b.column(item).type), ("width", pa.int32()), ("n", pa.int64()), ("hashes", pa.binary())]))

    return items.select(item, text).mapInArrow(run, schema)


class _Index:
    """Sorted arrays: hashes of sketches with their items, and whole sets."""

    def __init__(self, rows: list[tuple[int, bytes]], threshold: float):
        """rows: width and set of each item."""
        self.widths = sorted({w for w, _ in rows})
        self.sets = [np.frombuffer(h, np.uint64) for _, h in rows]
        keys = [s[: sketch_length(len(s), threshold)] for s in self.sets]
        self.need = np.array([_needed(len(s), threshold) for s in self.sets])
        hashes, owners = np.concatenate(keys), np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owners = hashes[order], owners[order]
        self.bits = np.zeros(1 << FILTER_BITS, bool)
        self.bits[self.hashes >> np.uint64(64 - FILTER_BITS)] = True

    def probe(self, found: np.ndarray) -> np.ndarray:
        """Positions in found of hashes in the index."""
        at = np.flatnonzero(self.bits[found >> np.uint64(64 - FILTER_BITS)])
        if len(at):
            k = np.minimum(np.searchsorted(self.hashes, found[at]), len(self.hashes) - 1)
            at = at[self.hashes[k] == found[at]]
        return at

    def owners_of(self, hashes: np.ndarray) -> np.ndarray:
        lo, hi = (np.searchsorted(self.hashes, hashes, side=s) for s in ("left", "right"))
        return np.unique(np.concatenate([self.owners[a:b] for a, b in zip(lo, hi, strict=True)]))


def _runs(w, widths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each width the hashes of all runs of a slice's words, and for each the number of its text; runs that cross texts left out."""
    doc = np.repeat(np.arange(len(w)), np.diff(w.ptr))
    for width in widths:
        if len(doc) >= width:
            run = shingles(w.hash, width)
            inside = doc[: len(run)] == doc[width - 1 :]
            yield width, run, np.where(inside, doc[: len(run)], -1)


def search(docs: DataFrame, items: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", max_broadcast: int = MAX_BROADCAST_SHINGLES) -> DataFrame:
    """key, item, n_shingles of the item, n_shared, and first_word, last_word of the matching stretch, where n_shared >= threshold * n_shingles."""
    sets = item_sets(items, item, item_text)
    size = sets.agg(F.sum("n")).first()[0] or 0
    if size > max_broadcast:
        return _search_joined(docs, sets, threshold, key, text, item)
    rows = sets.collect()
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField(item, items.schema[item].dataType), *(T.StructField(n, T.LongType()) for n in ("n_shingles", "n_shared", "first_word", "last_word"))])
    if not rows:
        return docs.sparkSession.createDataFrame([], schema)
    index = _Index([(r["width"], bytes(r["hashes"])) for r in rows], threshold)
    widths = [r["width"] for r in rows]
    names = [r["item"] for r in rows]
    shared = docs.sparkSession.sparkContext.broadcast((index, widths, names))

    def run(batches):
        index, widths, names = shared.value
        kind = None
        for b in batches:
            keys, out = b.column(key), []
            kind = kind or pa.array(names[:1]).type
            for lo, w in words(b.column(text)):
                hits = []
                for width, made, doc in _runs(w, index.widths):
                    at = index.probe(made)
                    hits += [(int(doc[p]), width, made[p]) for p in at if doc[p] >= 0]
                for d in sorted({h[0] for h in hits}):
                    own = w.hash[w.ptr[d] : w.ptr[d + 1]]
                    for width in sorted({h[1] for h in hits if h[0] == d}):
                        inside = shingles(own, width)
                        order = np.argsort(inside, kind="stable")
                        ranked = inside[order]
                        for o in index.owners_of(np.array([h[2] for h in hits if h[:2] == (d, width)], np.uint64)):
                            if widths[o] == width:
                                s = index.sets[o]
                                left = np.searchsorted(ranked, s, side="left")
                                there = np.searchsorted(ranked, s, side="right") > left
                                if (n := int(there.sum())) >= index.need[o]:
                                    first = order[left[there]]
                                    out.append((lo + d, names[o], len(s), n, int(first.min()), int(first.max()) + width - 1))
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], kind), *(pa.array(c, pa.int64()) for c in cols[2:])], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def _search_joined(docs: DataFrame, sets: DataFrame, threshold: float, key: str, text: str, item: str) -> DataFrame:
    """For indexes too large to broadcast: the runs of documents are joined with the sketches, then with the sets, by hash.

    Rows of a text are told apart by a number of their own, so repeated keys stay separate.
    """

    def explode(whole: bool):
        def run(batches):
            for b in batches:
                for r in b.to_pylist():
                    s = np.frombuffer(r["hashes"], np.uint64)
                    if not whole:
                        s = s[: sketch_length(len(s), threshold)]
                    yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(np.full(len(s), r["i"]))], names=["hash", "i"])

        return run

    def occurrences(batches):
        for b in batches:
            for lo, w in words(b.column(text)):
                rows = np.asarray(b.column("row"), np.int64)[lo : lo + len(w)]
                for _, made, doc in _runs(w, list(range(1, SHINGLE + 1))):
                    ok = doc >= 0
                    first = np.arange(len(made)) - w.ptr[:-1][doc]
                    yield pa.RecordBatch.from_arrays([pa.array(rows[doc[ok]]), pa.array(made[ok].view(np.int64)), pa.array(first[ok])], names=["row", "hash", "at"])

    scratch = Scratch(docs.sparkSession)
    sets = scratch.keep(sets.withColumn("i", F.monotonically_increasing_id()))
    docs = scratch.keep(docs.select(key, text).withColumn("row", F.monotonically_increasing_id()))
    found = docs.select("row", text).mapInArrow(occurrences, "row long, hash long, at long")
    sketch = sets.mapInArrow(explode(False), "hash long, i long")
    pairs = found.join(sketch, "hash").select("row", "i").distinct()
    need = sets.select("i", F.col("n").alias("n_shingles"), "width", F.col("item").alias(item))
    whole = sets.mapInArrow(explode(True), "hash long, i long")
    mine = found.join(pairs.select("row").distinct(), "row", "left_semi").groupBy("row", "hash").agg(F.min("at").alias("at"))
    shared = pairs.join(whole, "i").join(mine, ["row", "hash"]).groupBy("row", "i").agg(F.count("*").alias("n_shared"), F.min("at").alias("first_word"), F.max("at").alias("last"))
    return (
        shared.join(need, "i")
        .filter(F.col("n_shared") >= F.ceil(F.col("n_shingles") * F.lit(threshold) - 1e-9))
        .join(docs.select("row", key), "row")
        .select(key, item, "n_shingles", "n_shared", "first_word", (F.col("last") + F.col("width") - 1).cast("long").alias("last_word"))
    )
