"""How far the sources of a language differ in their words: exact divergences of all pairs, and each source's most telling terms.

Terms are runs of letters A-Z, lower-cased, and of characters beyond ASCII. A language keeps the terms that at least
MIN_DOCS of its rows hold. A group is a (lang, source); with N its occurrences of kept terms and V their number,
it gives each kept term the whole number p = 1 + floor(UNIT * (count + 1) / (N + V)), and q stands for the
other side's p. The value of a term is floor((p - q)^2 / q).

1. Tasks count occurrences and rows by (lang, source, term) before anything is shuffled, so a source with any share of
   all rows sends each term once a flush. Counts then meet by (lang, term), which gives the kept terms: one row a
   term, with its sources.
2. The kept terms are read in blocks of rows, in any order, as sums don't depend on it. A block is a dense group-by-term matrix of int64;
   values of all pairs of its groups come from broadcasting it against itself, some rows of groups at a time, and are summed over its terms into a partial
   pair matrix. Tasks add their matrices up, and so do the sums that follow.
3. For each group a heap holds the TOP best terms of a task; the heaps are merged by rank.

Only the groups' names and totals are broadcast: a group makes a result row with each other source of its language, so they are the
square root of the result. Pair matrices beyond CELLS cells go out after every block instead of being held.

Null text, lang and source count as ''. Rows that repeat are rows of their own. Every (lang, source) that occurs is a group, with value 0 for
each pair if no term is kept. An empty table gives an empty table. Columns other than the named ones aren't read. Long texts are counted in pieces.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flintglass.llm.store import Scratch

MIN_DOCS, UNIT, TOP = 3, 1_000_000_000, 200
FLUSH, PIECE = 400_000, 1 << 20
CELLS, TILE = 4_000_000, 1 << 20
#: Bytes of no term become spaces, A-Z lower case.
_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def term_lists(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in pieces."""
    line = data.translate(_BYTES)
    at = 0
    while at < len(line):
        to = line.find(b" ", at + PIECE)
        to = len(line) if to < 0 else to
        yield line[at:to].split()
        at = to


def _counted(batches):
    """lang, source, term, its occurrences and the rows that hold it, added up in the task as far as FLUSH entries go."""
    counts, rows = defaultdict(Counter), defaultdict(Counter)

    def out():
        for (lang, source), own in counts.items():
            terms = list(own)
            for lo in range(0, len(terms), 50_000):
                part = terms[lo : lo + 50_000]
                n, df = [own[t] for t in part], [rows[lang, source][t] for t in part]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()), pa.array(n, pa.int64()), pa.array(df, pa.int64())], names=["lang", "source", "term", "n", "df"])
        counts.clear()
        rows.clear()

    size = 0
    for b in batches:
        for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
            own, seen = counts[lang, source], set()
            before = len(own)
            for terms in term_lists(text.as_py()):
                own.update(terms)
                seen.update(terms)
            rows[lang, source].update(seen)
            size += len(own) - before
            if size > FLUSH:
                yield from out()
                size = 0
    yield from out()


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (counts + 1) / total): a long division by three digits at a time, so that nothing exceeds 63 bits."""
    rest, out = counts + 1, np.zeros(np.broadcast(counts, total).shape, np.int64)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + more
    return out + 1


def values(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class Lang:
    """What a task holds of one language: groups, their totals, a pair matrix and heaps."""

    def __init__(self, sources: list[str], totals: list[int], terms: int):
        self.sources, self.number = sources, {s: i for i, s in enumerate(sources)}
        self.total = np.array(totals, np.int64)[:, None] + terms
        self.all = np.int64(sum(totals) + terms)
        self.pairs = np.zeros((len(sources), len(sources)), np.int64)
        self.heaps: list[list] = [[] for _ in sources]

    def add(self, terms: list[bytes], at: np.ndarray, group: np.ndarray, n: np.ndarray, top: int) -> None:
        """A block: of the terms numbered at, groups have n occurrences."""
        counts = np.zeros((len(self.sources), len(terms)), np.int64)
        counts[group, at] = n
        p = shares(counts, self.total)
        step = max(1, TILE // max(1, p.size))
        for lo in range(0, len(p), step):
            self.pairs[lo : lo + step] += values(p[lo : lo + step, None, :], p[None, :, :]).sum(axis=2)
        q = shares(counts.sum(axis=0), self.all)
        best = np.where((counts > 0) & (p > q), values(p, q), -1)
        for heap, row in zip(self.heaps, best, strict=True):
            floor = heap[0][0] if len(heap) == top else 0
            found = np.flatnonzero(row >= floor)
            if len(found) > top:
                found = found[row[found] >= np.partition(row[found], -top)[-top]]
            for i in found.tolist():
                entry = (int(row[i]), _Last(terms[i]))
                if len(heap) < top:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)


class _Last:
    """A term that ranks the lower the later it comes in byte order."""

    __slots__ = ("term",)

    def __init__(self, term: bytes):
        self.term = term

    def __lt__(self, other: _Last) -> bool:
        return self.term > other.term

    def __eq__(self, other) -> bool:
        return self.term == other.term


_KIND = "lang string, source string, part string, item string, value long"


def _rows(lang: str, source: list[str], part: str, item: list[str], value) -> pa.RecordBatch:
    n = len(item)
    return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(source, pa.string()), pa.array([part] * n, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])


def _pairs(name: str, lang: Lang) -> Iterator[pa.RecordBatch]:
    for s, row in zip(lang.sources, lang.pairs, strict=True):
        yield _rows(name, [s] * (len(row) - 1), "pair", [x for x in lang.sources if x != s], np.delete(row, lang.number[s]))
    lang.pairs[:] = 0


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", top: int = TOP, scratch: Scratch | None = None) -> DataFrame:
    """lang, source, part, item, value and rank (from 1): for each group its distance to each other source, and its top terms against its language."""
    scratch, spark = scratch or Scratch(docs.sparkSession), docs.sparkSession
    read = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))))
    counted = read.mapInArrow(_counted, "lang string, source string, term binary, n long, df long").repartition("lang", "term")
    summed = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    terms = summed.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("groups"), F.sum("df").alias("df")).filter(F.col("df") >= MIN_DOCS)
    kept = scratch.keep(terms.select("lang", "term", "groups"))
    sizes = {r["lang"]: r["v"] for r in kept.groupBy("lang").agg(F.count("*").alias("v")).collect()}
    totals = kept.select("lang", F.inline("groups")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = read.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total")).orderBy("lang", "source")
    known: dict[str, tuple[list[str], list[int], int]] = {}
    for r in groups.collect():
        sources, counts, _ = known.setdefault(r["lang"], ([], [], sizes.get(r["lang"], 0)))
        sources.append(r["source"])
        counts.append(r["total"])
    shared = spark.sparkContext.broadcast(known)
    held = sum(len(s) ** 2 for s, _, _ in known.values()) <= CELLS

    def tiles(batches):
        langs: dict[str, Lang] = {}
        for b in batches:
            names, own = np.asarray(b.column("lang").to_pylist(), object), b.column("groups")
            sizes = np.diff(own.offsets.to_numpy())
            owner = np.repeat(np.arange(b.num_rows), sizes)
            inner = own.flatten()
            group, n = inner.field("source").to_pylist(), np.asarray(inner.field("n"))
            for name in set(names.tolist()):
                state = langs.get(name) or langs.setdefault(name, Lang(*shared.value[name]))
                rows = np.flatnonzero(names == name)
                place = np.full(b.num_rows, -1)
                place[rows] = np.arange(len(rows))
                cells = np.flatnonzero(place[owner] >= 0)
                state.add([b.column("term")[int(r)].as_py() for r in rows], place[owner[cells]], np.array([state.number[group[c]] for c in cells], np.int64), n[cells], top)
                if not held:
                    yield from _pairs(name, state)
                    langs[name].pairs = state.pairs
        for name, state in langs.items():
            if held:
                yield from _pairs(name, state)
            for s, heap in zip(state.sources, state.heaps, strict=True):
                yield _rows(name, [s] * len(heap), "term", [e[1].term.decode() for e in heap], [e[0] for e in heap])

    found = scratch.keep(kept.mapInArrow(tiles, _KIND))
    names = spark.createDataFrame([(name, s) for name, (sources, _, _) in known.items() for s in sources], "lang string, source string")
    empty = names.join(names.select("lang", F.col("source").alias("item")), "lang").filter("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    pairs = found.filter("part = 'pair'").union(empty).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).union(ranked(found.filter("part = 'term'")).filter(F.col("rank") <= top))
