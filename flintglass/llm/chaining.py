"""Passages that repeat across documents, also with small changes, by collinear chaining.

1. Seeds: of every window of 8 five-word runs the one with the lowest hash, so any common stretch of
   12 words has a seed in common. A seed met again in a text is also taken with its number there.
2. Each seed's first occurrence (least document id, then position) is its source; every other
   document's occurrences are matched with it. A passage in a thousand documents makes a thousand
   matches a seed, not a million.
3. Matches of a document with one source document are chained: positions must rise in both, a gap
   costs by its length in both, and the best predecessor comes from a Fenwick tree of maxima.
4. Chains are cut where a gap is long, and their surroundings fetched from both texts and aligned (longest
   common subsequence, bit-parallel). Passages are all stretches of the alignment, found best first, that
   have enough words of which enough agree.
5. A passage whose seeds have several sources, each with less of it, is in none of these chains. So seeds that
   lie outside of reported passages, in any document but their first, are paired with those so far behind them as any run of min_words has seeds, and up to twice that.
   Such a pair has a source of its own: the least document with both seeds so far apart, which a document with fewer words of a
   passage doesn't have. Matches with these sources are chained and aligned like the others, so passages with changed words
   are found however their seeds are spread over earlier documents.
6. Then every run of min_words words that isn't within reported passages and whose seeds all are in other documents is looked
   for as a whole: seeds that follow each other over the length that any such run has find the places (in
   all documents, sources included), hashes of the runs themselves the least document with each. Runs next to
   each other are reported as one exact passage. So no exact run of min_words is left that an earlier document has.

Sources are the earlier documents, so dropping every reported passage keeps one copy of each.

Null or empty texts, and texts of fewer than five words, have no seeds. Rows with a null id are not
searched. Rows that repeat an id count as one document: the one with most words, and of these the
one with the largest sum of hashes. Exact copies are reported as passages that span them. An empty table
gives an empty table; columns other than the two named ones are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flintglass.llm.store import Scratch, unused
from flintglass.llm.streams import apart, runs, whole
from flintglass.llm.words import SHINGLE, mix, rolled, shingles, words

WINDOW = 8
SEED_SCORE = 4.0
GAP_COST = 0.1
MAX_GAP = 32
MIN_SEEDS = 3
MIN_SPAN = 16
MARGIN = 40
PIECE = 2048
SPANS_PER_ROW = 512
MISMATCH = 2.0
ROWS_OUT = 1 << 16
#: Seeds and pairs of the search for spread passages are broadcast up to so many (of 8 to 24 bytes), and joined by a shuffle beyond.
KNOWN = 1_000_000


def minimizers(grams: np.ndarray) -> np.ndarray:
    """Positions of the lowest hash of each window, the first of equals; of a shorter text's only window."""
    if len(grams) <= WINDOW:
        return np.array([int(grams.argmin())]) if len(grams) else np.zeros(0, np.int64)
    low = np.lib.stride_tricks.sliding_window_view(grams, WINDOW).argmin(axis=1) + np.arange(len(grams) - WINDOW + 1)
    return low[np.append(True, low[1:] != low[:-1])]


def seeds(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of one text and their word positions; those of a seed met again that have its number are odd, all others even."""
    if len(hashes) < SHINGLE:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = shingles(hashes)
    at = np.unique(minimizers(grams))
    seed = grams[at] & ~np.uint64(1)
    order = np.argsort(seed, kind="stable")
    again = seed[order]
    first = np.append(True, again[1:] != again[:-1])
    if first.all():
        return seed, at
    rank = np.arange(len(seed)) - np.maximum.accumulate(np.where(first, np.arange(len(seed)), 0))
    later = order[rank > 0]
    return np.append(seed, mix(seed[later] + rank[rank > 0].astype(np.uint64)) | np.uint64(1)), np.append(at, at[later])


def best_chains(pos: np.ndarray, src: np.ndarray) -> list[np.ndarray]:
    """Chains of matches, as numbers of matches in rising order; pos must be sorted. Best first, none sharing a match."""
    n = len(pos)
    if n > 1 and (np.diff(pos) > 0).all() and (np.diff(src) > 0).all():
        return [np.arange(n)]
    slot = (np.unique(src, return_inverse=True)[1] + 1).tolist()
    top = max(slot)
    tree, holder = [-1e18] * (top + 1), [-1] * (top + 1)
    score, back = [0.0] * n, [-1] * n
    p, c = pos.tolist(), src.tolist()
    lo = 0
    while lo < n:
        hi = lo
        while hi < n and p[hi] == p[lo]:
            best, by, at = -1e18, -1, slot[hi] - 1
            while at:
                if tree[at] > best:
                    best, by = tree[at], holder[at]
                at &= at - 1
            best -= GAP_COST * (p[hi] + c[hi])
            score[hi] = SEED_SCORE + max(0.0, best)
            back[hi] = by if best > 0 else -1
            hi += 1
        for j in range(lo, hi):
            value, at = score[j] + GAP_COST * (p[j] + c[j]), slot[j]
            while at <= top:
                if value > tree[at]:
                    tree[at], holder[at] = value, j
                at += at & -at
        lo = hi
    used, out = [False] * n, []
    for j in sorted(range(n), key=lambda j: (-score[j], j)):
        chain = []
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(j)
            j = back[j]
        if len(chain) >= MIN_SEEDS:
            out.append(np.array(chain[::-1]))
    return out


def spans(pos: np.ndarray, src: np.ndarray) -> list[tuple[int, int, int, int]]:
    """First and last word (end excluded) in the text and the source of each part of a chain; no gap in it is long, and no part very long."""
    out = []
    for chain in best_chains(pos, src):
        p, c = pos[chain], src[chain]
        cut = np.flatnonzero((np.diff(p) > MAX_GAP) | (np.diff(c) > MAX_GAP)) + 1
        for part in np.split(np.arange(len(p)), cut):
            while len(part) >= MIN_SEEDS:
                take = int(np.searchsorted(p[part], p[part[0]] + PIECE, side="right"))
                now, part = part[:take], part[take:]
                a, b = now[0], now[-1]
                if len(now) >= MIN_SEEDS and p[b] + SHINGLE - p[a] >= MIN_SPAN:
                    out.append((int(p[a]), int(p[b]) + SHINGLE, int(c[a]), int(c[b]) + SHINGLE))
    return out


def aligned(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence, found with one big integer a row."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    middle = []
    if x and y:
        where: dict[int, int] = {}
        for i, word in enumerate(x):
            where[word] = where.get(word, 0) | (1 << i)
        full = (1 << len(x)) - 1
        v, rows = full, []
        for word in y:
            u = v & where.get(word, 0)
            v = ((v + u) | (v - u)) & full
            rows.append(v)
        # length of the best for x[:i], y[:j]: the zero bits below i of row j
        length = lambda i, j: i - (rows[j - 1] & ((1 << i) - 1)).bit_count() if i and j else 0
        i, j = len(x), len(y)
        now = length(i, j)
        while now:
            if x[i - 1] == y[j - 1]:
                middle.append((head + i - 1, head + j - 1))
                i, j, now = i - 1, j - 1, now - 1
            elif length(i, j - 1) == now:
                j -= 1
            else:
                i -= 1
    return [(i, i) for i in range(head)] + middle[::-1] + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def stretch(pairs: list[tuple[int, int]], mismatch: float) -> tuple[int, int] | None:
    """First and last pair of the stretch of the alignment with the best score, a word that agrees counting 1 and each skipped one -mismatch."""
    best, now, start, out = 0.0, 0.0, 0, None
    for k, (i, j) in enumerate(pairs):
        if k:
            skipped = max(i - pairs[k - 1][0], j - pairs[k - 1][1]) - 1
            now -= mismatch * skipped
        if now <= 0:
            now, start = 0.0, k
        now += 1
        if now > best:
            best, out = now, (start, k)
    return out


def longest(pairs: list[tuple[int, int]], min_words: int, min_identity: float) -> tuple[int, int] | None:
    """First and last pair of the stretch with most pairs of all that have the words and the identity, by trying all."""
    at = np.array(pairs, np.int64).reshape(-1, 2)
    n, most, out = len(at), int(np.ceil(min_identity * min_words)) - 1, None
    for k in range(n):
        if n - k <= most:
            break
        size = at[k + most :] - at[k] + 1
        good = (size.min(axis=1) >= min_words) & (np.arange(most + 1, n - k + 1) >= min_identity * size.max(axis=1))
        if good.any():
            last = k + most + int(np.flatnonzero(good)[-1])
            most, out = last - k + 1, (k, last)
    return out


def stretches(a: list[int], b: list[int], min_words: int, min_identity: float) -> list[tuple[int, int, int, int, int]]:
    """Bounds in a and b, and words that agree, of stretches of the alignment with at least so many words and such an identity, none sharing a word.

    Of a range of the alignment the best-scoring stretch is taken, at a penalty that joins across gaps; if
    it lacks identity, that at a penalty under which every stretch has it; if that is too short, the longest of
    all. The ranges left and right of it follow, until none is left.
    """
    pairs = aligned(a, b)
    strict = min_identity / (1 - min_identity) if min_identity < 1 else len(a) + len(b)

    def judge(lo: int, hi: int) -> tuple[int, int, int, int, int] | None:
        (i, j), (x, y) = pairs[lo], pairs[hi]
        size = (x + 1 - i, y + 1 - j)
        good = min(size) >= min_words and hi - lo + 1 >= min_identity * max(size)
        return (i, x + 1, j, y + 1, hi - lo + 1) if good else None

    out, ranges = [], [(0, len(pairs))]
    while ranges:
        lo, hi = ranges.pop()
        part = pairs[lo:hi]
        if len(part) < min_identity * min_words:
            continue
        for rule in (lambda p: stretch(p, MISMATCH), lambda p: stretch(p, strict), lambda p: longest(p, min_words, min_identity)):
            at = rule(part)
            if at and (made := judge(lo + at[0], lo + at[1])):
                out.append(made)
                ranges += [(lo, lo + at[0]), (lo + at[1] + 1, hi)]
                break
    return sorted(out)


def _batched(rows, names: list[str]):
    """Record batches of the tuples of arrays in rows, many to a batch."""
    held: list = []
    size = 0
    for r in rows:
        held.append(r)
        size += len(r[0])
        if size > ROWS_OUT:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)
            held, size = [], 0
    if size:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)


def uncovered(starts: np.ndarray, size: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which stretches of so many words aren't within the union of the intervals; lo must be sorted."""
    if not len(lo):
        return np.ones(starts.shape, bool)
    end = np.maximum.accumulate(hi)
    head = np.append(True, lo[1:] > end[:-1])
    first, last = lo[head], end[np.append(np.flatnonzero(head)[1:] - 1, len(lo) - 1)]
    at = np.searchsorted(first, starts, side="right") - 1
    return (at < 0) | (starts + size > last[at])


def _single(source: DataFrame) -> DataFrame:
    """Of rows that repeat an id, the one that counts."""
    repeated = source.groupBy("id").agg(F.count("*").alias("rows")).filter("rows > 1").select("id")
    if repeated.isEmpty():
        return source

    def weigh(batches):
        for b in batches:
            n, weight = [], []
            for _, w in words(b.column("text")):
                n += np.diff(w.ptr).tolist()
                weight += [int(w.hash[lo:hi].sum(dtype=np.uint64) >> np.uint64(1)) for lo, hi in zip(w.ptr[:-1], w.ptr[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text"), pa.array(n, pa.int64()), pa.array(weight, pa.int64())], names=["id", "text", "n", "weight"])

    weighed = source.join(repeated, "id", "left_semi").mapInArrow(weigh, "id long, text string, n long, weight long")
    best = Window.partitionBy("id").orderBy(F.desc("n"), F.desc("weight"), "text")
    chosen = weighed.withColumn("k", F.row_number().over(best)).filter("k = 1").select("id", "text")
    return source.join(repeated, "id", "left_anti").union(chosen)


def spanning_matches(sourced: DataFrame, reported: DataFrame, min_words: int, scratch: Scratch) -> DataFrame:
    """id, src, pos, src_pos of the seeds in pairs so far apart as any run of min_words has, or twice that, src being the least document with the pair; reported (id, lo, hi) are left alone."""
    nearest = max(1, min_words - SHINGLE - 2 * (WINDOW - 1))
    farthest = 2 * nearest

    def pairs(ids: np.ndarray, pos: np.ndarray, seed: np.ndarray):
        """Of many documents at once: their positions lie far apart."""
        (line,) = apart(ids, pos)
        for step in range(1, farthest + 1):
            gap = line[step:] - line[:-step]
            if not len(gap) or gap.min() > farthest:
                return
            i = np.flatnonzero((gap >= nearest) & (gap <= farthest))
            if len(i):
                j = i + step
                yield mix(mix(seed[i]) + seed[j]).view(np.int64), ids[i], pos[i].astype(np.int32), pos[j].astype(np.int32), seed[i].view(np.int64), seed[j].view(np.int64)

    names = ["pair", "id", "a", "b", "seed", "later"]
    schema = "pair long, id long, a int, b int, seed long, later long"

    def outside(batches):
        def made():
            for ids, kind, pos, value, src in whole(batches, ["id", "kind", "pos", "value", "src"], "id"):
                line, end = apart(ids, pos, value)
                seen = kind == 1
                free = np.flatnonzero(seen)[uncovered(line[seen], SHINGLE, line[~seen], end[~seen]) & (src[seen] != ids[seen])]
                yield from pairs(ids[free], pos[free], value[free].view(np.uint64))

        return _batched(made(), names)

    def everywhere(batches):
        return _batched((p for ids, pos, seed in whole(batches, ["id", "pos", "seed"], "id") for p in pairs(ids, pos, seed.view(np.uint64))), names)

    small = lambda df: F.broadcast(df) if df.limit(KNOWN + 1).count() <= KNOWN else df
    even = sourced.filter(F.col("seed").bitwiseAND(F.lit(1)) == 0)
    rows = even.select("id", F.lit(1).alias("kind"), F.col("pos").cast("long").alias("pos"), F.col("seed").alias("value"), "src")
    rows = rows.union(reported.select("id", F.lit(0), "lo", "hi", F.lit(0).cast("long")))
    own = scratch.keep(rows.repartition("id").sortWithinPartitions("id", "kind", "pos").mapInArrow(outside, schema))
    wanted = scratch.keep(own.select(F.explode(F.array("seed", "later")).alias("seed")).distinct())
    asked = scratch.keep(own.select("pair").distinct())
    near = even.select("id", "pos", "seed").join(small(wanted), "seed", "left_semi").repartition("id").sortWithinPartitions("id", "pos")
    every = near.mapInArrow(everywhere, schema).select("pair", "id", "a", "b").join(small(asked), "pair", "left_semi")
    least = scratch.keep(every.groupBy("pair").agg(F.min(F.struct("id", "a", "b")).alias("least")))
    scratch.drop(wanted, asked)
    both = own.join(small(least), "pair").filter("least.id < id")
    ends = F.explode(F.array(F.struct(F.col("a").alias("pos"), F.col("least.a").alias("src_pos")), F.struct(F.col("b").alias("pos"), F.col("least.b").alias("src_pos"))))
    return both.select("id", F.col("least.id").alias("src"), ends.alias("m")).select("id", "src", "m.*").distinct()


def split_sources(source: DataFrame, sourced: DataFrame, reported: DataFrame, min_words: int, scratch: Scratch) -> DataFrame:
    """id, src, lo, hi, src_lo, src_hi of the exact runs of min_words or more that an earlier document has and that aren't within reported ones (id, lo, hi)."""
    reach = max(0, min_words - SHINGLE - 2 * (WINDOW - 1))
    ahead = np.arange(WINDOW)

    def places(batches):
        def made():
            for ids, kind, at, value in whole(batches, ["id", "kind", "pos", "value"], "id"):
                line, end = apart(ids, at, value)
                seen = kind == 1
                lo, hi = line[~seen], end[~seen]
                ids, at, pos, seed = ids[seen], at[seen], line[seen], value[seen].view(np.uint64)
                if not len(pos):
                    continue
                part = np.append(0, np.cumsum(np.diff(pos) > WINDOW))
                to = np.searchsorted(pos, pos + reach)
                a = np.flatnonzero(to < len(pos))
                a = a[part[a] == part[to[a]]]
                mask = ((uncovered(pos[a, None] - ahead, min_words, lo, hi) & (at[a, None] >= ahead)) << ahead).sum(axis=1)
                yield rolled(seed, a, to[a] + 1).view(np.int64), ids[a], at[a].astype(np.int32), mask.astype(np.int32)

        return _batched(made(), ["line", "id", "pos", "mask"])

    rows = sourced.filter(F.col("seed").bitwiseAND(F.lit(1)) == 0).select("id", F.lit(1).alias("kind"), F.col("pos").cast("long").alias("pos"), F.col("seed").alias("value"))
    rows = rows.union(reported.select("id", F.lit(0), "lo", "hi"))
    lines = scratch.keep(rows.repartition("id").sortWithinPartitions("id", "kind", "pos").mapInArrow(places, "line long, id long, pos int, mask int"))
    scratch.drop(sourced)
    asked = scratch.keep(lines.groupBy("line").agg(F.min("id").alias("least"), F.max(F.when(F.col("mask") > 0, F.col("id"))).alias("top")).filter("least < top").select("line"))
    listed = lines.join(asked, "line").groupBy("id").agg(F.collect_list(F.struct("pos", "mask")).alias("at"))

    def cut(batches):
        def made():
            for b in batches:
                at, ids = b.column("at"), np.asarray(b.column("id"))
                for first, w in words(b.column("text")):
                    for i in range(len(w)):
                        own = w.hash[w.ptr[i] : w.ptr[i + 1]]
                        if len(own) < min_words:
                            continue
                        inner = at[first + i].values.flatten()
                        pos, mask = (np.asarray(x) for x in inner)
                        wanted, free = (np.zeros(len(own) - min_words + 1, bool) for _ in range(2))
                        for k in range(WINDOW):
                            here = (pos >= k) & (pos - k < len(wanted))
                            wanted[pos[here] - k] = True
                            free[pos[here & (mask >> k & 1 > 0)] - k] = True
                        starts = np.flatnonzero(wanted)
                        yield rolled(own, starts, starts + min_words).view(np.int64), np.full(len(starts), ids[first + i]), starts.astype(np.int32), free[starts]

        return _batched(made(), ["run", "id", "pos", "free"])

    found = scratch.keep(source.join(listed, "id").mapInArrow(cut, "run long, id long, pos int, free boolean"))
    scratch.drop(lines, asked)
    least = scratch.keep(found.groupBy("run").agg(F.min(F.struct("id", "pos")).alias("least"), F.max(F.when(F.col("free"), F.col("id"))).alias("top")).filter("least.id < top"))
    matches = found.filter("free").join(least, "run").filter("least.id < id").select("id", F.col("least.id").alias("src"), F.col("pos").cast("long").alias("pos"), (F.col("least.pos") - F.col("pos")).cast("long").alias("shift"))

    def joined(batches):
        def made():
            for ids, src, pos, shift in runs(batches, ["id", "src", "pos", "shift"], "id"):
                ids, src, pos, shift = (np.asarray(x) for x in (ids, src, pos, shift))
                head = np.append(True, (np.diff(src) != 0) | (np.diff(shift) != 0) | (np.diff(pos) > 1))
                lo, hi = pos[head], pos[np.append(np.flatnonzero(head)[1:] - 1, len(pos) - 1)] + min_words
                yield ids[head], src[head], lo, hi, lo + shift[head], hi + shift[head]

        return _batched(made(), ["id", "src", "lo", "hi", "src_lo", "src_hi"])

    return matches.repartition("id").sortWithinPartitions("id", "src", "shift", "pos").mapInArrow(joined, "id long, src long, lo long, hi long, src_lo long, src_hi long")


def passages(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 50, min_identity: float = 0.8, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, src_doc_id; start_word, end_word, src_start_word, src_end_word (ends excluded); n_matched words, and identity: n_matched by the longer side."""
    scratch = scratch or Scratch(docs.sparkSession)
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).filter("id is not null")
    source = _single(source)

    def emit(batches):
        for b in batches:
            ids = np.asarray(b.column("id"))
            for first, w in words(b.column("text")):
                seed, at, own = [], [], []
                for i in range(len(w)):
                    s, p = seeds(w.hash[w.ptr[i] : w.ptr[i + 1]])
                    seed.append(s)
                    at.append(p)
                    own.append(np.full(len(s), ids[first + i]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(seed).view(np.int64)), pa.array(np.concatenate(own)), pa.array(np.concatenate(at).astype(np.int32))], names=["seed", "id", "pos"])

    found = source.mapInArrow(emit, "seed long, id long, pos int")
    # sources are written before they are joined: Spark splits the rows of a seed met very often only in joins of tables, not of aggregates
    first = scratch.keep(found.groupBy("seed").agg(F.min("id").alias("src"), F.max("id").alias("top")).filter("src < top").drop("top"))
    sourced = scratch.keep(found.join(first, "seed"))
    scratch.drop(first)
    origin = scratch.keep(sourced.filter("id = src").groupBy("seed").agg(F.min("pos").alias("src_pos")))
    matches = sourced.filter("id <> src").join(origin, "seed").select("id", "src", "pos", "src_pos")

    def chained(batches):
        for ids, srcs, pos, at in runs(batches, ["id", "src", "pos", "src_pos"], "id"):
            src, pos, at = (np.asarray(x) for x in (srcs, pos, at))
            cuts = [0, *(np.flatnonzero(src[1:] != src[:-1]) + 1).tolist(), len(src)]
            out = [(src[lo], *s) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) if hi - lo >= MIN_SEEDS for s in spans(pos[lo:hi], at[lo:hi])]
            cols = np.array(out, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out), ids[0].as_py())), *(pa.array(c) for c in cols)], names=["id", "src", "lo", "hi", "src_lo", "src_hi"])

    names = [key, f"src_{key}", "start_word", "end_word", "src_start_word", "src_end_word", "n_matched", "identity"]
    schema = ", ".join(f"`{x}` {'double' if x == 'identity' else 'long'}" for x in names)

    def compared(matches: DataFrame) -> DataFrame:
        """Passages of the chains of matches."""
        chains = matches.repartition("id").sortWithinPartitions("id", "src", "pos", "src_pos").mapInArrow(chained, "id long, src long, lo long, hi long, src_lo long, src_hi long")
        chains = scratch.keep(chains.withColumn("chain", F.monotonically_increasing_id()))

        sides = chains.select("chain", F.explode(F.array(F.struct("id", "lo", "hi", F.lit(0).alias("side")), F.struct(F.col("src").alias("id"), F.col("src_lo").alias("lo"), F.col("src_hi").alias("hi"), F.lit(1).alias("side")))).alias("s")).select("chain", "s.*")
        parts = scratch.keep(sides.groupBy("id").agg(F.ceil(F.count("*") / SPANS_PER_ROW).cast("int").alias("parts")))
        listed = sides.join(parts, "id").groupBy("id", F.pmod(F.xxhash64("chain"), F.col("parts")).alias("part")).agg(F.collect_list(F.struct("chain", "side", "lo", "hi")).alias("spans"))
        texts = source.join(listed.select("id", "spans"), "id")

        def cut(batches):
            for b in batches:
                spans_of = b.column("spans")
                out = []
                ids = np.asarray(b.column("id"))
                for first, w in words(b.column("text")):
                    for i in range(len(w)):
                        own = (w.hash[w.ptr[i] : w.ptr[i + 1]] >> np.uint64(32)).astype(np.uint32)
                        weight = int(w.hash[w.ptr[i] : w.ptr[i + 1]].sum(dtype=np.uint64) >> np.uint64(1))
                        for s in spans_of[first + i].as_py():
                            lo, hi = max(0, s["lo"] - MARGIN), s["hi"] + MARGIN
                            out.append((s["chain"] * 2 + s["side"], s["chain"], s["side"], int(ids[first + i]), lo, len(own), weight, own[lo:hi].tobytes()))
                cols = list(zip(*out, strict=True)) or [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["order", "chain", "side", "id", "at", "n", "weight", "own"])

        windows = texts.mapInArrow(cut, "order long, chain long, side int, id long, at long, n long, weight long, own binary")

        def judged(batches):
            for chain, side, ids, at, n, weight, own in runs(batches, ["chain", "side", "id", "at", "n", "weight", "own"], "chain"):
                best = {}
                for k in range(len(side)):
                    best[side[k].as_py()] = max(best.get(side[k].as_py(), (-1,)), (n[k].as_py(), weight[k].as_py(), k))
                rows = []
                if len(best) == 2:
                    i, j = best[0][2], best[1][2]
                    x, y = (np.frombuffer(own[k].as_py(), np.uint32).tolist() for k in (i, j))
                    a, b = at[i].as_py(), at[j].as_py()
                    rows = [(ids[i].as_py(), ids[j].as_py(), a + p[0], a + p[1], b + p[2], b + p[3], p[4], round(p[4] / max(p[1] - p[0], p[3] - p[2]), 6)) for p in stretches(x, y, min_words, min_identity)]
                cols = list(zip(*rows, strict=True)) or [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array(cols[7], pa.float64())], names=names)

        out = scratch.keep(windows.repartition("chain").sortWithinPartitions("order").mapInArrow(judged, schema))
        scratch.drop(chains, parts)
        return out

    whole = compared(matches)
    scratch.drop(origin)
    intervals = [F.col(key).alias("id"), F.col("start_word").alias("lo"), F.col("end_word").alias("hi")]
    whole = whole.union(compared(spanning_matches(sourced, whole.select(*intervals), min_words, scratch)))
    more = split_sources(source, sourced, whole.select(*intervals), min_words, scratch)
    return whole.union(more.select("id", "src", "lo", "hi", "src_lo", "src_hi", F.col("hi") - F.col("lo"), F.lit(1.0)))


def without_passages(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text", size: str | None = "n_chars") -> DataFrame:
    """docs with the words of their reported passages cut out, the white space before each word with it.

    Documents of which nothing but white space is left are dropped; size, if given, is set to the new
    number of characters. Documents without passages, so null and empty texts and rows with a null id, are as they were.
    Passages may overlap. Of rows that repeat an id each is cut at the same words, as far as it has them. Columns keep
    their names, order and types, whatever they are; an empty table gives an empty table.
    """
    own_id, own_cut = unused(docs, "passage_id"), unused(docs, "passage_cut")
    listed = found.groupBy(F.col(key).alias(own_id)).agg(F.collect_set(F.struct("start_word", "end_word")).alias(own_cut))
    marked = docs.join(listed, docs[key] == F.col(own_id), "left").drop(own_id)
    schema = docs.schema

    def run(batches):
        for b in batches:
            cuts, texts = b.column(own_cut), b.column(text)
            made, keep = texts.to_pylist(), []
            for first, w in words(texts):
                for i in range(len(w)):
                    k = first + i
                    own = cuts[k].as_py()
                    keep.append(True)
                    if own:
                        raw, out, at = texts[k].as_py().encode(), [], 0
                        end = w.end[w.ptr[i] : w.ptr[i + 1]]
                        for lo, hi in sorted((c["start_word"], c["end_word"]) for c in own):
                            lo, hi = min(lo, len(end)), min(hi, len(end))
                            if lo < hi:
                                start = int(end[lo - 1]) if lo else 0
                                out.append(raw[at : max(at, start)])
                                at = max(at, int(end[hi - 1]))
                        out.append(raw[at:])
                        made[k] = b"".join(out).decode()
                        keep[-1] = bool(made[k].strip())
            cols = [pa.array(made, b.schema.field(n).type) if n == text else b.column(n) for n in schema.names]
            if size and size in schema.names:
                cut_now = [c is not None for c in cuts.to_pylist()]
                old = b.column(size).to_pylist()
                cols[schema.names.index(size)] = pa.array([len(m) if c else o for m, c, o in zip(made, cut_now, old, strict=True)], b.column(size).type)
            yield pa.RecordBatch.from_arrays(cols, names=schema.names).filter(pa.array(keep, pa.bool_()))

    return marked.mapInArrow(run, schema)
