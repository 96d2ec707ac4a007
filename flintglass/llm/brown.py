"""Scores of texts by a Brown class-based bigram model: P(w | v) = P(class of w | class of v) P(w | class of w).

Training counts cover every word of every training text. Words are sorted into classes by exchange:
each type moves to the class that most raises the likelihood of the class bigrams. The TYPES most
frequent words are types of their own; all others, unseen ones too, share a type with the words of
the same last three bytes, so every word has a class and the tables on executors have a fixed size.
The training texts are written once as sequences of types. A pass over these counts, for every type, the classes on
its left and on its right; the
exchange then visits the types by frequency and updates the class counts after each move. The first
pass takes the most frequent words as classes of their own, later passes the classes found so far.

Smoothing: transitions are mixed with class frequencies; in each class the part of its tokens that
are words met once is set aside for unseen words (Good-Turing). The end of a text is a token of a
class of its own, which is also the context of the first word.

A word's count is taken from a broadcast table of the HEAD most frequent words or, for the rest, by
a join on its hash of the words of texts, counted per text, with the count table.

Null or empty texts consist of their end. Rows are scored one by one, so repeated rows and null keys
are no special case (rows with a null key train). With no training texts every word is unknown. An
empty table gives an empty table. Columns other than the two named ones are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flintglass.llm.store import Scratch
from flintglass.llm.words import words

CLASSES = 64
TYPES = 1 << 14
ENDINGS = 1 << 12
HEAD = 1 << 17
ROUNDS = 4
MIX = 20.0
BLOCK_TYPES = 1024
SALTS = 16
CHUNK = 2_000_000
_U = np.uint64
END = TYPES + ENDINGS
ALL = END + 1


def _ending(affix: np.ndarray) -> np.ndarray:
    return (affix >> _U(52)).astype(np.int64)


class Vocabulary:
    """The most frequent words: sorted hashes, counts, and the type of each, -1 for that of its ending."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        """In order of frequency."""
        kind = np.where(np.arange(len(hashes)) < TYPES, np.arange(len(hashes)), -1)
        order = np.argsort(hashes)
        self.hashes, self.counts, self.kinds = hashes[order], counts[order], kind[order]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each is there, and where."""
        if not len(self.hashes):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.hashes[at] == hashes, at

    def types(self, w) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Type of each word, and what find() gives."""
        there, at = self.find(w.hash)
        ending = TYPES + _ending(w.affix[0])
        if not len(self.hashes):
            return ending, there, at
        own = self.kinds[at]
        return np.where(there & (own >= 0), own, ending), there, at


def _training(batch, text: str, affixes=()):
    """Words of the slices of a batch, with which words and which texts are for training."""
    learn = np.asarray(batch.column("learn"))
    for lo, w in words(batch.column(text), affixes):
        own = learn[lo : lo + len(w)]
        yield w, np.repeat(own, np.diff(w.ptr)), own


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """hash, ending, n of each word of training texts."""

    def run(batches):
        held: list = []
        size = 0

        def merged():
            h, e, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h, kind="stable")
            h, e, n = h[order], e[order], n[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
            return h[first], e[first], np.add.reduceat(n, first) if len(first) else n

        for b in batches:
            for w, mine, _ in _training(b, text, (-3,)):
                h, first, n = np.unique(w.hash[mine], return_index=True, return_counts=True)
                held.append((h, _ending(w.affix[0][mine][first]), n))
                size += len(h)
            if size > CHUNK:
                held = [merged()]
                size = len(held[0][0])
                if size > CHUNK // 2:
                    h, e, n = held[0]
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(e.astype(np.int32)), pa.array(n)], names=["hash", "ending", "n"])
                    held, size = [], 0
        if held:
            h, e, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(e.astype(np.int32)), pa.array(n)], names=["hash", "ending", "n"])

    partial = docs.mapInArrow(run, "hash long, ending int, n long")
    return partial.groupBy("hash").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


def _sequence(types: np.ndarray, w, mine: np.ndarray, learn: np.ndarray) -> np.ndarray:
    """Types of the training texts of a slice, an end before the first and after each."""
    sizes = np.diff(w.ptr)[learn]
    return np.append(END, np.insert(types[mine], np.cumsum(sizes), END))


def _pack(block: int, table: np.ndarray, salt: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([salt], pa.int32()), pa.array([zlib.compress(table.tobytes(), 1)], pa.binary())], names=["block", "salt", "counts"])


def _summed(batches):
    """Rows sorted by block: the sum of each block's tables."""
    now, total, salt = None, None, 0
    for b in batches:
        for block, s, counts in zip(b.column("block").to_pylist(), b.column("salt").to_pylist(), b.column("counts"), strict=True):
            table = np.frombuffer(zlib.decompress(counts.as_py()), np.int64)
            if block != now:
                if now is not None:
                    yield _pack(now, total, salt)
                now, total = block, np.zeros(len(table), np.int64)
            salt = s
            total += table
    if now is not None:
        yield _pack(now, total, salt)


def sequences(docs: DataFrame, text: str, vocabulary) -> DataFrame:
    """Rows of types, 16 bits each, of the training texts, an end before the first of a row and after each; vocabulary: a broadcast."""

    def run(batches):
        v = vocabulary.value
        for b in batches:
            for w, mine, learn in _training(b, text, (-3,)):
                if learn.any():
                    yield pa.RecordBatch.from_arrays([pa.array([_sequence(v.types(w)[0], w, mine, learn).astype(np.uint16).tobytes()], pa.binary())], names=["types"])

    return docs.mapInArrow(run, "types binary")


def neighbours(rows: DataFrame, classes) -> np.ndarray:
    """[side, type, class]: how often the class stands left (0) or right (1) of the type. rows: of sequences(); classes: a broadcast.

    The tables of partitions are added up block by block, in two steps, so no task sees many.
    """

    def run(batches):
        g = classes.value
        total = np.zeros((2, ALL * CLASSES), np.int64)
        codes: list = []
        size = 0

        def count():
            for side in (0, 1):
                total[side] += np.bincount(np.concatenate([x[side] for x in codes]), minlength=ALL * CLASSES)
            codes.clear()

        for b in batches:
            for types in b.column("types"):
                seq = np.frombuffer(types.as_py(), np.uint16).astype(np.int64)
                c = g[seq]
                codes.append((seq[1:] * CLASSES + c[:-1], seq[:-1] * CLASSES + c[1:]))
                size += len(seq)
                if size > CHUNK:
                    count()
                    size = 0
        if codes:
            count()
        salt = TaskContext.get().partitionId() % SALTS
        for side in (0, 1):
            for k, at in enumerate(range(0, ALL, BLOCK_TYPES)):
                part = total[side, at * CLASSES : (at + BLOCK_TYPES) * CLASSES]
                if part.any():
                    yield _pack(2 * k + side, part, salt)

    kinds = "block int, salt int, counts binary"
    rows = rows.mapInArrow(run, kinds)
    rows = rows.repartition("block", "salt").sortWithinPartitions("block").mapInArrow(_summed, kinds)
    rows = rows.repartition("block").sortWithinPartitions("block").mapInArrow(_summed, kinds)
    out = np.zeros((2, ALL, CLASSES), np.int64)
    for r in rows.collect():
        table = np.frombuffer(zlib.decompress(bytes(r["counts"])), np.int64).reshape(-1, CLASSES)
        at = r["block"] // 2 * BLOCK_TYPES
        out[r["block"] % 2, at : at + len(table)] += table
    return out


def exchange(left: np.ndarray, right: np.ndarray, classes: np.ndarray, sweeps: int = 1) -> np.ndarray:
    """Classes after each type in turn, the most frequent first, has moved to the class of the greatest likelihood.

    left, right: [type, context class] counts; contexts stay as they are. The likelihood is that of
    the class bigrams on both sides and of the words in their classes: the sum of n log n over class
    pairs, less twice that over classes.
    """
    g = classes.copy()
    both = np.concatenate([left, right], axis=1).astype(float)
    table = np.zeros((CLASSES, both.shape[1]))
    np.add.at(table, g, both)
    n = left.sum(axis=1).astype(float)
    size = np.bincount(g, weights=n, minlength=CLASSES)
    xlogx = lambda x: x * np.log(np.maximum(x, 1e-12))
    logs, logsize = xlogx(table), xlogx(size)
    order = np.argsort(-n[:END], kind="stable")
    order = order[n[order] > 0]
    for _ in range(sweeps):
        moved = 0
        for t in order.tolist():
            at = np.flatnonzero(both[t])
            mine, was = both[t, at], g[t]
            old = table[:, at]
            old[was] -= mine
            base = logs[:, at].sum(axis=1)
            base[was] = xlogx(old[was]).sum()
            rest = size.copy()
            rest[was] -= n[t]
            low = logsize.copy()
            low[was] = xlogx(rest[was])
            gain = xlogx(old + mine).sum(axis=1) - base - 2 * (xlogx(rest + n[t]) - low)
            gain[CLASSES - 1] = -np.inf
            to = int(gain.argmax())
            if to != was and gain[to] > gain[was] + 1e-9:
                table[was, at] -= mine
                table[to, at] += mine
                size[was] -= n[t]
                size[to] += n[t]
                logs[was, at], logs[to, at] = xlogx(table[was, at]), xlogx(table[to, at])
                logsize[[was, to]] = xlogx(size[[was, to]])
                g[t] = to
                moved += 1
        if not moved:
            break
    return g


class Model:
    """Log10 probabilities; the end's class is the last one."""

    def __init__(self, classes: np.ndarray, pairs: np.ndarray, singles: np.ndarray, vocabulary: Vocabulary, n: int, v: int, ends: int):
        self.classes, self.vocabulary, self.n, self.v, self.ends = classes, vocabulary, n, v, ends
        size = pairs.sum(axis=0).astype(float)
        share = (size + 1) / (size.sum() + CLASSES)
        self.step = np.log10((pairs + MIX * share) / (pairs.sum(axis=1, keepdims=True) + MIX))
        unseen = np.minimum((singles + 0.5) / (size + 1), 0.5)
        self.unseen = np.log10(unseen)
        self.seen = np.log10((1 - unseen) / np.maximum(size, 1))


def fit(docs: DataFrame, counts: DataFrame, text: str, scratch: Scratch) -> Model:
    """docs: the texts with a column learn; counts: of word_counts()."""
    spark = docs.sparkSession
    top = counts.orderBy(F.desc("n"), "hash").limit(HEAD).select("hash", "ending", "n").toArrow()
    hashes = np.asarray(top.column("hash").combine_chunks()).view(np.uint64) if top.num_rows else np.zeros(0, np.uint64)
    number = np.asarray(top.column("n").combine_chunks()) if top.num_rows else np.zeros(0, np.int64)
    vocabulary = Vocabulary(hashes, number)
    ends = docs.filter("learn").count()
    by_ending = counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("words"), F.count_if(F.col("n") == 1).alias("once")).collect()
    n, v = sum(r["n"] for r in by_ending) + ends, sum(r["words"] for r in by_ending) + bool(ends)

    g = np.full(ALL, CLASSES - 2, np.int64)
    g[: CLASSES - 2] = np.arange(CLASSES - 2)
    g[END] = CLASSES - 1
    shared = spark.sparkContext.broadcast(vocabulary)
    rows = scratch.keep(sequences(docs, text, shared))
    for k in range(ROUNDS + 1):
        about = spark.sparkContext.broadcast(g)
        left, right = neighbours(rows, about)
        about.destroy()
        if k < ROUNDS:
            if k == 0:
                # before there are classes, types start apart by their ending or rank
                start = g.copy()
                start[CLASSES - 2 : END] = np.arange(CLASSES - 2, END) % (CLASSES - 1)
                g = exchange(left, right, start, 2)
            else:
                g = exchange(left, right, g)
    scratch.drop(rows)
    pairs = np.zeros((CLASSES, CLASSES))
    np.add.at(pairs.T, g, left)
    singles = np.zeros(CLASSES)
    for r in by_ending:
        singles[g[TYPES + r["ending"]]] += r["once"]
    for e in (np.asarray(top.column("ending").combine_chunks())[:TYPES][number[:TYPES] == 1] if top.num_rows else ()):
        singles[g[TYPES + e]] -= 1
    for t in np.flatnonzero(number[:TYPES] == 1):
        singles[g[t]] += 1
    return Model(g, pairs, singles, vocabulary, n, v, ends)


def score(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """key, held_out (not learn), n_tokens, n_known, train_tokens, base_score of the unigram model, score, and perplexity per token."""
    scratch = scratch or Scratch(docs.sparkSession)
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(learn, F.lit(True)).alias("learn"))
    counts = scratch.keep(word_counts(docs.select("text", "learn"), "text"))
    model = fit(docs.select("text", "learn"), counts, "text", scratch)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["key"].dataType.simpleString()
    n, v = model.n, model.v
    floor = float(np.log10(n + v + 1))

    def run(batches):
        m = shared.value
        part = TaskContext.get().partitionId() << 33
        row = 0
        log_count = np.log10(m.vocabulary.counts)
        log_more = np.log10(m.vocabulary.counts + 1.0)
        kind = None
        for b in batches:
            keys, learn = b.column("key"), b.column("learn")
            kind = keys.type
            for lo, w in words(b.column("text"), (-3,)):
                size = np.diff(w.ptr)
                doc = np.repeat(np.arange(len(w)), size)
                types, there, at = m.vocabulary.types(w)
                c = m.classes[types]
                before = np.append(CLASSES - 1, c[:-1])
                first = w.ptr[:-1][size > 0]
                before[first] = CLASSES - 1
                each = m.step[before, c] + m.unseen[c]
                sums = np.bincount(doc, weights=each, minlength=len(w))
                last = np.full(len(w), CLASSES - 1)
                last[size > 0] = c[w.ptr[1:][size > 0] - 1]
                sums += m.step[last, CLASSES - 1] + m.unseen[CLASSES - 1]
                base = np.zeros(len(w))
                known = np.zeros(len(w), np.int64)
                if len(m.vocabulary.hashes):
                    hit = np.where(there, log_count[at] + m.seen[c] - m.unseen[c], 0)
                    sums += np.bincount(doc, weights=hit, minlength=len(w))
                    base += np.bincount(doc, weights=np.where(there, log_more[at], 0), minlength=len(w))
                    known += np.bincount(doc[there], minlength=len(w))
                if n:
                    sums += m.seen[CLASSES - 1] - m.unseen[CLASSES - 1] + np.log10(max(1, m.ends))
                    base += np.log10(m.ends + 1.0)
                    known += m.ends > 0
                rows = part + row + np.arange(len(w))
                row += len(w)
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.nulls(len(w), pa.int64()), pa.nulls(len(w), pa.int32()), pa.array(known), pa.array(base - (size + 1) * floor), pa.array(sums), keys.slice(lo, len(w)), learn.slice(lo, len(w)), pa.array(size + 1)], names=names)
                rare = np.flatnonzero(~there)
                if len(rare):
                    order = rare[np.lexsort((w.hash[rare], doc[rare]))]
                    h, d = w.hash[order], doc[order]
                    start = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])))
                    k = len(start)
                    yield pa.RecordBatch.from_arrays([pa.array(rows[d[start]]), pa.array(h[start].view(np.int64)), pa.array(c[order[start]].astype(np.int32)), pa.array(np.diff(np.append(start, len(h)))), *(pa.nulls(k, t) for t in (pa.float64(), pa.float64(), kind, pa.bool_(), pa.int64()))], names=names)

    names = ["row", "hash", "class", "n", "base", "score", "key", "learn", "size"]
    made = scratch.keep(docs.mapInArrow(run, f"row long, hash long, class int, n long, base double, score double, key {kind}, learn boolean, size long"))
    shift = docs.sparkSession.createDataFrame([(i, float(s - u)) for i, (s, u) in enumerate(zip(model.seen, model.unseen, strict=True))], "class int, shift double")
    rest = counts.filter(F.col("n") <= int(model.vocabulary.counts.min() if len(model.vocabulary.counts) == HEAD else 0)).select("hash", F.col("n").alias("c"))
    found = made.filter("hash is not null").select("row", "hash", "class", "n").join(rest, "hash").join(F.broadcast(shift), "class")
    parts = found.select("row", "n", (F.col("n") * F.log10(F.col("c") + 1)).alias("base"), (F.col("n") * (F.log10("c") + F.col("shift"))).alias("score"))
    parts = parts.groupBy("row").agg(F.sum("n").alias("more_n"), F.sum("base").alias("more_base"), F.sum("score").alias("more_score"))
    whole = made.filter("hash is null").join(parts, "row", "left")
    add = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return whole.select(
        F.col("key").alias(key),
        (~F.col("learn")).alias("held_out"),
        F.col("size").alias("n_tokens"),
        add("n", "more_n").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        add("base", "more_base").alias("base_score"),
        add("score", "more_score").alias("score"),
        F.pow(F.lit(10.0), -add("score", "more_score") / F.col("size")).alias("perplexity"),
    )
