"""Exact BM25 top-k by block-max dynamic pruning over index shards.

Texts are indexed in shards of up to SHARD_DOCS documents; within a shard, documents are ordered by
their commonest word and length, so that blocks of BLOCK neighbours are alike. A posting's impact is
its BM25 contribution from global statistics, in whole millionths: sums don't depend on their order,
so results of shards merge exactly. Queries with the same commonest words are searched together, QUERIES
at a time. Postings of their rarer terms are added up exactly; these sums and the greatest impacts of the common terms in a block
bound every score there. Blocks whose bound is below the k-th score of a query are skipped; in the others,
the common terms are added by products of matrices, which choose documents that are then scored exactly. An eighth of the
shards is searched first; the k-th score found there for a query is where the other shards start from.
Tasks merge their shards and give their top k to the final merge.

A query is the set of the distinct words of its text. Queries come in groups of a bounded number of
terms, each group being broadcast and searched in one pass over the index.

Scores are ranked by score, then key. Documents without a word of the query aren't results. Null or
empty texts are indexed as empty and, as queries, find nothing. Rows that repeat a key are documents
of their own, and as queries one query with the words of all. Rows with a null key are left out. An empty table gives an empty table. Columns other than the
two named ones are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flintglass.llm.store import Scratch
from flintglass.llm.words import words

K1, B = 1.2, 0.75
UNIT = 1_000_000
SHARD_DOCS, SHARD_WORDS = 8192, 6_000_000
BLOCK = 64
GROUP_TERMS = 2_000_000
FIRST_SHARDS = 8
#: Queries searched at once, postings of theirs added up at once, and blocks evaluated at once.
QUERIES, POSTINGS, BLOCKS = 64, 1 << 16, 8
#: Terms are common if they are at least so many of the pairs of a document and a query, at most so many terms.
DENSE, COMMON = 0.002, 1024
SLACK = 1 + 1e-4
_PARTS = (("ids", np.int64), ("sizes", np.int64), ("terms", np.uint64), ("counts", np.int32), ("docs", np.uint16), ("freqs", np.int32))


def _expand(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    total = np.cumsum(sizes)
    return np.arange(int(total[-1]) if len(total) else 0) + np.repeat(starts - (total - sizes), sizes)


def build(ids: np.ndarray, hashes: np.ndarray, ptr: np.ndarray) -> dict[str, np.ndarray]:
    """An index of texts given by their word hashes: postings by term, then document."""
    n = len(ids)
    doc = np.repeat(np.arange(n), np.diff(ptr))
    order = np.lexsort((doc, hashes))
    h, d = hashes[order], doc[order]
    start = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))) if len(h) else np.zeros(0, np.int64)
    terms, docs, freqs = h[start], d[start], np.diff(np.append(start, len(h)))
    main, best = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    if len(terms):
        by = np.lexsort((terms, freqs, docs))
        last = by[np.flatnonzero(np.append(docs[by][1:] != docs[by][:-1], True))]
        main[docs[last]], best[docs[last]] = terms[last], freqs[last]
    rank = np.empty(n, np.int64)
    order = np.lexsort((ids, np.diff(ptr), main))
    rank[order] = np.arange(n)
    docs = rank[docs]
    by = np.lexsort((docs, terms))
    terms, docs, freqs = terms[by], docs[by], freqs[by]
    first = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else np.zeros(0, np.int64)
    return {"ids": ids[order], "sizes": np.diff(ptr)[order], "terms": terms[first], "counts": np.diff(np.append(first, len(terms))).astype(np.int32), "docs": docs.astype(np.uint16), "freqs": freqs.astype(np.int32)}


def _index(batches, key: str, text: str):
    held: list = []
    docs = size = 0

    def out():
        ids = np.concatenate([x[0] for x in held])
        ptr = np.append(0, np.cumsum(np.concatenate([np.diff(x[2]) for x in held])))
        made = build(ids, np.concatenate([x[1] for x in held]), ptr)
        return pa.RecordBatch.from_arrays([pa.array([made[n].astype(t).tobytes()], pa.binary()) for n, t in _PARTS], names=[n for n, _ in _PARTS])

    for b in batches:
        keys = np.asarray(b.column(key).cast(pa.int64()))
        for lo, w in words(b.column(text)):
            at = 0
            while at < len(w):
                to = min(len(w), at + SHARD_DOCS - docs)
                ptr = w.ptr[at : to + 1]
                held.append((keys[lo + at : lo + to], w.hash[ptr[0] : ptr[-1]], ptr - ptr[0]))
                docs, size, at = docs + to - at, size + int(ptr[-1] - ptr[0]), to
                if docs >= SHARD_DOCS or size >= SHARD_WORDS:
                    yield out()
                    held, docs, size = [], 0, 0
    if held:
        yield out()


class Shard:
    """A shard with the impacts of the postings of the given terms.

    common: the terms that many of its documents and many of the queries have (asked: how many of so many queries have each term), whose impacts are
    a matrix of documents by terms too; float32 holds each of them exactly. most: their greatest impacts in each block. A term's postings are one entry.
    """

    def __init__(self, parts: dict[str, bytes], terms: np.ndarray, idf: np.ndarray, mean: float, asked: np.ndarray | None = None, queries: int = 1):
        p = {n: np.frombuffer(parts[n], t) for n, t in _PARTS}
        self.ids = p["ids"]
        n = len(self.ids)
        at = np.minimum(np.searchsorted(terms, p["terms"]), max(0, len(terms) - 1))
        mine = np.flatnonzero(terms[at] == p["terms"]) if len(terms) else np.zeros(0, np.int64)
        start = np.cumsum(p["counts"]) - p["counts"]
        counts = p["counts"][mine].astype(np.int64)
        post = _expand(start[mine], counts)
        self.docs = p["docs"][post].astype(np.int64)
        tf = p["freqs"][post].astype(float)
        norm = K1 * (1 - B + B * p["sizes"] / mean) if mean else np.full(n, K1)
        self.impacts = np.floor(np.repeat(idf[at[mine]], counts) * (tf * (K1 + 1)) / (tf + norm[self.docs]) * UNIT + 0.5)
        self.entry_start, self.entry_size = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        self.entry_start[at[mine]], self.entry_size[at[mine]] = np.cumsum(counts) - counts, counts
        self.lo = np.arange(len(terms))
        self.hi = self.lo + 1
        self.blocks = -(-n // BLOCK)
        gain = self.entry_size * (1 if asked is None else asked)
        often = np.flatnonzero((gain > DENSE * n * queries) & (idf * (K1 + 1) * UNIT + 1 < 1 << 24))
        self.common = np.sort(often[np.argsort(-gain[often], kind="stable")[:COMMON]])
        self.place = np.full(len(terms), -1, np.int64)
        self.place[self.common] = np.arange(len(self.common))
        own = _expand(self.entry_start[self.common], self.entry_size[self.common])
        self.matrix = np.zeros((self.blocks * BLOCK, len(self.common)), np.float32)
        self.matrix[self.docs[own], np.repeat(np.arange(len(self.common)), self.entry_size[self.common])] = self.impacts[own]
        self.most = self.matrix.reshape(self.blocks, BLOCK, len(self.common)).max(axis=1) if self.blocks else self.matrix

    def rare(self, ptr: np.ndarray, use: np.ndarray) -> np.ndarray:
        """Exact sums, by query and document, over the postings of the terms that aren't common; postings are added up by bounded parts."""
        width = self.blocks * BLOCK
        out = np.zeros((len(ptr) - 1, width))
        owner = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
        mine = np.flatnonzero((self.place[use] < 0) & (self.entry_size[use] > 0))
        owner, use = owner[mine], use[mine]
        size = self.entry_size[use]
        edge = np.append(0, np.cumsum(size))[np.searchsorted(owner, np.arange(len(ptr)))]  # postings before each query
        lo = 0
        while lo < len(out):
            hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + POSTINGS, side="right")) - 1)
            part = slice(*np.searchsorted(owner, (lo, hi)))
            post = _expand(self.entry_start[use[part]], size[part])
            cell = self.docs[post] + np.repeat((owner[part] - lo) * width, size[part])
            out[lo:hi] = np.bincount(cell, weights=self.impacts[post], minlength=(hi - lo) * width).reshape(hi - lo, width)
            lo = hi
        return out

    def top(self, ptr: np.ndarray, use: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, score and document number of each query's top k, of those that reach its least; a query has the terms use[ptr[q] : ptr[q + 1]], by number.

        Blocks are evaluated only for queries whose bound in them, or in one of the BLOCKS taken together, reaches the least. Products in float32 only choose documents (they are raised by more than their error, SLACK);
        scores are added up in whole numbers.
        """
        n = len(ptr) - 1
        scores, floor = self.rare(ptr, use), np.maximum(1.0, least)
        has = np.zeros((n, len(self.common)), np.float32)
        place = self.place[use]
        has[np.repeat(np.arange(n), np.diff(ptr))[place >= 0], place[place >= 0]] = 1
        free = np.flatnonzero(floor <= 1)  # whose k-th score isn't known yet
        if len(free) and scores.shape[1] >= k:
            kth = np.partition(scores[free] + (has[free] @ self.matrix.T) * SLACK, -k, axis=1)[:, -k]
            floor[free] = np.maximum(floor[free], np.floor(kth * (2 - SLACK) / SLACK))
        can = scores.reshape(n, self.blocks, BLOCK).max(axis=2) + (has @ self.most.T) * SLACK >= floor[:, None]
        live = np.flatnonzero(can.any(axis=0))
        chosen = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for at in range(0, len(live), BLOCKS):
            part = live[at : at + BLOCKS]
            mine, docs = np.flatnonzero(can[:, part].any(axis=1)), (part[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            if part[-1] - part[0] == len(part) - 1:
                docs = slice(docs[0], docs[-1] + 1)  # neighbours aren't copied
            q, d = np.nonzero((has[mine] @ self.matrix[docs].T) * SLACK >= floor[mine, None] - scores[mine][:, docs])
            chosen.append((mine[q], part[d // BLOCK] * BLOCK + d % BLOCK))
        q, d = (np.concatenate(x) for x in zip(*chosen, strict=True))
        exact = scores[q, d]
        for lo in range(0, len(q), 1024):
            part = slice(lo, lo + 1024)
            exact[part] += (has[q[part]].astype(float) * self.matrix[d[part]]).sum(axis=1)
        order = np.flatnonzero(exact >= floor[q])
        order = order[np.lexsort((self.ids[d[order]], -exact[order], q[order]))]
        q, d, exact = q[order], d[order], exact[order]
        order = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[order], exact[order].astype(np.int64), d[order]

    def search(self, terms: np.ndarray, k: int, least: float = 1.0) -> list[tuple[int, int]]:
        """Scores and document numbers of the top k, of those that reach least, for one query's terms (by number)."""
        _, scores, docs = self.top(np.array([0, len(terms)]), np.asarray(terms), k, np.array([least]))
        return list(zip(scores.tolist(), docs.tolist(), strict=True))


def search(docs: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """query_id, rank (from 1), doc_id and score of the k best documents for each row of queries; both tables have the two columns."""
    scratch = scratch or Scratch(docs.sparkSession)
    spark = docs.sparkSession

    def asked(batches):
        for b in batches:
            keys = np.asarray(b.column(key).cast(pa.int64()))
            for lo, w in words(b.column(text)):
                own = np.repeat(keys[lo : lo + len(w)], np.diff(w.ptr))
                pair = np.unique(np.stack([own.view(np.uint64), w.hash]), axis=1) if len(own) else np.zeros((2, 0), np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(pair[0].view(np.int64)), pa.array(pair[1].view(np.int64))], names=["query_id", "term"])

    def frequencies(batches):
        for b in batches:
            for terms, counts in zip(b.column("terms"), b.column("counts"), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms.as_py(), np.int64)), pa.array(np.frombuffer(counts.as_py(), np.int32).astype(np.int64))], names=["term", "n"])

    def totals(batches):
        for b in batches:
            sizes = [np.frombuffer(x.as_py(), np.int64) for x in b.column("sizes")]
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, sizes))], pa.int64()), pa.array([sum(int(s.sum()) for s in sizes)], pa.int64())], names=["docs", "words"])

    known = docs.select(key, text).filter(F.col(key).isNotNull())
    index = known.mapInArrow(lambda batches: _index(batches, key, text), ", ".join(f"{n} binary" for n, _ in _PARTS))
    index = scratch.keep(index.withColumn("shard", F.monotonically_increasing_id()))
    lead = F.pmod(F.xxhash64("shard"), F.lit(FIRST_SHARDS)) == 0
    n, total = index.select("sizes").mapInArrow(totals, "docs long, words long").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    mean = total / n if n else 0.0

    wanted = scratch.keep(queries.select(key, text).filter(F.col(key).isNotNull()).mapInArrow(asked, "query_id long, term long").distinct())
    n_terms = wanted.count()
    groups = max(1, -(-n_terms // GROUP_TERMS))
    df = index.select("terms", "counts").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    weighted = wanted.join(df, "term").select(F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("grp"), "query_id", "term", "n")
    weighted = scratch.keep(weighted)

    def pass_over(group: int) -> None:
        """Searches one group of queries and adds what it finds to the results."""
        rows = weighted.filter(F.col("grp") == group).select("query_id", "term", "n").toArrow()
        cols = [np.asarray(rows.column(c).combine_chunks()) if rows.num_rows else np.zeros(0, np.int64) for c in ("query_id", "term", "n")]
        terms, at = np.unique(cols[1].view(np.uint64), return_inverse=True)
        often = np.zeros(len(terms))
        often[at] = cols[2]
        idf = np.log(1 + (n - often + 0.5) / (often + 0.5))
        asked = np.bincount(at, minlength=len(terms))
        order = np.lexsort((at, -often[at], cols[0]))
        ids, start = np.unique(cols[0][order], return_index=True)
        use, ends = at[order], np.append(start, len(order))[1:]
        alike = np.lexsort([use[np.minimum(start + i, ends - 1)] for i in (2, 1, 0)])  # queries that share their commonest terms are searched together
        use, ptr = use[_expand(start[alike], (ends - start)[alike])], np.append(0, np.cumsum((ends - start)[alike]))

        def over(shards: DataFrame, least: np.ndarray) -> DataFrame:
            shared = spark.sparkContext.broadcast((terms, idf, asked, ids[alike], ptr, use, least[alike]))

            def run(batches):
                terms, idf, asked, ids, ptr, use, least = shared.value
                best: list[list[tuple[int, int]]] = [[] for _ in ids]
                floor = least.copy()
                for b in batches:
                    for r in range(b.num_rows):
                        shard = Shard({name: b.column(name)[r].as_py() for name, _ in _PARTS}, terms, idf, mean, asked, len(ids))
                        for lo in range(0, len(ids), QUERIES):
                            hi = min(lo + QUERIES, len(ids))
                            own, scores, docs = shard.top(ptr[lo : hi + 1] - ptr[lo], use[ptr[lo] : ptr[hi]], k, floor[lo:hi])
                            got: dict[int, list[tuple[int, int]]] = {}
                            for q, s, d in zip((own + lo).tolist(), scores.tolist(), shard.ids[docs].tolist(), strict=True):
                                got.setdefault(q, []).append((-s, d))
                            for q, more in got.items():
                                best[q] = sorted(best[q] + more)[:k]
                                if len(best[q]) == k:
                                    floor[q] = max(floor[q], -best[q][-1][0])
                out = [(ids[q], d, -s) for q, rows in enumerate(best) for s, d in rows]
                cols = np.array(out, np.int64).reshape(-1, 3).T
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_id", "doc_id", "score"])

            return shards.drop("shard").mapInArrow(run, kinds)

        first = scratch.keep(over(index.filter(lead), np.ones(len(ids))))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        kth = first.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select("query_id", "score").toArrow()
        least = np.ones(len(ids))
        if kth.num_rows:
            least[np.searchsorted(ids, np.asarray(kth.column("query_id").combine_chunks()))] = np.asarray(kth.column("score").combine_chunks())
        first.union(over(index.filter(~lead), least)).write.mode("append").parquet(results)
        scratch.drop(first)

    kinds, results = "query_id long, doc_id long, score long", f"{scratch.base}/results"
    for group in range(groups):
        pass_over(group)
    found = spark.read.schema(kinds).parquet(results)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("long").alias("rank"), F.col("doc_id"), (F.col("score") / F.lit(UNIT)).alias("score"))
