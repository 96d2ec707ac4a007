"""Near-duplicate documents by MinHash signatures and a multi-index Hamming join.

A document's set holds its distinct 5-word shingles. Its signature is 65 minima of hashes, of which 8
bits each are kept. Signatures that differ in at most 25 symbols are candidates; a pair at a
similarity of 0.85 differs in 9.7 on average, and in more than 25 once in over a million. Split into
13 chunks of 5 symbols, such a pair has, by the pigeonhole principle, a chunk with at most one error,
so it shares one of the keys made by leaving out one symbol of one chunk: the join on these 65 keys
finds every pair under the signature distance.

That is for 0.85 or more. Similarities from 0.80 up take another scheme: 64 symbols of 16 bits, a distance of
31 (a pair at 0.80 differs in 12.8 on average, and in more than 31 less than once in ten million) and 16
chunks of 4 symbols, of which again one has at most one error.

1. Documents with equal sets form a class, represented by its least id.
2. Keys held by several classes become buckets. Within each, a search over the signatures finds the
   parts connected by candidate pairs and gives one edge for each further member, never all pairs.
3. The components of these edges are the candidate groups. Their sets are dealt out group by group;
   a group beyond a fixed number of bytes is dealt in pairs of blocks. Each task verifies similarity
   on the whole sets and gives a spanning forest of true links.
4. The components of these links are the answer.

Null or empty texts, and texts of white space, have empty sets and are linked with nothing. Texts
shorter than a shingle count as one. Rows that repeat an id are one document, whose links are those
of its largest set. Rows with a null id are linked with nothing, have a null component_id and are
kept. An empty table gives an empty table. Columns other than the two named ones are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flintglass.llm.components import components
from flintglass.llm.store import Scratch
from flintglass.llm.streams import runs
from flintglass.llm.words import mix, shingles, words


class Scheme(NamedTuple):
    """Chunks of a signature, symbols of a chunk, bytes of a symbol, and the greatest distance of candidates: at most 2 * chunks - 1."""

    chunks: int
    width: int
    size: int
    distance: int

    @property
    def symbols(self) -> int:
        return self.chunks * self.width

    @property
    def kind(self) -> np.dtype:
        return np.dtype(f"<u{self.size}")


AT_85, AT_80 = Scheme(13, 5, 1, 25), Scheme(16, 4, 2, 31)
SYMBOLS, DISTANCE = AT_85.symbols, AT_85.distance
BLOCK_BYTES = 8 << 20
BUCKET_ROWS = 50_000
_U = np.uint64
_MUL = np.random.Generator(np.random.PCG64(650)).integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * _U(2) + _U(1)
_SALT = _U(0xA0761D6478BD642F)


def signature(shingle_set: np.ndarray, scheme: Scheme = AT_85) -> np.ndarray:
    """The first bits of each minimum over the set."""
    least = np.full(scheme.symbols, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingle_set), 256):
        np.minimum(least, (shingle_set[None, at : at + 256] * _MUL[: scheme.symbols, None]).min(axis=1), out=least)
    return (mix(least) >> _U(64 - 8 * scheme.size)).astype(scheme.kind)


def chunk_keys(signatures: np.ndarray, scheme: Scheme = AT_85) -> np.ndarray:
    """For signatures in rows, the keys in columns: which chunk and symbol left out, then the other symbols."""
    bits = 8 * scheme.size
    chunks = signatures.reshape(len(signatures), scheme.chunks, scheme.width).astype(np.int64)
    out = np.empty((len(signatures), scheme.chunks, scheme.width), np.int64)
    for left in range(scheme.width):
        key = np.zeros((len(signatures), scheme.chunks), np.int64)
        for j in range(scheme.width):
            if j != left:
                key = (key << bits) | chunks[:, :, j]
        out[:, :, left] = key | ((np.arange(scheme.chunks) * scheme.width + left + 1) << bits * (scheme.width - 1))
    return out.reshape(len(signatures), -1)


def _digests(docs: DataFrame, key: str, text: str, scheme: Scheme) -> DataFrame:
    def run(batches):
        for b in batches:
            n, hi, lo, sig = [], [], [], []
            for _, w in words(b.column(text)):
                for i in range(len(w)):
                    s = np.unique(shingles(w.hash[w.ptr[i] : w.ptr[i + 1]]))
                    n.append(len(s))
                    hi.append(np.sum(mix(s), dtype=np.uint64))
                    lo.append(np.sum(mix(s ^ _SALT), dtype=np.uint64))
                    sig.append(signature(s, scheme).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(key).cast(pa.int64()), pa.array(n, pa.int64()), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (hi, lo)), pa.array(sig, pa.binary())], names=["id", "n", "hi", "lo", "sig"])

    return docs.select(key, text).mapInArrow(run, "id long, n long, hi long, lo long, sig binary")


def _keys(scheme: Scheme):
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                p = b.slice(at, 4096)
                sig = np.frombuffer(b"".join(p.column("sig").to_pylist()), scheme.kind).reshape(-1, scheme.symbols)
                keys = chunk_keys(sig, scheme)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(np.asarray(p.column("rep")), scheme.symbols))], names=["key", "rep"])

    return run


def _shared(batches):
    """Rows, sorted by key, whose key isn't theirs alone; the last row waits for the next one's key."""
    last, known = None, False
    for b in batches:
        keys, reps = np.asarray(b.column("key")), np.asarray(b.column("rep"))
        if last is not None:
            keys, reps = np.append(last[0], keys), np.append(last[1], reps)
        if not len(keys):
            continue
        same = keys[1:] == keys[:-1]
        keep = np.append(False, same) | np.append(same, False)
        keep[0] |= known
        last, known = (keys[-1:], reps[-1:]), bool(keep[-1])
        keep[-1] = False
        yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(reps[keep])], names=["key", "rep"])
    if known:
        yield pa.RecordBatch.from_arrays([pa.array(last[0]), pa.array(last[1])], names=["key", "rep"])


def _dealt(rows: DataFrame, item: str, group: str) -> DataFrame:
    """rows, whose groups are in as many blocks as the column blocks says, with a column key for each pair of blocks, a block with itself included."""
    own = F.pmod(F.xxhash64(item), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("key", F.xxhash64(group, F.least("own", "other"), F.greatest("own", "other"))).drop("own", "other", "blocks")


def _bucket_edges(scheme: Scheme):
    """Within each bucket, or pair of blocks of one, a spanning forest of its candidate pairs."""

    def run(batches):
        for reps, sigs in runs(batches, ["rep", "sig"]):
            reps = np.asarray(reps)
            sig = np.frombuffer(b"".join(sigs.to_pylist()), scheme.kind).reshape(-1, scheme.symbols)
            a, b = [], []
            left = np.arange(len(reps))
            while len(left):
                queue, left = [left[0]], left[1:]
                while queue and len(left):
                    x = queue.pop()
                    near = (sig[left] != sig[x]).sum(axis=1) <= scheme.distance
                    found = left[near]
                    queue += found.tolist()
                    a += [reps[x]] * len(found)
                    b += reps[found].tolist()
                    left = left[~near]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= percent * union, by a search that compares each set with all not yet reached."""
    if len(sets) < 2:
        return []
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    _, local = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    ptr = np.append(0, np.cumsum(size[order]))
    mark = np.zeros(int(local.max()) + 1 if len(local) else 1, np.int32)
    size = size[order]
    left = np.ones(len(sets), bool)
    out = []
    for start in range(len(sets)):
        if not left[start]:
            continue
        left[start] = False
        queue = [start]
        while queue:
            x = queue.pop()
            lo = int(np.searchsorted(size, -(-percent * size[x] // 100)))
            hi = int(np.searchsorted(size, size[x] * 100 // percent, side="right"))
            near = np.flatnonzero(left[lo:hi]) + lo
            if not len(near):
                continue
            own = local[ptr[x] : ptr[x + 1]]
            mark[own] = 1
            if 2 * len(near) > hi - lo:
                both = np.add.reduceat(mark[local[ptr[lo] : ptr[hi]]], ptr[lo:hi] - ptr[lo])[near - lo]
            else:
                both = np.array([int(mark[local[ptr[y] : ptr[y + 1]]].sum()) for y in near])
            mark[own] = 0
            found = near[100 * both >= percent * (size[x] + size[near] - both)]
            left[found] = False
            queue += found.tolist()
            out += [(int(order[x]), int(order[y])) for y in found]
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85, scratch: Scratch | None = None) -> DataFrame:
    """For each row: key, n_shingles, component_id and kept, and n_links: the verified links that its class has in the forest."""
    if not 80 <= percent <= 100:
        raise ValueError("signatures are made for a similarity of 0.80 or more")
    scheme = AT_85 if percent >= 85 else AT_80
    scratch = scratch or Scratch(docs.sparkSession)
    digests = scratch.keep(_digests(docs, key, text, scheme))
    largest = digests.filter("id is not null and n > 0").groupBy("id").agg(F.max(F.struct("n", "hi", "lo", "sig")).alias("s")).select("id", "s.*")
    member = scratch.keep(largest.select("id", "n", "hi", "lo", "sig"))
    classes = scratch.keep(member.groupBy("n", "hi", "lo").agg(F.min("id").alias("rep"), F.first("sig").alias("sig")))

    keys = classes.select("rep", "sig").mapInArrow(_keys(scheme), "key long, rep long")
    shared = scratch.keep(keys.repartition("key").sortWithinPartitions("key").mapInArrow(_shared, "key long, rep long"))
    hot = scratch.keep(shared.groupBy("key").agg(F.count("*").alias("rows")).filter(F.col("rows") > BUCKET_ROWS))
    buckets = shared.join(hot, "key", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("rows") / BUCKET_ROWS).cast("int"), F.lit(1)))
    buckets = _dealt(buckets.drop("rows").withColumnRenamed("key", "bucket"), "rep", "bucket").select("key", "rep").join(classes.select("rep", "sig"), "rep")
    candidates = scratch.keep(buckets.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(_bucket_edges(scheme), "a long, b long").distinct())
    scratch.drop(shared, hot)
    found = components(candidates, scratch)
    groups = found.select(F.col("node").alias("rep"), F.col("component").alias("grp"))
    groups = scratch.keep(groups.union(groups.select(F.col("grp").alias("rep"), "grp").distinct()))

    size = classes.select("rep", "n").join(groups, "rep").groupBy("grp").agg(F.ceil(F.sum("n") * 8 / F.lit(BLOCK_BYTES)).cast("int").alias("blocks"))
    wanted = member.select("id", F.struct("n", "hi", "lo").alias("s")).join(groups.withColumnRenamed("rep", "id"), "id").join(size, "grp")
    wanted = wanted.select("id", "s.*", "grp", "blocks")

    def task_sets(batches):
        """Of rows that repeat an id, only the set that counts comes through."""
        for b in batches:
            ids, n, hi, lo = (np.asarray(b.column(c)) for c in ("id", "n", "hi", "lo"))
            out_id, out_set = [], []
            for first, w in words(b.column("text")):
                for i in range(len(w)):
                    s = np.unique(shingles(w.hash[w.ptr[i] : w.ptr[i + 1]]))
                    k = first + i
                    same = len(s) == n[k] and np.sum(mix(s), dtype=np.uint64).view(np.int64) == hi[k] and np.sum(mix(s ^ _SALT), dtype=np.uint64).view(np.int64) == lo[k]
                    out_id.append(k)
                    out_set.append(s.tobytes() if same else None)
            take = pa.array(out_id, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in ("id", "grp", "blocks")), pa.array(out_set, pa.binary())], names=["id", "grp", "blocks", "hashes"])

    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(wanted, "id")
    sets = texts.mapInArrow(task_sets, "id long, grp long, blocks int, hashes binary").filter("hashes is not null")
    dealt = _dealt(sets, "id", "grp").select("key", "grp", "id", "hashes")

    def verified(batches):
        for grp, ids, hashes in runs(batches, ["grp", "id", "hashes"]):
            grp, ids = np.asarray(grp), np.asarray(ids)
            a, b = [], []
            for g in np.unique(grp):
                at = np.flatnonzero(grp == g)
                _, first = np.unique(ids[at], return_index=True)
                at = at[first]
                made = links([np.frombuffer(hashes[int(i)].as_py(), np.uint64) for i in at], percent)
                a += [ids[at[x]] for x, _ in made]
                b += [ids[at[y]] for _, y in made]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    edges = scratch.keep(dealt.repartition("key").sortWithinPartitions("key", "id").mapInArrow(verified, "a long, b long"))
    scratch.drop(candidates, groups)
    final = components(edges, scratch)
    degree = edges.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    classed = classes.select("n", "hi", "lo", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    ids = member.join(classed, ["n", "hi", "lo"]).select("id", F.coalesce("component", "rep").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = digests.select("id", "n").join(ids, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(key),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
