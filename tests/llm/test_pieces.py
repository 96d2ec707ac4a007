"""The parts that need no cluster, against plain versions."""

import base64
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from flintglass.llm import bm25, bpe, brown, bytecnn, chaining, containment, crf, minhash, sharding
from flintglass.llm.words import BLOCK, shingles, word_hash, words

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def plain_words(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


def test_words():
    texts = ["", None, "A b\tÉ c", "  ", "x" * 10, "one  two\nthree\x0bfour five ", "lang " * (BLOCK // 2), "y" * (3 * BLOCK)]
    seen = []
    for lo, w in words(pa.array(texts)):
        for i in range(len(w)):
            own = plain_words(texts[lo + i])
            seen.append(lo + i)
            a, b = w.ptr[i], w.ptr[i + 1]
            assert b - a == len(own)
            for j in {0, len(own) // 2, len(own) - 1} & set(range(len(own))):
                assert w.hash[a + j] == word_hash(own[j])
                assert texts[lo + i].encode()[w.start[a + j] : w.end[a + j]].decode().translate(LOWER) == own[j]
    assert seen == list(range(len(texts)))
    assert len(shingles(np.arange(3, dtype=np.uint64))) == 1 and len(shingles(np.arange(9, dtype=np.uint64))) == 5


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(PATH, public_tokenizers.PATTERN)


def test_bpe_equals_library(codec):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}  # noqa: SIM115
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(5)
    texts = ["", "a" * 5000, "é" * 700, " " * 900 + "x", "<|endoftext|> it's 漢字 😀"]
    texts += ["".join(rnd.choice("abcdefgh thion \n\t'sllé漢😀0123 AB!!%\x1ć") for _ in range(rnd.randrange(60))) for _ in range(1500)]
    for t in texts:
        ids = codec(t)
        assert ids == library.encode_ordinary(t)
        stream = bpe.Utf8Decoder()
        assert codec.text(ids) == t == "".join([codec.decode([i], stream) for i in ids]) + stream.finish()
        assert [codec.general.findall(t)] == list(codec.pieces(t))
        assert codec.count(t) == len(ids)
    codec.machine.max_states, kept = 50, codec.machine.max_states
    codec.memo, codec.older = {}, {}
    assert all(codec(t) == library.encode_ordinary(t) for t in texts[-200:])
    codec.machine.max_states = kept


def test_bpe_in_runs_equals_library(monkeypatch):
    """Texts beyond STREAM, pieces beyond SETTLE bytes and a memo that is full again and again."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}  # noqa: SIM115
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(8)
    for name, value in (("STREAM", 40), ("RUN", 7), ("SETTLE", 16)):
        monkeypatch.setattr(bpe, name, value)
    codec = bpe.Codec(PATH, public_tokenizers.PATTERN, memo=20)
    for n in [*range(1, 200, 7), 3000]:
        for letters in ("abcdefgh thion \n\t'sllé漢😀0123 AB!!%", "ab", "etaoin", "é漢", "0123456789"):
            t = "".join(rnd.choice(letters) for _ in range(n))
            assert codec(t) == library.encode_ordinary(t)
            assert "".join(x for run in codec.pieces(t) for x in run) == t
            assert codec.count(t) == len(codec(t))


def test_utf8_decoder():
    rnd = random.Random(3)
    for _ in range(5000):
        data = bytes(rnd.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 0xFF]) for _ in range(rnd.randrange(9)))
        d = bpe.Utf8Decoder()
        assert "".join(d.feed(bytes([b])) for b in data) + d.finish() == data.decode("utf-8", "replace")


def test_sharding_table():
    owner = sharding.fill(["a", "b", "c"], 1009)
    counts = np.bincount(owner)
    assert counts.max() - counts.min() <= 1
    less = sharding.fill(["a", "b"], 1009)
    stay = np.isin(owner, [0, 1])
    assert (owner[stay] == less[stay]).mean() > 0.75
    heavy = np.bincount(sharding.fill(["a", "b"], 1009, [1, 3]))
    assert 2.9 < heavy[1] / heavy[0] < 3.1
    taken, at = {}, {s: 0 for s in "abc"}
    while len(taken) < 1009:
        for s in "abc":
            offset, step = sharding.preference(s, 1009)
            while (slot := (offset + at[s] * step) % 1009) in taken:
                at[s] += 1
            taken[slot] = "abc".index(s)
            if len(taken) == 1009:
                break
    assert [taken[i] for i in range(1009)] == owner.tolist()
    with pytest.raises(ValueError):
        sharding.fill(["a"], 1000)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    odds, ptr, step = np.exp(rng.normal(0, 2, 300)), np.array([0, 130, 130, 131, 300]), np.array([[1, 0.3], [0.5, 2.0]])
    p, expected = crf.marginals(odds, ptr, step, True)
    for lo, hi in zip(ptr[:-1], ptr[1:], strict=True):
        f, a = np.array([1.0, 0.0]), []
        for t in range(lo, hi):
            f = (f @ step) * [1, odds[t]]
            f /= f.sum()
            a.append(f)
        g = np.ones(2)
        for t in range(hi - 1, lo - 1, -1):
            q = a[t - lo] * g
            assert np.isclose(p[t], q[1] / q.sum())
            g = step @ (np.array([1, odds[t]]) * g)
            g /= g.sum()
    assert np.isclose(expected.sum(), 300)


def test_toxicity_and_quality_on_held_out():
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice(["th", "er", "on", "an", "re", "ing"]) for _ in range(rnd.randrange(1, 4)))
    rows = []
    for i in range(600):
        ws, bad = [word() for _ in range(rnd.randrange(20, 200))], i % 4 == 0
        if bad:
            for _ in range(3):
                ws[rnd.randrange(len(ws))] = rnd.choice(["grubb", "snool"]) + word()
        rows.append((" ".join(ws), int(bad)))
    model = crf.fit(rows[:400])
    scores = model.score(crf.judge(model, pa.array([t for t, _ in rows[400:]]))[0])
    right = np.mean((scores >= 0.3) == np.array([y == 1 for _, y in rows[400:]]))
    assert right > 0.97
    _, spans = crf.judge(model, pa.array(["the grubbth an on"]), True)
    assert spans[0] and spans[0][0]["start"] == 4 and spans[0][0]["end"] == 11
    net = bytecnn.fit([((t.upper() + "!!") if i % 3 == 0 else t, int(i % 3 > 0)) for i, (t, _) in enumerate(rows[:300])])
    buf, offs = bytecnn.utf8(pa.array(["THE ON AN!!" * 40, "the on an ing er " * 30, "", None]))
    desc = bytecnn.describe(buf, offs, net.tables(), net.bias)
    p = 1 / (1 + np.exp(-(desc @ net.weights + net.offset)))
    assert p[0] < 0.5 < p[1] and np.isfinite(p).all()
    assert crf.fit([]).score(np.zeros(2)).tolist() == crf.fit([("a", 0)] * 0).score(np.zeros(2)).tolist()
    assert crf.fit([("a", 1)]).score(np.zeros(1))[0] > 0.5


def test_alignment_is_longest():
    rnd = random.Random(3)
    for _ in range(200):
        a, b = ([rnd.randrange(5) for _ in range(rnd.randrange(20))] for _ in range(2))
        pairs = chaining.aligned(a, b)
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert len(pairs) == table[-1][-1] and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def test_every_stretch_that_qualifies_is_found():
    rnd = random.Random(5)
    fresh = lambda n: [rnd.randrange(1 << 60) for _ in range(n)]
    same = [fresh(50) for _ in range(6)]
    a, b = ([w for p in same for w in [*fresh(16), *p]] for _ in range(2))
    found = chaining.stretches(a, b, 50, 0.8)
    covered = {k for lo, hi, *_ in found for k in range(lo, hi)}
    assert all(k in covered for n in range(6) for k in range(16 + 66 * n, 66 + 66 * n))
    # an exact passage within text of which three words in four agree
    loose = [fresh(120), fresh(120)]
    exact = fresh(60)
    edit = lambda p: [w if k % 4 else fresh(1)[0] for k, w in enumerate(p)]
    found = chaining.stretches(loose[0] + exact + loose[1], edit(loose[0]) + exact + edit(loose[1]), 50, 0.8)
    assert any(lo <= 120 and hi >= 180 for lo, hi, *_ in found)
    # every fifth word differs: no strict stretch is long, the longest of all is
    text = fresh(101)
    assert chaining.stretches(text, [w if k % 5 else fresh(1)[0] for k, w in enumerate(text)], 50, 0.8)
    for lo, hi, x, y, n in found:
        assert min(hi - lo, y - x) >= 50 and n >= 0.8 * max(hi - lo, y - x)
    assert chaining.stretches(text[:49], text[:49], 50, 0.8) == [] == chaining.stretches([], [], 50, 0.8)


def test_chains_rise_and_take_the_best():
    pos, src = np.array([0, 5, 6, 9, 14, 20]), np.array([100, 3, 105, 110, 115, 4])
    best = chaining.best_chains(pos, src)[0]
    assert best.tolist() == [0, 2, 3, 4]
    assert chaining.spans(np.arange(0, 60, 6), np.arange(1000, 1060, 6)) == [(0, 59, 1000, 1059)]


def test_links_equal_brute_force():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 60, 200, dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(200) < rng.choice([0.02, 0.05, 0.3]), rng.integers(0, 1 << 60, 200, dtype=np.uint64), base)) for _ in range(60)]
    parent = list(range(60))
    root = lambda x: x if parent[x] == x else root(parent[x])
    for i in range(60):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j]))
            if 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    other = list(range(60))
    find = lambda x: x if other[x] == x else find(other[x])
    for a, b in minhash.links(sets, 85):
        other[find(a)] = find(b)
    assert all((root(i) == root(j)) == (find(i) == find(j)) for i in range(60) for j in range(i))


def test_keys_are_shared_within_the_distance():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a = rng.integers(0, 256, minhash.SYMBOLS, dtype=np.uint8)
        b = a.copy()
        at = rng.choice(minhash.SYMBOLS, minhash.DISTANCE, replace=False)
        b[at] ^= rng.integers(1, 256, minhash.DISTANCE, dtype=np.uint8)
        keys = minhash.chunk_keys(np.stack([a, b]))
        assert (keys[0] == keys[1]).any()


def test_sketch_cannot_miss():
    for size in range(1, 400):
        m = containment.sketch_length(size, 0.8)
        assert size - containment._needed(size, 0.8) < m <= size


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(1)
    left, right = rng.poisson(1, (brown.ALL, brown.CLASSES)), rng.poisson(1, (brown.ALL, brown.CLASSES))
    left[300:], right[300:] = 0, 0
    g = np.arange(brown.ALL) % (brown.CLASSES - 1)

    def value(g):
        t = np.zeros((brown.CLASSES, 2 * brown.CLASSES))
        np.add.at(t, g, np.concatenate([left, right], axis=1))
        n = t[:, : brown.CLASSES].sum(axis=1)
        xlogx = lambda x: (x * np.log(np.maximum(x, 1e-12))).sum()
        return xlogx(t) - 2 * xlogx(n)

    assert value(brown.exchange(left, right, g)) > value(g)


def test_pruned_search_equals_full():
    rng = np.random.default_rng(7)
    hashes = rng.zipf(1.3, 40_000).astype(np.uint64)
    ptr = np.sort(np.concatenate([[0, 40_000], rng.integers(0, 40_000, 799)]))
    parts = bm25.build(np.arange(800), hashes, ptr)
    raw = {n: parts[n].astype(t).tobytes() for n, t in bm25._PARTS}
    terms = np.unique(hashes)
    shard = bm25.Shard(raw, terms, np.linspace(0.1, 5, len(terms)), 50.0)
    for _ in range(30):
        query = rng.choice(len(terms), 12, replace=False)
        scores = np.zeros(800)
        for t in query:
            for e in range(shard.lo[t], shard.hi[t]):
                s = slice(shard.entry_start[e], shard.entry_start[e] + shard.entry_size[e])
                scores[shard.docs[s]] += shard.impacts[s]
        order = np.lexsort((shard.ids, -scores))[:10]
        assert shard.search(query, 10) == [(int(scores[d]), int(d)) for d in order if scores[d] > 0]


def test_queries_searched_together_equal_full(monkeypatch):
    """Common terms as a matrix and rarer ones by postings, whatever the floors; equal scores by id."""
    rng = np.random.default_rng(8)
    hashes = (rng.zipf(1.2, 60_000) % 5000).astype(np.uint64)
    ptr = np.sort(np.concatenate([[0, 60_000], rng.integers(0, 60_000, 998), [60_000]]))
    hashes[ptr[500] : ptr[500] + 2000] = np.tile(hashes[ptr[500] : ptr[500] + 50], 40)
    ids = rng.permutation(5000)[:1000]
    parts = bm25.build(ids, hashes, ptr)
    raw = {n: parts[n].astype(t).tobytes() for n, t in bm25._PARTS}
    terms = np.unique(hashes)
    queries = [rng.choice(len(terms), rng.integers(0, 300), replace=False) for _ in range(40)] + [np.arange(60), np.arange(len(terms))]
    asked, ends = np.bincount(np.concatenate(queries), minlength=len(terms)), np.append(0, np.cumsum([len(q) for q in queries]))
    for dense, common, postings in ((0.0, 50, 1000), (0.004, 1024, 1 << 20), (0.05, 1024, 1), (9.0, 9, 500)):
        for name, value in (("DENSE", dense), ("COMMON", common), ("POSTINGS", postings)):
            monkeypatch.setattr(bm25, name, value)
        shard = bm25.Shard(raw, terms, np.linspace(7.4, 0.01, len(terms)), 60.0, asked, len(queries))
        assert (len(shard.common) > 0) == (dense < 1)
        want = []
        for q, use in enumerate(queries):
            full = np.zeros(len(shard.ids))
            for t in use:
                at = slice(shard.entry_start[t], shard.entry_start[t] + shard.entry_size[t])
                full[shard.docs[at]] += shard.impacts[at]
            order = np.lexsort((shard.ids, -full))[:10]
            want.append([(q, int(full[d]), int(d)) for d in order if full[d] > 0])
        for least in (0, 4, 9):
            floors = np.array([w[least][1] if len(w) > least else 1.0 for w in want])
            got = list(zip(*(x.tolist() for x in shard.top(ends, np.concatenate(queries), 10, floors)), strict=True))
            assert got == [x for w, f in zip(want, floors, strict=True) for x in w if x[1] >= f]


def test_passages_whose_seeds_lie_in_many_earlier_documents(spark):
    """Earlier documents hold pieces of a passage, so that each seed has a source of its own: changed words don't hide it."""
    rnd = random.Random(3)
    some = lambda n: [f"w{rnd.randrange(10**7)}" for _ in range(n)]
    passage = some(120)
    docs = [(i, some(20) + passage[i * 10 : i * 10 + 16] + some(20)) for i in range(11)]
    docs += [(500, some(60) + passage + some(30)), (501, some(60) + [w if (j + 1) % 25 else f"x{j}" for j, w in enumerate(passage)] + some(20))]
    cases, n = [], 1000
    for _ in range(60):
        size, rate, own = rnd.choice([60, 80, 120, 200]), rnd.choice([0.0, 0.02, 0.04, 0.06]), some(200)
        for _ in range(rnd.choice([0, 6, 12])):
            length = rnd.choice([12, 20, 35, 45])
            at = rnd.randrange(size - length)
            docs.append((n, some(30) + own[:size][at : at + length] + some(30)))
            n += 1
        docs += [(n, some(rnd.randrange(90)) + own[:size] + some(40)), (n + 1, some(rnd.randrange(90)) + [w if rnd.random() >= rate else "y" + w for w in own[:size]] + some(40))]
        cases.append((n + 1, n))
        n += 2
    rows = chaining.passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").repartition(4)).collect()
    (known,) = [r for r in rows if r.doc_id == 501]
    assert known.src_doc_id == 500 and known.start_word <= 80 and known.end_word >= 175
    found = {(r.doc_id, r.src_doc_id) for r in rows}
    assert found <= {(501, 500), *cases} and sum(c in found for c in cases) >= 0.9 * len(cases)
