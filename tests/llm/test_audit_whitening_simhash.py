"""Source divergence, whitening and SimHash: brute force, nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from flintglass.llm import divergence, simhash, whitening
from flintglass.llm import queries as Q
from tests.compare import duck_rows, spark_rows
from tests.llm.test_tables import LOWER, SCHEMA, make, plain_words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make()[0], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_audit(rows, top):
    """rows: lang, source, text. The contract in Python's whole numbers."""
    seen, counts, df = set(), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        seen.add((lang, source))
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.translate(LOWER))
        counts[lang, source].update(terms)
        df[lang].update(set(terms))
    out = set()
    for lang in {a for a, _ in seen}:
        kept = sorted(t for t, n in df[lang].items() if n >= 3)
        groups = sorted(s for a, s in seen if a == lang)
        of = {s: Counter({t: n for t, n in counts[lang, s].items() if t in set(kept)}) for s in groups}
        every = sum(of.values(), Counter())

        def p(c, t):
            return 1 + 10**9 * (c[t] + 1) // (c.total() + len(kept))  # noqa: B023

        def f(a, b):
            return (a - b) ** 2 // b

        for s in groups:
            pairs = sorted((-sum(f(p(of[s], t), p(of[o], t)) for t in kept), o.encode()) for o in groups if o != s)
            best = sorted((-f(p(of[s], t), p(every, t)), t.encode()) for t in of[s] if of[s][t] and p(of[s], t) > p(every, t))[:top]
            out |= {(lang, s, part, o.decode(), -v, i) for part, found in (("pair", pairs), ("term", best)) for i, (v, o) in enumerate(found, 1)}
    return out


def test_divergence_equals_plain_numbers(spark, monkeypatch):
    rnd = random.Random(3)
    word = lambda: rnd.choice(["Ab", "ab", "cd", "éa", "É", "x", "yz", "q", "ﬁ", "日本"]) + rnd.choice(["", "a", "b"])
    text = lambda n: rnd.choice([" ", "-", "1", "_", "\n"]).join(word() for _ in range(n))
    rows = [(rnd.choice(["en", "de"]), rnd.choice(["a", "b", "c", "ü"]), text(rnd.randrange(60))) for _ in range(60)]
    rows += [("en", "a", "zz ")] * 3 + [("en", None, None), (None, "a", "zz zz"), (None, None, text(40)), ("fr", "a", None), ("fr", "b", "one two"), ("xx", "only", text(2000)), ("en", "b", "tie1 tie2"), ("en", "b", "tie1 tie2"), ("en", "b", "tie1 tie2")]
    frame = spark.createDataFrame([(i, t, a, b, 7, "h", "rank", "value", "groups") for i, (a, b, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, term string, part string, item string, groups string").repartition(3)
    want = {top: plain_audit(rows, top) for top in (3, 200)}
    as_set = lambda df: {(r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect()}
    got = divergence.audit(frame).collect()
    assert len(got) == len(want[200]) and as_set(divergence.audit(frame)) == want[200]
    assert as_set(divergence.audit(frame, top=3)) == want[3]
    for name, value in (("CELLS", 1), ("FLUSH", 5), ("PIECE", 8), ("TILE", 1)):
        monkeypatch.setattr(divergence, name, value)
    assert as_set(divergence.audit(frame)) == want[200]
    assert divergence.audit(frame.limit(0)).count() == 0


def test_divergence_equals_sql(spark):
    assert spark_rows(Q.QUERIES["op11_source_divergence"](spark, SF)) == duck_rows(Q.ORACLE["op11_source_divergence"], SF)


def test_shares_are_exact_beyond_63_bits():
    rnd = random.Random(2)
    counts = np.array([[rnd.randrange(1 << 40) for _ in range(200)] for _ in range(2)], np.int64)
    totals = np.array([[1 << 52], [(1 << 50) + 7]], np.int64)
    assert divergence.shares(counts, totals).tolist() == [[1 + 10**9 * (c + 1) // int(t[0]) for c in row] for row, t in zip(counts.tolist(), totals, strict=True)]


def check_whitening(got, vectors, k=8):
    """got: rows by id; vectors: id to floats."""
    x = {i: np.array([math.floor(1024 * float(c)) + 100_000 for c in v], object) for i, v in vectors.items()}
    n, total = len(x), sum(x.values())
    real = np.array([(v * n - total) / n for v in x.values()], float)
    values, axes = np.linalg.eigh(real.T @ real / n)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(got) == n * k
    for r in got:
        away = sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[r.vec_id], total, strict=True))
        assert (r.n, r.deviation if away < 1 << 63 else None, r.deviation_digits) == (n, r.deviation, str(away)) and (r.deviation == away if away < 1 << 63 else r.deviation is None)
        assert abs(r.explained - values[r.component - 1] / values.sum()) <= 1e-4 * r.explained and r.identity_error <= 1e-4
    for c in range(1, k + 1):
        mine = {r.vec_id: r.whitened for r in got if r.component == c}
        theirs = {i: float(np.dot(row, axes[:, c - 1])) / math.sqrt(values[c - 1]) for i, row in zip(x, real, strict=True)}
        sign = 1 if sum(mine[i] * theirs[i] for i in mine) > 0 else -1
        assert all(abs(mine[i] - sign * theirs[i]) < 1e-6 for i in mine)


KIND = "vec_id long, embedding array<float>, label int, n string, component string, x string"


def test_whitening_equals_an_eigendecomposition(spark):
    rng = np.random.default_rng(4)
    for dims, n in ((12, 60), (130, 300)):
        scale = np.linspace(3, 0.5, dims)
        vectors = {i: (rng.normal(size=dims) * scale).astype(np.float32).tolist() for i in range(n)}
        bad = [(900, None), (901, [None] * dims), (902, [float("nan")] + [0.0] * (dims - 1)), (903, [float("-inf")] * dims), (904, []), (905, [1.0] * (dims + 1)), (906, [3e38] * dims)]
        table = spark.createDataFrame([(i, v, 1, "a", "b", "c") for i, v in [*vectors.items(), *bad]], KIND).repartition(3)
        check_whitening(whitening.whiten(table).collect(), vectors)
    few = {i: [1e8 * (-1) ** i, 5e8 * i, float(i % 3)] for i in range(5)}
    table = spark.createDataFrame([(i, v, 1, "a", "b", "c") for i, v in few.items()], KIND.replace("float", "double"))
    found = whitening.whiten(table).collect()
    assert {r.vec_id for r in found} == set(few) and any(r.deviation is None for r in found)


def test_whitening_of_degenerate_tables(spark):
    table = lambda rows: spark.createDataFrame([(i, v, 1, "a", "b", "c") for i, v in rows], KIND)
    assert whitening.whiten(table([])).count() == 0 and whitening.whiten(table([(1, None)])).count() == 0 and whitening.whiten(table([(1, [])])).count() == 0
    assert whitening.whiten(table([(1, [1.0, 2.0])])).count() == 0 and whitening.whiten(table([(i, [1.0, 2.0]) for i in range(5)])).count() == 0
    line = [(i, [float(i), 2.0 * i, 1.0]) for i in range(9)] + [(None, [3.0, 6.0, 1.0]), (3, [3.0, 6.0, 1.0])]
    got = whitening.whiten(table(line)).collect()
    assert {r.component for r in got} == {1} and len(got) == 11 and all(abs(r.explained - 1) < 1e-9 for r in got)
    same = {round(r.whitened, 9) for r in got if r.vec_id in (3, None)}
    assert len(same) == 1


def plain_print(text):
    words = [w.encode() for w in plain_words(text)]
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """prints: (id, fingerprint), ids may repeat."""
    parent = {i: i for i, _ in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, p) in enumerate(prints):
        for b, q in prints[:k]:
            if (p ^ q).bit_count() <= 2 and root(a) != root(b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in parent}


def test_simhash_equals_all_pairs(spark, docs, none):
    rows = [(i, t) for i, t, *_ in make()[0]]
    base = [f"w{j}" for j in range(400)]
    rows += [(1000 + k, " ".join(w if j != 20 * k else "new" for j, w in enumerate(base))) for k in range(15)] + [(2000, "one Two"), (2001, "one\ttwo "), (2002, "w " * 5), (2002, "other words here now"), (2003, "other WORDS here now")]
    frame = spark.createDataFrame([(i, t, "en", "s", 1, "h", "k", "i", "n") for i, t in rows], SCHEMA).repartition(3)
    got = simhash.near_duplicates(frame.withColumnRenamed("hash", "print").withColumnRenamed("key", "rep").withColumnRenamed("n", "component")).collect()
    want = [(i, plain_print(t)) for i, t in rows]
    of = plain_components([w for w in want if w[0] is not None])
    assert Counter((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got) == Counter((i, p, of.get(i)) for i, p in want)
    assert all(len(r.fingerprint) == 16 for r in got) and of[301] == of[302] == 300 and of[2003] == 2002
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_of_a_hot_ball(spark, monkeypatch):
    """Fingerprints close to each other fill one key beyond any block: they are dealt again, and every link is found."""
    rnd = random.Random(8)
    center = rnd.getrandbits(64)
    prints = sorted({center ^ (1 << a) ^ (1 << b) ^ (1 << c) for a in range(0, 64, 5) for b in range(64) for c in (0, 9)})
    far = [rnd.getrandbits(64) for _ in range(300)]
    rows = list(enumerate(prints + far + [far[7] ^ 3, far[8] ^ (1 << 40), far[9] ^ 7]))
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in rows]
    monkeypatch.setattr(simhash, "LANES", 64)
    monkeypatch.setattr(simhash, "SMALL", 64)
    monkeypatch.setattr(simhash, "_prints", lambda docs, key, text: docs.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("print")))
    frame = spark.createDataFrame([(i, "", "", "", p, "", "", "", "") for i, p in signed], SCHEMA)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame).collect()}
    assert len(simhash.levels()) > 3 and got == plain_components(rows)


def test_bit_sliced_links_are_a_forest_of_all_pairs():
    rng = np.random.default_rng(1)
    for n in (1, 2, 63, 64, 65, 700):
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        for i in range(0, n - 1, 3):
            base[i + 1] = base[i] ^ np.uint64(1 << int(rng.integers(64)) | 1 << int(rng.integers(64)))
        base = np.unique(base)
        near = np.bitwise_count(base[:, None] ^ base[None, :]) <= 2
        made = simhash.links(base)
        want = plain_components(list(enumerate(base.tolist())))
        assert all(near[a, b] for a, b in made) and len(made) == len(base) - len(set(want.values()))


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = " ".join(f"Word{i % 91}" for i in range(5000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "PIECE", 50)
    assert simhash.fingerprint(text.encode()) == whole == plain_print(text)
    assert [simhash.fingerprint(t) for t in (b"", b"  \n", b"a", b" a  b ")] == [0, 0, xxh64_intdigest(b"a", 42), xxh64_intdigest(b"a b", 42)]
