"""Columns with clashing names, a text of over a megabyte and a plain version of the class model's scores."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flintglass.llm import bm25, brown, bytecnn, chaining, containment, crf, minhash, simhash
from flintglass.llm.store import Scratch
from flintglass.llm.words import words as words_of
from tests.llm.test_tables import make

#: Names that operators use for columns of their own.
CLASHING = ["id", "key", "k", "t", "h", "y", "n", "s", "seed", "src", "pos", "pair", "grp", "rep", "sig", "term", "hash", "row", "class", "size", "learn", "base", "score", "print", "shard", "query_id", "rank", "item_id", "chain", "lo", "hi", "kind"]


@pytest.fixture(scope="module")
def both(spark):
    """The same documents with and without further columns; one text has over a megabyte."""
    rnd = random.Random(7)
    rows = [(i, t) for i, t, *_ in make(3)[0] if i != 305]
    long = " ".join(f"z{rnd.randrange(5000)}" for _ in range(230_000))
    rows.append((400, long))
    plain = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    more = plain.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])
    return plain.cache(), more.cache(), rows


def same(a, b) -> bool:
    return a.columns == b.columns and Counter(map(str, a.collect())) == Counter(map(str, b.collect()))


def test_further_columns_change_nothing(both):
    plain, more, rows = both
    learnt = [(t, i % 2) for i, t in rows[:30] if t]
    model, net = crf.fit(learnt), bytecnn.fit(learnt)
    item = plain.filter("doc_id = 200").select(F.lit(1).cast("long").alias("item_id"), F.substring("text", 150, 200).alias("text"))
    for f in (
        lambda d: minhash.near_duplicates(d),
        lambda d: simhash.near_duplicates(d),
        lambda d: chaining.passages(d),
        lambda d: crf.score(d, model, spans=True),
        lambda d: bytecnn.score(d, net),
        lambda d: bm25.search(d, d.filter("doc_id % 100 = 0 and doc_id < 400"), 5),
        lambda d: containment.search(d, item),
    ):
        assert same(f(plain), f(more))
    got = {r.doc_id: r for r in brown.score(more, F.lit(True)).collect() if r.doc_id is not None}
    assert all(abs(got[r.doc_id].score - r.score) < 1e-6 for r in brown.score(plain, F.lit(True)).collect() if r.doc_id is not None and r.doc_id != 151)
    assert got[400].n_tokens == 230_001 and got[400].n_known == 230_001


def test_class_model_by_its_definition(spark, both):
    """Probabilities after any context sum to 1, and scores are the sums of their logarithms."""
    _, _, rows = both
    rows = [(i, t) for i, t in rows if i is not None and i < 200]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = docs.select("text", (F.col("doc_id") % 3 > 0).alias("learn"))
    scratch = Scratch(spark)
    counts = scratch.keep(brown.word_counts(train, "text"))
    model = brown.fit(train, counts, "text", scratch)
    step, seen, unseen = (10.0**x for x in (model.step, model.seen, model.unseen))
    assert np.allclose(step.sum(axis=1), 1)
    tally, of = Counter(), {}
    texts = {}
    for i, t in rows:
        got = [w for _, w in words_of(pa.array([t or ""]), (-3,))]
        kinds = np.concatenate([model.vocabulary.types(w)[0] for w in got]) if got else np.zeros(0, np.int64)
        hashes = np.concatenate([w.hash for w in got]) if got else np.zeros(0, np.uint64)
        texts.setdefault(i, []).append((hashes.tolist(), model.classes[kinds].tolist()))
        of |= dict(zip(hashes.tolist(), model.classes[kinds].tolist(), strict=True))
        if i % 3 > 0:
            tally.update(hashes.tolist())
    end = brown.CLASSES - 1
    mass = unseen.copy()
    for h, n in tally.items():
        mass[of[h]] += n * seen[of[h]]
    mass[end] += model.ends * seen[end]
    used = {of[h] for h in tally} | {end}
    assert np.allclose(mass[sorted(used)], 1)
    scored = {}
    for r in brown.score(docs, F.col("doc_id") % 3 > 0).collect():
        scored.setdefault(r.doc_id, []).append(r.score)
    for i, versions in texts.items():
        want = []
        for hashes, classes in versions:
            total, before = 0.0, end
            for h, c in zip([*hashes, None], [*classes, end], strict=True):
                p = model.ends * seen[end] if h is None else tally[h] * seen[c] if tally[h] else unseen[c]
                total += np.log10(step[before, c] * p)
                before = c
            want.append(total)
        assert np.allclose(sorted(scored[i]), sorted(want), atol=1e-6)
