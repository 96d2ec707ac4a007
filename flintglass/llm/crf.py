"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Tokens are words; the states are O and T (toxic). A token's features are hashes of the word, of its first
four, five and six bytes and of its last four, so unseen forms of a stem are known too. Labelled tokens come
from labelled documents: in a toxic one, those with a feature that occurs in several toxic documents
and nearly only there are T, all others O. Weights and transitions are fitted by gradient ascent on
the conditional likelihood, whose gradient the forward-backward marginals give. A document's score is
a logistic function, fitted to the same documents, of the logarithm of its strength, the sum of the squared marginals of T: squaring keeps the many faint
marginals of a long clean text from adding up.

Fitting uses a bounded sample (ROWS, CHARS), of which a part (CHAIN_WORDS) is held in full at a time; scoring covers every word of every text. Chains are
cut into segments whose 2x2 transfer matrices are computed side by side and then combined, which is
exact for any length. Null or empty texts have no tokens and score as a text without T tokens.
Repeated rows score alike. An empty table gives an empty table. Without labels of both kinds the
score is the smoothed share of label 1. Only the two named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flintglass.llm.words import words

AFFIXES = (4, 5, 6)
BITS = 21
SEGMENT = 128
ROWS, CHARS = 5000, 20_000_000
MIN_SHARE, MIN_DOCS, MIN_RATIO = 0.015, 3, 25.0
STEPS, RATE, DECAY = 30, 0.3, 1e-4
CHAIN_WORDS = 200_000
_U = np.uint64


def features(w) -> np.ndarray:
    """Slots of the weight table, one row for each kind of feature."""
    kinds = [w.hash, *w.affix]
    return np.stack([((h ^ _U(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)) * _U(0xD6E8FEB86659FD93) >> _U(64 - BITS)).astype(np.int32) for k, h in enumerate(kinds)])


def marginals(odds: np.ndarray, ptr: np.ndarray, step: np.ndarray, counts: bool = False):
    """Probability of T for each token; with counts also the expected number of each transition.

    odds: exp of the tokens' scores for T; ptr: bounds of the chains; step[i, j]: exp of the score of
    state j after state i. Chains start after a state O.
    """
    sizes = np.diff(ptr)
    if not len(odds):
        return (np.zeros(0), np.zeros((2, 2))) if counts else np.zeros(0)
    per = -(-sizes // SEGMENT)
    first = np.append(0, np.cumsum(per))
    n = int(first[-1])
    chain = np.repeat(np.arange(len(sizes)), per)
    number = np.arange(n) - first[chain]
    start = ptr[:-1][chain] + number * SEGMENT
    size = np.minimum(SEGMENT, ptr[1:][chain] - start)
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    active = np.searchsorted(-size, -np.arange(SEGMENT), side="left")
    (a, b), (c, d) = step.tolist()

    m = np.tile(np.array([[1.0], [0.0], [0.0], [1.0]]), n)
    for t in range(SEGMENT):
        k = active[t]
        if not k:
            break
        e = odds[start[:k] + t]
        o0, t0, o1, t1 = m[:, :k]
        new = np.stack([o0 * a + t0 * c, (o0 * b + t0 * d) * e, o1 * a + t1 * c, (o1 * b + t1 * d) * e])
        m[:, :k] = new / new.sum(axis=0)
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    fwd, bwd = np.empty((2, n)), np.empty((2, n))
    depth = np.argsort(-per, kind="stable")
    live = np.searchsorted(-per[depth], -np.arange(int(per.max())), side="left")
    f = np.tile(np.array([[1.0], [0.0]]), len(sizes))
    for t, k in enumerate(live):
        who = depth[:k]
        s = back[first[who] + t]
        fwd[:, s] = f[:, who]
        o0, t0, o1, t1 = m[:, s]
        new = np.stack([f[0, who] * o0 + f[1, who] * o1, f[0, who] * t0 + f[1, who] * t1])
        f[:, who] = new / new.sum(axis=0)
    g = np.full((2, len(sizes)), 0.5)
    for t in range(len(live) - 1, -1, -1):
        who = depth[: live[t]]
        s = back[first[who] + t]
        bwd[:, s] = g[:, who]
        o0, t0, o1, t1 = m[:, s]
        new = np.stack([o0 * g[0, who] + t0 * g[1, who], o1 * g[0, who] + t1 * g[1, who]])
        g[:, who] = new / new.sum(axis=0)

    before = np.empty((SEGMENT, n))
    x, y = fwd
    x, y = x.copy(), y.copy()
    for t in range(SEGMENT):
        k = active[t]
        if not k:
            break
        before[t, :k] = y[:k] / (x[:k] + y[:k])
        e = odds[start[:k] + t]
        nx, ny = x[:k] * a + y[:k] * c, (x[:k] * b + y[:k] * d) * e
        total = nx + ny
        x[:k], y[:k] = nx / total, ny / total
    out, expected = np.empty(len(odds)), np.zeros((2, 2))
    x, y = bwd
    x, y = x.copy(), y.copy()
    for t in range(SEGMENT - 1, -1, -1):
        k = active[t]
        if not k:
            continue
        e, q = odds[start[:k] + t], before[t, :k]
        p = 1 - q
        oo, ot, to, tt = p * a * x[:k], p * b * e * y[:k], q * c * x[:k], q * d * e * y[:k]
        total = oo + ot + to + tt
        out[start[:k] + t] = (ot + tt) / total
        if counts:
            expected += np.array([[(oo / total).sum(), (ot / total).sum()], [(to / total).sum(), (tt / total).sum()]])
        nx, ny = a * x[:k] + b * e * y[:k], c * x[:k] + d * e * y[:k]
        total = nx + ny
        x[:k], y[:k] = nx / total, ny / total
    return (out, expected) if counts else out


def strength(p: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    return np.add.reduceat(np.append(p * p, 0.0), np.minimum(ptr[:-1], len(p))) * (np.diff(ptr) > 0)


def _odds(weights: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """exp of each token's score for T, one kind of feature after the other."""
    total = np.full(slots.shape[1], float(weights[-1]))
    for s in slots:
        total += weights[s]
    return np.exp(np.clip(total, -30, 30, out=total), out=total)


def _parts(ptr: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of chains of about CHAIN_WORDS tokens together."""
    out, lo = [], 0
    while lo < len(ptr) - 1:
        hi = max(lo + 1, int(np.searchsorted(ptr, ptr[lo] + CHAIN_WORDS, side="right")) - 1)
        out.append((lo, hi))
        lo = hi
    return out


@dataclass
class Model:
    weights: np.ndarray | None
    step: np.ndarray | None
    scale: tuple[float, float]

    def odds(self, slots: np.ndarray) -> np.ndarray:
        return _odds(self.weights, slots)

    def score(self, strengths: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * np.log(strengths + 0.01) + b, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a lightly regularised logistic regression on one variable, by Newton's method."""
    w = np.zeros(2)
    design = np.stack([x, np.ones_like(x)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w @ design, -30, 30)))
        grad = design @ (y - p) - 0.05 * w
        hess = (design * np.maximum(p * (1 - p), 1e-9)) @ design.T + 0.05 * np.eye(2)
        move = np.linalg.solve(hess, grad)
        w += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _chains(texts: pa.Array):
    slots, sizes = [], []
    for _, w in words(texts, AFFIXES):
        slots.append(features(w))
        sizes.append(np.diff(w.ptr))
    kinds = len(AFFIXES) + 1
    return np.concatenate(slots, axis=1) if slots else np.zeros((kinds, 0), np.int32), np.append(0, np.cumsum(np.concatenate(sizes))) if sizes else np.zeros(1, np.int64)


def token_labels(slots: np.ndarray, ptr: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """T tokens: in toxic documents, with a feature met in MIN_DOCS of them and MIN_SHARE of all of them, and MIN_RATIO times as often a document there as elsewhere."""
    doc = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    hot = np.zeros(slots.shape[1], bool)
    yes, no = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    for s in slots:
        pair = np.unique(s.astype(np.int64) * len(toxic) + doc)
        where = (pair // len(toxic)).astype(np.int64)
        bad = toxic[pair % len(toxic)]
        t, o = np.bincount(where[bad], minlength=1 << BITS), np.bincount(where[~bad], minlength=1 << BITS)
        hot |= ((t >= max(MIN_DOCS, MIN_SHARE * yes)) & (t / yes >= MIN_RATIO * (o + 0.5) / no))[s]
    return hot & toxic[doc]


def fit(rows: list[tuple[str, int]]) -> Model:
    toxic = np.array([y == 1 for _, y in rows], bool)
    share = (toxic.sum() + 0.5) / (len(toxic) + 1)
    if not toxic.any() or toxic.all():
        return Model(None, None, (0.0, float(np.log(share / (1 - share)))))
    slots, ptr = _chains(pa.array([t for t, _ in rows]))
    label = token_labels(slots, ptr, toxic)
    y = label.astype(float)
    previous = np.append(False, label[:-1])
    previous[ptr[:-1][np.diff(ptr) > 0]] = False
    seen = np.array([[(~previous & ~label).sum(), (~previous & label).sum()], [(previous & ~label).sum(), (previous & label).sum()]], float)
    size = (1 << BITS) + 1
    w, trans = np.zeros(size), np.zeros((2, 2))
    w[-1] = np.log((y.mean() + 1e-4) / (1 - y.mean() + 1e-4))
    sums = [np.zeros(size), np.zeros((2, 2))]
    parts = _parts(ptr)
    rest = np.empty(len(y))
    for _ in range(STEPS):
        expected = np.zeros((2, 2))
        for lo, hi in parts:
            a, b = ptr[lo], ptr[hi]
            p, some = marginals(_odds(w, slots[:, a:b]), ptr[lo : hi + 1] - a, np.exp(trans), True)
            rest[a:b] = y[a:b] - p
            expected += some
        grad = -DECAY * len(y) * w / 100
        for s in slots:
            grad[:-1] += np.bincount(s, weights=rest, minlength=1 << BITS)
        grad[-1] += rest.sum()
        g2 = seen - expected - DECAY * len(y) * trans / 100
        for k, (value, g) in enumerate(((w, grad), (trans, g2))):
            sums[k] += g * g
            value += RATE * g / np.sqrt(sums[k] + 1e-6)
        trans -= trans[0, 0]
    model = Model(w.astype(np.float32), np.exp(trans), (1.0, 0.0))
    strengths = [strength(marginals(model.odds(slots[:, ptr[lo] : ptr[hi]]), ptr[lo : hi + 1] - ptr[lo], model.step), ptr[lo : hi + 1] - ptr[lo]) for lo, hi in parts]
    model.scale = logistic(np.log(np.concatenate(strengths) + 0.01), toxic.astype(float))
    return model


def judge(model: Model, texts: pa.Array, spans: bool = False, threshold: float = 0.5) -> tuple[np.ndarray, list]:
    """Scores of texts, their strengths, and with spans the stretches at or over the threshold."""
    total, found, held = [np.zeros(0)], [], []

    def weigh():
        """Marginals of several slices at once."""
        odds = np.concatenate([model.odds(features(w)) for w in held])
        shift = np.append(0, np.cumsum([len(w.hash) for w in held]))
        ptr = np.concatenate([*(w.ptr[:-1] + s for w, s in zip(held, shift[:-1], strict=True)), shift[-1:]])
        p = marginals(odds, ptr, model.step)
        total.append(strength(p, ptr))
        for w, s in zip(held, shift, strict=False) if spans else ():
            for i in range(len(w)):
                lo, hi = int(w.ptr[i]), int(w.ptr[i + 1])
                edge = lo + np.flatnonzero(np.diff(np.concatenate([[False], p[s + lo : s + hi] >= threshold, [False]]).astype(np.int8)))
                found.append([{"start": int(w.start[x]), "end": int(w.end[y - 1]), "p": float(p[s + x : s + y].max())} for x, y in zip(edge[::2], edge[1::2], strict=True)])
        held.clear()

    for _, w in words(texts, AFFIXES):
        if model.weights is None:
            total.append(np.zeros(len(w)))
            found += [[] for _ in range(len(w))]
            continue
        held.append(w)
        if sum(len(w.hash) for w in held) >= CHAIN_WORDS:
            weigh()
    if held:
        weigh()
    return np.concatenate(total), found


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", spans: bool = False, threshold: float = 0.5) -> DataFrame:
    """key, score and strength; with spans also a list of the stretches of words whose marginals reach the threshold: byte offsets start and end in the UTF-8 text, and their greatest marginal p."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, score double, strength double" + ", spans array<struct<start:long,end:long,p:double>>" * spans

    def run(batches):
        m = shared.value
        for b in batches:
            whole, found = judge(m, b.column(text), spans, threshold)
            cols = [b.column(key), pa.array(m.score(whole)), pa.array(whole)]
            if spans:
                cols.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(cols, names=[key, "score", "strength", "spans"][: len(cols)])

    return docs.select(key, text).mapInArrow(run, schema)


def clean(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose text scores below the threshold.

    A null or empty text scores as one without toxic tokens. A model fitted without labels of both kinds can't tell
    texts apart, so all rows stay.
    Repeated rows are judged alike; rows with a null id are judged too, as only the text is read. An empty table
    gives an empty table.
    """
    if model.weights is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            yield b.filter(pa.array(m.score(judge(m, b.column(text))[0]) < threshold))

    return docs.mapInArrow(run, docs.schema)
