"""Quality of documents by a byte-level convolutional network in numpy.

Filters over WIDTH bytes run along the whole text. Their rectified responses are max-pooled over
chunks of two CHUNK-byte halves that overlap by one half; a document is then described by the mean
and the maximum of its chunks' values, which one logistic unit combines into a probability. Filters
are kept as tables of byte pairs, so a response is a sum of WIDTH / 2 table rows.

Fitting uses a bounded sample (ROWS, CHARS) with Adam; gradients reach a filter through the
positions where it was greatest. Scoring covers every byte of every text, in blocks. Null and empty
texts are one chunk of zero bytes. Repeated rows score alike. An empty table gives an empty table.
Without labels of both kinds the score is the smoothed share of label 1. Only the two named columns
are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flintglass.llm.words import slices, utf8

FILTERS, WIDTH, CHUNK = 16, 6, 256
BLOCK = 64
ROWS, CHARS = 5000, 20_000_000
EPOCHS, BATCH, RATE, SEED = 6, 64, 0.01, 6


@dataclass
class Model:
    filters: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: float

    def tables(self) -> list[np.ndarray]:
        """For each pair of filter positions, the responses to each pair of bytes."""
        f = self.filters
        return [(f[j][:, None, :] + f[j + 1][None, :, :]).reshape(65536, FILTERS).astype(np.float32) for j in range(0, WIDTH, 2)]


def halves(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of CHUNK + WIDTH - 1 bytes, the last WIDTH - 1 being those of the next row of the text or zeros, and each text's first row."""
    sizes = np.diff(offs)
    per = np.maximum(1, -(-sizes // CHUNK))
    first = np.append(0, np.cumsum(per))
    flat = np.zeros(int(first[-1]) * CHUNK + WIDTH, np.uint8)
    base = first[:-1] * CHUNK
    at = np.arange(int(offs[0]), int(offs[-1])) + np.repeat(base - offs[:-1], sizes)
    flat[at] = buf[int(offs[0]) : int(offs[-1])]
    rows = np.lib.stride_tricks.sliding_window_view(flat, CHUNK + WIDTH - 1)[::CHUNK][: int(first[-1])].copy()
    rows[first[1:] - 1, CHUNK:] = 0
    return rows, first


def responses(rows: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """For each row, position and filter the sum of the table rows."""
    codes = rows[:, :-1].astype(np.int32) << 8
    codes |= rows[:, 1:]
    out = tables[0][codes[:, :CHUNK]]
    for j, table in enumerate(tables[1:], 1):
        out += table[codes[:, 2 * j : 2 * j + CHUNK]]
    return out


def pooled(low: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean and maximum over each text's chunks, a chunk being two neighbouring rows, or the only one."""
    n = np.diff(first)
    nxt = np.minimum(np.arange(len(low)) + 1, np.repeat(first[1:] - 1, n))
    chunk = np.maximum(low, low[nxt])
    last = (n > 1).astype(bool)
    keep = np.ones(len(low), bool)
    keep[first[1:][last] - 1] = False
    chunk = chunk[keep]
    starts = np.append(0, np.cumsum(n - last))[:-1]
    return np.concatenate([np.add.reduceat(chunk, starts) / (n - last)[:, None], np.maximum.reduceat(chunk, starts)], axis=1)


def describe(buf: np.ndarray, offs: np.ndarray, tables: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    rows, first = halves(buf, offs)
    low = np.empty((len(rows), FILTERS), np.float32)
    for at in range(0, len(rows), BLOCK):
        low[at : at + BLOCK] = responses(rows[at : at + BLOCK], tables).max(axis=1)
    return pooled(np.maximum(low + bias.astype(np.float32), 0), first)


def fit(samples: list[tuple[str, int]]) -> Model:
    y = np.array([v for _, v in samples], float)
    rng = np.random.Generator(np.random.PCG64(SEED))
    model = Model(rng.normal(0, 0.3, (WIDTH, 256, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 2 * FILTERS), 0.0)
    share = (y.sum() + 0.5) / (len(y) + 1)
    model.offset = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        model.weights[:] = 0
        return model
    buf, offs = utf8(pa.array([t for t, _ in samples]))
    params = [model.filters, model.bias, model.weights, np.array([model.offset])]
    first_moment, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, steps = 0, EPOCHS * -(-len(y) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            pick = np.sort(order[at : at + BATCH])
            sizes = np.diff(offs)[pick]
            own = np.append(0, np.cumsum(sizes))
            text = buf[np.arange(int(own[-1])) + np.repeat(offs[pick] - own[:-1], sizes)]
            rows, first = halves(text, own)
            tables = model.tables()
            low, where = np.empty((len(rows), FILTERS), np.float32), np.empty((len(rows), FILTERS), np.int64)
            for r in range(0, len(rows), BLOCK):
                made = responses(rows[r : r + BLOCK], tables)
                where[r : r + BLOCK] = made.argmax(axis=1)
                low[r : r + BLOCK] = made.max(axis=1)
            act = np.maximum(low + model.bias, 0)
            desc = pooled(act, first)
            p = 1 / (1 + np.exp(-np.clip(desc @ model.weights + params[3][0], -30, 30)))
            err = (p - y[pick]) / len(pick)
            d_desc = err[:, None] * model.weights
            n = np.diff(first)
            doc = np.repeat(np.arange(len(pick)), n)
            nxt = np.minimum(np.arange(len(low)) + 1, first[1:][doc] - 1)
            real = (nxt > np.arange(len(low))) | (n[doc] == 1)
            chunks = np.maximum(n - 1, 1)
            winner = np.where(act >= act[nxt], np.arange(len(low))[:, None], nxt[:, None])
            chunk = np.maximum(act, act[nxt])
            g = np.where(real[:, None], d_desc[doc, :FILTERS] / chunks[doc, None], 0)
            top = desc[doc, FILTERS:]
            g += np.where(real[:, None] & (chunk == top), d_desc[doc, FILTERS:], 0)
            cols = np.broadcast_to(np.arange(FILTERS), winner.shape)
            d_low = np.bincount((winner * FILTERS + cols).ravel(), weights=g.ravel(), minlength=act.size).reshape(act.shape)
            d_low[act <= 0] = 0
            d_filter = np.zeros_like(model.filters)
            r, f = np.nonzero(d_low)
            for j in range(WIDTH):
                byte = rows[r, where[r, f] + j].astype(np.int64)
                d_filter[j] = np.bincount(byte * FILTERS + f, weights=d_low[r, f], minlength=256 * FILTERS).reshape(256, FILTERS)
            grads = [d_filter, d_low.sum(axis=0), desc.T @ err + 1e-4 * model.weights, np.array([err.sum()])]
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for q, g1, m1, m2 in zip(params, grads, first_moment, second, strict=True):
                m1 += 0.1 * (g1 - m1)
                m2 += 0.01 * (g1 * g1 - m2)
                q -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    model.offset = float(params[3][0])
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        m = shared.value
        tables = m.tables()
        for b in batches:
            buf, offs = utf8(b.column(text))
            out = [np.zeros(0)]
            for lo, hi in slices(offs):
                desc = describe(buf, offs[lo : hi + 1], tables, m.bias)
                out.append(1 / (1 + np.exp(-np.clip(desc @ m.weights + m.offset, -30, 30))))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(np.concatenate(out))], names=[key, "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double")
