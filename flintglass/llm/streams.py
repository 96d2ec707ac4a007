"""Groups of consecutive rows from the sorted batches of a partition."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def runs(batches, columns: list[str], key: str = "key"):
    """For each run of rows with one key, arrays of the columns."""
    held: list = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.asarray(b.column(key))
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and keys[lo] != last:
                yield [pa.concat_arrays(c) for c in zip(*held, strict=True)]
                held = []
            last = keys[lo]
            held.append([b.column(c).slice(lo, hi - lo) for c in columns])
    if held:
        yield [pa.concat_arrays(c) for c in zip(*held, strict=True)]


def whole(batches, columns: list[str], key: str):
    """Numpy arrays of the columns, batch by batch, each key's rows together in one; the last key's rows wait for the next batch."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        rows = [np.asarray(b.column(c)) for c in columns]
        if held is not None:
            rows = [np.append(h, r) for h, r in zip(held, rows, strict=True)]
        keys = rows[columns.index(key)]
        cut = int(np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[-1])
        if cut:
            yield [r[:cut] for r in rows]
        held = [r[cut:] for r in rows]
    if held is not None:
        yield held


def apart(keys: np.ndarray, *positions: np.ndarray) -> list[np.ndarray]:
    """Positions, below 2^31, of runs of keys on one line, far from those of other keys."""
    run = np.cumsum(np.append(0, keys[1:] != keys[:-1])).astype(np.int64) << 32
    return [p + run for p in positions]
