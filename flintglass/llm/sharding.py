"""Placement of rows on shards by a permutation-filled lookup table.

The table has a prime number of slots. Each shard has its own permutation of the slots, made from two
hashes of its name, and the shards take turns to claim their next free slot until none is left. A
row's slot is a hash of its key, so placement is one array access, shards get equal parts to within
1/slots of the table, and adding or removing a shard moves little besides that shard's own rows.

Null keys go to the slot of the hash seed; repeated keys go to one shard; an empty table gives an
empty table; columns named like an output are replaced. The table's size is fixed by its parameters,
never by the data, so it may be broadcast.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 65537
MAX_SLOTS = 1 << 22


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(shard: str, slots: int) -> tuple[int, int]:
    """Offset and step of the shard's permutation of the slots."""
    h = hashlib.sha256(shard.encode()).digest()
    return int.from_bytes(h[:8], "big") % slots, int.from_bytes(h[8:16], "big") % (slots - 1) + 1


def fill(shards: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> np.ndarray:
    """For each slot the number of the shard that owns it; a shard of weight w claims w slots a turn."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be named, and differently")
    if not _is_prime(slots) or slots > MAX_SLOTS:
        raise ValueError(f"slots must be a prime of at most {MAX_SLOTS}")
    weights = weights or [1] * len(shards)
    if len(weights) != len(shards) or min(weights) < 0 or not sum(weights):
        raise ValueError("weights must be one for each shard, none below 0 and some above")
    at, step = map(list, zip(*(preference(s, slots) for s in shards), strict=True))
    owner, left = [-1] * slots, slots
    while True:
        for i, turns in enumerate(weights):
            for _ in range(turns):
                slot = at[i]
                while owner[slot] >= 0:
                    slot = (slot + step[i]) % slots
                owner[slot] = i
                at[i] = (slot + step[i]) % slots
                left -= 1
                if not left:
                    return np.array(owner, np.int32)


def place(df: DataFrame, shards: list[str], key: str = "doc_id", slots: int = SLOTS, weights: list[int] | None = None, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """df with each row's slot and the name of its shard."""
    spark = df.sparkSession
    table = spark.createDataFrame([(i, shards[o]) for i, o in enumerate(fill(shards, slots, weights).tolist())], f"`{slot}` int, `{shard}` string")
    hashed = F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string")), F.lit(slots)).cast("int")
    return df.drop(*({slot, shard} - {key})).withColumn(slot, hashed).join(F.broadcast(table), slot)
