"""A bounded sample of labelled rows to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flintglass.llm.store import Scratch


def crc_mod(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n; null for a null key."""
    return F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % n


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int, chars: int, key: str = "doc_id", text: str = "text") -> list[tuple[str, int]]:
    """Texts and 0/1 labels of at most rows keys, of at most chars characters together.

    Of the labelled keys for which learn holds and that docs has, the first rows by hash are taken in
    this order, and one whose text doesn't fit beside those taken is passed over. Of rows that repeat a key the
    longest text counts, of labels for one key the greatest; null and empty texts are passed over.
    Only these columns are read, whatever else the tables have. What reaches the driver is bounded
    by rows and chars also where a key has many rows: rows are reduced to one for each key first.
    """
    chosen = labels.filter(learn & F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.length("t") > 0)
    chosen = chosen.join(docs.select(F.col(key).alias("k")), "k", "left_semi").withColumn("h", F.xxhash64("k")).orderBy("h", "k").limit(rows)
    found = texts.join(F.broadcast(chosen), "k")
    single = found.groupBy("h", "k", "y").agg(F.max(F.struct(F.length("t").alias("n"), F.col("t").alias("t"))).alias("s"))
    scratch = Scratch(docs.sparkSession)
    kept = scratch.keep(single.select("h", "k", "y", "s.n", "s.t"))
    taken, left = [], chars
    for r in sorted(kept.select("h", "k", "n").collect()):
        if r["n"] <= left:
            taken.append((r["h"], r["k"]))
            left -= r["n"]
    if not taken:
        return []
    wanted = docs.sparkSession.createDataFrame(taken, kept.select("h", "k").schema)
    got = kept.join(F.broadcast(wanted), ["h", "k"]).select("h", "k", "t", "y").collect()
    scratch.drop(kept)
    return [(r["t"], r["y"]) for r in sorted(got, key=lambda r: (r["h"], r["k"]))]
