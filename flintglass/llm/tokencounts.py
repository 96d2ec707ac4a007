"""Exact histogram of encoded lengths, and what it answers for every context limit.

Documents are counted by length; suffix sums over lengths then give, for any limit, the documents
that reach it, the tokens they hold and the tokens left if every document is cut at it. Sums run in
two levels (ranges of lengths, then the lengths of a range), so no task gets the whole histogram.
Null and empty texts have length 0; an empty table has an empty histogram.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flintglass.llm import bpe
from flintglass.llm.store import Scratch

RANGE = 512


def histogram(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    """n_tokens, n_docs for each length there is; null lengths count as 0."""
    n = F.coalesce(F.col(f"`{length}`").cast("long"), F.lit(0))
    return lengths.groupBy(n.alias("n_tokens")).agg(F.count("*").alias("n_docs"))


def context_limits(hist: DataFrame) -> DataFrame:
    """For each length L of the histogram, as a limit.

    docs_reaching and tokens_reaching: documents of length L or more and their tokens; docs_within and
    tokens_within: documents of length L or less and theirs; truncated_total: tokens if each document
    is cut at L; dropped_tokens: what cutting loses; quantile: the part of documents within L.
    """
    part = hist.withColumn("part", F.floor(F.col("n_tokens") / RANGE)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    coarse = part.groupBy("part").agg(F.sum("n_docs").alias("part_docs"), F.sum("tokens").alias("part_tokens"))
    above = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    coarse = coarse.select(
        "part",
        *(F.coalesce(F.sum(f"part_{x}").over(above), F.lit(0)).alias(f"above_{x}") for x in ("docs", "tokens")),
        *(F.sum(f"part_{x}").over(everything).alias(f"all_{x}") for x in ("docs", "tokens")),
    )
    down = Window.partitionBy("part").orderBy(F.desc("n_tokens"))
    out = part.join(coarse, "part").select(
        "n_tokens",
        "n_docs",
        "tokens",
        "all_docs",
        "all_tokens",
        (F.sum("n_docs").over(down) + F.col("above_docs")).alias("docs_reaching"),
        (F.sum("tokens").over(down) + F.col("above_tokens")).alias("tokens_reaching"),
    )
    cut = F.col("tokens_reaching") - F.col("docs_reaching") * F.col("n_tokens")
    within = F.col("all_docs") - F.col("docs_reaching") + F.col("n_docs")
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_reaching",
        "tokens_reaching",
        within.alias("docs_within"),
        (F.col("all_tokens") - F.col("tokens_reaching") + F.col("tokens")).alias("tokens_within"),
        (F.col("all_tokens") - cut).alias("truncated_total"),
        cut.alias("dropped_tokens"),
        F.round(within / F.col("all_docs"), 9).alias("quantile"),
    )


def with_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """The histogram with rows of no documents for the limits, so that context_limits() answers for each of them whether a document has that length or not."""
    asked = hist.sparkSession.createDataFrame([(int(x), 0) for x in limits], "n_tokens long, n_docs long")
    return hist.union(asked).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def quantiles(limits: DataFrame, probabilities: list[float]) -> DataFrame:
    """For each probability the least length that at least that part of the documents keeps within."""
    wanted = limits.sparkSession.createDataFrame([(float(p),) for p in probabilities], "probability double")
    return wanted.join(limits, F.col("quantile") >= F.round("probability", 9)).groupBy("probability").agg(F.min("n_tokens").alias("n_tokens"))


#: Usual context limits, which are answered also where no document has the length.
LIMITS = [1 << k for k in range(7, 21)]


def token_counts(df: DataFrame, path: str, pattern: str, text: str = "text", limits: list[int] = LIMITS) -> DataFrame:
    """context_limits() of a table of texts, for each length there is and each of the limits; an empty table has no rows. The histogram is written once, as both levels of the sums read it."""
    hist = Scratch(df.sparkSession).keep(histogram(bpe.lengths(df, path, pattern, text)))
    return context_limits(with_limits(hist, limits if limits and not hist.isEmpty() else []))
