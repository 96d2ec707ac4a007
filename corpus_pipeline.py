"""The corpus pipeline: stages that each take the documents kept so far and return those to keep.

toxicity: drops documents scored as toxic; fitted on the labelled documents it is given.
near_dedup: keeps of each group of near-duplicates (similarity of 0.8 or more) the document with the least id; rows that repeat
an id are one document, of which the row with the longest text stays. Rows without an id stay.
Each stage keeps null and empty texts, whatever other columns the table has, and gives an empty table for one.
substring_dedup: cuts passages out of documents that an earlier document has too, and drops documents
of which nothing is left.
decontamination: drops documents that hold a benchmark item, rows without an id too; of rows that repeat an id all go if one holds an item.
byte_bpe: adds token_ids and n_tokens to each row, whatever its id, and gives the text as decoded from the ids; null texts stay null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flintglass.llm import bpe, chaining, containment, crf, minhash
from flintglass.llm.queries import toxicity_model, vocabulary
from flintglass.llm.store import Scratch, unused


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return crf.clean(docs, toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    verdicts = minhash.near_duplicates(docs, percent=80)
    copies = verdicts.filter(~F.col("kept")).select("doc_id").distinct()
    kept = docs.join(copies, "doc_id", "left_anti").select(docs.columns)
    repeated = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    rank = unused(docs, "row_rank")
    best = Window.partitionBy("doc_id").orderBy(F.desc(F.length("text")), *docs.columns)
    single = kept.join(repeated, "doc_id", "left_semi").withColumn(rank, F.row_number().over(best)).filter(F.col(rank) == 1)
    return kept.join(repeated, "doc_id", "left_anti").select(docs.columns).union(single.select(docs.columns))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    return chaining.without_passages(docs, scratch.keep(chaining.passages(docs, scratch=scratch)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = containment.search(docs, items).select("doc_id").distinct()
    kept = docs.filter("doc_id is not null").join(found, "doc_id", "left_anti").select(docs.columns)
    nameless = docs.filter("doc_id is null")
    if nameless.isEmpty():
        return kept
    row = unused(docs, "row_id")  # rows without an id are searched by a number of their own
    numbered = Scratch(spark).keep(nameless.withColumn(row, F.monotonically_increasing_id()))
    held = containment.search(numbered, items, key=row).select(row).distinct()
    return kept.union(numbered.join(held, row, "left_anti").select(docs.columns))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, *vocabulary())


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("byte_bpe", byte_bpe)]

#: Classification, chaining and BPE have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
