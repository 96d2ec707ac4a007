"""The queries opN_*: each operator on its whole table with production parameters; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flintglass.llm import bm25, bpe, brown, bytecnn, chaining, containment, crf, divergence, minhash, sharding, simhash, tokencounts, whitening
from flintglass.llm.labelled import crc_mod, sample
from flintglass.sources.tables import spread

SHARDS = [f"shard-{i:03d}" for i in range(64)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents")).drop("n_links")


def op2_maglev_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_table(spark, sf_dir, "documents").select("doc_id"), SHARDS)


def _judged(scored: DataFrame, modulus: int, rest: int) -> DataFrame:
    held_out = F.coalesce(crc_mod("doc_id", modulus) == rest, F.lit(False))
    return scored.withColumn("held_out", held_out).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> crf.Model:
    return crf.fit(sample(docs, labels, "toxic", crc_mod("doc_id", 4) != 2, crf.ROWS, crf.CHARS))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _judged(crf.score(docs, toxicity_model(docs, _table(spark, sf_dir, "labels")), spans=True), 4, 2)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = bytecnn.fit(sample(docs, _table(spark, sf_dir, "labels"), "quality", crc_mod("doc_id", 5) != 0, bytecnn.ROWS, bytecnn.CHARS))
    return _judged(bytecnn.score(docs, model), 5, 0)


def op4_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(_table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) != 2)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.passages(_table(spark, sf_dir, "documents"))


def op7_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return bm25.search(docs, docs.filter("doc_id % 100 = 0"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.token_counts(_table(spark, sf_dir, "documents"), *vocabulary())


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), *vocabulary())


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup, op2_maglev_sharding, op3_toxicity, op4_brown_lm, op5_substring_dedup, op6_quality, op7_bm25_top_k, op8_token_counts, op9_benchmark_decontamination, op10_byte_bpe,
        op11_source_divergence, op12_whitening, op13_simhash_near_dedup,
    )
}

#: The documents' words in DuckDB: A-Z lower-cased, runs of bytes other than white space.
_WORDS = r"""
doc_words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
)"""

_SHINGLES = r"""
shingles AS (
    SELECT DISTINCT doc_id, list_aggregate(w[i : i + least(5, len(w)) - 1], 'string_agg', ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM doc_words WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id)"""

ORACLE: dict[str, str] = {
    "op1_minhash_near_dedup": rf"""
WITH RECURSIVE {_WORDS}, {_SHINGLES},
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM shingles a JOIN shingles b USING (s) JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
    WHERE a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, x.n, y.n
    HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
),
reach AS (
    SELECT doc_id AS a, doc_id AS b FROM doc_words
    UNION
    SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
),
least_of AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least_of LEFT JOIN sizes USING (doc_id)
""",
    "op7_bm25_top_k": rf"""
WITH {_WORDS},
tf AS (SELECT doc_id, word, count(*) AS f FROM (SELECT doc_id, unnest(w) AS word FROM doc_words) GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM doc_words),
df AS (SELECT word, count(*) AS d FROM tf GROUP BY word),
impacts AS (
    SELECT tf.doc_id, word, floor(ln(1 + (n - d + 0.5) / (d + 0.5)) * (f * 2.2::DOUBLE) / (f + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * len(w) / mean)) * 1000000 + 0.5) AS impact
    FROM tf JOIN df USING (word) JOIN doc_words USING (doc_id), stats
),
scored AS (
    SELECT q.doc_id AS query_id, i.doc_id, sum(impact) AS score
    FROM tf q JOIN impacts i USING (word)
    WHERE q.doc_id % 100 = 0
    GROUP BY ALL
)
SELECT query_id, rank, doc_id, score / 1000000 AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
""",
    "op9_benchmark_decontamination": rf"""
WITH {_WORDS},
item_words AS (
    SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM benchmark
),
item_shingles AS (
    SELECT DISTINCT item_id, least(5, len(w)) AS width, list_aggregate(w[i : i + least(5, len(w)) - 1], 'string_agg', ' ') AS s
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)
),
item_sizes AS (SELECT item_id, width, count(*) AS n_shingles FROM item_shingles GROUP BY ALL),
doc_shingles AS (
    SELECT doc_id, width, list_aggregate(w[i : i + width - 1], 'string_agg', ' ') AS s, min(i) - 1 AS pos
    FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM doc_words, (SELECT DISTINCT width FROM item_sizes) WHERE len(w) >= width)
    GROUP BY ALL
)
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared, min(pos) AS first_word, max(pos) + width - 1 AS last_word
FROM doc_shingles JOIN item_shingles USING (width, s) JOIN item_sizes USING (item_id, width)
GROUP BY doc_id, item_id, n_shingles, width
HAVING count(*) >= 0.8 * n_shingles
""",
    "op11_source_divergence": r"""
WITH docs AS (
    SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents
),
words AS (SELECT lang, source, d, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT d) >= 3),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
totals AS (SELECT lang, source, sum(n) AS n FROM counts GROUP BY ALL),
p AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(t.n, 0)::HUGEINT + v) AS p
    FROM groups g JOIN kept k USING (lang) JOIN sizes USING (lang) LEFT JOIN totals t USING (lang, source) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
of_lang AS (
    SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (any_value(total)::HUGEINT + any_value(v)) AS q
    FROM counts JOIN (SELECT lang, sum(n) AS total FROM totals GROUP BY lang) USING (lang) JOIN sizes USING (lang) GROUP BY lang, term
),
pairs AS (
    SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(f, 0) AS value
    FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
    LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
        ON x.lang = g.lang AND x.source = g.source AND x.item = h.source
),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM p JOIN of_lang USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
""",
}
