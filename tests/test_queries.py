"""Every inspection query against its SQL."""

import io
import os
import sys
import zipfile
import zlib

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))

from flintglass import queries  # noqa: E402
from tests.compare import duck_rows, spark_rows  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, SF)) == duck_rows(queries.ORACLE[name], SF)


def test_walks_in_sql(spark):
    """The table functions, for bytes whose rows are known, null and broken ones."""
    from flintglass.functions.udtfs import FUNCTIONS, register
    from tests.test_scan import CALL, gguf, safetensors

    register(spark)
    zipped = io.BytesIO()
    with zipfile.ZipFile(zipped, "w") as z:
        z.writestr("a/data.pkl", CALL)
    wrong = safetensors({"t": {"data_offsets": [3, 1]}, "__metadata__": {"k": "v"}})
    rows = [("call", CALL), ("zip", zipped.getvalue()), ("gguf", gguf("key", "value")), ("tensors", wrong), ("broken", b"\x80\x04\x95"), ("empty", b""), ("null", None)]
    spark.createDataFrame([(n, None if d is None else bytearray(d)) for n, d in rows], "name string, content binary").createOrReplaceTempView("walked_bytes")
    got = {f: {} for f in FUNCTIONS}
    for f in FUNCTIONS:
        for r in spark.sql(f"SELECT w.name AS of, r.* FROM walked_bytes w, LATERAL {f}(w.content) r").collect():
            got[f].setdefault(r.of, []).append(tuple(r)[1:])
    assert got["pickle_imports"]["call"] == [("os", "system", 25)] and "zip" not in {n for n, r in got["pickle_imports"].items() if r == [("os", "system", 25)]}
    assert ("STACK_GLOBAL", None) in {x[1:] for x in got["pickle_opcodes"]["call"]}
    assert got["archive_members"]["zip"] == [("a/data.pkl", zlib.crc32(CALL), len(CALL), 40)]
    assert got["tensor_errors"] == {"tensors": [("t", "start offset 3 exceeds data size 0"), ("t", "end offset 1 exceeds data size 0"), ("t", "start offset 3 after end offset 1")]}
    assert ("gguf", "key", "value") in got["tensor_pairs"]["gguf"] and ("safetensors", "k", "v") in got["tensor_pairs"]["tensors"]
    assert got["pickle_stream"]["empty"][0][0] == "Empty file" and all("null" not in of for of in got.values())


def test_every_rule_hits_and_misses(spark):
    from pyspark.sql import functions as F

    from flintglass.operators import textrules as T

    a = queries.artifacts(spark, SF)
    n = a.count()
    body = F.col("body")
    for found, rules in ((T.header(body), 10), (T.svg(body), 8), (T.image_metadata(body), 14), (T.keras_config(body), 10)):
        hits = {r.rule: r.n for r in a.select("doc_id", F.explode(found).alias("f")).groupBy("f.rule").agg(F.countDistinct("doc_id").alias("n")).collect()}
        assert len(hits) == rules and all(0 < k < n for k in hits.values()), hits


def test_compressed_regions_of_long_texts(spark, tmp_path):
    """Streams of over 64 KiB count; a gzip header only where a stream follows it."""
    import gzip
    import random

    import pyarrow as pa
    import pyarrow.parquet as pq

    from flintglass.operators import containers

    packed = gzip.compress(b"a" * 100)
    assert containers.compressed_regions(b"_" + packed) == [("gzip", 1, 100)] and containers.compressed_regions(b"_" + packed[:5]) == [("gzip", 1, None)]
    text = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ", k=300_000))
    pq.write_table(pa.table({"doc_id": [0, 1, 2, 3, 4], "text": [text, text[:-1], text[:-2], text[:30], None]}), tmp_path / "documents.parquet")
    sql = queries.ORACLE["compressed_regions"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet'")
    import duckdb

    want = sorted(duckdb.connect().execute(sql).fetchall())
    assert sorted(tuple(r) for r in queries.compressed_regions(spark, str(tmp_path)).collect()) == want and len(want) == 2


def test_rows_are_judged_once(spark):
    """No plan computes an array once more in a filter before its generator, parses a body twice or sends rows through a row-wise table function."""
    plan = lambda name: queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for name in ("workflow_nodes", "workflow_widgets", "pickle_functions", "pickle_opcode_rules"):
        found = plan(name)
        assert not any(line.lstrip(" +-:*()0123456789").startswith("Filter") and ("transform(" in line or "get_json_object" in line) for line in found.splitlines()), name
        assert found.count("from_json(") <= 1 + (name == "workflow_widgets"), name
    assert plan("workflow_nodes").count("$.type") == 1
    for name in ("tensor_offset_checks", "pickle_functions"):
        assert "MapInArrow" in plan(name) and "UDTF" not in plan(name)
