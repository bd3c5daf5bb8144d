"""The pipeline's stages one after another, and the registration of the queries."""

from __future__ import annotations

import __spark_entry__ as entry
import corpus_pipeline
import duckdb
from pyspark.sql import functions as F
from test_llm_operators import brute_components, brute_spans, check_packing


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(i)))
        before, after = docs.toPandas(), spark.read.parquet(str(tmp_path / str(i)))
        got = after.toPandas()
        if name != "best-fit packing":
            assert after.columns == columns and not got["doc_id"].duplicated().any() and set(got["doc_id"]) <= set(before["doc_id"])
        if name == "quality classifier":
            labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id")["quality"]
            kept = set(got["doc_id"])
            assert sum((d in kept) == bool(q) for d, q in labels.items()) >= 0.9 * len(labels)
        elif name == "n-gram Jaccard join":
            of = brute_components(zip(before["doc_id"], before["text"], strict=True), 5, 4, 5)
            assert set(got["doc_id"]) == set(of.values())
        elif name == "secret scans":
            assert len(got) == len(before) and not any(brute_spans(t) for t in got["text"] if t)
            assert (got["text"].str.len() == got["n_chars"]).mean() > 0.99
        elif name == "best-fit packing":
            check_packing(after.collect(), list(zip(before["doc_id"], before["text"], strict=True)))
        docs = after


def test_run_on_odd_documents(spark, tmp_path):
    """The whole pipeline on nulls, empty texts, repeated ids and rows and extra columns, and on an empty table."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = [F.lit(1).alias(c) for c in ("spans", "blob_", "rate", "row", "gone_id", "piece", "length", "drawn", "n_tokens")]
    some = docs.limit(60)
    odd = some.select("*", *extra).unionByName(some.limit(20).select("*", *extra)).unionByName(some.limit(10).withColumn("doc_id", F.lit(None).cast("long")).select("*", *extra))
    odd = odd.unionByName(some.limit(3).withColumn("text", F.lit(None).cast("string")).select("*", *extra)).unionByName(some.limit(3).withColumn("text", F.lit("")).select("*", *extra))
    for name, table in (("odd", odd), ("none", odd.limit(0))):
        at = tmp_path / name
        table.write.parquet(f"{at}/documents.parquet")
        spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{at}/labels.parquet")
        got = corpus_pipeline.run(spark, str(at)).collect()
        if name == "none":
            assert got == []
            continue
        assert got and {r["doc_id"] for r in got} <= {r["doc_id"] for r in odd.collect()}
        ends = [(r["sequence_id"], r["offset"], r["length"]) for r in got]
        by_seq = {}
        for s, o, n in sorted(ends):
            assert o == by_seq.get(s, 0)
            by_seq[s] = o + n
        assert max(by_seq.values()) <= 1024
        # One row of each id with words is left, whose text is packed whole.
        pieces = sorted((r["doc_id"], r["piece"], r["start"]) for r in got if r["doc_id"] is not None)
        assert len(pieces) == len(set(pieces))


def test_every_query_is_registered(spark):
    names = entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 11)) and "pipeline" in names


def test_topk_oracle(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{sf}/embeddings.parquet')")
    want = sorted(con.execute(entry.oracle_sql()["op6_exact_topk_search"]).fetchall())
    got = sorted(tuple(r) for r in entry.queries()["op6_exact_topk_search"](spark, sf).select("query_id", "rank", "vec_id", "score").collect())
    assert got == want


def test_workers_need_no_installed_package(tmp_path):
    """A session started elsewhere, without the repository on its Python path, runs the operators."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).resolve().parent
    code = f"""
import sys; sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as e
print("rows", e.queries()["op1_media_columns"](s, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "rows 200" in out.stdout, out.stderr[-800:]
