"""Core queries run on the smallest tables and agree with their SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as e
from quillspark.plans import catalogue

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    return sorted(str([round(float(x), 6) if isinstance(x, float) else None if x is None else str(x) for x in r]) for r in df.values.tolist())


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = e.queries()[name](spark, D).toPandas(), con.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert e.entry(spark).columns == ["doc_id", "score", "text"]


def test_stream_ingest(spark, tmp_path):
    from quillspark.streaming.ingest import ingest

    spark.createDataFrame([(1, "cat dog cat"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.segment_id, r.term, r.doc_id, r.tf) for r in got) == [(0, "cat", 1, 2), (0, "dog", 1, 1)]


def test_stream_into_an_index(spark, tmp_path):
    from quillspark.operators.handle import Index, Settings
    from quillspark.streaming.ingest import ingest_index

    path, source, cp = (str(tmp_path / x) for x in ("index", "in", "cp"))
    for k, rows in enumerate(([(1, "fern moss fern"), (2, None)], [(3, "fern"), (4, "reed")])):
        spark.createDataFrame(rows, "doc_id long, text string").write.mode("append").parquet(source)
        stream = spark.readStream.schema("doc_id long, text string").parquet(source)
        ingest_index(stream, path, cp, Settings(flush=10)).awaitTermination()
        assert Index.open(spark, path).batch == k
    opened = Index.open(spark, path)
    assert opened.size() == 4 and opened.num_segments() == 2 and sorted(r.doc_id for r in opened.keyword("fern").collect()) == [1, 3]
    assert opened.add_batch(spark.createDataFrame([(9, "fern")], "doc_id long, text string"), 1).size() == 4
