"""Queries of the operators against their SQL, and the pipeline's stages."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from readloom.llm import queries as Q

SQL = Q.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    df = Q.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(*cols).collect())
    res = con.execute(SQL[name])
    names = [x[0] for x in res.description]
    assert got == sorted(tuple(str(r[names.index(c)]) for c in cols) for r in res.fetchall())


def test_pipeline(spark, sf, edge):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = edge.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert docs.count() > 0
    assert docs.filter(~F.col("text").rlike(r"\p{L}")).count() == 0
    pieces = pipeline.STAGES[-1][1](spark, docs, sf)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(pieces.columns)
    none = spark.createDataFrame([], docs.schema)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0
