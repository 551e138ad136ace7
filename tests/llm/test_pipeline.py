import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from titleforge.llm import queries as Q

SF = "/root/testdata/sf0.001"
needs = pytest.mark.skipif(not os.path.exists(SF), reason="needs the driver's tables")


@needs
@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = Q.queries()[name](spark, SF).toPandas(), con.sql(Q.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    rows = lambda p: sorted(map(repr, p[cols].astype(object).where(p[cols].notna(), None).values.tolist()))
    assert cols == sorted(want.columns) and rows(got) == rows(want)


@needs
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names, name
        out.write.parquet(str(tmp_path / name))
        again = spark.read.parquet(str(tmp_path / name))
        assert 0 < again.count() <= docs.count() and again.join(docs, "doc_id", "left_anti").count() == 0
        assert again.filter(F.length("text") != F.col("n_chars")).count() == 0
        docs = again
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


@needs
def test_stages_take_odd_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("row", F.lit("x")).withColumn("key", F.lit(1))
    odd = docs.limit(3).select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes])
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, docs.limit(0), SF).count() == 0, name
        f(spark, docs.limit(5).union(odd).union(docs.limit(2)), SF).collect()
