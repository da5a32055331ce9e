"""The queries with SQL against it, and the pipeline as a whole."""

import pytest

from cadenza.llm import queries as Q

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = Q.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(map(repr, r)) for r in df.select(*columns).collect())
    found = duck.execute(Q.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert got == sorted(tuple(repr(r[names.index(c)]) for c in columns) for r in found.fetchall())


def test_pipeline(spark):
    corpus = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        assert out.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
        assert out.count() <= docs.count()
    assert corpus.run(spark, DATA).where("lossless").count() > 100
