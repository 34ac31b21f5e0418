"""Each stage against SQL on its own input, the last against direct encoding."""

import duckdb
import pytest

import corpus_pipeline as P
from gapmend.llm.common import staged
from gapmend.llm.queries import ORACLE
from test_token_store import expected


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, stage in P.STAGES:
        out.append(staged(stage(spark, out[-1], sf), "test"))
    return out


def sql(text, docs, sf):
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{sf}/benchmark.parquet'")
    return con.sql(text)


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_columns(steps):
    assert all(x.columns == steps[0].columns for x in steps[1:5])


def test_quality_rules(steps, sf):
    want = sql(f"SELECT doc_id FROM ({ORACLE['op5_host_rules']}) WHERE kept", steps[0], sf).fetchall()
    assert ids(steps[1]) == sorted(x[0] for x in want) and 0 < len(want) < steps[0].count()


def test_near_duplicates(steps, sf):
    want = sql(ORACLE["op6_jaccard_join"], steps[1], sf).df()
    assert ids(steps[2]) == sorted(want.component_id.unique()) and len(ids(steps[2])) < len(want)


def test_decontamination(steps, sf):
    bad = {x[0] for x in sql(ORACLE["op4_simhash_leaks"], steps[2], sf).fetchall()}
    assert ids(steps[3]) == [i for i in ids(steps[2]) if i not in bad] and bad


def test_mix(steps, sf):
    want = sql(ORACLE["op8_poisson_mix"], steps[3], sf).df()
    assert ids(steps[4]) == sorted(want.doc_id)


def test_tokens(steps):
    rows = [tuple(r) for r in steps[4].select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in steps[5].collect()) == sorted(expected(rows))


def test_registered(spark, sf, steps):
    import __spark_entry__
    assert __spark_entry__.queries()["pipeline"](spark, sf).count() == steps[5].count()
