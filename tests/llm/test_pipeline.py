import os

import pytest

import corpus_pipeline as P
from shellgraph.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before, seen = docs.columns, docs, {}
    for name, stage in P.STAGES:
        after = stage(spark, before, DATA)
        rows = after.collect()
        if name != "shard":
            assert after.columns == columns
            assert {r.doc_id for r in rows} <= {r.doc_id for r in before.collect()}
            after = spark.createDataFrame(rows, docs.schema)
        seen[name], before = rows, after
    assert len(seen["language"]) >= 0.97 * docs.count()
    assert len({r.text for r in seen["dedup"]}) == len(seen["dedup"]) < len(seen["language"])
    assert len(seen["shard"]) == len(seen["mix"]) and {r.shard for r in seen["shard"]} <= set(range(16))
    assert P.run(spark, DATA).count() == len(seen["shard"])


@pytest.mark.parametrize("stage", [s for _, s in P.STAGES], ids=[n for n, _ in P.STAGES])
def test_stage_on_odd_rows(spark, odd, none, stage):
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    assert stage(spark, plain.where("false"), DATA).collect() == []
    stage(spark, plain, DATA).collect()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    import duckdb

    from tests.test_queries import table

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    got = queries.queries()[name](spark, DATA)
    rel = con.sql(queries.oracle_sql()[name])
    assert table(got.collect(), got.columns) == table(rel.fetchall(), list(rel.columns))
