import corpus_pipeline as P
import __spark_entry__ as E
from funnelwise.llm.queries import ORACLE, QUERIES
from tests.llm.helpers import docs_frame, edge_rows, spaced

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


def test_registered():
    names = set(E.queries())
    assert {"pipeline", *QUERIES} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "toxicity", "minhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(ORACLE[name])
    columns = [d[0] for d in cur.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted([tuple(r) for r in df.select(*columns).collect()]) == sorted(cur.fetchall())


def test_stages_narrow_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        docs = P.staged(stage(spark, docs, SF), name)
        assert docs.columns == columns
        left = {r.doc_id for r in docs.collect()}
        assert left <= ids and len(left) == docs.count()
        ids = left
    assert 0 < len(ids) < 200
    packed = P.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == ids
    assert {r.doc_id for r in P.run(spark, SF).collect()} == ids


def test_stages_on_edge_rows_and_nothing(spark, tmp_path):
    """Nulls, empty and blank texts, repeated rows, a long text and clashing column names."""
    rows = edge_rows()
    docs = docs_frame(spark, rows, extra=True)
    spark.createDataFrame([(i, int(i % 5 > 0), int(i % 7 == 0)) for i in range(40)] + [(None, 1, 1), (104, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, rows[5][1]), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for given in (docs, docs.limit(0)):
        whole = given.collect()
        for name, stage in P.STAGES[:-1]:
            kept = stage(spark, given, str(tmp_path))
            assert kept.columns == docs.columns, name
            left = kept.collect()
            assert len(left) <= len(whole) and all(r in whole for r in left), name
        packed = P.STAGES[-1][1](spark, given, str(tmp_path)).collect()
        assert sum(r.length for r in packed) == sum(len(spaced(r.text)) + 1 for r in whole)
