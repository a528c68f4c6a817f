import os
from collections import defaultdict

import duckdb
import pytest

import corpus_pipeline
from tessera.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DATA)
    want = con.execute(queries.ORACLE_SQL[name])
    names, columns = [d[0] for d in want.description], sorted(got.columns)
    assert sorted(names) == columns
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted((tuple(r[names.index(c)] for c in columns) for r in want.fetchall()), key=repr)


def test_pipeline_stages(spark):
    docs = queries.table(spark, DATA, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    seen = set(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        kept = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(kept) == len(set(kept)) and set(kept) <= seen, name
        if name == "exact dedup":
            groups = defaultdict(list)
            for d in seen:
                groups[rows[d].text].append(d)
            assert set(kept) == {max(g) for g in groups.values()}
        seen = set(kept)
        docs = docs.filter(docs.doc_id.isin(kept))
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r.doc_id for r in last} == seen and all(r.n_tokens == len(r.ids) for r in last)


def test_pipeline_on_odd_rows(spark, tmp_path):
    prose = " ".join(f"word{k} of" for k in range(60))
    rows = [(1, prose, "a"), (1, prose, "b"), (None, prose, "c"), (2, prose + " end", "d"), (None, None, "e"), (3, "", None), (4, "alone", "f"), (None, "apart", "g"), (None, "apart", "h"), (4, "quite another text", "i")]
    for name, schema, data in (("documents", "doc_id bigint, text string, row string", rows), ("labels", "doc_id bigint, toxic int", []), ("benchmark", "item_id bigint, text string", [])):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = queries.table(spark, str(tmp_path), "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "row"]
    left = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(left, key=repr) == sorted([(1, prose), (3, ""), (4, "alone"), (4, "quite another text"), (None, "apart")], key=repr)
    none = queries.table(spark, str(tmp_path), "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, str(tmp_path))
    assert none.count() == 0
