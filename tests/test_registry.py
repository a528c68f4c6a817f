import os

import duckdb
import pytest

from tessera.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def shown(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    want = duck.execute(registry.ORACLE_SQL[name])
    columns = sorted(got.columns)
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    mine = sorted((tuple(shown(r[c]) for c in columns) for r in got.collect()), key=repr)
    theirs = sorted((tuple(shown(r[names.index(c)]) for c in columns) for r in want.fetchall()), key=repr)
    assert mine == theirs
