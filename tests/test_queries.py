import duckdb
import pytest

import __spark_entry__
from verispan.plans.oracle import ORACLE
from verispan.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    r = duck.execute(ORACLE[name])
    cols = [c[0] for c in r.description]
    assert sorted(cols) == sorted(got.columns)
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    want = sorted(tuple(repr(x[i]) for i in at) for x in r.fetchall())
    assert sorted(tuple(repr(x[c]) for c in sorted(cols)) for x in got.collect()) == want


def test_entry_point_names_what_it_has_sql_for():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
