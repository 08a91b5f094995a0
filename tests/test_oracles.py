"""Every registered query against its SQL oracle on the smallest tables."""

import pytest

from gridtide.workload import oracle_sql, queries
from tools import compare

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert rows and len(df.columns) == len(set(df.columns))
        return
    cur = con.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert compare.compare(rows, df.columns, cur.fetchall(), cols).startswith("ok")


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
