"""Every query on odd rows and on empty tables; SQL oracles on the smallest tables."""

import pytest

from gridtide.llm import registry
from tests.llm.conftest import ROWS
from tools import compare

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()
LABELS = [(1, 1, 0), (7, 1, 1), (None, 1, 1), (8, 0, 0), (5, None, None), (99, 1, 1)]
ITEMS = [(1, "the quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (None, "nothing at all"), (4, "...")]

ONE_ROW_EACH = ("op1_tree_bpe", "op2_importance_resampling", "op5_toxic_spans", "op6_licence_automaton", "op7_language_filters", "op8_katz_backoff", "op9_closed_syncmers", "op10_token_groups", "op11_recursive_splitting", "op12_multi_index")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows(spark, odd, place, name):
    got = QUERIES[name](spark, place(odd, LABELS, ITEMS)).collect()
    if name in ONE_ROW_EACH:
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, none, place, name):
    df = QUERIES[name](spark, place(none))
    assert len(set(df.columns)) == len(df.columns)
    assert df.collect() == []


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    df = QUERIES[name](spark, SF)
    cur = compare.connect(SF).execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert compare.compare([tuple(r) for r in df.collect()], df.columns, cur.fetchall(), cols).startswith("ok")
