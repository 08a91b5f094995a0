"""The corpus pipeline on the smallest tables, each stage on what its predecessor kept."""

import pytest

import corpus_pipeline
from gridtide.llm import op1_tree_bpe
from tests.llm.test_corpus import brute_components

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        before, after = ({r.doc_id: r for r in x.collect()} for x in (docs, out))
        seen[name] = before, after
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names and set(after) <= set(before)
        docs = out
    before, after = seen["toxicity"]
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    assert len(toxic & set(after)) <= 0.2 * len(toxic) and len(after) >= 0.8 * len(before)
    before, after = seen["line dedup"]
    assert all(r.n_chars == len(r.text) for r in after.values()) and len(after) >= 0.95 * len(before)
    before, after = seen["n-gram Jaccard join"]
    assert set(after) == {root for _, _, root in brute_components([(i, r.text) for i, r in before.items()])} | {i for i, r in before.items() if not r.text.split()}
    before, after = seen["benchmark decontamination"]
    assert set(before) - set(after) == {i for i, r in before.items() if any(x in r.text for x in items)}
    before, after = seen["BPE encoding"]
    c = op1_tree_bpe.codec(None)
    assert set(before) == set(after) and all(r.ids == c.encode(before[i].text) for i, r in after.items())


LABELS = [(1, 1, 0), (7, 1, 1), (None, 1, 1), (8, 0, 0), (5, None, None), (99, 1, 1)]
ITEMS = [(1, "the quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (None, "nothing at all"), (4, "...")]


@pytest.mark.parametrize("place_in_order", range(len(corpus_pipeline.STAGES)))
def test_stage_on_odd_and_no_rows(spark, odd, none, place, place_in_order):
    """Nulls, repeated ids and rows, very long texts and columns with the names that operators use themselves."""
    name, stage = corpus_pipeline.STAGES[place_in_order]
    out = stage(spark, odd, place(odd, LABELS, ITEMS))
    kept = out.collect()
    assert len(kept) <= odd.count() and stage(spark, none, place(none)).count() == 0
    if place_in_order < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == odd.columns
        assert {(r.doc_id, r.source, r.row, r.kind) for r in kept} <= {(r.doc_id, r.source, r.row, r.kind) for r in odd.collect()}
    if name in ("n-gram Jaccard join", "BPE encoding"):
        assert any(r.doc_id == 6 for r in kept) and sum(r.doc_id is None for r in kept) == 2


def test_run_on_odd_rows(spark, odd, none, place):
    got = corpus_pipeline.run(spark, place(odd, LABELS, ITEMS)).collect()
    assert 0 < len(got) <= odd.count()
    assert corpus_pipeline.run(spark, place(none)).collect() == []
