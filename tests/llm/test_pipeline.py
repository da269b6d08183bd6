"""The pipeline's stages one after the other against brute force, and its queries at the smallest size."""

import corpus_pipeline
import pytest

from quarry.llm import queries

from .test_operators import leak_brute, lowered, near_brute, token_ids

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        rows = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        if name == "packing":
            assert sum(r.length for r in docs.collect()) == sum(len(token_ids(t)) + 1 for t in rows.values())
            break
        assert docs.columns == columns
        left = {r.doc_id for r in docs.collect()}
        if name == "toxicity":
            labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            assert not [i for i in rows.keys() - left if labels.get(i) == 0] and rows.keys() - left
        if name == "exact_dedup":
            best = {}
            for i, t in rows.items():
                best[lowered(t)] = max(best.get(lowered(t), i), i)
            assert left == set(best.values())
        if name == "near_dedup":
            assert left == {i for i, w in near_brute(list(rows.items())).items() if w[2]}
        if name == "decontamination":
            assert left == rows.keys() - {d for d, _ in leak_brute(list(rows.items()), bench)}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs(spark, name):
    df = queries.queries()[name](spark, SF)
    assert df.count() > 0
