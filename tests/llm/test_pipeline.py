"""The corpus pipeline, stage by stage, on the smallest tables."""

from pathlib import Path

import brute
import pytest
from test_texts import brute_hits

import corpus_pipeline as pipeline
from cratewise.plans.guards import cut_lineage

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for _, stage in pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, FOLDER))
        out.append(docs)
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_keep_the_columns_of_documents(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixture", "sharding"]


def test_quality_agrees_with_labels(spark, stages):
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = set(texts(stages[1]))
    known = [i for i in texts(stages[0]) if i in truth]
    assert sum((i in kept) == (truth[i] == 1) for i in known) >= 0.97 * len(known)


def test_one_document_of_each_group_stays(stages):
    before = texts(stages[1])
    want = {h for h, (_, c) in brute.note_classes(list(before.items())).items() if h == c}
    assert set(texts(stages[2])) == want


def test_benchmark_passages_are_gone(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    want = {h for h, t in texts(stages[2]).items() if not brute_hits(t, items)[1]}
    assert set(texts(stages[3])) == want


def test_mixture_draws_each_document_once_at_most(stages):
    before, after = texts(stages[3]), texts(stages[4])
    size = lambda d: sum(len((t or "").split()) for t in d.values())
    assert after.items() <= before.items() and 0.6 * size(before) < size(after) <= 0.91 * size(before)
    assert stages[4].count() == len(after)


def test_every_document_has_a_shard(stages):
    rows = stages[5].collect()
    assert {r["doc_id"] for r in rows} == set(texts(stages[4]))
    for s in {r["shard"] for r in rows}:
        places = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert places == list(range(len(places)))
