import numpy as np
import pytest
from pyspark.sql import functions as F

from cratewise.operators import knn, vectors


def _brute(ids, m, k):
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    u = m / np.where(norm > 0, norm, 1)
    sims = u @ u.T
    out = {}
    for i, a in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-round(sims[i, j], 9), ids[j]))
        out[a] = [ids[j] for j in order[:k]]
    return out


@pytest.fixture(scope="module")
def copies(spark):
    """A third of the rows share one vector, one row is all zero."""
    rng = np.random.default_rng(5)
    m = rng.normal(size=(180, 6))
    m[:60] = m[0]
    m[179] = 0
    ids = [f"t{i:03d}" for i in range(180)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, m)], "hash string, e array<double>")
    return ids, m, df.cache()


@pytest.mark.parametrize("options", [{}, {"cells": 9, "probes": 2, "block_rows": 8}])
def test_exact_knn_with_copies(copies, options):
    ids, m, df = copies
    got = {}
    for r in knn.knn_join(df, "hash", "e", 4, **options).orderBy("hash", "rank").collect():
        got.setdefault(r["hash"], []).append(r["neighbour"])
    want = _brute(ids, m, 4)
    assert {k: v for k, v in got.items() if k != "t179"} == {k: v for k, v in want.items() if k != "t179"}
    assert len(got["t179"]) == 4


def test_ivf_with_every_cell_is_exact(copies):
    ids, m, df = copies
    got = knn.knn_join(df, "hash", "e", 3, mode="ivf", cells=6, probes=6, block_rows=16).where("rank = 1")
    want = _brute(ids, m, 3)
    assert all(r["neighbour"] == want[r["hash"]][0] for r in got.collect() if r["hash"] != "t179")


def test_ivf_recall_grows_with_probes(copies):
    ids, m, df = copies
    want = _brute(ids, m, 3)

    def recall(probes):
        rows = knn.knn_join(df, "hash", "e", 3, mode="ivf", cells=12, probes=probes, block_rows=16).collect()
        return sum(r["neighbour"] in want[r["hash"]] for r in rows) / (3 * len(ids))

    assert recall(1) <= recall(6) <= 1.0 and recall(6) > 0.8


def test_graph_keeps_positive_edges_once(spark, copies):
    edges = knn.similarity_graph(knn.knn_join(copies[2], "hash", "e", 2), "hash").collect()
    assert len({(e["a"], e["b"]) for e in edges}) == len(edges)
    assert all(e["a"] < e["b"] and e["sim"] > 0 for e in edges)


def _bass(conf):
    rows = [("q", [1.0, 0.0, 0.05], "K-Pop", "Pop", conf)]
    rows += [(f"n{i}", [1.0, 0.01 * i, 0.0], "Brostep" if i < 2 else "Dubstep", "Dubstep", 0.9) for i in range(4)]
    return rows


@pytest.mark.parametrize("conf, flagged", [(0.29, True), (0.80, False)])
def test_misread_needs_a_shaky_read(spark, conf, flagged):
    df = spark.createDataFrame(_bass(conf), "hash string, e array<double>, style string, family string, confidence double")
    rows = knn.misread_audit(df, "hash", "e").collect()
    assert [r["hash"] for r in rows] == (["q"] if flagged else [])
    if flagged:
        assert (rows[0]["suggested_family"], rows[0]["agreement"]) == ("Dubstep", 1.0)


def test_audit_needs_four_rows(spark):
    df = spark.createDataFrame(_bass(0.2)[:3], "hash string, e array<double>, style string, family string, confidence double")
    assert knn.misread_audit(df, "hash", "e").count() == 0


def test_check_one_needs_three_others(spark):
    df = spark.createDataFrame(_bass(0.2)[1:], "hash string, e array<double>, style string, family string, confidence double")
    row = knn.check_one([1.0, 0.0, 0.0], "K-Pop", "Pop", 0.2, df, "hash", "e").first()
    assert row["flag"] and row["suggested_family"] == "Dubstep"
    assert knn.check_one([1.0, 0.0, 0.0], "K-Pop", "Pop", 0.2, df.limit(2), "hash", "e").count() == 0


def test_centroids_and_matching(spark):
    rows = [("v", [1.0, 0.0], 1.0), ("v", [0.0, 1.0], -0.5), ("v", [1.0, 1.0], None), ("z", [1.0, 0.0], 0.0)]
    df = spark.createDataFrame(rows, "vibe string, e array<double>, w double")
    out = {r["vibe"]: r["centroid"] for r in vectors.weighted_centroids(df, ["vibe"], "e", "w").collect()}
    assert list(out) == ["v"] and out["v"] == pytest.approx([2 / 2.5, 0.5 / 2.5])
    tracks = spark.createDataFrame([("a", [2.0, 0.5]), ("b", [0.0, 0.0])], "hash string, e array<double>")
    cents = vectors.weighted_centroids(df, ["vibe"], "e", "w")
    small = vectors.match_centroids(tracks, "hash", "e", cents, "vibe").collect()
    assert {(r["hash"], r["sim"]) for r in small} == {("a", 1.0), ("b", 0.0)}


def test_matching_beyond_the_broadcast_bound(spark, copies, monkeypatch):
    df = copies[2]
    cents = df.limit(20).select(F.col("hash").alias("vibe"), F.col("e").alias("centroid")).cache()
    want = sorted(map(tuple, vectors.match_centroids(df, "hash", "e", cents, "vibe").collect()))
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", 1)
    assert sorted(map(tuple, vectors.match_centroids(df, "hash", "e", cents, "vibe").collect())) == want


def test_pca_is_standardised(spark, copies):
    e = np.array([r["e"] for r in vectors.pca_coords(copies[2], "hash", "e").collect()])
    assert e.mean(axis=0) == pytest.approx(np.zeros(6), abs=1e-3)
    assert e.std(axis=0) == pytest.approx(np.ones(6), abs=1e-3)
    assert np.abs(np.corrcoef(e.T) - np.eye(6)).max() < 1e-3
