"""Templates trained to convergence, and the recall of the approximate join."""

import numpy as np
from pyspark.sql import functions as F

from cratewise.operators import keys as K, knn
from cratewise.operators.descent import minimise


def converged(x, y, l2=1e-2, lr=1.0):
    """The rule of train_templates over one array, with many more steps."""
    r = K.rotations(K.standardise(x))
    w, b = np.zeros((2, 1, 12)), np.zeros((2, 1))
    for _ in range(4000):
        flat = K._logits(r, w, b)[0].transpose(0, 2, 1).reshape(len(x), 24)
        p = np.exp(flat - flat.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(x)), y] -= 1.0
        g = p.reshape(len(x), 2, 12).transpose(0, 2, 1)
        w = w - lr * (np.einsum("ntm,ntd->md", g, r)[:, None, :] / len(x) + l2 * w)
        b = b - lr * g.sum(axis=(0, 1))[:, None] / len(x)
    return r, w, b


def test_templates_predict_as_converged_ones(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 24, 240)
    faint = np.stack([0.25 * np.roll(K.PROFILES["kk"][("major", "minor")[k // 12]], k % 12) for k in y])
    x = faint + rng.normal(0, 1, (240, 12))
    df = spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, y, strict=True)], "v array<double>, y int")
    w, b = K.train_templates(df.coalesce(2), "v", "y")
    r, best_w, best_b = converged(x, y)
    picks = [K._logits(r, *t)[0].reshape(240, 24).argmax(axis=1) for t in ((w, b), (best_w, best_b))]
    assert (picks[0] == picks[1]).mean() >= 0.99
    assert np.abs(w - best_w).max() < 5e-3


def test_ivf_finds_nine_of_ten_without_clusters(spark):
    x = np.random.default_rng(5).normal(0, 1, (400, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "hash int, e array<double>")
    exact, near = (knn.knn_join(df, "hash", "e", 4, mode=m, cells=16) for m in ("exact", "ivf"))
    assert knn.recall(exact, near, "hash").first()["recall"] >= 0.9


def test_folds_fitted_together_predict_as_fitted_alone(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 24, 150)
    x = np.stack([0.4 * np.roll(K.PROFILES["kk"][("major", "minor")[k // 12]], k % 12) for k in y]) + rng.normal(0, 1, (150, 12))
    names = [K.music.KEY_NAMES[k % 12] for k in y]
    rows = [(i, v.tolist(), n, ("major", "minor")[k // 12], i % 3) for i, (v, n, k) in enumerate(zip(x, names, y, strict=True))]
    df = spark.createDataFrame(rows, "hash int, v array<double>, key string, scale string, fold int").coalesce(2)
    together = {r["hash"]: (r["pred_key"], r["pred_scale"]) for r in K.cross_validate_templates(df, "v", "fold", 3).collect()}
    alone = {}
    for f in range(3):
        w, b = K.train_templates(df.where(F.col("fold") != f).withColumn("y", K.key_number()), "v", "y")
        held = df.where(F.col("fold") == f).select("hash", K.score_keys("v", w.tolist(), b.tolist()).alias("k")).collect()
        alone |= {r["hash"]: (r["k"]["key"], r["k"]["scale"]) for r in held}
    assert together == alone


def test_descent_rests_at_the_minimum():
    centres = np.array([[1.0, -2.0, 3.0], [0.0, 5.0, 1.0]])
    scale = np.array([1.0, 100.0, 0.01])
    calls = []

    def evaluate(points):
        calls.append(1)
        gap = points - centres
        return (scale * gap**2).sum(axis=1) + (gap**4).sum(axis=1), 2 * scale * gap + 4 * gap**3

    found = minimise(evaluate, np.zeros((2, 3)), tol=1e-9)
    assert np.abs(found - centres).max() < 1e-3 and len(calls) < 100
