import numpy as np
import pytest
from pyspark.sql import functions as F

from cratewise.functions import music
from cratewise.operators import keys as K, learn as M


def _score(spark, vec, fn):
    return spark.createDataFrame([([float(x) for x in vec],)], "v array<double>").select(fn.alias("k")).first()["k"]


@pytest.mark.parametrize("tonic", [0, 3, 7, 11])
@pytest.mark.parametrize("mode", ["major", "minor"])
def test_transposition_moves_the_key(spark, tonic, mode):
    vec = np.roll(K.PROFILES["kk"][mode], tonic)
    w = K.standardise(np.array([K.PROFILES["kk"]["major"], K.PROFILES["kk"]["minor"]]))[:, None, :].tolist()
    for fn in (K.score_keys("v", w, [[0.0], [0.0]]), K.match_profile("v", K.PROFILES["kk"])):
        k = _score(spark, vec, fn)
        assert (k["key"], k["scale"]) == (music.KEY_NAMES[tonic], mode)


def test_silence_is_c_minor_without_strength(spark):
    k = _score(spark, [0] * 12, K.score_keys("v", np.ones((2, 1, 12)).tolist(), [[0.0], [0.0]]))
    assert (k["key"], k["scale"], k["strength"]) == ("C", "minor", 0.0)


@pytest.mark.parametrize("pred, ref, want", [
    (("C", "major"), ("C", "major"), "exact"), (("G", "major"), ("C", "major"), "fifth"), (("F", "minor"), ("C", "minor"), "fifth"), (("C", "minor"), ("C", "major"), "parallel"),
    (("A", "minor"), ("C", "major"), "relative"), (("Eb", "major"), ("C", "minor"), "relative"), (("Db", "major"), ("C#", "major"), "exact"), (("E", "minor"), ("C", "major"), "other"),
])
def test_error_categories(spark, pred, ref, want):
    c = music.key_category(*[F.lit(x) for x in (*pred, *ref)])
    assert spark.range(1).select(c.alias("c")).first()["c"] == want


def test_template_training_learns_and_pools(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        mode, t = ("major", "minor")[i % 2], int(rng.integers(0, 12))
        v = np.roll(K.PROFILES["temperley"][mode], t) + rng.normal(0, 0.05, 12)
        rows.append((i, [float(x) for x in v], music.KEY_NAMES[t], mode, i % 3, None if i % 5 else 2))
    df = spark.createDataFrame(rows, "id int, v array<double>, key string, scale string, fold int, confidence int")
    out = K.cross_validate_templates(df, "v", "fold", 3, steps=40, min_confidence=1)
    report = K.mirex_report(out).first()
    assert report["n"] == 60 and report["exact"] > 54
    w, b = K.train_templates(df.withColumn("y", K.key_number()), "v", "y", steps=3, subclasses=2)
    assert w.shape == (2, 2, 12) and b.shape == (2, 2)


def test_leave_one_out_equals_refit(spark):
    rng = np.random.default_rng(4)
    for n in (5, 6):
        rows = [(i, [float(x) for x in rng.integers(0, 3, 12)], "C", "major") for i in range(n)]
        df = spark.createDataFrame(rows, "id int, v array<double>, key string, scale string")
        got = {(r["id"], r["pos"]): r["median"] for r in K.leave_one_out_profiles(df, "id", "v").collect()}
        for i in range(n):
            want = np.median([r[1] for r in rows if r[0] != i], axis=0)
            assert [got[(i, p)] for p in range(12)] == want.tolist()


def _head():
    return M.Head([0, 0], [1, 1], [[1, 0], [0, 1]], [0, 0], [[2, 0], [0, 2]], [0, 0], ["A", "B"])


def test_relabel_preview_and_revert(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0], None), ("b", [0.0, 1.0], None), ("c", [0.0, 1.0], "X")], "hash string, e array<double>, override string")
    events = M.relabel(df, "hash", "e", _head(), "h1", 1.0)
    assert {r["hash"] for r in events.collect()} == {"a", "b"}
    now = spark.createDataFrame([("a", "A"), ("b", "A"), ("c", "X")], "hash string, style string")
    totals, examples = M.relabel_preview(now, events, "hash")
    assert tuple(totals.first()) == (3, 1, 2) and examples.first()["to"] == "B"
    both = events.select("hash", "head", "at").unionByName(M.revert_relabels(events, "hash", 2.0))
    assert M.standing_relabels(both, "hash").count() == 0


def test_split_keeps_one_and_folds_cover(spark):
    df = spark.createDataFrame([(i, "big" if i < 23 else "two" if i < 25 else "one") for i in range(26)], "id int, label string")
    held = {r["label"]: r["count"] for r in M.stratified_split(df, "id", "label").where("validation").groupBy("label").count().collect()}
    assert held == {"big": 5, "two": 1}
    folds = M.assign_folds(df, "id", "label", 5).groupBy("label", "fold").count().collect()
    assert max(r["count"] for r in folds if r["label"] == "big") - min(r["count"] for r in folds if r["label"] == "big") <= 1


def test_heads_learn_separable_classes(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(3 * (i % 3 == 0), 0.3, 2)] + [float(3 * (i % 3 == 1))], f"c{i % 3}") for i in range(90)]
    df = spark.createDataFrame(rows, "id int, e array<double>, label string")
    scores = M.class_report(M.cross_validate(df, "id", "e", "label", folds=3, max_iter=30))
    assert M.overall_report(scores).first()["accuracy"] > 0.95
    _, names, held = M.train_head(df, "id", "e", "label", hidden=6, max_iter=60)
    assert names == ["c0", "c1", "c2"] and M.overall_report(M.class_report(held)).first()["accuracy"] > 0.8


def test_report_has_no_zero_division(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "b")], "label string, prediction string")
    got = {r["class"]: r for r in M.class_report(df).collect()}
    assert (got["a"]["precision"], got["a"]["recall"], got["a"]["f1"]) == (0, 0, 0) and got["b"]["recall"] == 1
    assert [tuple(r) for r in M.confusion(df, ["a", "b"]).orderBy("label").collect()] == [("a", 0, 2), ("b", 0, 1)]
