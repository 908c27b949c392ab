"""The stored vector index and the approximate join by signed projections."""

import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from cratewise.operators import index as I, knn, lsh

SCHEMA = "hash long, e array<double>"


def clustered(n, dim=16, centres=8, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    return [(i, (middle[i % centres] * 3 + rng.normal(size=dim) * 0.4).tolist()) for i in range(n)]


def plain(stored, asked, k, others=False):
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    ids, c, q = [r[0] for r in stored], unit(np.array([r[1] for r in stored])), unit(np.array([r[1] for r in asked]))
    out = {}
    for (h, _), sims in zip(asked, q @ c.T, strict=True):
        ranked = sorted((-round(s, 9), i) for s, i in zip(sims, ids, strict=True) if not (others and i == h))
        out[h] = [i for _, i in ranked[:k]]
    return out


def answers(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["hash"], []).append(r["neighbour"])
    return out


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = clustered(400)
    path = str(tmp_path_factory.mktemp("index") / "ix")
    return rows, path, I.build_index(spark.createDataFrame([*rows, (9999, None)], SCHEMA), "hash", "e", path, cells=12)


def test_answers_are_exact_and_the_index_is_read_again(spark, stored):
    rows, path, built = stored
    asked = clustered(60, seed=2)
    df = spark.createDataFrame([*asked, (777, None)], SCHEMA)
    assert answers(built.nearest(df, "hash", "e", 5)) == plain(rows, asked, 5)
    before = {p: os.stat(os.path.join(p, f)).st_mtime_ns for p, _, fs in os.walk(path) for f in fs}
    again = I.open_index(spark, path)
    assert answers(again.nearest(spark.createDataFrame(rows[:50], SCHEMA), "hash", "e", 4, others=True)) == plain(rows, rows[:50], 4, others=True)
    assert before == {p: os.stat(os.path.join(p, f)).st_mtime_ns for p, _, fs in os.walk(path) for f in fs}


def test_only_the_needed_cells_are_opened(spark, stored, tmp_path):
    rows, path, built = stored
    copy = str(tmp_path / "ix")
    shutil.copytree(path, copy)
    target = rows[0]
    unit = np.array(target[1]) / np.linalg.norm(target[1])
    near = set(np.argsort(-(built.pivots @ unit), kind="stable")[: knn.PROBES].tolist())
    lost = 0
    for cell in set(range(12)) - near:  # what cannot matter is made unreadable
        folder = f"{copy}/{built.folders[0]}/cell={cell}"
        for f in os.listdir(folder) if os.path.isdir(folder) else []:
            if f.endswith(".parquet"):
                with open(f"{folder}/{f}", "wb") as out:
                    out.write(b"no parquet")
                lost += 1
                crc = f"{folder}/.{f}.crc"
                if os.path.exists(crc):
                    os.remove(crc)
    assert lost
    found = I.open_index(spark, copy).nearest(spark.createDataFrame([target], SCHEMA), "hash", "e", 3)
    assert answers(found) == plain(rows, [target], 3)


def test_appended_versions_stand_side_by_side(spark, stored):
    rows, path, built = stored
    more = [(1000 + i, v) for i, v in clustered(80, seed=3)]
    grown = built.append(spark.createDataFrame(more, SCHEMA), "hash", "e")
    asked = clustered(20, seed=4)
    df = spark.createDataFrame(asked, SCHEMA)
    assert I.versions(spark, path) == [1, 2] and grown.rows.sum() == 480
    assert answers(I.open_index(spark, path).nearest(df, "hash", "e", 6)) == plain([*rows, *more], asked, 6)
    assert answers(I.open_index(spark, path, 1).nearest(df, "hash", "e", 6)) == plain(rows, asked, 6)
    with pytest.raises(Exception, match="exist"):
        built.append(spark.createDataFrame(more, SCHEMA), "hash", "e")
    assert I.open_index(spark, path, 7) is None and I.open_index(spark, path + "-none") is None


def test_checks_equal_the_single_check(spark, tmp_path):
    rows = [(i, v, f"s{i % 5}", f"f{i % 8 // 2}", 0.3) for i, v in clustered(80)]
    full = "hash long, e array<double>, style string, family string, confidence double"
    tracks = spark.createDataFrame(rows, full)
    built = I.build_index(tracks, "hash", "e", str(tmp_path / "ix"), eps=1e-9)
    asked = spark.createDataFrame([(i, v, "s0", "f9", 0.2) for i, v in clustered(4, seed=9)], full)
    got = {r["hash"]: r for r in I.check_outside(built, asked, tracks.select("hash", "style", "family"), "hash", "e").collect()}
    for r in asked.collect():
        one = knn.check_one(r["e"], "s0", "f9", 0.2, tracks.withColumn("hash", F.col("hash").cast("string")), "hash", "e").first()
        same = ("suggested_family", "suggested_style", "agreement", "top_sim", "flag")
        assert [got[r["hash"]][c] for c in same] == [one[c] for c in same]
    two = I.build_index(tracks.limit(2), "hash", "e", str(tmp_path / "two"))
    assert I.check_outside(two, asked, tracks, "hash", "e").count() == 0
    none = I.build_index(tracks.limit(0), "hash", "e", str(tmp_path / "none"))
    assert none.nearest(asked, "hash", "e", 3).count() == 0


def test_projections_spare_most_pairs_of_clusters(spark):
    rows = clustered(1200, centres=24)
    df = spark.createDataFrame(rows, SCHEMA)
    exact, near = (knn.knn_join(df, "hash", "e", 4, mode=m) for m in ("exact", "lsh"))
    assert knn.recall(exact, near, "hash").first()["recall"] >= 0.9
    reps = knn._distinct_vectors(df, "hash", "e", 4, None)[1]
    plan = lsh._sampled(reps, 5, 6, 5)
    assert lsh.compared_share(reps, 16, plan) < 0.3
    found = {(r["hash"], r["neighbour"]): r["sim"] for r in near.collect()}
    true = {(r["hash"], r["neighbour"]): r["sim"] for r in exact.collect()}
    assert all(abs(found[p] - true[p]) < 1e-12 for p in found.keys() & true.keys())


def test_all_keys_asked_is_exact(spark):
    rows = clustered(150, centres=150)
    df = spark.createDataFrame([*rows, (500, rows[3][1]), (501, None)], SCHEMA)
    exact = sorted(map(tuple, knn.knn_join(df, "hash", "e", 3).select("hash", "rank", "neighbour").collect()))
    every = knn.knn_join(df, "hash", "e", 3, mode="lsh", plan=lsh.Plan(4, 2, 16, 1))
    assert sorted(map(tuple, every.select("hash", "rank", "neighbour").collect())) == exact
    assert knn.knn_join(df.limit(0), "hash", "e", 3, mode="lsh").count() == 0


def test_asked_keys_begin_with_the_own_one_and_differ():
    keys = lsh.Keys.draw(2, 9, 5, 1)
    units = np.random.default_rng(2).normal(size=(20, 5))
    asked = keys.asked(units, 30)
    assert (asked[:, :, 0] == keys.of(units)[0]).all()
    assert all(len(set(a.tolist())) == 30 for row in asked for a in row)
