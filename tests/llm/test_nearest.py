"""Cover trees: exact ranks, invariants, dirty vectors."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from cratewise.llm import covertree
from cratewise.plans.guards import cut_lineage

KIND = "hash long, embedding array<float>, score int, rank int"


def brute(rows, queries, k):
    scaled = {i: np.floor(np.array(v, dtype=np.float32).astype(float) * 64) for i, v in rows}
    out = {}
    for q, v in queries:
        x = np.floor(np.array(v, dtype=np.float32).astype(float) * 64)
        near = sorted((-int(x @ y), i) for i, y in scaled.items() if i != q and len(y) == len(x))
        out[q] = [(i, -s) for s, i in near[:k]]
    return out


@pytest.mark.parametrize("spread,block", [(0.05, 64), (1.0, 64), (0.2, 4096)])
def test_ranks_are_exact(spark, spread, block):
    rng = np.random.default_rng(int(spread * 100) + block)
    heads = rng.normal(size=(6, 8))
    rows = [(i, (heads[i % 6] + spread * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)]  # many ties
    df = cut_lineage(spark.createDataFrame([(*r, 0, 0) for r in rows], KIND))
    got = {}
    for r in covertree.top_tracks(df, df.where("hash % 20 = 0"), k=7, block=block, sample=300).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["hash"], r["score"]))
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 7)
    assert {q: [(h, s) for _, h, s in sorted(v)] for q, v in got.items()} == want
    assert all([x for x, _, _ in sorted(v)] == list(range(1, 8)) for v in got.values())


def test_unsound_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, []), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (20, [1.0, 1.0]), (None, [1.0, 1.0]), (40, [nan, nan])]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], KIND)
    got = sorted((r["query"], r["rank"], r["hash"]) for r in covertree.top_tracks(df, df.where("hash % 20 = 0"), k=5).collect())
    assert got == [(0, 1, 20), (0, 2, 1), (20, 1, 0), (20, 2, 1)]
    assert covertree.top_tracks(df.limit(0), df, k=5).count() == 0
    assert covertree.top_tracks(df, df.limit(0), k=5).count() == 0


def test_tree_covers_and_parts_its_points():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(size=(500, 3)) * s + c for s, c in ((0.1, 0), (0.1, 5), (2, 20))])
    tree = covertree.build_tree(points, np.arange(len(points)))
    assert sorted(tree.ids.tolist()) == list(range(len(points)))
    for i in range(len(tree.radius)):
        inside = tree.points[tree.start[i] : tree.end[i]]
        assert np.sqrt(((inside - tree.center[i]) ** 2).sum(1)).max() <= tree.radius[i] + 1e-9
        if len(tree.kids[i]):
            assert sorted((tree.start[k], tree.end[k]) for k in tree.kids[i])[0][0] == tree.start[i]
            assert sum(tree.end[k] - tree.start[k] for k in tree.kids[i]) == tree.end[i] - tree.start[i]
    assert max(map(len, tree.kids)) > 0


def test_search_prunes_what_cannot_matter():
    rng = np.random.default_rng(2)
    near, far = rng.normal(size=(400, 4)) + 20, rng.normal(size=(4000, 4)) - 20
    tree = covertree.build_tree(np.concatenate([near, far]), np.arange(4400))
    best = covertree.Best(covertree.build_tree(rng.normal(size=(50, 4)) + 20, np.arange(10_000, 10_050)), 5)
    seen = []
    take = best.take
    best.take = lambda rows, t, cols: (seen.append(len(t.ids[cols])), take(rows, t, cols))
    best.walk(tree)
    assert sum(seen) < 4400 and (best.id < 400).all()


@pytest.mark.parametrize("gathered", [False, True])
def test_trees_of_the_given_vectors_have_levels(gathered):
    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pydict()
    points = np.floor(np.array(table["embedding"]) * 64)
    if gathered:  # a tenth of each vector around its label's
        heads = np.floor(np.random.default_rng(3).normal(size=(10, 64)) * 16)
        points = np.floor(points / 10) + heads[np.array(table["label"])]
    ids = np.array(table["vec_id"])
    tree, asked = covertree.build_tree(points, ids), covertree.build_tree(points[ids % 4 == 0], ids[ids % 4 == 0])

    def depth(i):
        return 1 + max((depth(k) for k in tree.kids[i]), default=0)

    assert depth(0) >= 3 and len(tree.radius) > 30
    best = covertree.Best(asked, 20)
    best.walk(tree)
    print("pairs of nodes visited", best.visited, "left", best.left)
    assert best.visited > 100 and (best.left > 0 or not gathered)
    for q in range(len(asked.ids)):
        scores = sorted((-int(s), int(i)) for s, i in zip(points @ asked.points[q], ids, strict=True) if i != asked.ids[q])[:20]
        assert [(-int(s), int(i)) for s, i in zip(best.score[q], best.id[q], strict=True)] == scores
