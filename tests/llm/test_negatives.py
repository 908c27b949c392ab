"""Hard negatives against plain integer products, and their edge cases."""

import math

import numpy as np
import pytest

from cratewise.llm import negatives

SCHEMA = "hash long, genre string, embedding array<double>, row int, slot int, anchor int, body string, group string"
EXTRA = (1, 2, 3, "x", "y")


def plain(rows, asked, positives=5, most=5, low=80, scale=256):
    """[(anchor, positive, rank, negative, positive score, negative score)]"""
    def ready(rows):
        good = [r for r in rows if None not in r[:3] and r[2] and all(x is not None and math.isfinite(x) for x in r[2])]
        return [(h, g, [math.floor(scale * x) for x in v]) for h, g, v in good]

    tracks, out = ready(rows), []
    for h, g, v in sorted({(h, g, tuple(v)) for h, g, v in ready(asked)}):
        scores = [(-sum(a * b for a, b in zip(v, w, strict=True)), i, k) for i, k, w in tracks if i != h and len(w) == len(v)]
        for p, i, _ in sorted(x for x in scores if x[2] == g)[:positives]:
            window = sorted(x for x in scores if x[2] != g and low * -p <= 100 * -x[0] <= 100 * -p)[:most]
            out += [(h, i, n + 1, j, -p, -s) for n, (s, j, _) in enumerate(window)]
    return sorted(out)


def found(spark, rows, asked, **options):
    make = lambda x: spark.createDataFrame([(*r, *EXTRA) for r in x], SCHEMA)
    return sorted(map(tuple, negatives.hard_negatives(make(rows), make(asked), **options).collect()))


def vectors(n, dim, seed=1, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dim))
    return [(i, f"g{rng.integers(3)}", (centres[rng.integers(4)] / 8 + spread * rng.normal(size=dim) / math.sqrt(dim)).tolist()) for i in range(n)]


@pytest.mark.parametrize("group", [7, 4096])
def test_negatives_equal_plain_products(spark, group):
    rows = vectors(300, 24)
    rows += [(1000 + i, "g1", rows[3][2]) for i in range(40)] + [(2000 + i, "g2", rows[3][2]) for i in range(40)]  # ties
    asked = [r for r in rows if r[0] % 20 == 0]
    want = plain(rows, asked)
    assert len(want) > 100
    assert found(spark, rows, asked, group=group) == want


def test_odd_rows(spark):
    v = [0.5, -0.25, 0.125]
    rows = [(1, "a", v), (2, "a", v), (2, "a", v), (3, "b", v), (3, "b", [0.45, -0.2, 0.1]), (4, None, v), (None, "b", v), (5, "b", None), (6, "b", []),
            (7, "b", [0.5, None, 0.1]), (8, "b", [0.5, float("nan"), 0.1]), (9, "b", [float("inf"), 0.1, 0.1]), (10, "b", [0.5]), (11, "a", [0.6]), (12, "c", [0.0, 0.0, 0.0]),
            (13, "a", [-x for x in v])]
    got = found(spark, rows, rows + [rows[0]])
    assert got == plain(rows, rows)
    assert {r[0] for r in got} == {1, 2}  # 3 has no other track of its genre but itself
    assert found(spark, [], []) == [] and found(spark, rows, []) == []


def test_wide_components_stay_exact(spark):
    rows = [(i, "ab"[i % 2], [(1 << 40) * (1 + (i * 7 % 5) / 9), float(i), -(1 << 20) / (i + 1)]) for i in range(30)]
    got = found(spark, rows, rows[:6], scale=1, positives=3)
    want = plain(rows, rows[:6], scale=1, positives=3)
    clip = lambda x: min(x, (1 << 63) - 1)
    assert got and got == sorted((*r[:4], clip(r[4]), clip(r[5])) for r in want)


@pytest.mark.parametrize("largest", [1, 160, 5000, 1 << 30])
def test_packed_products_are_exact(largest):
    rng = np.random.default_rng(largest)
    a, t = rng.integers(-largest, largest + 1, (9, 64)), rng.integers(-largest, largest + 1, (101, 64))
    a[0], t[0], t[1] = largest, largest, -largest
    layout = negatives.Layout.of(largest, int(np.abs(a).sum(axis=1).max()))
    assert layout.fields > 1 and layout.wide == (largest > 1000)
    exact = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in t] for p in a]
    anchors = a.astype(object) if layout.wide else a
    assert layout.products(anchors, layout.pack(t.astype(object) if layout.wide else t), len(t)).tolist() == exact
