"""Near copies by MinHash against brute force, and their edge cases."""

import random

import brute
import numpy as np
from test_texts import ROWS, empty, odd, prose  # noqa: F401

from cratewise.llm import minhash


def classes(rows, width=4):
    """{hash: (set size, component)} by comparing all sets."""
    old = brute.shingles
    brute.shingles = lambda t: old(t, width)
    try:
        return brute.note_classes(rows)
    finally:
        brute.shingles = old


def edited(words, places, mark):
    out = list(words)
    for i, p in enumerate(places):
        out[p] = f"{mark}x{i}"
    return " ".join(out)


def test_components_equal_brute_force(spark):
    rng = random.Random(3)
    base = prose(21, 150).split()
    chain = [(300 + k, edited(base, range(0, 6 * k, 6), "c")) for k in range(14)]  # each near to the next ones only
    apart = [(400 + k, edited(prose(22, 120).split(), rng.sample(range(120), 7), f"a{k}")) for k in range(50)]  # alike, mostly not linked
    short = [(500 + k, " ".join(f"w{i}" for i in range(k, k + 8))) for k in range(4)] + [(510, "one two three"), (511, "one  TWO three"), (512, "one two")]
    rows = [*ROWS, *chain, *apart, *short]
    notes = spark.createDataFrame([(h, t, 1, "x", 2) for h, t in rows], "hash long, note string, sig int, keys string, root int")
    got = {r["hash"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_copies(notes).collect()}
    assert got == classes(rows)
    assert len({c for h, (_, c) in got.items() if 300 <= h < 314}) == 1 and len({c for h, (_, c) in got.items() if 400 <= h < 450}) > 1


def test_what_the_stars_leave_is_compared_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(minhash, "MEMBERS", 5)
    monkeypatch.setattr(minhash, "STAR_ROUNDS", 0)
    base = prose(23, 120).split()
    rows = [(k, edited(base, rng.sample(range(120), 1 + k % 7), f"b{k}")) for k in range(60)]
    notes = spark.createDataFrame(rows, "hash long, note string")
    got = {r["hash"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_copies(notes).collect()}
    assert got == classes(rows)


def test_odd_and_empty_tables(odd, empty):  # noqa: F811
    found = minhash.near_copies(odd).collect()
    assert len(found) == odd.count()
    assert sorted((r["hash"] is not None and r["hash"], r["component_id"], r["kept"]) for r in found) == sorted(
        [(False, 5, False), (False, 5, False), (5, 5, True), (5, 5, True), (5, 5, True), (6, 5, False), (7, 7, True), (7, 7, True)]
    )
    assert minhash.near_copies(empty).count() == 0


def test_sketches_agree_about_as_often_as_sets_are_alike():
    rng = np.random.default_rng(1)
    sketcher = minhash.Sketcher(200)
    for size in (3, 20, 150, 3000):
        shares = []
        for _ in range(30):
            grams = np.unique(rng.integers(0, 1 << 63, int(size * 1.25) + 1, dtype=np.uint64))
            rng.shuffle(grams)
            a, b = np.sort(grams), np.sort(grams[: int(len(grams) * 0.8)])
            shares.append((sketcher.of(a) == sketcher.of(b)).mean() - len(b) / len(a))
        assert abs(np.mean(shares)) < 0.05
    one = sketcher.of(np.array([7], dtype=np.uint64))
    assert (one == 7).all()
