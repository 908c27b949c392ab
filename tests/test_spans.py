"""Spans, window modes and tempo windows against plain loops, with hot keys and wide extents."""

import random

import pytest
from pyspark.sql import functions as F

from cratewise.operators import search, sequences as S
from cratewise.plans import dyadic


@pytest.mark.parametrize("piece", [0, 2, 12])
def test_best_of_aligned_nodes_equals_every_place(spark, piece):
    rng = random.Random(5)
    spans = [(f"t{i % 3}", lo := rng.randrange(60), lo + rng.randrange(0, 70), i) for i in range(200)] + [("t0", None, 4, -1), ("t1", 3, None, -1)]
    df = spark.createDataFrame(spans, "k string, lo long, hi long, v long")
    got = {(r["k"], r["idx"]): r["best"] for r in dyadic.best_at(df, ["k"], "lo", "hi", F.col("v"), piece=piece).collect()}
    want = {}
    for k, lo, hi, v in spans:
        for i in range(lo, hi) if lo is not None and hi is not None else ():
            want[k, i] = min(v, want.get((k, i), v))
    assert got == want


def test_nodes_of_a_span_are_few_and_aligned(spark):
    spans = spark.createDataFrame([(0, 1), (5, 6), (1, 2**40 - 1), (3, 1_000_003)], "lo long, hi long").withColumn("n", dyadic._nodes("lo", "hi"))
    for r in spans.collect():
        edges = sorted((n["node"] << n["level"], (n["node"] + 1) << n["level"]) for n in r["n"])
        assert edges[0][0] == r["lo"] and edges[-1][1] == r["hi"]
        assert all(a[1] == b[0] for a, b in zip(edges, edges[1:])) and len(edges) <= 2 * r["hi"].bit_length()


def test_labels_of_one_long_span_beside_many_short_ones(spark):
    """A week beside short spans, repeated and null positions, ties, spans without an extent."""
    rng = random.Random(8)
    week = 7 * 86_400.0
    frames = [("a", rng.randrange(0, 4000) / 2) for _ in range(1500)] + [("a", None), (None, 3.0), ("b", 1.0), ("c", week - 0.5), ("c", week)]
    spans = [("a", s := rng.randrange(0, 4000) / 2, s + rng.randrange(0, 6) / 2, rng.choice("xyz")) for _ in range(800)]
    spans += [("a", 100.0, week, "week"), ("c", 0.0, week, "week"), ("c", 0.0, week, "day"), ("b", None, 5.0, "n"), ("b", 0.0, None, "n"), (None, 0.0, 9.0, "n")]
    out = S.interval_labels(
        spark.createDataFrame(frames, "hash string, at double"), "hash", "at", spark.createDataFrame(spans, "hash string, start_s double, end_s double, genre string")
    ).collect()

    def first(h, at):
        over = [(s, e, g) for k, s, e, g in spans if k == h and None not in (k, s, e, at) and s <= at < e]
        return min(over)[2] if over else None

    assert len(out) == len(frames)
    by = lambda rows: sorted(rows, key=repr)
    assert by((r["hash"], r["at"], r["label"]) for r in out) == by((h, at, first(h, at)) for h, at in frames)


@pytest.mark.parametrize("win", [1, 7, 200])
def test_window_mode_equals_a_plain_count(spark, win):
    rng = random.Random(win)
    tracks = {"long": [rng.choice("aaab" if i % 90 < 45 else "bcd") for i in range(700)], "one": ["a"], "flat": ["b"] * 30, "pair": ["b", "a"]}
    rows = [(h, i, s) for h, styles in tracks.items() for i, s in enumerate(styles)]
    got = {(r["hash"], r["frame_idx"]): r["style"] for r in S.majority_smooth(spark.createDataFrame(rows, "hash string, frame_idx long, style string"), "hash", win).collect()}
    want = {}
    for h, styles in tracks.items():
        for i in range(len(styles)):
            near = styles[max(0, i - win) : i + win + 1]
            want[h, i] = max(dict.fromkeys(near), key=near.count)
    assert got == want


@pytest.mark.parametrize("small", [0, 200_000])
def test_tempo_windows_are_exact_at_their_ends(spark, small):
    """Tempos placed on and beside every end of a window, codes in several spellings."""
    rng = random.Random(4)
    base = [round(rng.uniform(40, 220), rng.choice((0, 1, 3))) for _ in range(25)] + [100.0, 0.0, None, float("nan")]
    tempos = base + [b * f * (1 + e) for b in base[:12] for f in (1.06, 1 / 1.06, 1.88, 2.12, 1 / 1.88, 1 / 2.12) for e in (0, 2e-16, -2e-16, 1e-9)]
    rows = [(i, rng.choice(("8A", " 8a", "08A", "9A", "8B", "1A", "12A", "H", None)), b) for i, b in enumerate(tempos)]
    df = spark.createDataFrame(rows, "id long, camelot string, bpm double")
    got = {r["id"]: r["partners"] for r in search.harmonic_counts(df, "id", small=small).collect()}
    other = df.select(*[F.col(c).alias(c + "2") for c in df.columns])
    ok = search.music.keys_compatible(F.col("camelot"), F.col("camelot2")) & search.music.bpms_compatible(F.col("bpm"), F.col("bpm2")) & (F.col("id") != F.col("id2"))
    pairs = df.join(other, ok).groupBy("id").count()
    want = {i: 0 for i, _, _ in rows} | {r["id"]: r["count"] for r in pairs.collect()}
    assert got == want
