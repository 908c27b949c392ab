import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cratewise.operators import sequences as S
from cratewise.streaming.frames import label_stream

FRAME = "hash string, frame_idx long, top array<struct<style:string,score:double>>"


def _frames(rng, n, labels="abcd"):
    out = []
    for _ in range(n):
        names = rng.sample(labels, rng.randint(1, len(labels)))
        scores = sorted((round(rng.random() * 0.4, 3) for _ in names), reverse=True)
        out.append(list(zip(names, scores)))
    return out


def _fold(frames):
    state, out = (None, None, 0), []
    for top in frames:
        state = S.hysteresis_step(state, top)
        out.append(state[0])
    return out


@pytest.mark.parametrize("chunk", [1, 2, 5, 4096])
def test_hysteresis_chunks_equal_the_fold(spark, chunk):
    rng = random.Random(11)
    tracks = {f"t{i}": _frames(rng, rng.randint(1, 40)) for i in range(12)}
    rows = [(h, i, top) for h, fs in tracks.items() for i, top in enumerate(fs)]
    got = {}
    for r in S.hysteresis(spark.createDataFrame(rows, FRAME), "hash", chunk=chunk).orderBy("hash", "frame_idx").collect():
        got.setdefault(r["hash"], []).append(r["style"])
    assert got == {h: _fold(fs) for h, fs in tracks.items()}


@settings(max_examples=200, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 10**9), st.integers(1, 25), st.integers(1, 7))
def test_chunk_summaries_compose(seed, n, size):
    """The summaries alone, chained, give the state the fold has at every chunk start."""
    frames = _frames(random.Random(seed), n)
    held, rival, run, done = None, None, 0, []
    for at in range(0, n, size):
        if at:
            assert held == _fold(frames[:at])[-1]
        s = S._summarise(frames[at : at + size], S.MARGIN, S.HOLD)
        brought = min(S.HOLD, run) if s["first"] == rival else 0
        start = s["first"] if held is None else held
        end = s["maps"][brought].get(start, s["maps"][brought][S._OUTSIDE])
        held = start if end == S._OUTSIDE else end
        run = s["tail"] + (run if s["tail"] == s["rows"] and s["last"] == rival else 0)
        rival = s["last"]
        done.append(held)
    assert held == _fold(frames)[-1]


def _smooth(segs, win):
    """Literal rounds of the two passes."""
    n = len(segs)
    out = []
    for i in range(n):
        counts = {}
        for j in range(max(0, i - win), min(n - 1, i + win) + 1):
            counts[segs[j]] = counts.get(segs[j], 0) + 1
        out.append(max(counts, key=counts.get))
    for _ in range(20):
        changed, i = False, 0
        while i < n:
            j = i
            while j < n and out[j] == out[i]:
                j += 1
            if j - i < win and (i > 0 or j < n):
                repl = out[i - 1] if i > 0 else out[j]
                if repl != out[i]:
                    out[i:j] = [repl] * (j - i)
                    changed = True
            i = j
        if not changed:
            break
    return out


@pytest.mark.parametrize("chunk", [3, 4096])
def test_smoothing_reaches_the_fixed_point(spark, chunk):
    rng = random.Random(2)
    tracks = {}
    for k in range(60):
        segs, n = [], rng.randint(1, 30)
        while len(segs) < n:
            segs += [rng.choice("abc")] * rng.randint(1, 5)
        tracks[f"t{k:02d}"] = segs[:n]
    df = spark.createDataFrame([(h, i, s) for h, segs in tracks.items() for i, s in enumerate(segs)], "hash string, frame_idx long, style string")
    for win in (2, 3):
        voted = S.majority_smooth(df, "hash", win)
        out = S.spread_runs(S.absorb_short_runs(voted, "hash", win, chunk), "hash", chunk).orderBy("hash", "frame_idx").collect()
        got = {}
        for r in out:
            got.setdefault(r["hash"], []).append(r["style"])
        assert got == {h: _smooth(segs, win) for h, segs in tracks.items()}


def _series(spark, values, key="k"):
    return spark.createDataFrame([(key, i, float(v)) for i, v in enumerate(values)], "k string, frame_idx long, value double")


@pytest.mark.parametrize("n, bins", [(100, 8), (5, 8), (37, 10)])
def test_envelope_matches_integer_edges(spark, n, bins):
    x = np.sin(np.arange(n)) * 3
    edges = np.linspace(0, n, bins + 1, dtype=int)
    peak = np.abs(x).max()
    got = {r["bin"]: (r["lo"], r["hi"], r["rms"]) for r in S.envelope(_series(spark, x), "k", bins).collect()}
    for b in range(bins):
        seg = x[edges[b] : edges[b + 1]]
        want = (seg.min(), seg.max(), np.sqrt((seg**2).mean())) if len(seg) else (0, 0, 0)
        assert got[b] == pytest.approx([v / peak for v in want], abs=1e-3)


def test_resample_clamps_both_ends(spark):
    x = np.random.default_rng(0).normal(size=31)
    for rate_in, rate_out, phase in ((4, 3, -1.24), (2, 5, 0.0), (3, 3, 0.0)):
        step, n_out = rate_in / rate_out, round(len(x) * rate_out / rate_in)
        pos = np.arange(n_out) * step + phase
        i0 = np.clip(np.floor(pos).astype(int), 0, len(x) - 1)
        frac = pos - np.floor(pos)
        want = (1 - frac) * x[i0] + frac * x[np.clip(i0 + 1, 0, len(x) - 1)]
        rows = S.resample(_series(spark, x), "k", rate_in, rate_out, phase).orderBy("out_idx").collect()
        assert [r["value"] for r in rows] == pytest.approx(want.tolist())


def test_patches_drop_the_tail(spark):
    rows = S.patches(_series(spark, range(130 + 62)), "k", 128, 62).groupBy("patch").count().collect()
    assert {(r["patch"], r["count"]) for r in rows} == {(0, 128), (1, 128)}
    assert S.patches(_series(spark, range(100)), "k", 128, 62).count() == 0


def test_sections_and_histogram_mode(spark):
    loud = _series(spark, [1, 1, 1, 1, 9, 9, 1, 1]).withColumnRenamed("value", "energy")
    assert S.densest_section(loud, "k").first()["start"] == 4
    assert S.densest_section(loud, "k", which="quiet").first()["start"] == 0
    df = spark.createDataFrame([("a", 0.15, 5.0), ("a", -0.4, 1.0), ("b", 0.15, 1.0), ("b", -0.3, 1.0), ("b", 0.35, 1.0)], "k string, value double, weight double")
    got = {r["k"]: r["mode"] for r in S.histogram_mode(df, "k", -0.5, 0.5, 5).collect()}
    assert got["a"] == pytest.approx(0.2) and got["b"] == 0.0


def test_span_bounds(spark):
    frames = spark.createDataFrame([("t", float(i)) for i in range(8)], "hash string, at double")
    spans = spark.createDataFrame([("t", 2.0, 4.0, "A"), ("t", 3.0, 100.0, "B"), ("t", 5.0, 5.0, "bad")], "hash string, start_s double, end_s double, genre string")
    known = spark.createDataFrame([("t", 99.5)], "hash string, duration double")
    ok = S.valid_spans(spans, known, "hash")
    got = {r["at"]: r["label"] for r in S.interval_labels(frames, "hash", "at", ok).collect()}
    assert [got[float(i)] for i in range(8)] == [None, None, "A", "A", "B", "B", "B", "B"]


def test_salience_prefers_loud_and_recurring(spark):
    rows = [("t", "House", 0.9, 1.0)] * 6 + [("t", "Ambient", 0.9, 0.0)] * 4 + [("t", "Techno", 0.2, 0.5)]
    out = S.salience(spark.createDataFrame(rows, "hash string, style string, conf double, energy double"), "hash").orderBy("rank").collect()
    assert [r["style"] for r in out] == ["House", "Techno", "Ambient"] and out[2]["score"] == 0.0
    assert sum(r["score"] for r in out) == pytest.approx(1)


def test_streaming_labels_equal_batch(spark, tmp_path):
    rng = random.Random(9)
    rows = [(f"t{k}", i, top) for k in range(3) for i, top in enumerate(_frames(rng, 20))]
    df = spark.createDataFrame(rows, FRAME)
    for part in range(2):
        df.where((F.col("frame_idx") >= part * 10) & (F.col("frame_idx") < part * 10 + 10)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    query = label_stream(stream, "hash", contiguous=True).writeStream.format("memory").queryName("labels").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.table("labels").where("not late").drop("late").collect()))
    assert got == sorted(map(tuple, S.hysteresis(df, "hash").select("hash", "frame_idx", "style").collect()))
