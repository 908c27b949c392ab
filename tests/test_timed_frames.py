"""Frames by event time: any order of batches, late and missing frames, tracks that end."""

import itertools
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from cratewise.operators import sequences
from cratewise.streaming.frames import _TimedLabels, label_timed

SCHEMA = "hash string, frame_idx long, sec long, top array<struct<style:string,score:double>>"


def frames_of(track: str, n: int, seed: int, start: int = 0) -> list:
    rng = random.Random(seed)
    return [(track, i, 100 + start + i, [(rng.choice(["House", "Techno", "Dub"]), 0.9), ("Ambient", 0.1)]) for i in range(n)]


@pytest.fixture()
def feed(spark, tmp_path):
    """Runs batches through one stream, a fresh query for each so that the state is stored and read again."""
    runs = itertools.count()

    def run(batches: list, **options) -> list:
        home = tmp_path / f"run-{next(runs)}"
        for batch in batches:
            rows = spark.createDataFrame(batch, SCHEMA).withColumn("at", F.timestamp_seconds("sec")).drop("sec")
            rows.coalesce(1).write.mode("append").parquet(f"{home}/in")
            stream = spark.readStream.schema(rows.schema).parquet(f"{home}/in")
            query = label_timed(stream, "hash", "at", **options).writeStream.format("parquet").option("path", f"{home}/out").option(
                "checkpointLocation", f"{home}/log").trigger(availableNow=True).start()
            query.awaitTermination(120)
        out = spark.read.schema("hash string, frame_idx long, style string, late boolean").parquet(f"{home}/out")
        return sorted(map(tuple, out.collect()), key=lambda r: (r[0], r[1], r[3]))

    return run


def batch_labels(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).drop("sec")
    return sorted((r["hash"], r["frame_idx"], r["style"], False) for r in sequences.hysteresis(df, "hash").collect())


@pytest.mark.parametrize(("contiguous", "seed"), [(True, 1), (False, 2)])
def test_any_order_of_batches_equals_batch_hysteresis(spark, feed, contiguous, seed):
    rows = frames_of("a", 24, 1) + frames_of("b", 24, 2)
    mixed = rows[:]
    random.Random(seed).shuffle(mixed)
    end = [("z", 0, 500, [("House", 1.0)])]  # lets the watermark pass all others
    got = feed([mixed[:16], mixed[16:32], mixed[32:], end], delay="60 seconds", contiguous=contiguous)
    assert [r for r in got if r[0] != "z"] == batch_labels(spark, rows)


def test_contiguous_frames_do_not_wait_for_the_watermark(spark, feed):
    rows = frames_of("a", 6, 3)
    got = feed([rows[3:], rows[:3]], delay="1 hour", contiguous=True)
    assert got == batch_labels(spark, rows)
    assert feed([rows[3:], rows[:3]], delay="1 hour") == []


def test_late_repeated_and_missing_frames(spark, feed):
    rows = frames_of("a", 10, 4)
    gap = rows[:4] + rows[5:]
    end = [("z", 0, 500, [("House", 1.0)])]
    got = feed([gap, gap[:2], end, rows[4:5]], delay="60 seconds", contiguous=True)
    mine = [r for r in got if r[0] == "a"]
    # frame 4 comes after the watermark and is dropped; repeats come back as late
    assert [r for r in mine if not r[3]] == batch_labels(spark, gap)
    assert [(r[1], r[2]) for r in mine if r[3]] == [(0, None), (1, None)]


def test_a_track_that_ended_leaves_the_state_and_may_start_anew(spark, feed):
    first, again = frames_of("a", 3, 5), frames_of("a", 3, 6, start=2000)
    end = [("z", 0, 1000, [("House", 1.0)])]
    kept = feed([first, end, again], delay="10 seconds", idle=10_000, contiguous=True)
    assert sum(r[3] for r in kept if r[0] == "a") == 3  # still known: the same indices are repeats
    gone = feed([first, end, again], delay="10 seconds", idle=60, contiguous=True)
    assert [r for r in gone if r[0] == "a" and r[3]] == []
    assert sorted(r for r in gone if r[0] == "a") == sorted(batch_labels(spark, first) + batch_labels(spark, again))


def test_unsound_frames_are_left_out(spark, feed):
    rows = frames_of("a", 3, 7)
    odd = [("a", 3, None, [("House", 1.0)]), ("a", 4, 4, None), ("a", 5, 5, [])]
    got = feed([rows + odd], delay="10 seconds", contiguous=True)
    assert got == batch_labels(spark, rows)


def test_a_chunk_is_released_part_by_part(spark, feed):
    """frames that came together pass the watermark one batch after another."""
    rows = frames_of("a", 12, 8)
    steps = [[("z", k, sec, [("House", 1.0)])] for k, sec in enumerate((108, 112, 500))]
    got = feed([rows[:9], steps[0], rows[9:], *steps[1:]], delay="5 seconds")
    assert [r for r in got if r[0] == "a"] == batch_labels(spark, rows)


class _Store:
    """State of one track in memory that counts how often it is asked."""

    def __init__(self):
        self.calls, self.value, self.maps = 0, None, {}

    def getValueState(self, name, schema):  # noqa: N802
        return _Value(self)

    def getMapState(self, name, key, value):  # noqa: N802
        return _Map(self, self.maps.setdefault(name, {}))

    def registerTimer(self, ms):  # noqa: N802
        self.calls += 1

    deleteTimer = registerTimer  # noqa: N815


class _Value:
    def __init__(self, store):
        self.store = store

    def exists(self):
        self.store.calls += 1
        return self.store.value is not None

    def get(self):
        self.store.calls += 1
        return self.store.value

    def update(self, value):
        self.store.calls += 1
        self.store.value = value

    def clear(self):
        self.update(None)


class _Map:
    def __init__(self, store, rows):
        self.store, self.rows = store, rows

    def _asked(self, answer=None):
        self.store.calls += 1
        return answer

    def getValue(self, key):  # noqa: N802
        return self._asked(self.rows.get(key))

    def updateValue(self, key, value):  # noqa: N802
        self._asked(self.rows.update({key: value}))

    def removeKey(self, key):  # noqa: N802
        self._asked(self.rows.pop(key))

    def keys(self):
        return self._asked(list(self.rows))

    def iterator(self):
        return self._asked(list(self.rows.items()))


class _At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms


def test_the_state_is_asked_by_chunks_of_frames():
    """round trips grow with the chunks of a track, three of each frame before."""
    n, store = 2000, _Store()
    labels = _TimedLabels("hash", sequences.MARGIN, sequences.HOLD, False, 86_400_000)
    labels.init(store)
    rows = [{"frame_idx": i, "_ms": 1000 * i, "top": [Row(style="House", score=1.0)]} for i in range(n)]
    early = list(labels.handleInputRows(("a",), iter(rows), _At(0)))
    half = list(labels.handleExpiredTimer(("a",), _At(1000 * (n // 2)), None))
    rest = list(labels.handleExpiredTimer(("a",), _At(1000 * n), None))
    assert [r["frame_idx"] for r in early + half + rest] == list(range(n)) and len(half) == n // 2
    assert not any(store.maps.values()) and store.calls < 60
