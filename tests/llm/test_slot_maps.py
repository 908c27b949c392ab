"""The stored slot map: versions against a plain fold, and what is never written twice."""

import pytest
from pyspark.sql import functions as F

from cratewise.llm import shards
from cratewise.plans.guards import cut_lineage

SLOTS = 128


def plain_edit(shard_of: dict, bytes_of: dict, count: int) -> dict:
    """Heaviest slot first: it stays while its shard is below the mean, else goes to the lightest."""
    mean, load, out = sum(bytes_of.values()) / count, [0] * count, {}
    for slot in sorted(shard_of, key=lambda s: (-bytes_of[s], s)):
        to = shard_of[slot]
        if to >= count or load[to] + bytes_of[slot] > mean:
            to = load.index(min(load))
        load[to] += bytes_of[slot]
        out[slot] = to
    return out


def tracks_of(spark, n, longest):
    return cut_lineage(spark.range(n).select(F.col("id").alias("hash"), F.repeat(F.lit("x"), (F.col("id") * 7 % longest).cast("int")).alias("payload")))


def as_dict(rows, value):
    return {r["vslot"]: r[value] for r in rows.collect()}


def test_versions_equal_a_plain_fold(spark, tmp_path):
    store = str(tmp_path / "map")
    steps = [(tracks_of(spark, 900, 50), 5), (tracks_of(spark, 2000, 90), 5), (tracks_of(spark, 2000, 90), 6), (tracks_of(spark, 2000, 90), 3)]
    want = {s: s * 5 // SLOTS for s in range(SLOTS)}
    for number, (tracks, count) in enumerate(steps, 1):
        rows = shards.shard_tracks(tracks, count, SLOTS, store).collect()
        loads = as_dict(shards.slot_loads(shards.slotted(tracks, SLOTS), SLOTS), "bytes")
        want = plain_edit(want, loads, count)
        assert as_dict(shards.stored_map(spark, store, number), "shard") == want
        assert all(r["shard"] == want[r["vslot"]] for r in rows)
        for s in range(count):
            places = sorted(r["slot"] for r in rows if r["shard"] == s)
            assert places == list(range(len(places)))
    assert shards.stored_versions(spark, store) == [0, 1, 2, 3, 4]
    assert as_dict(shards.stored_map(spark, store, 0), "shard") == {s: s * 5 // SLOTS for s in range(SLOTS)}


def test_nothing_is_stored_when_no_slot_moves(spark, tmp_path):
    store = str(tmp_path / "map")
    none = spark.createDataFrame([], "hash long, payload string")
    assert shards.shard_tracks(none, 4, SLOTS, store).count() == 0
    assert shards.stored_versions(spark, store) == [0]
    assert shards.stored_versions(spark, str(tmp_path / "nowhere")) == []


def test_a_version_is_written_once_and_slots_are_fixed(spark, tmp_path):
    store = str(tmp_path / "map")
    shards.store_map(shards.first_map(spark, 4, SLOTS), store, 0)
    with pytest.raises(ValueError, match="stored already"):
        shards.store_map(shards.first_map(spark, 2, SLOTS), store, 0)
    assert as_dict(shards.stored_map(spark, store), "shard") == {s: s * 4 // SLOTS for s in range(SLOTS)}
    with pytest.raises(ValueError, match="slots"):
        shards.shard_tracks(tracks_of(spark, 10, 5), 4, SLOTS * 2, store)
