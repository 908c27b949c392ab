from pyspark.sql import functions as F

from cratewise.operators import edits as E, search as Q


def test_partial_ratings_merge_and_clean(spark):
    rows = [("t", 1, "4", None, None), ("t", 2, None, " abcde ", None), ("t", 3, None, None, "x" * 1200), ("u", 1, "9", None, None), ("v", 1, "-1", None, None), ("w", 1, "junk", None, None)]
    df = spark.createDataFrame(rows, "hash string, updated long, stars string, grade string, note string")
    got = {r["hash"]: r for r in E.rating_state(df, "hash").collect()}
    assert (got["t"]["stars"], got["t"]["grade"], len(got["t"]["note"])) == (4, "ABCD", 1000)
    assert (got["u"]["stars"], got["v"]["stars"], got["w"]["stars"]) == (5, 0, 0)
    again = E.rating_state(df.union(df), "hash")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.values()))


def test_confirm_clears_reject_and_reject_stands(spark):
    rows = [("a", "House", "reject", 1), ("a", "House", "confirm", 2), ("b", "House", "reject", 1), ("c", "House", "confirm", 1), ("c", "House", "reject", 2)]
    df = spark.createDataFrame(rows, "hash string, genre string, action string, updated long").withColumn("source", F.lit("propagation"))
    labels, rejects = E.label_state(df, "hash")
    assert {r["hash"] for r in labels.collect()} == {"a", "c"} and {r["hash"] for r in rejects.collect()} == {"b", "c"}


def test_lifted_drop_does_not_bring_its_step_back(spark):
    rows = [("t", 1, {"House": 3, "Disco": 0}, None), ("t", 2, None, ["House"]), ("t", 3, None, []), ("u", 1, {"House": 9}, None), ("v", 1, None, ["House"]), ("v", 2, {"House": 2}, None)]
    df = spark.createDataFrame(rows, "hash string, updated long, steps map<string,int>, drops array<string>")
    got = {r["hash"]: (r["steps"], r["drops"]) for r in E.adjustment_state(df, "hash").collect()}
    assert got == {"t": ({}, []), "u": ({"House": 3}, []), "v": ({"House": 2}, ["House"])}


def test_vibe_events_and_import(spark):
    rows = [("v", "a", "set", 0.2, 1), ("v", None, "clear", None, 2), ("v", "b", "set", -0.5, 3), ("v", None, "reset", None, 4), ("v", "c", "set", 0.3, 5), ("w", "a", "set", 1.0, 1), ("w", "a", "remove", None, 2)]
    got = E.vibe_members(spark.createDataFrame(rows, "vibe string, hash string, action string, weight double, updated long"))
    assert sorted(map(tuple, got.collect())) == [("v", "b", 1.0), ("v", "c", 0.3)]
    have = spark.createDataFrame([("x", "a", 0.5), ("y", "q", 1.0)], "name string, hash string, weight double")
    new = spark.createDataFrame([(" x ", 0, "a", "7"), ("x", 1, "b", "oops"), ("z", 0, None, None), ("", 0, "n", "1")], "name string, pos int, hash string, weight string")
    merged, counts = E.import_vibes(have, new)
    assert sorted(map(tuple, merged.collect())) == [("x", "a", 1.0), ("x", "b", 1.0), ("y", "q", 1.0)]
    assert tuple(counts.select("created", "merged", "links").first()) == (1, 1, 2)


def test_snapshot_round_trip(spark, tmp_path):
    tracks = spark.createDataFrame([("a",)], "hash string")
    labels = spark.createDataFrame([("a", "House"), ("gone", "Techno")], "hash string, genre string")
    E.take_snapshot({"labels": labels}, str(tmp_path), "s1", "first", 1.0)
    E.take_snapshot({"labels": labels.limit(0)}, str(tmp_path), "s2", "second", 2.0)
    assert [r["label"] for r in E.list_snapshots(spark, str(tmp_path)).collect()] == ["second", "first"]
    back = E.restore_snapshot(spark, str(tmp_path), "s1", "labels", tracks, "hash")
    assert [tuple(r) for r in back.collect()] == [("a", "House")]


def test_stamp_changes_with_any_input(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, updated long")
    stamps = {E.input_stamp({"t": a}, "updated", "dark"), E.input_stamp({"t": a.limit(1)}, "updated", "dark"), E.input_stamp({"t": a}, "updated", "light")}
    assert len(stamps) == 3 and E.input_stamp({"t": a}, "updated", "dark") in stamps


def test_null_rules_of_ranges_and_harmony(spark):
    df = spark.createDataFrame([("a", 120.0, "8A"), ("b", None, "8A"), ("c", 120.0, None), ("d", 60.0, "9A"), ("e", 120.0, "10A"), ("f", 124.0, "8B")], "hash string, bpm double, camelot string")
    ids = lambda d: sorted(r["hash"] for r in d.collect())
    assert ids(df.where(Q.in_range(F.col("bpm"), 100, None))) == ["a", "c", "e", "f"]
    assert len(ids(df.where(Q.in_range(F.col("bpm"), None, None)))) == 6
    assert ids(Q.harmonic_matches(df, "hash", "8A", 120.0, "a")) == ["b", "d", "f"]
    assert ids(Q.harmonic_matches(df, "hash", "1A", None)) == []
    got = {r["hash"]: r["partners"] for r in Q.harmonic_counts(df, "hash").collect()}
    want = {r["hash"]: Q.harmonic_matches(df, "hash", r["camelot"] or "", r["bpm"], r["hash"]).count() for r in df.collect()}
    assert got == want


def test_playlist_entries(spark):
    lists = spark.createDataFrame([(1, '["a", {"hash": "b"}, "a", "gone", {}]'), (2, "{bad")], "id int, tracks string")
    tracks = spark.createDataFrame([("a", "A"), ("b", "B")], "hash string, title string")
    assert [r["title"] for r in Q.playlist_rows(lists, tracks).orderBy("pos").collect()] == ["A", "B", "A"]
