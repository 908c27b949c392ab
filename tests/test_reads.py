import pytest
from pyspark.sql import functions as F

from cratewise import schemas
from cratewise.functions import reads as R
from cratewise.operators import taxonomy as X

READ = [("Techno", 0.66), ("House", 0.17), ("Tech Trance", 0.165), ("Ambient", 0.005)]


def _adjust(spark, read, steps=None, drops=None):
    df = spark.createDataFrame([(read, steps, drops)], f"read {schemas.READ}, steps map<string,int>, drops array<string>")
    rows = df.select(R.adjust(F.col("read"), F.col("steps"), F.col("drops")).alias("r")).first()["r"]
    return {e["style"]: e["score"] for e in rows}, [e["style"] for e in rows]


def test_no_adjustment_only_renormalises(spark):
    got, order = _adjust(spark, READ)
    assert order == [s for s, _ in READ] and sum(got.values()) == pytest.approx(1, abs=1e-3)


def test_raise_scales_and_floor_applies_to_traces(spark):
    got, _ = _adjust(spark, READ, {"House": 3})
    raw = {s: v * (1.9**3 if s == "House" else 1) for s, v in READ}
    assert got["House"] == pytest.approx(raw["House"] / sum(raw.values()), abs=1e-4)
    trace, _ = _adjust(spark, READ, {"Ambient": 1})
    fresh, _ = _adjust(spark, READ[:3] + [("Ambient", 0.0)], {"Ambient": 1})
    assert trace["Ambient"] == pytest.approx(fresh["Ambient"], abs=2e-3) and trace["Ambient"] > 0.1


def test_absent_styles_enter_only_when_raised(spark):
    assert "Disco" in _adjust(spark, READ, {"Disco": 2})[0]
    assert "Disco" not in _adjust(spark, READ, {"Disco": -2})[0]


def test_drop_redistributes_and_takes_its_step(spark):
    got, _ = _adjust(spark, READ, {"Techno": 3}, ["Techno"])
    assert "Techno" not in got and sum(got.values()) == pytest.approx(1, abs=1e-3)


def test_last_reading_cannot_be_dropped(spark):
    assert _adjust(spark, [("House", 0.4)], None, ["House"])[0] == {"House": 1.0}
    df = spark.createDataFrame([(READ[:2], ["House", "Nope", "Techno"])], f"read {schemas.READ}, drops array<string>")
    assert df.select(R.surviving_drops(F.col("read"), F.col("drops")).alias("d")).first()["d"] == ["House", "Nope"]


@pytest.mark.parametrize("gone, source, style", [
    (0, "override", "O"), (1, "weights", "W"), (2, "relabel", "R"), (3, "salience", "S"), (4, "styles", "F"), (5, None, None),
])
def test_precedence(spark, gone, source, style):
    values = ["O", {"W": 3}, [("R", 0.5)], [("S", 0.4)], [("F", 0.3)]]
    row = tuple(None if i < gone else v for i, v in enumerate(values))
    if gone == 1:
        row = (None, {"W": 3}, [("R", 0.0)], None, None)
    df = spark.createDataFrame([row], f"o string, w map<string,int>, r {schemas.READ}, s {schemas.READ}, f {schemas.READ}")
    if gone == 1:  # an all-zero read keeps its top, so give the blend something to lift
        df = spark.createDataFrame([(None, {"W": 3}, [("W", 0.5), ("R", 0.5)], None, None)], df.schema)
    drops = F.lit(None).cast("array<string>")
    got = df.select(R.identity(F.col("o"), F.col("r"), F.col("s"), F.col("f"), F.col("w"), drops).alias("i")).first()["i"]
    assert (got["source"], got["style"]) == (source, style)


def test_candidates_second_style_and_trim(spark):
    df = spark.createDataFrame([(READ,)], f"read {schemas.READ}")
    row = df.select(
        R.candidates(F.col("read"), F.lit("Techno")).alias("c"), R.second_style(F.col("read"), F.lit("Techno"), F.lit(0.66), F.lit(None)).alias("s"),
        R.trim_flat(F.col("read")).alias("t"), R.trim_flat(F.slice("read", 4, 1)).alias("one"),
    ).first()
    assert [e["style"] for e in row["c"]] == ["House", "Tech Trance"]
    assert (row["s"]["style"], row["s"]["weight"]) == ("House", round(0.17 / 0.83, 3))
    assert len(row["t"]) == 3 and len(row["one"]) == 1


@pytest.mark.parametrize("label, want", [
    ("Electronic---Deep House", "House"), ("Electronic---Hardcore", "Hard Dance"), ("Rock---Hardcore", "Punk"), ("Rock---Goregrind", "Metal"),
    ("Rock---Shoegaze", "Rock"), ("Non-Music---Spoken Word", None), ("Jazz---Bop", "Jazz"), ("Folk, World, & Country---Polka", None), ("hardcore", "Hard Dance"),
    ("Trap Wave", "Dubstep"), ("Big Room House", "House"), ("Melodic Drum n Bass", "Drum n Bass"), ("Hip Hop---Trap", "Trap"), ("", None), ("nothing here", None),
    ("metalcore", "Metal"),
])
def test_keystones(spark, label, want):
    assert spark.range(1).select(X.keystone(F.lit(label)).alias("k")).first()["k"] == want


def _classify(spark, pairs, overrides=None):
    tall = spark.createDataFrame([("t", 0, i, s, v) for i, (s, v) in enumerate(pairs)], "hash string, tier int, pos int, style string, score double")
    return X.classify(tall, "hash", X.style_dim(tall, "style"), overrides).first()


def test_fusion_threshold_is_inclusive(spark):
    at = _classify(spark, [("Dubstep", 0.65), ("Drum n Bass", 0.35)])
    assert (at["keystones"], at["label"], at["group"]) == (["Dubstep", "Drum n Bass"], "Drumstep", "Drum n Bass + Dubstep")
    below = _classify(spark, [("Dubstep", 0.66), ("Drum n Bass", 0.34)])
    assert below["keystones"] == ["Dubstep"] and not below["fusion"]
    unnamed = _classify(spark, [("Techno", 0.5), ("Hardstyle", 0.4)])
    assert unnamed["label"] == "Techno / Hard Dance" and not unnamed["cross_family"]


def test_small_siblings_add_up_and_tiers_fall_through(spark):
    row = _classify(spark, [("Techno", 0.3), ("Deep House", 0.15), ("Tech House", 0.15), ("House", 0.15), ("Spoken Word", 5.0)])
    assert row["keystones"][0] == "House"
    tall = spark.createDataFrame([("t", 0, 0, "House", 0.0), ("t", 0, 1, "No Such Thing", 1.0), ("t", 1, 0, "Techno", 0.2)], "hash string, tier int, pos int, style string, score double")
    assert X.classify(tall, "hash", X.style_dim(tall, "style")).first()["keystones"] == ["Techno"]


def test_override_short_circuits(spark):
    ov = spark.createDataFrame([("t", "Deep House")], "hash string, override string")
    row = _classify(spark, [("Techno", 0.9)], ov)
    assert (row["keystones"], row["share"], row["archgenre"], row["family"]) == (["House"], 1.0, "House", "Dance")


def test_overlay_patch_and_clean(spark):
    events = spark.createDataFrame(
        [("aliases", " Big Beat ", "House", 1), ("aliases", "big beat", None, 2), ("archgenre", "Halftime", "", 1), ("family", "X", "", 1), ("family", "Y", " Z ", 1), ("nope", "a", "b", 1)],
        "section string, name string, value string, updated long")
    assert sorted(map(tuple, X.patch_overlay(events).collect())) == [("archgenre", "Halftime", ""), ("family", "Y", "Z")]


def test_genre_graph_walk(spark):
    rows = [("hardwave", ["hard wave"], ["wave", "bass music"]), ("zap", ["zapp"], ["loop"]), ("loop", [], ["zap", "deep house"]), ("lost", [], ["lost"]),
            ("far1", [], ["far2"]), ("far2", [], ["far3"]), ("far3", [], ["far4"]), ("far4", [], ["far5"]), ("far5", [], ["far6"]), ("far6", [], ["techno"])]
    rows = [(i, *r) for i, r in enumerate(rows)]
    rows += [(20, "Foo", ["f"], ["House"]), (21, "Foo", ["f", "g"], ["Techno"]), (22, "g", [], ["Techno"])]
    g = spark.createDataFrame(rows, "pos long, name string, aliases array<string>, parents array<string>")
    got = {r["name"]: r["keystone"] for r in X.graph_keystones(g).collect()}
    assert got["hard wave"] == "Hard Dance"  # the canonical name's own answer beats its parents
    assert got["hardwave"] == "Downtempo" and got["zap"] == "House" and got["zapp"] == "House"
    assert "lost" not in got and "far1" not in got and got["far2"] == "Techno"
    assert (got["foo"], got["f"], got["g"]) == ("House", "House", "Techno")  # the first record with a spelling owns it
    names = spark.createDataFrame([("Zapp",), ("Hard  Wave",), ("Drum & Bass",), ("nothing",)], "tag string")
    placed = {r["tag"]: r["keystone"] for r in X.placed_names(names, "tag", graph=X.graph_keystones(g)).collect()}
    assert placed == {"Zapp": "House", "Hard  Wave": "Downtempo", "Drum & Bass": "Drum n Bass", "nothing": None}
