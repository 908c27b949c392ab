import pytest
from pyspark.sql import functions as F

from cratewise.operators import credits as C, labels as L

LIBRARY = (
    ["Above & Beyond"] * 4 + ["Afrojack & Steve Aoki", "Afrojack", "Afrojack", "Steve Aoki feat. Miss Palmer"]
    + ["AC/DC"] * 4 + ["Smoakland/Heyz", "AC Slater/Chris Lorenzo/Fly With Us", "Chris Lorenzo", "Tyler, The Creator", "Bob feat. bob", "A vs. B presents C", "", None]
)


@pytest.fixture(scope="module")
def split(spark):
    df = spark.createDataFrame([(c,) for c in LIBRARY], "credit string")
    out = {}
    for r in C.split_credits(df, "credit").orderBy("credit", "pos").collect():
        out.setdefault(r["credit"], []).append(r["artist"])
    return out


@pytest.mark.parametrize("credit, names", [
    ("Above & Beyond", ["Above & Beyond"]), ("Afrojack & Steve Aoki", ["Afrojack", "Steve Aoki"]), ("AC/DC", ["AC/DC"]), ("Smoakland/Heyz", ["Smoakland", "Heyz"]),
    ("AC Slater/Chris Lorenzo/Fly With Us", ["AC Slater", "Chris Lorenzo", "Fly With Us"]), ("Steve Aoki feat. Miss Palmer", ["Steve Aoki", "Miss Palmer"]),
    ("Tyler, The Creator", ["Tyler", "The Creator"]), ("Bob feat. bob", ["Bob"]), ("A vs. B presents C", ["A", "B", "C"]),
])
def test_credit_rules(split, credit, names):
    assert split[credit] == names
    assert "" not in split


def test_stars_take_the_best_artist(spark):
    tracks = spark.createDataFrame([("1", "Afrojack & Steve Aoki"), ("2", "Afrojack"), ("3", "Nobody")], "hash string, credit string")
    ratings = spark.createDataFrame([("1", 2)], "hash string, stars int")
    artists = spark.createDataFrame([("steve aoki", 5), ("nobody", 1)], "artist_key string, stars int")
    got = {r["hash"]: r["stars"] for r in C.artist_stars(tracks, "hash", "credit", ratings, artists).collect()}
    assert got == {"1": 5, "2": 0, "3": 1}


LABELS = ["Electronic---Drum n Bass", "Electronic---Psy-Trance", "Electronic---Techno", "Rock---Punk", "Hip Hop---Trap", "Pop---Europop"]


@pytest.mark.parametrize("raw, want", [
    ("drum & bass", ("Drum n Bass", "style")), ("Drum and Bass", ("Drum n Bass", "style")), ("psy trance", ("Psy-Trance", "style")), ("Techno (Peak Time / Driving)", ("Techno", "style")),
    ("Rap/Hip Hop", ("Hip Hop", "parent")), ("Hip-Hop", ("Hip Hop", "parent")), ("EDM", (None, "umbrella")), ("(17)", (None, None)), ("", (None, None)), ("Riddim", ("Riddim", "other")),
])
def test_genre_normaliser(spark, raw, want):
    styles, parents = L.genre_dims(spark.createDataFrame([(x,) for x in LABELS], "label string"))
    row = L.normalise_genres(spark.createDataFrame([(raw, 1)], "raw string, o int"), "raw", styles, parents, "o").first()
    assert (row["genre"], row["kind"]) == want


def test_first_seen_spelling_and_tags(spark):
    styles, parents = L.genre_dims(spark.createDataFrame([(x,) for x in LABELS], "label string"))
    names = spark.createDataFrame([("RIDDIM", 2), ("Riddim", 1)], "raw string, o int")
    assert {r["genre"] for r in L.normalise_genres(names, "raw", styles, parents, "o").collect()} == {"Riddim"}
    tags = spark.createDataFrame([("Trance; Electronic", 1), ("House, Techno", 2), ("Electronic;Dance", 3), ("Electro", 4), ("Electro|Techno", 5), (" ; ", 6)], "tag string, o int")
    got = {r["tag"]: (r["genre"], r["kind"]) for r in L.normalise_tags(tags, "tag", styles, parents, "o").collect()}
    assert got["Trance; Electronic"] == ("Trance", "other") and got["House, Techno"] == (None, "ambiguous")
    assert got["Electronic;Dance"] == (None, "umbrella") and got["Electro"] == (None, "ambiguous") and got["Electro|Techno"] == ("Techno", "style")


def test_contested_turns(spark):
    rows = [(f"a{i}", "House", "Techno") for i in range(3)] + [(f"b{i}", "Techno", "House") for i in range(2)] + [("c0", "Trance", "House")] * 1
    rows += [("d0", "House", "House"), ("e0", None, "House"), ("f0", "Trap", "House"), ("g0", "Disco", "House")]
    out = L.contested_order(spark.createDataFrame(rows, "hash string, tag_keystone string, read_keystone string"), "hash").orderBy("tier", "turn", "place").collect()
    assert len(out) == 8 and out[0]["boundary"] == "House + Techno"
    assert [r["tier"] for r in out] == [0] * 7 + [1]
    assert len({r["boundary"] for r in out[:3]}) == 3


def test_union_priority_and_imports(spark):
    tracks = spark.createDataFrame([("a",), ("b",)], "hash string")
    one = spark.createDataFrame([("a", "House"), ("zz", "House")], "hash string, genre string")
    two = spark.createDataFrame([("a", "Techno"), ("b", "Trance")], "hash string, genre string")
    union = L.label_union({"blind": two, "override": one}, tracks, "hash")
    assert union.count() == 3
    best = {r["hash"]: (r["genre"], r["source"]) for r in L.resolve_priority(union, "hash", L.SOURCES).collect()}
    assert best == {"a": ("House", "override"), "b": ("Trance", "blind")}
    found, missing = L.import_manifest(one, tracks, "hash")
    assert (found.count(), missing.first()["hash"]) == (1, "zz")
    entries = L.manifest(tracks, two.withColumn("source", F.lit("import")), "hash").collect()
    assert {tuple(r) for r in entries} == {("a", "folder"), ("b", "folder")}
