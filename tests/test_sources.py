import hashlib
import struct
import xml.dom.minidom
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cratewise.functions import text as T
from cratewise.operators import learn, reference as R
from cratewise.sources import files, pages, sinks, tracks
from cratewise.streaming import ingest


@pytest.fixture()
def folder(tmp_path):
    root = tmp_path / "music"
    for name, data in {"a.mp3": b"one", "sub/b.FLAC": b"one", "c.wav": b"two", "._c.wav": b"two", "d.txt": b"x", "Windows/e.mp3": b"sys"}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    return root


def test_scan_hash_and_dedupe(spark, folder):
    scanned = files.scan_folder(spark, str(folder))
    names = sorted(r["path"].rsplit("/", 1)[1] for r in scanned.select("path").collect())
    assert names == ["a.mp3", "b.FLAC", "c.wav"]
    got = {r["hash"]: (r["path"], r["copies"]) for r in files.first_paths(files.content_hash(scanned)).collect()}
    one = got[hashlib.sha1(b"one").hexdigest()]
    assert one[0].endswith("/a.mp3") and one[1] == 2


def test_path_audit_and_repair(spark):
    lib = spark.createDataFrame([("a", ""), ("b", "/gone"), ("c", "/here"), ("d", None)], "hash string, filepath string")
    present = spark.createDataFrame([("/here",)], "path string")
    scanned = spark.createDataFrame([("a", "/n/a"), ("b", "/n/b"), ("c", "/n/c"), ("z", "/n/z")], "hash string, path string")
    assert {tuple(r) for r in files.path_report(files.path_states(lib, present)).collect()} == {("missing", 2), ("broken", 1), ("ok", 1)}
    fixed = files.repair_paths(lib, scanned, present)
    assert {(r["hash"], r["filepath"], r["action"]) for r in fixed.collect()} == {("a", "/n/a", "filled"), ("b", "/n/b", "repointed"), ("c", "/here", "kept")}
    assert tuple(files.repair_report(fixed, scanned).first()) == (3, 1, 1, 1, 1)


def test_payload_columns_and_vectors(spark):
    good = '{"styles":[{"parent":"E","style":"House","score":0.5}],"bpm":128,"tags":{"tag":{"artist":"  X "}},"frames":[[["House","0.5"]]]}'
    df = spark.createDataFrame([("a", good, bytearray(struct.pack("<2f", 1.5, -2.0))), ("b", "{nope", None)], "hash string, payload string, embedding binary")
    rows = tracks.listing_columns(tracks.parse_payload(tracks.decode_vectors(df))).collect()
    assert len(rows) == 1 and (rows[0]["style"], rows[0]["bpm"], rows[0]["tag_artist"], rows[0]["embedding"]) == ("House", 128.0, "X", [1.5, -2.0])


def test_views_prune_columns(spark, tmp_path):
    spark.createDataFrame([("a", "t", "big", [1.0])], "hash string, title string, payload string, embedding array<double>").write.parquet(str(tmp_path / "t"))
    plan = tracks.read_tracks(spark, str(tmp_path / "t"), "paths")._jdf.queryExecution().executedPlan().toString()
    assert "payload" not in plan and "embedding" not in plan


def test_lookup_lone_object_and_duplicates(spark):
    rows = [("a", "lastfm", '{"toptags":{"tag":{"name":"Dub","count":"5"}}}'), ("b", "musicbrainz", '{"recordings":[{"genres":[{"name":"House","count":1}],"tags":[{"name":"house","count":4},{"name":"Acid","count":2}]}]}'), ("c", "discogs", '{"results":[]}')]
    got = [tuple(r) for r in tracks.lookup_names(spark.createDataFrame(rows, "hash string, source string, response_json string")).orderBy("hash", "pos").collect()]
    assert [(g[0], g[3], g[4]) for g in got] == [("a", "Dub", 5), ("b", "house", 4), ("b", "Acid", 2)]


def test_collection_document_is_xml(spark):
    entries = spark.createDataFrame(
        [(1, 0, "a", 'A "q" & <b>', "X", "C:\\m\\a b.mp3", 128.123, "Am", 61.9), (1, 1, "b", "B", None, "", None, None, None), (1, 2, "c", "C", None, "/m/é.mp3", None, None, None)],
        "id int, pos long, hash string, title string, artist string, filepath string, bpm double, key string, duration double")
    ratings = spark.createDataFrame([("a", 4, "A", "good")], "hash string, stars int, grade string, note string")
    lists = spark.createDataFrame([(1, "Mix & Match"), (2, "Empty")], "id int, name string")
    lines = sinks.collection_xml(entries, ratings, lists).orderBy("id", "pos").collect()
    doc = xml.dom.minidom.parseString("\n".join(r["line"] for r in lines if r["id"] == 1))
    got = doc.getElementsByTagName("COLLECTION")[0].getElementsByTagName("TRACK")
    assert [t.getAttribute("TrackID") for t in got] == ["1", "2"]
    a = got[0]
    assert (a.getAttribute("Name"), a.getAttribute("Location"), a.getAttribute("Rating"), a.getAttribute("Comments")) == ('A "q" & <b>', "file://localhost/C:/m/a%20b.mp3", "204", "A - good")
    assert not got[1].hasAttribute("AverageBpm") and not got[1].hasAttribute("Comments")
    assert any("1 track(s) omitted" in r["line"] for r in lines)
    assert xml.dom.minidom.parseString("\n".join(r["line"] for r in lines if r["id"] == 2))


def test_sinks_round_trip(spark, tmp_path):
    labels = spark.createDataFrame([("b", "/x", "House", "blind"), ("a", "", "Techno, hard", "override")], "hash string, filepath string, genre string, source string")
    sinks.write_label_csv(labels, str(tmp_path / "csv"))
    back = sinks.read_label_csv(spark, str(tmp_path / "csv"))
    assert {r["genre"] for r in back.collect()} == {"House", "Techno, hard"}
    totals = sinks.write_results(spark.createDataFrame([("ok",), ("short",), ("error",)], "status string"), str(tmp_path / "nd"))
    assert tuple(totals.first()) == (1, 3, 1, 1) and spark.read.json(str(tmp_path / "nd")).count() == 3
    entries = spark.createDataFrame([(1, 0, "h", "T", "A"), (1, 1, "g", None, None)], "id int, pos long, hash string, title string, artist string")
    sinks.write_lines(sinks.m3u_lines(entries, "http://x/"), str(tmp_path / "m3u"))
    text = [r["value"] for r in spark.read.text(str(tmp_path / "m3u")).collect()]
    assert text == ["#EXTM3U", "#EXTINF:-1,A - T", "http://x/h", "#EXTINF:-1,Track", "http://x/g"]


def stand_ins():
    """An analyser's answers, drawn from the content."""
    def seeded(content):
        return np.random.default_rng(zlib.crc32(content))

    return learn.Engines(
        genre=lambda c: sorted(zip(["House", "Techno", "Trance"], seeded(c).dirichlet(np.ones(3)).tolist(), strict=True), key=lambda x: -x[1]),
        tempo=lambda c: float(80 + seeded(c).integers(0, 100)), key=lambda c: ("C", "minor" if seeded(c).integers(0, 2) else "major"),
        duration=lambda c: len(c) / 4.0,
    )


ENGINES = stand_ins()


@pytest.mark.parametrize("where", ["before", "after"])
def test_a_batch_that_stops_at_its_commit_is_stored_once(spark, folder, tmp_path, monkeypatch, where):
    def totals(store):
        return sorted(map(tuple, ingest.ingest_report(spark, store).collect()), key=str)

    whole, broken, log = str(tmp_path / "whole"), str(tmp_path / "broken"), str(tmp_path / "cp")
    options = {"minimum": 0.5}
    ingest.ingest_stream(spark, str(folder), whole, str(tmp_path / "cp0"), ENGINES, **options).awaitTermination(120)
    commit, calls = ingest.BatchLog.commit, []

    def stops(self, run, number, rows):
        calls.append(1)
        if where == "after":
            commit(self, run, number, rows)
        raise RuntimeError("stopped")

    monkeypatch.setattr(ingest.BatchLog, "commit", stops)
    with pytest.raises(Exception, match="stopped"):
        ingest.ingest_stream(spark, str(folder), broken, log, ENGINES, **options).awaitTermination(120)
    assert calls and (totals(broken) == []) == (where == "before")
    monkeypatch.setattr(ingest.BatchLog, "commit", commit)
    for _ in range(2):
        ingest.ingest_stream(spark, str(folder), broken, log, ENGINES, **options).awaitTermination(120)
        assert totals(broken) == totals(whole) != []
    key = lambda store: sorted((r["hash"], r["path"], r["bpm"]) for r in ingest.read_store(spark, store).collect())
    assert key(broken) == key(whole)
    assert ingest.BatchLog(spark, broken).commit(*[n.rsplit("-", 1) for n in [p.stem for p in (tmp_path / "broken" / "log").glob("*.json")]][0], "rows-none") is False


def test_ingest_is_idempotent_in_batch_and_stream(spark, folder, tmp_path):
    scanned = files.scan_folder(spark, str(folder))
    for _ in range(2):
        ingest.ingest_batch(scanned, str(tmp_path / "s1"), ENGINES, root=str(folder))
    batch = ingest.read_store(spark, str(tmp_path / "s1"))
    assert batch.count() == 2
    for _ in range(2):
        ingest.ingest_stream(spark, str(folder), str(tmp_path / "s2"), str(tmp_path / "cp"), ENGINES).awaitTermination(120)
    stream = ingest.read_store(spark, str(tmp_path / "s2"))
    assert sorted(r["hash"] for r in stream.collect()) == sorted(r["hash"] for r in batch.collect())


def test_short_and_failing_files_are_rows(spark, folder):
    def broken(content):
        if content == b"two":
            raise ValueError("bad")
        return 100.0

    engines = learn.Engines(ENGINES.genre, broken, ENGINES.key, lambda c: 1.0)
    rows = ingest.new_tracks(files.scan_folder(spark, str(folder)), ingest.read_store(spark, "/tmp/no-such-store"), engines, minimum=2.0, root=str(folder)).collect()
    assert sorted(r["status"] for r in rows) == ["error", "short"]


def test_text_rules(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(T.name_key(F.lit("Musique  Concrète & D'n'B"))) == "musique concrete and d n b"
    assert one(T.fold_and(F.lit("Drum & Bass"))) == "Drum n Bass" and one(T.fold_and(F.lit("drum 'n' bass"))) == "drum n bass"
    assert [one(T.year_of(F.lit(s))) for s in ("1985-01-01T00:00:00Z", "-1980.0", "-500-01-01", "x")] == [1985, 1980, -500, None]
    assert one(T.safe_name(F.lit("St. Germain"))) == "St_ Germain" and one(T.folder_name(F.lit("///"))) is None
    assert one(T.native_path(F.lit("/mnt/c/Users/x"))) == "C:\\Users\\x" and one(T.native_path(F.lit("/m/c"))) == "/m/c"
    f = one(T.search_fields(F.lit(""), F.lit(""), F.lit("Artist - Song (Foo Remix)"), F.lit("")))
    assert (f["artist"], f["title"], f["remix"]) == ("Artist", "Song", "Foo Remix")
    assert one(T.strip_html(F.lit("<b>drum &#039;n&#039;</b>\n bass &amp; x"))) == "drum 'n' bass & x"
    assert one(T.comment_text(F.lit("A"), F.lit(""))) == "A" and one(T.comment_text(F.lit(""), F.lit("n"))) == "n"


def test_annotations_and_nodes(spark, tmp_path):
    for name, body in {"1 x.txt": "Db minor\n", "2.txt": "X", "3.txt": "C# minor | E major", "4.txt": "F minor phrygian", "5.txt": "A\tmajor"}.items():
        (tmp_path / name).write_text(body)
    conf = spark.createDataFrame([("1", 2)], "id string, confidence int")
    got = {r["id"]: (r["key"], r["scale"], r["confidence"]) for r in pages.read_annotations(spark, str(tmp_path), conf).collect()}
    assert got == {"1 x": ("C#", "minor", 2), "5": ("A", "major", None)}


def test_depth_ends_on_cycles_and_takes_the_short_path(spark):
    edges = spark.createDataFrame([("a", "root"), ("b", "a"), ("c", "b"), ("c", "root"), ("a", "b"), ("x", "y"), ("y", "x")], "child string, parent string")
    assert {tuple(r) for r in R.graph_depth(edges, "root").collect()} == {("root", 0), ("a", 1), ("c", 1), ("b", 2)}
    assert {tuple(r) for r in R.field_coverage(spark.createDataFrame([(0, "", []), (None, "x", ["q"])], "d int, s string, a array<string>")).collect()} == {("d", 1), ("s", 1), ("a", 1)}
