"""Operators on texts against plain versions, and their edge cases."""

import random
import re
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cratewise.llm import decontam, jaccard, licenses, mixture, quality, secrets, shards, suffixes
from cratewise.plans.guards import cut_lineage

SCHEMA = "hash long, note string, n int, sig string, spans int, hits int, rest int, whole int, row int, pos int, tokens int, score string"
EXTRA = (1, "x", 2, 3, 4, 5, 6, 7, 8, "y")


def prose(seed: int, words: int, upper: bool = False) -> str:
    rng = random.Random(seed)
    out = " ".join("".join(rng.choice("abcdeéghñ") for _ in range(rng.randint(2, 8))) for _ in range(words))
    return out.upper() if upper else out


BASE = prose(1, 120)
LONG = " ".join([prose(2, 3000), BASE, prose(3, 3000)])
ROWS = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two  Three"), (6, "One\ttwo three"), (7, BASE), (8, BASE), (9, BASE.upper()),
    (10, BASE.replace(BASE.split()[60], "zzz")), (11, LONG), (12, prose(4, 150) + " " + BASE + "\n" + prose(5, 10)), (13, "a" * 450), (14, "ab" * 300),
    (15, prose(6, 40) * 4), (16, "a" * 450), (17, "é" * 120), (18, prose(7, 300)), (19, "Released under the MIT License."), (20, "token: '" + "k" * 9 + "'"),
]
for _k in range(40):  # near copies that are only near to their origin
    _w = prose(8, 100).split()
    _w[(_k * 13) % 100] = f"edit{_k}"
    _w[(_k * 29 + 7) % 100] = f"more{_k}"
    ROWS.append((100 + _k, " ".join(_w)))


@pytest.fixture(scope="module")
def notes(spark):
    return cut_lineage(spark.createDataFrame([(h, t, *EXTRA) for h, t in ROWS], SCHEMA))


@pytest.fixture(scope="module")
def odd(spark):
    """Null keys, rows that repeat a key or repeat whole."""
    rows = [(None, BASE), (None, LONG), (5, BASE), (5, LONG), (5, LONG), (6, LONG), (7, None), (7, None)]
    return cut_lineage(spark.createDataFrame([(h, t, *EXTRA) for h, t in rows], SCHEMA))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_classes_equal_brute_force(notes):
    got = {r["hash"]: (r["n_shingles"], r["component_id"]) for r in jaccard.note_classes(notes, buckets=1 << 10).collect()}
    assert got == brute.note_classes(ROWS)
    kept = {r["hash"] for r in jaccard.distinct_notes(notes, buckets=1 << 10).collect()}
    assert kept == {h for h, (_, c) in got.items() if h == c}


def test_classes_of_odd_and_empty_tables(odd, empty):
    assert jaccard.note_classes(odd, buckets=1 << 10).count() == odd.count()
    assert jaccard.note_classes(empty, buckets=1 << 10).count() == 0


def test_order_is_one_order_whatever_the_counts():
    grams = np.arange(1, 2000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = jaccard.Order(np.bincount(np.arange(64) % 7, minlength=64) * 3, 8)
    assert len(set(order.keys(grams).tolist())) == len(grams)
    assert (np.diff(order.cuts.astype(float)) >= 0).all()


def test_passages_equal_brute_force(notes):
    cut = suffixes.without_repeats(notes)
    got = {
        r["hash"]: (r["b"], r["gone"] or 0, r["k"], r["digest"]) for r in cut.select(
            "hash", F.octet_length(F.coalesce("note", F.lit(""))).alias("b"), F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["e"] - s["s"]).alias("gone"),
            F.size("spans").alias("k"), F.sha2("kept", 256).alias("digest"),
        ).collect()
    }
    assert got == brute.passages(ROWS)


def test_passages_of_odd_and_empty_tables(odd, empty):
    rows = suffixes.without_repeats(odd).collect()
    assert len(rows) == odd.count()
    left = {(r["hash"], zlib.crc32((r["note"] or "").encode())): len(r["kept"]) for r in rows}
    # the null key comes first: of its two notes one is whole, the other lacks what both hold
    assert left[(None, zlib.crc32(LONG.encode()))] + left[(None, zlib.crc32(BASE.encode()))] in (
        len(LONG.encode()), len(LONG.replace(BASE, "").encode()) + len(BASE.encode())
    )
    assert left[(6, zlib.crc32(LONG.encode()))] == 0
    assert suffixes.without_repeats(empty).count() == 0


ITEMS = [(1, " ".join(BASE.split()[20:45])), (2, "One, TWO three"), (3, None), (4, "--"), (None, " ".join(LONG.split()[:12])), (10, " ".join(BASE.split()[30:41]))]


def brute_hits(text, items):
    w, hit, found = brute.words(text), set(), set()
    for key, t in items:
        v = brute.words(t)
        size = min(len(v), 10)
        wins = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if v else set()
        for i in range(len(w) - size + 1):
            if size and tuple(w[i : i + size]) in wins:
                hit.update(range(i, i + size))
                found.add(key)
    return len(w), len(hit), sorted(str(k) for k in found if k is not None), hit


def test_contamination_equals_brute_force(spark, notes, odd, empty):
    items = spark.createDataFrame(ITEMS, "item long, text string")
    got = {r["hash"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontam.contaminated_notes(notes, items).collect()}
    assert got == {h: brute_hits(t, ITEMS)[:3] for h, t in ROWS}
    assert decontam.contaminated_notes(odd, items).count() == odd.count()
    assert decontam.contaminated_notes(empty, items).count() == 0
    none = decontam.contaminated_notes(notes, items.limit(0))
    assert none.where("n_hit > 0").count() == 0 and none.count() == len(ROWS)


def test_clean_notes_drop_documents_or_spans(spark, notes):
    items = spark.createDataFrame(ITEMS, "item long, text string")
    kept = {r["hash"] for r in decontam.clean_notes(notes, items).collect()}
    assert kept == {h for h, t in ROWS if not brute_hits(t, ITEMS)[1]}
    cut = {r["hash"]: r["note"] for r in decontam.clean_notes(notes, items, action="span").collect()}
    for h, t in ROWS:
        hit = brute_hits(t, ITEMS)[3]
        assert brute.words(cut[h]) == [w for i, w in enumerate(brute.words(t)) if i not in hit]


def test_secrets_equal_brute_force(spark, empty):
    texts = [
        None, "", "password=abcdefgh1 é api_key: 'short' Token= \"abcdefghij\"", "AKIA" + "Q" * 12, "AKIA" + "Q" * 11, "f" * 31 + " " + "0" * 32,
        "ToKeN:=x secret==y passwd = 12345678", "é" * 50 + "a1" * 20 + " -----BEGIN RSA PRIVATE KEY-----", LONG + " secret=" + "z" * 20, "ghp_" + "a" * 36,
    ]
    found = secrets.found_secrets(spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "hash int, response_json string")).collect()
    assert len(found) == 2 * len(texts)
    for r in found:
        base = [s for s in r["secrets"] if s["kind"] in secrets.BASE]
        want = brute.secrets(r["response_json"])
        assert tuple(sum(s["kind"] == k for s in base) for k in secrets.BASE) == want[:3]
        assert brute.hashlib.sha256(",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in base).encode()).hexdigest() == want[3]
    kinds = {s["kind"] for r in found for s in r["secrets"]}
    assert {"pem", "github"} <= kinds
    masked = secrets.without_secrets(spark.createDataFrame([("a password=abcdefgh1 b",)], "response_json string")).first()[0]
    assert masked == "a [removed] b"
    assert secrets.found_secrets(empty.withColumnRenamed("note", "response_json")).count() == 0


def test_trigram_queries_are_mandatory():
    assert secrets.trigram_query("[0-9a-f]+") == []
    assert secrets.trigram_query("AKIA[A-Z]+") == [[frozenset({"aki", "kia"})]]
    assert secrets.trigram_query("(abc|defg)x?") == [[frozenset({"abc"}), frozenset({"abc", "bcx"}), frozenset({"def", "efg"}), frozenset({"def", "efg", "fgx"})]]
    assert secrets.trigram_query("ab|c") == []


def test_licenses_equal_brute_force(spark, empty):
    texts = [
        None, "", "MIT License", "the mit-license, CC BY-NC 4.0 and cc\nby", "GNU General Public License Apache License", "mit licenses", LONG + " MIT License",
        "This work is licensed under the GNU General Public License, version 3.", "licensed under GNU General Public License",
        "Licensed under the Apache License, Version 2.0.", "Released under the terms of the MIT License", "Released under terms of MIT License",
    ]
    rows = licenses.licensed_notices(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "name int, notice string, found int")).collect()
    for r in rows:
        base = r["found"]["base"]
        starts = [p["start"] for p in base]
        got = (r["found"]["n_words"], len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({p["label"] for p in base})))
        assert got == brute.licenses(r["notice"])
    more = {r["name"]: [m["label"] for m in r["found"]["matches"]] for r in rows}
    assert more[7] == ["gpl-notice"] and more[8] == [] and more[9] == ["apache-notice"] and more[10] == ["mit-notice"] and more[11] == []
    assert licenses.licensed_notices(empty.withColumnRenamed("note", "notice")).count() == 0


def test_template_regions():
    a = licenses.compile_template("t", 'by <<var;name="who";match="[a-z]+">> under<<beginOptional>> the <<beginOptional>>old <<endOptional>>terms<<endOptional>> ok')

    def took(text):
        return a.longest([w.encode() for w in text.split()])

    assert took("by jo under ok") == 4 and took("by jo k under the terms ok") == 7 and took("by jo under the old terms ok x") == 7
    assert took("by under ok") == 0 and took("by jo under old terms ok") == 0 and took("by 12 under ok") == 0
    with pytest.raises(ValueError):
        licenses.compile_template("t", "<<beginOptional>>all of it<<endOptional>>")


def test_forest_learns_and_handles_poor_data():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    forest = quality.boost(x[:1500], y[:1500], trees=40)
    assert ((forest.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.93
    assert quality.boost(np.zeros((0, 3)), np.zeros(0)).score(x).tolist() == [0.5] * len(x)
    assert quality.boost(x[:5], np.ones(5)).score(x[:1])[0] > 0.8


def test_statistics_of_odd_texts():
    s = quality.statistics(pa.array([None, "", "one one\none one", LONG, "é"]))
    assert s.shape == (5, len(quality.FEATURES)) and np.isfinite(s).all()
    assert not s[0].any() and not s[1].any()
    named = dict(zip(quality.FEATURES, s[2], strict=True))
    assert named["echoes"] == 0.75 and named["repeated_lines"] == 0.5 and named["distinct_words"] == 0.25


def test_grading_keeps_held_out_labels_unseen(spark, empty):
    texts = [(i, prose(i, 60) if i % 2 else prose(i, 5, True) + "!! " * 30) for i in range(300)]
    notes = cut_lineage(spark.createDataFrame([*texts, (None, None), (7, texts[7][1])], "hash long, note string"))
    truth = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(None, 1), (5000, 0), (9, None)], "hash long, keep int")
    wrong = truth.withColumn("keep", F.when(quality.held_out(F.col("hash")), 1 - F.col("keep")).otherwise(F.col("keep")))
    scores = [sorted((str(r["hash"]), r["score"]) for r in quality.graded_notes(notes, quality.train_quality(notes, g)).collect()) for g in (truth, wrong)]
    assert scores[0] == scores[1] and len(scores[0]) == 302
    got = {r["hash"]: r["predicted"] for r in quality.graded_notes(notes, quality.train_quality(notes, truth)).collect() if r["hash"] is not None}
    assert sum(got[i] == i % 2 for i in range(300)) > 290
    assert quality.graded_notes(empty, quality.train_quality(empty, truth)).count() == 0
    assert [bool(zlib.crc32(str(i).encode()) % 3 == 1) for i in range(9)] == [r[0] for r in spark.range(9).select(quality.held_out(F.col("id"))).collect()]


def test_shards_are_even_gapless_and_stable(spark, notes, odd, empty):
    tracks = cut_lineage(spark.range(3000).select(F.col("id").alias("hash"), F.repeat(F.lit("é"), (F.col("id") % 97).cast("int")).alias("payload"), F.lit(1).alias("slot")))
    rows = shards.shard_tracks(tracks, shards=7, slots=512).collect()
    sums = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(7)]
    assert len(rows) == 3000 and max(sums) - min(sums) <= 2 * max(r["size"] for r in rows)
    for s in range(7):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert all(r["size"] == 8 + 2 * (r["hash"] % 97) and r["crc"] == zlib.crc32(("é" * (r["hash"] % 97)).encode()) for r in rows)
    placed, maps = shards.balanced_map(tracks, 7, 512)
    now = maps.where("version = 1").select("version", "vslot", "shard")
    grown = shards.edited_map(now, shards.slot_loads(placed, 512), 8)
    moved = now.join(grown.select("vslot", F.col("shard").alias("to")), "vslot").where("shard <> to")
    assert 0 < moved.count() < 512 / 3 and grown.first()["version"] == 2
    fewer = shards.edited_map(now, shards.slot_loads(placed, 512), 5)
    assert fewer.where("shard >= 5").count() == 0 and fewer.count() == 512
    for df in (notes, odd, empty):
        assert shards.shard_tracks(df.withColumnRenamed("note", "payload"), shards=3, slots=64).count() == df.count()


def test_budgets_go_to_siblings_before_ancestors():
    held = {("web", "en"): 100, ("web", "de"): 1000, ("book", "en"): 1000}
    assert mixture.leaf_budgets(held, {}, 600, 1) == {("web", "en"): 100, ("web", "de"): 200, ("book", "en"): 300}
    assert mixture.leaf_budgets(held, {("web",): 3}, 1600, 1) == {("web", "en"): 100, ("web", "de"): 1000, ("book", "en"): 500}
    assert mixture.leaf_budgets(held, {("web", "de"): 0}, 600, 2) == {("web", "en"): 200, ("web", "de"): 0, ("book", "en"): 400}
    assert mixture.leaf_budgets({}, {}, 10, 1) == {}


def test_mixture_takes_prefixes_of_seeded_epochs(spark, odd, empty):
    texts = [(i, "w " * (i % 13), ("en", "de", None)[i % 3], f"s{i % 2}") for i in range(400)] + [(None, None, None, None), (3, "w w w", "en", "s1")]
    tracks = cut_lineage(spark.createDataFrame(texts, "hash long, note string, lang string, source string"))
    weights = {("en",): 3.0, ("de",): 1.0}
    rows = mixture.mixed(tracks, ("lang", "source"), weights, share=0.9, epochs=2).collect()
    assert len(rows) == len(texts)
    held: dict = {}
    for h, t, lang, source in texts:
        held[(lang or "", source or "")] = held.get((lang or "", source or ""), 0) + len((t or "").split())
    goal = mixture.leaf_budgets(held, weights, 0.9 * sum(held.values()), 2)
    for leaf, n in held.items():
        whole, rest = divmod(goal[leaf], n) if n else (0, 0)
        mine = [r for r in rows if (r["lang"] or "", r["source"] or "") == leaf]
        order = {r["h"]: r["o"] for r in spark.createDataFrame([(r["hash"],) for r in mine], "h long").select("h", F.xxhash64(F.lit(17), F.lit(whole).cast("long"), "h").alias("o")).collect()}
        total = 0
        for r in sorted(mine, key=lambda r: (order[r["hash"]] % 2**64, r["tokens"])):
            total += r["tokens"]
            assert r["tokens"] == len((r["note"] or "").split())
            assert r["copies"] == whole + (total <= rest and rest > 0)
    taken = mixture.taken(mixture.mixed(tracks, ("lang", "source"), weights, share=0.9, epochs=2))
    assert taken.count() == sum(r["copies"] for r in rows) and taken.columns == tracks.columns
    for df in (odd, empty):
        assert mixture.mixed(df, ("sig",), {}, share=0.5, epochs=1).count() == df.count()


def test_words_match_their_pattern():
    assert re.findall(decontam.WORDS, "a_b 9ñ") == ["a", "b", "9ñ"]
