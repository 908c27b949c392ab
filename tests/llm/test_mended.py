"""Cases that were wrong once: regions of any length, odd names and keys, workers without the package."""

import os
import subprocess
import sys
import time
from pathlib import Path

import pytest
from test_texts import BASE, prose

from cratewise.llm import jaccard, licenses, mixture, quality


def plain_longest(words, steps, jumps, start):
    """Where the longest accepted reading stops, by following every reading."""
    best, now, final = -1, {(s, start) for s in jumps[0]}, len(steps) - 1
    seen = set()
    while now:
        s, i = now.pop()
        if (s, i) in seen:
            continue
        seen.add((s, i))
        best = max(best, i) if s == final else best
        for test, to in steps[s]:
            if i < len(words) and licenses._accepts(test, words[i]):
                now |= {(t, i + 1) for t in jumps[to]}
    return best


@pytest.mark.parametrize("markup", [
    'by <<var;name="holder";match="[a-z]+">> all rights reserved', 'a <<beginOptional>>b <<var;name="x";match="[ab]+">> <<endOptional>>c',
    'x <<var;name="x";match="x|y">> <<var;name="y";match="y|z">><<beginOptional>> z<<endOptional>>',
])
def test_readings_are_the_longest_whatever_their_length(markup):
    import random

    rng = random.Random(2)
    automaton = licenses.compile_template("t", markup)
    pool = [b"by", b"all", b"rights", b"reserved", b"a", b"b", b"c", b"x", b"y", b"z"]
    for n in (0, 1, 5, 60):
        for _ in range(30):
            words, reach = [rng.choice(pool) for _ in range(n)], {}
            for i in range(n + 1):
                assert automaton.stop(words.__getitem__, i, n, reach) == plain_longest(words, automaton.steps, automaton.jumps, i)


def test_a_holder_of_forty_words_is_read(spark):
    template = {"rights": 'by <<var;name="holder";match="[a-z]+">> all rights reserved'}
    rows = [(n, "Made by " + " ".join(f"name{chr(97 + i % 26)}" for i in range(n)) + " all rights reserved.") for n in (0, 1, 12, 13, 40, 5000)]
    found = licenses.licensed_notices(spark.createDataFrame(rows, "name int, notice string"), templates=template).collect()
    assert {r["name"]: [(m["start"], m["end"]) for m in r["found"]["matches"]] for r in found} == {
        n: [(1, n + 5)] if n else [] for n, _ in rows
    }


def test_many_leaves_are_budgeted_quickly():
    held = {(f"a{i % 10}", f"k{i % 5000}", f"s{i}"): 1 + i % 7 for i in range(100_000)} | {("flat", "f", f"x{i}"): 1 + i % 11 for i in range(50_000)}
    start = time.time()
    got = mixture.leaf_budgets(held, {("a1",): 3.0}, 0.5 * sum(held.values()), 1)
    assert time.time() - start < 10
    assert sum(got.values()) <= 0.5 * sum(held.values()) + 1 and all(got[p] <= held[p] for p in held)


def test_levels_may_hold_any_character(spark):
    rows = [(1, "one two", "y\x1fz", "q"), (2, "three four", "y", "z\x1fq"), (3, "five", None, '"],["'), (4, "six", "", "x")]
    df = spark.createDataFrame(rows, "hash int, note string, a string, b string")
    got = mixture.mixed(df, ("a", "b"), {}, share=1.0, epochs=1).collect()
    assert sorted((r["hash"], r["copies"]) for r in got) == [(1, 1), (2, 1), (3, 1), (4, 1)]


def test_columns_of_any_name_and_blank_notes_without_a_key_stay(spark):
    text = prose(31, 60)
    rows = [(1, text, "a", 1, "p"), (2, text, "b", 2, "q"), (1, text, "a", 1, "p"), (None, "", "c", 3, "r"), (None, " ", "d", 4, "s"), (None, None, "e", 5, "t"), (4, " ", "f", 6, "u"), (4, " ", "f", 6, "u")]
    notes = spark.createDataFrame(rows, "hash long, note string, _h string, _s int, _place string")
    kept = sorted(map(tuple, jaccard.distinct_notes(notes, buckets=1 << 10).collect()), key=str)
    assert kept == sorted([rows[0], rows[3], rows[4], rows[5], rows[6]], key=str)


def test_a_key_with_many_notes_is_learnt_once(spark):
    good, bad = BASE, "x!!! " * 40
    rows = [(i, good if i % 2 else bad) for i in range(60)] + [(1, f"{good} {k}") for k in range(300)]
    notes = spark.createDataFrame(rows, "hash long, note string")
    grades = spark.createDataFrame([(i, i % 2) for i in range(60)], "hash long, keep int")
    forest = quality.train_quality(notes, grades, most=40)
    scored = quality.graded_notes(notes, forest).where("hash > 1").collect()
    assert all(r["predicted"] == r["hash"] % 2 for r in scored)


def test_workers_need_no_copy_of_the_package(tmp_path):
    root = Path(__file__).resolve().parents[2]
    script = f"""
import sys
sys.path.insert(0, {str(root)!r})
from cratewise.session import build_session
from cratewise.llm import jaccard, minhash
spark = build_session(master="local[2]", spark__sql__shuffle__partitions="2", spark__ui__enabled="false")
text = " ".join(f"w{{i}}" for i in range(50))
notes = spark.createDataFrame([(1, text), (2, text + " more"), (3, "other words")], "hash long, note string")
print(sorted(r["component_id"] for r in jaccard.note_classes(notes, buckets=1 << 10).collect()), sum(r["kept"] for r in minhash.near_copies(notes).collect()))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "[1, 1, 3] 2" in done.stdout, done.stderr[-2000:]
