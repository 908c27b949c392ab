"""Links between near-equal notes, and the rows that stand for their groups."""

from collections import Counter

import brute
from test_texts import BASE, LONG, ROWS, odd, prose  # noqa: F401

from cratewise.llm import jaccard


def brute_links(rows):
    sets = [brute.shingles(t) for _, t in rows]
    return [sum(i != j and bool(s) and 100 * len(s & o) >= 80 * len(s | o) for j, o in enumerate(sets)) for i, s in enumerate(sets)]


def test_every_link_is_counted(spark):
    words = prose(9, 200).split()
    near = [(200 + k, " ".join([*words[: 5 * k], f"edit{k}", *words[5 * k :]])) for k in range(12)]  # all linked with all
    rows = [*ROWS, *near, (200, near[0][1]), (300, near[3][1].replace(" ", "\t")), (None, near[5][1])]
    notes = spark.createDataFrame(rows, "hash long, note string")
    got = Counter((r["hash"], r["n_links"]) for r in jaccard.note_classes(notes, buckets=1 << 10).collect())
    want = brute_links(rows)
    assert got == Counter((h, n) for (h, _), n in zip(rows, want, strict=True))
    assert min(want[len(ROWS) :]) == 14
    pairs = {frozenset(p) for p in jaccard.note_links(notes, buckets=1 << 10)[1].collect()}
    assert len(pairs) >= 12 * 11 / 2


def test_components_are_those_of_all_links(spark):
    notes = spark.createDataFrame(ROWS, "hash long, note string")
    every = jaccard.note_classes(notes, buckets=1 << 10).drop("n_links")
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, jaccard.note_components(notes, buckets=1 << 10).collect()))


def test_one_row_of_each_component_stays(spark, odd):  # noqa: F811
    def kept(notes):
        return sorted(((r["hash"], r["note"]) for r in jaccard.distinct_notes(notes, buckets=1 << 10).collect()), key=str)

    a, b = prose(11, 60), prose(12, 60)
    four = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b)], "hash long, note string")
    assert kept(four) == [(1, a), (2, b)]
    assert kept(odd) == sorted([(5, BASE), (5, LONG), (7, None)], key=str)
