"""Results reused by stamp and by key: what is read, what is worked out again, what a stop leaves."""

import pytest
from pyspark.sql import functions as F

from cratewise.operators import reuse

SCHEMA = "hash long, style string, score double"


class Work:
    """Best style and number of rows per key; remembers the keys it was given."""

    def __init__(self):
        self.seen = []

    def __call__(self, rows):
        self.seen.append({r[0] for r in rows.select("hash").distinct().collect()})
        return rows.groupBy("hash").agg(F.max_by("style", F.struct("score", "style")).alias("best"), F.count("*").alias("n"))


def rows_of(n, extra=()):
    return [(k, s, (k * 7 + i * 3) % 10 / 10) for k in range(n) for i, s in enumerate(["House", "Techno", "Dub"])] + list(extra)


@pytest.fixture()
def library(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(2).write.mode("overwrite").parquet(str(tmp_path / "source"))
        return read()

    def read():
        return spark.read.schema(SCHEMA).parquet(str(tmp_path / "source"))

    return write, read, str(tmp_path / "store")


def table_of(df):
    return sorted((tuple(r) for r in df.select("hash", "best", "n").collect()), key=str)


def test_unchanged_files_are_not_read(spark, library):
    write, read, store = library
    work = Work()
    first = reuse.reused(write(rows_of(40)), "hash", work, store)
    again = reuse.reused(read(), "hash", work, store)
    assert len(work.seen) == 1 and again.touched is None and again.version == first.version == 0
    assert again.rows.inputFiles() and all("/source/" not in f for f in again.rows.inputFiles())
    assert table_of(again.rows) == table_of(Work()(read()))


def test_only_edited_keys_are_worked_out_again(spark, library):
    write, read, store = library
    work = Work()
    odd = [(None, "House", None), (None, None, 0.5), (3, "House", 0.1), (3, "House", 0.1)]
    reuse.reused(write(rows_of(60, odd)), "hash", work, store)
    edited = [(k, s, v + 1 if k in range(10, 20) else v) for k, s, v in rows_of(60, odd[1:]) if k != 50]
    second = reuse.reused(write(edited + [(99, "Dub", 0.3)]), "hash", work, store)
    assert work.seen[1] == {*range(10, 20), 99, None}  # key 50 is gone, the null key lost a row
    assert {r[0] for r in second.touched.collect()} == work.seen[1]
    assert table_of(second.rows) == table_of(Work()(read()))
    assert {r["gen"] for r in second.rows.collect()} == {0, 1}
    # the same rows in other files: digests are compared, nothing is worked out
    third = reuse.reused(write(list(reversed(edited)) + [(99, "Dub", 0.3)]), "hash", work, store)
    assert work.seen[2] == set() and table_of(third.rows) == table_of(second.rows)


def test_nulls_and_repeats_are_part_of_a_digest(spark):
    def digests(*rows):
        return [r["digest"] for r in reuse.key_digests(spark.createDataFrame(rows, SCHEMA), "hash").collect()]

    cases = [[(1, None, 0.5)], [(1, "House", None)], [(1, None, None)], [(1, None, None)] * 2, [(1, "House", 0.5)], [(1, "House", 0.5)] * 2, [(1, "House", 0.5)] * 3]
    assert len({digests(*c)[0] for c in cases}) == len(cases)
    assert digests((1, "a", 0.1), (1, "b", 0.2)) == digests((1, "b", 0.2), (1, "a", 0.1))


def test_another_code_or_a_stop_before_the_end(spark, library):
    write, read, store = library

    def stops(rows):
        raise RuntimeError("stopped")

    reuse.reused(write(rows_of(5)), "hash", Work(), store)
    with pytest.raises(RuntimeError):
        reuse.reused(write(rows_of(7)), "hash", stops, store)
    work = Work()
    after = reuse.reused(read(), "hash", work, store)
    assert after.version == 1 and work.seen == [{5, 6}] and table_of(after.rows) == table_of(Work()(read()))
    reuse.reused(read(), "hash", work, store, code="2")
    assert work.seen[1] == set(range(7))


def test_many_generations_are_written_together(spark, library, monkeypatch):
    write, read, store = library
    monkeypatch.setattr(reuse, "MOST_GENERATIONS", 2)
    for n in (2, 3, 4, 5):
        kept = reuse.reused(write(rows_of(n)), "hash", Work(), store)
        assert table_of(kept.rows) == table_of(Work()(read()))
        assert len({r["gen"] for r in kept.rows.collect()}) <= 2
    empty = reuse.reused(write([]), "hash", Work(), store)
    assert empty.rows.count() == 0
