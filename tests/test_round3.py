"""Inputs on which queries of the third round failed or left their SQL."""

import datetime as dt
import sys
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from check_queries import compare  # noqa: E402

from cratewise.operators import sequences as S  # noqa: E402


def stored(folder, name, table):
    pq.write_table(table, f"{folder}/{name}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def events(rows):
    """(user, half-day, type, value) as an ``events`` table."""
    start = dt.datetime(2024, 1, 1, 1)
    return pa.table({
        "event_id": pa.array(range(len(rows)), pa.int64()),
        "ts": pa.array([start + dt.timedelta(hours=12 * r[1], seconds=i) for i, r in enumerate(rows)], pa.timestamp("us")),
        "user_id": pa.array([r[0] for r in rows], pa.int64()),
        "event_type": [r[2] for r in rows], "value": pa.array([r[3] for r in rows], pa.float64()), "props": ["{}"] * len(rows),
    })


SLOTTED = """frame_topk salience timeline_share top_n_other pooled_winner sibling_winner hysteresis steady_siblings majority_smooth
absorb_short_runs style_runs value_at change_points""".split()


@pytest.mark.parametrize("name", SLOTTED)
def test_frames_without_energy(spark, tmp_path, name):
    """Frames whose values are all 0, alone, twice running, first, and a whole track of them."""
    rows = [(1, 0, "view", 5.0), (1, 1, "click", 0.0), (1, 2, "click", 0.0), (1, 2, "view", 0.0), (1, 3, "click", 0.0), (1, 4, "click", 0.0), (1, 5, "view", 9.0)]
    rows += [(2, 0, "error", 0.0), (2, 3, "error", 0.0), (3, 0, "signup", 0.0), (3, 1, "view", 4.0), (3, 1, "signup", 4.0), (3, 2, "view", 3.0)]
    con = stored(tmp_path, "events", events(rows))
    result, _ = compare(spark, con, str(tmp_path), name)
    assert result.startswith("ok"), result


def test_shares_round_as_the_sql_does(spark, tmp_path):
    """shares within a bit of half a thousandth, where the two ways to round differ."""
    pairs = [(a, b) for total in (2.0, 4.0, 8.0, 16.0, 20.0, 40.0) for a in (total * k / 2000 for k in range(1, 1999, 44)) for b in [total - a]]
    rows = [(u, 0, t, round(v, 4)) for u, pair in enumerate(pairs) for t, v in zip(("view", "click"), pair, strict=True)]
    con = stored(tmp_path, "events", events(rows))
    result, _ = compare(spark, con, str(tmp_path), "frame_topk")
    assert result.startswith("ok"), result


def test_empty_frames_through_chunks(spark):
    """A chunked series holds styles through frames without energy as the plain fold does."""
    nan = float("nan")
    tops = [[("a", 0.9)], [("b", nan)], [("b", nan), ("a", nan)], [("c", 0.5), ("b", 0.4)], [("a", nan)], [("a", nan)], [("c", 0.9)]] * 3
    df = spark.createDataFrame([("t", i, t) for i, t in enumerate(tops)], "k string, frame_idx long, top array<struct<style:string,score:double>>")
    whole, parts = (sorted(map(tuple, S.hysteresis(df, "k", chunk=c).collect())) for c in (1000, 3))
    assert whole == parts and whole[2][2] == "b"


def test_sharp_s_in_grades(spark, tmp_path):
    """a grade is the first four letters after upper-casing letter by letter."""
    rows = pa.table({"conv_id": [1, 1, 2, 2], "turn": [0, 1, 0, 1], "role": ["user", "assistant"] * 2, "text": ["x" * 90, "muß es", "y", "aßßb"]})
    result, _ = compare(spark, stored(tmp_path, "conversations", rows), str(tmp_path), "partial_ratings")
    assert result.startswith("ok"), result
