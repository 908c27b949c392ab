import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cratewise.plans import ranks, scan


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds half of the rows; values repeat heavily."""
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.5 else f"g{rng.randrange(20)}", rng.randrange(40) / 4, i) for i in range(4000)]
    return spark.createDataFrame(rows, "g string, v double, id long").cache()


@pytest.mark.parametrize("large", [100, 2_000_000])
@pytest.mark.parametrize("keys", [["g"], []])
def test_group_rank_equals_window(skewed, keys, large):
    got = ranks.group_rank(skewed, keys, [F.col("v"), F.col("id")], size_out="n", large=large)
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    want = skewed.withColumn("rank", F.row_number().over(part.orderBy("v", "id")).cast("long")).withColumn("n", F.count("*").over(part))
    assert sorted(map(tuple, got.select("id", "rank", "n").collect())) == sorted(map(tuple, want.select("id", "rank", "n").collect()))


@pytest.mark.parametrize("large", [5, 2_000_000])
def test_order_stats_equal_sorted_lists(skewed, large):
    picks = {**ranks.median_picks(), "p90": ranks.nearest_rank(0.9)}
    got = {r["g"]: r for r in ranks.order_stats(skewed, ["g"], "v", picks, large=large).collect()}
    groups = {}
    for r in skewed.collect():
        groups.setdefault(r["g"], []).append(r["v"])
    for g, vs in groups.items():
        vs.sort()
        n = len(vs)
        assert (got[g]["n"], got[g]["_med_lo"], got[g]["_med_hi"], got[g]["p90"]) == (n, vs[(n + 1) // 2 - 1], vs[n // 2], vs[int(0.9 * (n - 1))])


@pytest.mark.parametrize("chunk", [3, 1000])
def test_scans_cross_chunks(spark, chunk):
    values = [None, "a", None, None, "b", "b", None, None, None, "c", "c"]
    df = spark.createDataFrame([("k", i, v, i + 1) for i, v in enumerate(values)], "k string, i long, v string, x long")
    prev = {r["i"]: r["o"] for r in scan.neighbour(df, ["k"], "i", F.col("v"), "o", chunk=chunk).collect()}
    nxt = {r["i"]: r["o"] for r in scan.neighbour(df, ["k"], "i", F.col("v"), "o", step=1, chunk=chunk).collect()}
    known = {r["i"]: r["o"] for r in scan.last_known(df, ["k"], "i", F.col("v"), "o", chunk).collect()}
    total = {r["i"]: r["o"] for r in scan.running_sum(df, ["k"], "i", F.col("x"), "o", chunk).collect()}
    last = None
    for i, v in enumerate(values):
        last = v or last
        assert prev[i] == (values[i - 1] if i else None)
        assert nxt[i] == (values[i + 1] if i + 1 < len(values) else None)
        assert known[i] == last
        assert total[i] == (i + 1) * (i + 2) // 2


def test_plain_plan_when_groups_are_small(skewed):
    plan = ranks.group_rank(skewed, ["g"], [F.col("v")])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
