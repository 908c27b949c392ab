"""Profile queries: ``lineitem`` x ``part`` as tracks (type keystone, brand subgenre, quantity tempo)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..operators import profiles
from ..plans.ranks import group_rank
from .registry import query, table

TRACKS = "t AS (SELECT p_type AS keystone, p_brand AS subgenre, l_quantity AS bpm FROM lineitem JOIN part ON l_partkey = p_partkey)"
CANONICAL = {"ECONOMY": (48, 54), "LARGE": (11, 14), "MEDIUM": (20, 30)}
CANON_SQL = "canon AS (SELECT * FROM (VALUES ('ECONOMY', 48.0, 54.0), ('LARGE', 11.0, 14.0), ('MEDIUM', 20.0, 30.0)) v(keystone, clo, chi))"


def _stats(group: str, source: str, value: str = "bpm") -> str:
    """Tempo statistics in SQL: sorted list, exclusive deciles, half-even rounding."""
    dec = lambda i: (
        f"(l[greatest(1, least((n + 1) * {i} // 10, n - 1))] * (10 - ((n + 1) * {i} - 10 * greatest(1, least((n + 1) * {i} // 10, n - 1)))) + "
        f"l[greatest(1, least((n + 1) * {i} // 10, n - 1)) + 1] * ((n + 1) * {i} - 10 * greatest(1, least((n + 1) * {i} // 10, n - 1)))) / 10"
    )
    return f"""l AS (SELECT {group}, list_sort(list({value})) AS l, count(*) AS n FROM {source} WHERE {value} > 0 GROUP BY {group}),
stats AS (SELECT {group}, n, round_even((l[(n + 1) // 2] + l[n // 2 + 1]) / 2, 0)::BIGINT AS median, round_even(l[1], 0)::BIGINT AS lo, round_even(l[n], 0)::BIGINT AS hi,
 round_even(CASE WHEN n >= 10 THEN {dec(1)} ELSE l[1] END, 0)::BIGINT AS p10, round_even(CASE WHEN n >= 10 THEN {dec(9)} ELSE l[n] END, 0)::BIGINT AS p90 FROM l)"""


def _tracks(spark, d):
    parts = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("keystone"), F.col("p_brand").alias("subgenre"))
    return table(spark, d, "lineitem").select("l_partkey", F.col("l_quantity").alias("bpm")).join(parts, F.col("l_partkey") == F.col("p_partkey"))


@query(f"""WITH {TRACKS}, {_stats('keystone', 't')}, {CANON_SQL}, c AS (SELECT keystone, count(*) AS count, count(DISTINCT subgenre) AS subgenres FROM t GROUP BY 1)
SELECT keystone, count, 0::BIGINT AS self_count, subgenres, n, median, lo, hi, p10, p90, round_even(count / (SELECT count(*) FROM t), 4) AS share,
 CASE WHEN (clo + chi) / 2 / median BETWEEN 1.7 AND 2.3 THEN 'half' WHEN median / ((clo + chi) / 2) BETWEEN 1.7 AND 2.3 THEN 'double' END AS octave_flag
FROM c JOIN stats USING (keystone) LEFT JOIN canon USING (keystone)""")
def keystone_profile(spark, d):
    """Count, share, subgenres, robust tempo and octave flag per keystone (A3, A4, A5)."""
    return profiles.keystone_profile(_tracks(spark, d), dims.canonical_bpm_dim(spark, CANONICAL))


@query(f"WITH {TRACKS}, {_stats('keystone, subgenre', 't')}, c AS (SELECT keystone, subgenre, count(*) AS count FROM t GROUP BY ALL) SELECT * FROM c JOIN stats USING (keystone, subgenre)")
def subgenre_profile(spark, d):
    """Count and tempo per subgenre (A3, A4)."""
    return profiles.subgenre_profile(_tracks(spark, d))


@query(f"WITH {_stats('o_orderpriority', 'orders', 'o_totalprice')} SELECT * FROM stats")
def exclusive_deciles(spark, d):
    """Median, extremes and exclusive deciles by group (A4)."""
    return profiles.tempo_stats(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice")


ROLL = """p AS (SELECT r_name AS family, n_name AS keystone, count(*) AS count FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)"""


@query(f"""WITH {ROLL} SELECT family, sum(count)::BIGINT AS count, round_even(sum(count) / (SELECT sum(count) FROM p), 4) AS share,
 string_agg(keystone, ', ' ORDER BY count DESC, keystone) AS keystones FROM p GROUP BY family""")
def nation_region_rollup(spark, d):
    """Family totals with their keystones, largest first."""
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    counts = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("count"))
    rows = counts.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("r_name").alias("family"), F.col("n_name").alias("keystone"), "count")
    return profiles.group_rollup(rows, "family")


@query("""WITH r AS (SELECT p_type, p_partkey, p_retailprice, p_size, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_size DESC, p_partkey)::INT AS rank FROM part)
SELECT p_type, p_partkey, p_retailprice AS share, p_size AS confidence, rank FROM r WHERE rank <= 5""")
def representative_tracks(spark, d):
    """The five most representative rows per group."""
    rows = table(spark, d, "part").select("p_type", "p_partkey", F.col("p_retailprice").alias("share"), F.col("p_size").alias("confidence"))
    return profiles.top_tracks(rows, ["p_type"], "p_partkey")


MAJORITY = """c AS (SELECT c_mktsegment, r_name AS family, count(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
f AS (SELECT family, sum(c) AS size FROM c GROUP BY 1),
m AS (SELECT c_mktsegment, family AS parent, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c DESC, size DESC, family DESC) AS n, sum(c) OVER (PARTITION BY c_mktsegment)::BIGINT AS count FROM c JOIN f USING (family))"""


def _segments(spark, d):
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("family"))
    return table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))


@query(f"WITH {MAJORITY} SELECT c_mktsegment, parent, count FROM m WHERE n = 1")
def majority_parent(spark, d):
    """The one family each style hangs under."""
    return profiles.majority_parent(_segments(spark, d), "c_mktsegment", "family")


@query(f"WITH {MAJORITY} SELECT parent, sum(count)::BIGINT AS count, 0::BIGINT AS self_count, count(*) AS leaves FROM m WHERE n = 1 GROUP BY 1")
def genre_tree(spark, d):
    """Tracks and leaves under each parent once styles have one parent."""
    return profiles.tree_groups(_segments(spark, d), "c_mktsegment", "family")


@query("""WITH b AS (SELECT p_brand, count(*) AS c, max(p_name) AS description FROM part GROUP BY 1)
SELECT count(*) AS groups, sum(c)::BIGINT AS members, max(c) AS largest_count, count(*) FILTER (trim(description) <> '') AS described,
 (SELECT p_brand FROM b ORDER BY c DESC, p_brand LIMIT 1) AS largest, round(max(c) / sum(c), 4) AS largest_share FROM b""")
def summary_card(spark, d):
    """Totals, largest group and described count."""
    return profiles.summary_card(table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("count"), F.max("p_name").alias("description")), "p_brand")


@query("""SELECT c_custkey, count(o_orderkey) AS count, CASE WHEN count(o_orderkey) = 0 THEN 'empty' WHEN count(o_orderkey) < 10 THEN 'growing' ELSE 'solid' END AS state
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def size_states(spark, d):
    """How full each group is, empty ones included."""
    counts = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("count"))
    joined = table(spark, d, "customer").select("c_custkey").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("count", F.lit(0)).alias("count"), profiles.size_state(F.col("count")).alias("state"))


@query("SELECT l_orderkey, min(p_brand) AS p_brand FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def first_membership(spark, d):
    """Each track's first group by name."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return profiles.first_membership(rows, "l_orderkey", "p_brand")


BANDS = """l AS (SELECT p_type, list_sort(list(p_retailprice)) AS l, count(*) AS n FROM part GROUP BY 1),
b AS (SELECT p_partkey, part.p_type, p_retailprice, (p_retailprice > l[(floor(0.2 * (n - 1)) + 1)::INT])::INT + (p_retailprice > l[(floor(0.4 * (n - 1)) + 1)::INT])::INT
 + (p_retailprice > l[(floor(0.6 * (n - 1)) + 1)::INT])::INT + (p_retailprice > l[(floor(0.8 * (n - 1)) + 1)::INT])::INT AS band FROM part JOIN l USING (p_type))"""


@query(f"WITH {BANDS} SELECT p_partkey, band FROM b")
def quantile_bands(spark, d):
    """Five bands by nearest-rank cuts within each group."""
    return profiles.quantile_bands(table(spark, d, "part").select("p_partkey", "p_type", "p_retailprice"), ["p_type"], "p_retailprice").select("p_partkey", "band")


@query(f"WITH {BANDS} SELECT p_type, band, count(*) AS count, floor(min(p_retailprice) + 0.5)::BIGINT || '-' || floor(max(p_retailprice) + 0.5)::BIGINT AS label FROM b GROUP BY ALL")
def band_labels(spark, d):
    """Size and value range of each band."""
    banded = profiles.quantile_bands(table(spark, d, "part").select("p_partkey", "p_type", "p_retailprice"), ["p_type"], "p_retailprice")
    return profiles.band_labels(banded, ["p_type"], "p_retailprice")


@query("SELECT (p_size // 10) * 10 || '-' || ((p_size // 10) * 10 + 9) || ' BPM' AS label, count(*) AS count FROM part GROUP BY 1")
def grouped_listing(spark, d):
    """A listing grouped by tempo decade (L2)."""
    return profiles.grouped_listing(table(spark, d, "part").select(F.col("p_size").alias("bpm")), "bpm_band")


@query("SELECT row_number() OVER (ORDER BY p_size // 10, lower(p_name), p_partkey) AS place, p_partkey FROM part")
def library_order(spark, d):
    """Place of every row in the sorted, grouped library (L1), ranked without one global sort task."""
    rows = table(spark, d, "part").select("p_partkey", "p_name", F.col("p_size").alias("bpm"))
    order = [F.floor(F.col("bpm") / 10), F.lower("p_name"), F.col("p_partkey")]
    return group_rank(rows, [], order, out="place").select("place", "p_partkey")
