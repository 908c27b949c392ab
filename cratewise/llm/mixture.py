"""Mixing a library to target weights by hierarchical budgets.

Weights are set on a tree, such as archgenre, keystone, style for tracks or domain,
language, source for texts. A token budget flows down it: every node parts its budget
among its children by weight, what a child cannot use goes to its siblings, and only
what a whole family cannot use goes to the families beside it.
"""

from __future__ import annotations

import json
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.guards import cut_lineage, fetch_bounded

MAX_LEAVES = 100_000
BUCKETS = 4096


def shares(budget: float, weights: dict[str, float], room: dict[str, float]) -> dict[str, float]:
    """``budget`` parted by ``weights``, no child above its ``room``; shortages go to siblings."""
    given = dict.fromkeys(room, 0.0)
    # those that fill first come first; what they leave is for the ones after them
    order = sorted((c for c in room if room[c] > 0 and weights.get(c, 0) > 0), key=lambda c: (room[c] / weights[c], c))
    left = min(budget, sum(room[c] for c in order))
    rest = list(accumulate((weights[c] for c in reversed(order)), initial=0.0))[:0:-1]
    for c, total in zip(order, rest, strict=True):
        given[c] = min(room[c], left * weights[c] / total)
        left = max(left - given[c], 0.0)
    return given


def leaf_budgets(tokens: dict[tuple, int], weights: dict[tuple, float], budget: float, epochs: int) -> dict[tuple, int]:
    """Tokens each leaf is to give. ``tokens`` maps a leaf's path to what it holds.

    ``weights`` maps a path, or the beginning of one, to its weight among its siblings;
    one that is missing weighs 1, and 0 leaves the whole branch out.
    """
    room: dict[tuple, dict[str, float]] = {}  # of every node, what each child can give
    for path, held in tokens.items():
        usable = all(weights.get(path[: k + 1], 1.0) > 0 for k in range(len(path)))
        for k, child in enumerate(path):
            kids = room.setdefault(path[:k], {})
            kids[child] = kids.get(child, 0.0) + (held * epochs if usable else 0.0)
    out: dict[tuple, int] = {}
    open_ = [((), budget)] if tokens else []
    while open_:
        prefix, amount = open_.pop()
        if prefix in tokens:
            out[prefix] = int(amount + 1e-6)
            continue
        kids = room[prefix]
        open_ += [((*prefix, c), given) for c, given in shares(amount, {c: weights.get((*prefix, c), 1.0) for c in kids}, kids).items()]
    return out


def tokens_in(text: Column) -> Column:
    """Words parted by blanks; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def mixed(
    tracks: DataFrame, levels: tuple[str, ...] = ("archgenre", "keystone", "style"), weights: dict[tuple, float] | None = None,
    share: float = 0.8, epochs: int = 2, seed: int = 17,
) -> DataFrame:
    """``tracks`` with ``tokens`` and ``copies``: how often each is taken to meet the mixture.

    ``tracks`` is (hash, note), the columns named by ``levels`` from the top of the tree
    down, and any others; all are returned, but columns of the names ``tokens``,
    ``copies``, ``_leaf``, ``_whole``, ``_rest``, ``_end``, ``_before``, ``_at``, ``_bucket``
    are replaced or left out. The budget is
    ``share`` of all tokens. A leaf is read for at most ``epochs`` epochs, each in a
    seeded order of its own: whole epochs as often as its budget holds them, then the
    longest beginning of the next epoch's order that fits in the rest.

    * A null level is the leaf named ''. A null hash is ordered like any other key.
    * A null note has no tokens; it is taken with its place in the order, costing nothing.
    * Rows that repeat are each counted and ordered side by side.
    * An empty table gives no rows. Up to MAX_LEAVES leaves; more are an error.

    The order of a leaf is cut into BUCKETS ranges. Their sums, at most leaves times
    BUCKETS rows, say which one the budget ends in; only that range is sorted, so a leaf
    that holds a third of all rows is one task's work nowhere.
    """
    spark = tracks.sparkSession
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in levels]
    leaf = F.to_json(F.array(*text))  # one text per path, whatever its levels hold
    keyed = tracks.drop("tokens", "copies", "_whole", "_rest", "_end", "_before", "_at", "_bucket").withColumn("_leaf", leaf)
    narrow = cut_lineage(keyed.select("hash", "_leaf", tokens_in(F.col("note")).alias("tokens")))
    rows = fetch_bounded(narrow.groupBy("_leaf").agg(F.sum("tokens").alias("n")), MAX_LEAVES)
    if rows is None:
        raise ValueError(f"the tree has more than {MAX_LEAVES} leaves")
    names = {tuple(json.loads(r["_leaf"])): r["_leaf"] for r in rows}
    held = {tuple(json.loads(r["_leaf"])): r["n"] for r in rows}
    goal = leaf_budgets(held, weights or {}, share * sum(held.values()), epochs)
    plan = [(names[p], *(divmod(goal[p], n) if n else (0, 0))) for p, n in sorted(held.items())]
    plan = spark.createDataFrame(plan, "_leaf string, _whole long, _rest long")

    def ordered(df: DataFrame, plans: DataFrame) -> DataFrame:
        place = F.xxhash64(F.lit(seed), "_whole", "hash")
        return df.join(F.broadcast(plans), "_leaf").withColumn("_at", place).withColumn("_bucket", F.shiftrightunsigned("_at", 52))

    sums = cut_lineage(ordered(narrow, plan).groupBy("_leaf", "_bucket", "_rest").agg(F.sum("tokens").alias("n")))
    upto = F.sum("n").over(Window.partitionBy("_leaf").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    ends = sums.withColumn("upto", upto).where("upto > _rest").groupBy("_leaf").agg(F.min(F.struct("_bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("e"))
    cuts = cut_lineage(plan.join(ends, "_leaf", "left").select(
        "_leaf", "_whole", "_rest", F.coalesce("e._bucket", F.lit(BUCKETS)).alias("_end"), F.coalesce("e.before", F.lit(0)).alias("_before")
    ).coalesce(1))
    placed = ordered(keyed, cuts)
    inside = placed.where("_bucket <> _end").withColumn("tokens", tokens_in(F.col("note"))).withColumn(
        "copies", F.col("_whole") + ((F.col("_bucket") < F.col("_end")) & (F.col("_rest") > 0)).cast("long")
    )
    run = Window.partitionBy("_leaf").orderBy("_at", "hash", F.xxhash64("note")).rowsBetween(Window.unboundedPreceding, 0)
    last = placed.where("_bucket = _end").withColumn("tokens", tokens_in(F.col("note"))).withColumn(
        "copies", F.col("_whole") + ((F.col("_before") + F.sum("tokens").over(run) <= F.col("_rest")) & (F.col("_rest") > 0)).cast("long")
    )
    return inside.unionByName(last).drop("_leaf", "_whole", "_rest", "_end", "_before", "_at", "_bucket")


def taken(mixture: DataFrame) -> DataFrame:
    """The rows of :func:`mixed`, each as often as its ``copies`` say, without the two added columns."""
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy")
    return mixture.where("copies > 0").select("*", each).drop("_copy", "copies", "tokens")
