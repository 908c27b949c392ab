"""Genre heads: inference, re-labelling, training and evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..plans.guards import cut_lineage
from ..plans.ranks import group_rank

READ_LENGTH = 8
EXAMPLES = 25


@dataclass
class Head:
    """A trained head: standardise, ReLU layer, softmax. Bounded parameters, shipped with the task."""

    mu: list
    sigma: list
    w1: list
    b1: list
    w2: list
    b2: list
    labels: list


def head_probabilities(head: Head):
    """Function from a vector column to class probabilities in label order (M1)."""
    mu, sigma, w1, b1, w2, b2 = (np.asarray(a, dtype=np.float64) for a in (head.mu, head.sigma, head.w1, head.b1, head.w2, head.b2))

    @F.arrow_udf("array<double>")
    def forward(v: pa.Array) -> pa.Array:
        x = (V.as_matrix(v, mu.size) - mu) / sigma
        logits = np.maximum(x @ w1 + b1, 0.0) @ w2 + b2
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return V.as_lists(e / e.sum(axis=1, keepdims=True))

    return forward


def predict_tracks(frames: DataFrame, key: str, vec: str, head: Head) -> DataFrame:
    """(key, rank, style, score): mean class probability over a track's frames, best first (M1)."""
    probs = frames.where(F.col(vec).isNotNull()).select(key, head_probabilities(head)(F.col(vec)).alias("p"))
    names = F.array(*[F.lit(x) for x in head.labels])
    tall = probs.select(key, F.posexplode("p").alias("i", "p")).groupBy(key, "i").agg(F.avg("p").alias("score"))
    order = Window.partitionBy(key).orderBy(F.desc("score"), "i")  # one row per class
    return tall.select(key, F.row_number().over(order).alias("rank"), F.element_at(names, F.col("i") + 1).alias("style"), F.round("score", 4).alias("score"))


def relabel(tracks: DataFrame, key: str, vec: str, head: Head, head_id: str, at: float) -> DataFrame:
    """Re-label events of tracks without an override: the eight best classes over their own mass (M2)."""
    free = tracks.where(F.coalesce("override", F.lit("")) == "").where(F.col(vec).isNotNull())
    probs = free.select(key, head_probabilities(head)(F.col(vec)).alias("p"))
    names = F.array(*[F.lit(x) for x in head.labels])
    ranked = F.slice(F.array_sort(F.transform("p", lambda p, i: F.struct((-p).alias("n"), i.alias("i")))), 1, READ_LENGTH)
    mass = F.aggregate(ranked, F.lit(0.0), lambda a, e: a - e["n"])
    read = F.transform(F.filter(ranked, lambda e: e["n"] < 0), lambda e: F.struct(
        F.element_at(names, e["i"] + 1).alias("style"), F.bround(-e["n"] / mass, 4).alias("score")))
    return probs.select(
        key, read.alias("styles"), F.lit(head_id).alias("head"), F.lit(float(at)).alias("at"), F.lit("mean-embedding").alias("method")
    ).where(F.size("styles") > 0)


def relabel_preview(identities: DataFrame, events: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(totals, examples) of what a re-label would change; writes nothing.

    ``identities`` is (key, style) as shown now.
    """
    after = events.select(key, F.col("styles")[0]["style"].alias("to"), F.col("styles")[0]["score"].alias("score"))
    joined = identities.join(after, key, "left")
    changed = F.col("to").isNotNull() & ~F.col("style").eqNullSafe(F.col("to"))
    totals = joined.agg(F.count(F.lit(1)).alias("total"), F.count_if(changed).alias("changed")).withColumn("unchanged", F.col("total") - F.col("changed"))
    examples = joined.where(changed).select(key, F.col("style").alias("from"), "to", "score").orderBy(key).limit(EXAMPLES)
    return totals, examples


def revert_relabels(events: DataFrame, key: str, at: float) -> DataFrame:
    """Tombstones that take every standing re-label away (M4)."""
    return events.select(key).distinct().select(key, F.lit(None).cast("string").alias("head"), F.lit(float(at)).alias("at"))


def standing_relabels(events: DataFrame, key: str) -> DataFrame:
    """The latest re-label per track unless it was reverted (M2, M4)."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), "at").alias("_r")).select(key, "_r.*").where(F.col("head").isNotNull())


def stratified_split(tracks: DataFrame, key: str, label: str, fraction: float = 0.2, seed: int = 0) -> DataFrame:
    """``tracks`` plus ``validation``: per class round(n * fraction) rows by seeded hash, one at least if n > 1 (M5)."""
    ranked = group_rank(tracks, [label], [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)], out="_r", size_out="_n")
    held = F.when(F.col("_n") > 1, F.greatest(F.lit(1), F.bround(F.col("_n") * fraction).cast("long"))).otherwise(0)
    return ranked.withColumn("validation", F.col("_r") <= held).drop("_r", "_n")


def assign_folds(tracks: DataFrame, key: str, label: str, folds: int, seed: int = 0) -> DataFrame:
    """``tracks`` plus a stratified ``fold`` 0..folds-1, the same for every candidate (M7)."""
    ranked = group_rank(tracks, [label], [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)], out="_r")
    return ranked.withColumn("fold", F.pmod(F.col("_r") - 1, F.lit(folds)).cast("int")).drop("_r")


def class_weights(tracks: DataFrame, label: str) -> DataFrame:
    """(label, weight): n / (classes * class size) (M7)."""
    sizes = tracks.groupBy(label).agg(F.count(F.lit(1)).alias("c"))
    total = sizes.agg((F.sum("c") / F.count(F.lit(1))).alias("t")).select("t").scalar()
    return sizes.select(label, (total / F.col("c")).alias("weight"))


def _labelled(df: DataFrame, label: str) -> tuple[DataFrame, list]:
    """Rows with a numeric class, and the class names in order (bounded by the taxonomy)."""
    names = [r[0] for r in df.select(label).distinct().orderBy(label).collect()]
    table = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(float(i)))])
    return df.withColumn("_y", F.element_at(table, F.col(label))), names


def _features(df: DataFrame, vec: str) -> DataFrame:
    return df.withColumn("_x", array_to_vector(F.col(vec).cast("array<double>")))


def cross_validate(tracks: DataFrame, key: str, vec: str, label: str, folds: int = 5, seed: int = 0, max_iter: int = 100) -> DataFrame:
    """(key, label, fold, prediction) of a class-balanced logistic head, each row scored unseen (M7)."""
    # Every fold reads the same written rows, so folds are assigned once.
    rows, names = _labelled(cut_lineage(assign_folds(tracks.select(key, vec, label), key, label, folds, seed)), label)
    rows = _features(rows, vec)
    labels = F.array(*[F.lit(n) for n in names])
    head = Pipeline(stages=[
        StandardScaler(inputCol="_x", outputCol="_s", withMean=True, withStd=True),
        LogisticRegression(featuresCol="_s", labelCol="_y", weightCol="weight", family="multinomial", regParam=1e-3, maxIter=max_iter, predictionCol="_p"),
    ])
    out = None
    for f in range(folds):
        fit = rows.where(F.col("fold") != f)
        model = head.fit(fit.join(class_weights(fit, label), label))
        scored = model.transform(rows.where(F.col("fold") == f)).select(
            key, label, "fold", F.element_at(labels, F.col("_p").cast("int") + 1).alias("prediction")
        )
        out = scored if out is None else out.unionByName(scored)
    return out


def train_head(frames: DataFrame, key: str, vec: str, label: str, hidden: int = 256, max_iter: int = 100, seed: int = 0):
    """(model, labels, validation predictions): one hidden layer on standardised frames, track-level split (M6).

    The split keeps all frames of a track on one side. Frame probabilities are
    averaged per track before the class is chosen.
    """
    tracks = stratified_split(frames.select(key, label).distinct(), key, label, seed=seed)
    rows, names = _labelled(cut_lineage(frames.select(key, vec, label).join(tracks.select(key, "validation"), key)), label)
    rows = _features(rows, vec)
    dim = rows.agg(F.max(F.size(vec))).first()[0]
    head = Pipeline(stages=[
        StandardScaler(inputCol="_x", outputCol="_s", withMean=True, withStd=True),
        MultilayerPerceptronClassifier(featuresCol="_s", labelCol="_y", layers=[dim, hidden, len(names)], maxIter=max_iter, seed=seed, probabilityCol="_q"),
    ])
    model = head.fit(rows.where(~F.col("validation")))
    probs = model.transform(rows.where("validation")).select(key, label, F.posexplode(vector_to_array("_q")).alias("i", "p"))
    means = probs.groupBy(key, label, "i").agg(F.avg("p").alias("p"))
    best = means.groupBy(key, label).agg(F.max_by("i", F.struct("p", -F.col("i"))).alias("i"))
    labels = F.array(*[F.lit(n) for n in names])
    return model, names, best.select(key, label, F.element_at(labels, F.col("i") + 1).alias("prediction"))


def class_report(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(class, precision, recall, f1, support) of every true class; an empty denominator gives 0."""
    cells = predictions.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("c"))
    truth = cells.groupBy(F.col(label).alias("class")).agg(F.sum("c").alias("support"), F.coalesce(F.sum(F.when(F.col(label) == F.col(prediction), F.col("c"))), F.lit(0)).alias("hits"))
    called = cells.groupBy(F.col(prediction).alias("class")).agg(F.sum("c").alias("called"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(F.col("hits"), F.col("called")), ratio(F.col("hits"), F.col("support"))
    return truth.join(called, "class", "left").select(
        "class", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), "support", "hits",
    )


def overall_report(report: DataFrame) -> DataFrame:
    """(macro_f1, accuracy, n, largest_share) from :func:`class_report`."""
    return report.agg(
        F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(F.sum("hits") / F.sum("support"), 6).alias("accuracy"),
        F.sum("support").alias("n"), F.round(F.max("support") / F.sum("support"), 6).alias("largest_share"),
    )


def confusion(predictions: DataFrame, classes: list, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Confusion matrix: rows are truth, one column per class."""
    return predictions.groupBy(label).pivot(prediction, classes).count().na.fill(0)


def missing_extractions(tracks: DataFrame, cache: DataFrame, candidates: list[str], key: str) -> DataFrame:
    """(key, candidate) pairs with no cached embedding (M8)."""
    wanted = tracks.select("*", F.explode(F.array(*map(F.lit, candidates))).alias("candidate"))
    return wanted.join(cache.select(key, "candidate"), [key, "candidate"], "left_anti")


def extract(todo: DataFrame, key: str, source: str, engines: dict[str, Callable]) -> DataFrame:
    """(key, candidate, embedding, error) by user functions; a failure is a row, never the job's end."""
    kind = todo.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors, errors = [], []
            for name, value in zip(pdf["candidate"], pdf[source]):
                try:
                    vectors.append([float(x) for x in engines[name](value)])
                    errors.append(None)
                except Exception as e:  # one bad input must not end a long job
                    vectors.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({key: pdf[key], "candidate": pdf["candidate"], "embedding": vectors, "error": errors})

    return todo.select(key, "candidate", source).mapInPandas(run, f"{key} {kind}, candidate string, embedding array<double>, error string")


# --- user functions --------------------------------------------------------------------

@dataclass
class Engines:
    """The four user callables of an analysis, each ``content -> value``."""

    genre: Callable
    tempo: Callable
    key: Callable
    duration: Callable


ANALYSIS_SCHEMA = (
    "styles array<struct<style:string,score:double>>, bpm double, key string, scale string, duration double, error string"
)


def analyse(files: DataFrame, engines: Engines) -> DataFrame:
    """Feature columns for (hash, path, content) by the given engines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for h, path, content in zip(pdf["hash"], pdf["path"], pdf["content"]):
                row = {"hash": h, "path": path, "styles": None, "bpm": None, "key": None, "scale": None, "duration": None, "error": None}
                try:
                    key, scale = engines.key(content)
                    row |= {
                        "styles": [{"style": s, "score": v} for s, v in engines.genre(content)], "bpm": engines.tempo(content),
                        "key": key, "scale": scale, "duration": engines.duration(content),
                    }
                except Exception as e:  # failures become rows
                    row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            yield pd.DataFrame(rows, columns=["hash", "path", "styles", "bpm", "key", "scale", "duration", "error"])

    return files.select("hash", "path", "content").mapInPandas(run, f"hash string, path string, {ANALYSIS_SCHEMA}")
