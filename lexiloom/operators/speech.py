"""Speech operators: framed segments, alignment of states, Gaussian mixtures by label."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import signal


def segments(points: DataFrame, key: str, order: list[str], value: str, size: int, before: int = 0, after: int = 0) -> DataFrame:
    """key, segment, samples: each key's values in order, cut into arrays of ``size`` values at most, so that no row grows with the data.
    Each array also has up to ``before`` values ahead of it and ``after`` values behind it."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    cut = points.select(key, F.col(value).alias("x"), n.alias("i"))
    if before or after:
        first, last = F.floor(F.greatest(F.lit(0), F.col("i") - after) / size), F.floor((F.col("i") + before) / size)
        cut = cut.withColumn("segment", F.explode(F.sequence(first, last)))
    else:
        cut = cut.withColumn("segment", F.floor(F.col("i") / size))
    ordered = F.array_sort(F.collect_list(F.struct("i", "x")))
    return cut.groupBy(key, "segment").agg(F.transform(ordered, lambda s: s["x"]).alias("samples"))


def cepstra(points: DataFrame, key: str, order: list[str], value: str, rate: float, size: int, shift: int, frames: int = 256) -> DataFrame:
    """key, segment, frame, features: every frame of each key once, by its number within the key. Segments of ``frames`` frames overlap by
    a frame and by the four frames that changes of changes reach either way, so a seam leaves no trace."""
    reach = 4
    if frames < reach:
        raise ValueError("a segment has to be as long as what changes reach")
    cut = segments(points, key, order, value, frames * shift, reach * shift, reach * shift + max(0, size - shift))
    rows = cut.select(key, "segment", F.posexplode(signal.mfcc(F.col("samples"), rate, size, shift)).alias("frame", "features"))
    own = F.col("frame") - F.when(F.col("segment") > 0, reach).otherwise(0)
    return rows.withColumn("own", own).where((F.col("own") >= 0) & (F.col("own") < frames)).select(key, "segment", (F.col("own") + F.col("segment") * frames).alias("frame"), "features")


def gmm_train(features: DataFrame, label: str, vector: str, components: int = 2, rounds: int = 4, least_variance: float = 1e-3) -> dict:
    """Diagonal-covariance mixtures by label: {label: (weights, means, variances)}.

    Each round is one distributed pass: tasks reduce their rows to sums by (label, component), which are
    added up by key; only labels x components rows reach the driver. Starts from the labels' means and variances, spread along the deviation.
    Null vectors and vectors that hold nulls take no part.
    """
    rows = features.select(F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL AND label IS NOT NULL AND NOT exists(v, x -> x IS NULL)")

    def pass_over(model):
        def partial(batches):
            for pdf in batches:
                for lab, part in pdf.groupby("label"):
                    x = np.stack(part["v"].to_numpy())
                    r = np.ones((len(x), 1)) if model is None else posterior(x, model[lab])
                    for c in range(r.shape[1]):
                        w = r[:, c : c + 1]
                        yield pd.DataFrame({"label": [lab], "c": [c], "s": [np.concatenate([[w.sum()], (w * x).sum(0), (w * x * x).sum(0)])]})

        kind = dict(rows.dtypes)["label"]
        sums = rows.mapInPandas(partial, f"label {kind}, c int, s array<double>").select("label", "c", F.posexplode("s").alias("i", "x"))
        summed = sums.groupBy("label", "c", "i").agg(F.sum("x").alias("x")).groupBy("label", "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("s"))
        return {(r["label"], r["c"]): np.array(r["s"]) for r in summed.collect()}

    def parts(s):
        n, d = max(s[0], 1e-9), (len(s) - 1) // 2
        mean = s[1 : 1 + d] / n
        return n, mean, np.maximum(s[1 + d :] / n - mean**2, least_variance)

    model = {}
    for (lab, _), s in pass_over(None).items():
        _, mean, var = parts(s)
        shifts = np.linspace(-0.5, 0.5, components)[:, None] if components > 1 else np.zeros((1, 1))
        model[lab] = (np.full(components, 1 / components), mean + shifts * np.sqrt(var), np.repeat(var[None], components, 0))
    for _ in range(rounds):
        got = pass_over(model)
        for lab in model:
            n, mean, var = (np.array(x) for x in zip(*(parts(got[lab, c]) for c in range(components))))
            model[lab] = (n / n.sum(), mean, var)
    return model


def densities(x: np.ndarray, mixture) -> np.ndarray:
    """(rows, components) log of weight times density."""
    weights, means, variances = mixture
    return np.stack([np.log(max(w, 1e-300)) + signal.log_normal(x, m, v) for w, m, v in zip(weights, means, variances)], 1)


def posterior(x: np.ndarray, mixture) -> np.ndarray:
    d = densities(x, mixture)
    p = np.exp(d - d.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def gmm_classify(vector: Column, model: dict, kind: str) -> Column:
    """The label whose mixture gives a vector the greatest log-density, least label first; null for a null vector."""
    labels = sorted(model)

    def run(s: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(s), dtype=object)
        good = [i for i, v in enumerate(s) if v is not None and not pd.isna(np.asarray(v, float)).any()]
        if good and labels:
            x = np.stack([np.asarray(s.iloc[i], float) for i in good])
            score = np.stack([np.logaddexp.reduce(densities(x, model[k]), axis=1) for k in labels], 1)
            for i, best in zip(good, score.argmax(1)):
                out.iloc[i] = labels[best]
        return out

    return F.pandas_udf(run, kind)(vector)
