"""Detectors over frames: persistence, robust, latent and coherent latent."""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Window, functions as F

from tidegauge.operators import linear, skew
from tidegauge.operators.frames import lookback_frames


def vector_steps(z, value="z"):
    """One feature array per (run, i), in feature order."""
    rows = z.groupBy("run", "i").agg(
        F.array_sort(F.collect_list(F.struct("feature", F.col(value).alias("v")))).alias("a")
    )
    return rows.select("run", "i", F.transform("a", lambda x: x["v"]).alias("state"))


def vector_frames(steps, lookback):
    """Flattened context of the steps before, and the target step, per run."""
    framed = lookback_frames(steps, ["run"], lookback, "state")
    return framed.select("run", "i", F.flatten("context").alias("context"), "target")


def persistence_score(frames, features):
    """Root mean squared change from the last context step."""
    last = F.slice("context", F.size("context") - features + 1, features)
    sq = F.aggregate(
        F.zip_with("target", last, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x
    )
    return frames.withColumn("score", F.sqrt(sq / features))


def robust_score(frames):
    """Largest absolute scaled value of the target step."""
    return frames.withColumn("score", F.array_max(F.transform("target", lambda x: F.abs(x))))


@dataclass(frozen=True)
class LatentModel:
    """Fitted latent predictor: a handful of small matrices."""

    kind: str
    features: int
    center: tuple
    components: tuple
    coefficients: tuple
    residual_scale: tuple
    consensus_rank: int
    threshold: float

    def parameter_count(self):
        return sum(np.asarray(x).size for x in (self.center, self.components, self.coefficients))

    def to_row(self):
        return {k: getattr(self, k) for k in self.__dataclass_fields__}


def _rows(m):
    return tuple(tuple(map(float, r)) for r in np.atleast_2d(m))


def fit_latent(frames, features, lookback, latent=2, ridge=1e-2, quantile=0.99,
               coherent=False, consensus_rank=2, floor=1e-6, fallback=1.0, widen=1.0):
    """Principal axes of the targets, ridge from context to latent, quantile threshold.

    One Gram pass gives the axes and the ridge; the residual medians and the score
    quantile are exact distributed order statistics.
    """
    d = lookback * features
    joint = frames.withColumn("_j", F.concat("context", F.array(F.lit(1.0)), "target"))
    g = linear.gram_matrices(joint, "_j", d + 1 + features)
    targets = list(range(d + 1, d + 1 + features))
    mean, cov = linear.covariance(g, targets, d)
    axes, _ = linear.principal_axes(cov, min(latent, features))
    inputs = list(range(d + 1))
    weights = linear.solve_ridge(g, inputs, targets, ridge, free=d)
    intercept = np.zeros_like(weights)
    intercept[-1] = mean
    latent_weights = (weights - intercept) @ axes.T
    model = LatentModel(
        "coherent" if coherent else "latent", features, tuple(map(float, mean)), _rows(axes),
        _rows(latent_weights), (1.0,) * features, consensus_rank, float("inf"),
    )
    if coherent:
        out = frames.select(F.posexplode(decoded_residual(model)("context", "target")).alias("p", "r"))
        fit = skew.exact_quantiles(
            out.withColumn("a", F.abs("r")), ["p"], "a", {"m": 0.5}
        ).orderBy("p").collect()
        scale = [r.m if r.m > floor else fallback for r in fit]
        model = LatentModel(**{**model.to_row(), "residual_scale": tuple(scale)})
    scores = score_latent(frames, model)
    cut = skew.exact_quantiles(scores, [], "score", {"q": quantile}).first().q
    return LatentModel(**{**model.to_row(), "threshold": float(cut) * widen})


def decoded_residual(model):
    """Target minus the prediction decoded back to feature space."""
    center, axes = np.asarray(model.center), np.asarray(model.components)
    weights = np.asarray(model.coefficients)

    @F.pandas_udf("array<double>")
    def apply(context: pd.Series, target: pd.Series) -> pd.Series:
        x = np.stack(context.to_numpy())
        x = np.hstack([x, np.ones((len(x), 1))])
        y = np.stack(target.to_numpy())
        if model.kind == "coherent":
            return pd.Series(list(y - (x @ weights @ axes + center)))
        return pd.Series(list((y - center) @ axes.T - x @ weights))

    return apply


def score_latent(frames, model):
    """Adds ``score``, ``evidence`` (signed, per feature) and strict ``alert``."""
    rows = frames.withColumn("_r", decoded_residual(model)("context", "target"))
    if model.kind == "coherent":
        scale = F.array(*[F.lit(float(s)) for s in model.residual_scale])
        rows = rows.withColumn("evidence", F.zip_with("_r", scale, lambda r, s: r / s))
        size = F.sort_array(F.transform("evidence", lambda x: F.abs(x)), False)
        rows = rows.withColumn("score", F.get(size, model.consensus_rank - 1))
    else:
        sq = F.aggregate("_r", F.lit(0.0), lambda s, x: s + x * x)
        rows = rows.withColumn("evidence", linear.linear_map(model.components)("_r"))
        rows = rows.withColumn("score", F.sqrt(sq / F.size("_r")))
    return rows.drop("_r").withColumn("alert", F.col("score") > F.lit(model.threshold))


def top_evidence(rows, first, features, lookback, k=3):
    """Top features at a run's first alert, averaged over the look-back buffer.

    ``rows``: run, i, evidence array (signed); ``first``: run, first_i. The signed
    mean is taken first, then its size.
    """
    near = rows.join(first, "run").where(
        (F.col("i") <= F.col("first_i")) & (F.col("i") > F.col("first_i") - lookback)
    )
    names = F.array(*[F.lit(f) for f in features])
    flat = near.select("run", F.posexplode("evidence").alias("p", "e")).groupBy("run", "p").agg(
        F.abs(F.avg("e")).alias("evidence")
    )
    w = Window.partitionBy("run").orderBy(F.col("evidence").desc(), F.col("feature").desc())
    return (
        flat.select("run", F.get(names, F.col("p")).alias("feature"), "evidence")
        .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    )
