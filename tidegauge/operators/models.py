"""Fitted detectors as stored rows: one Parquet row per model, restored by kind.

A model is a kind, a format version, named numbers (its threshold among them) and named arrays with their
shapes. The row carries a SHA-256 over all of that, taken from the bytes of the doubles, so a restored model
scores as the fitted one did, and a changed row is refused. Scoring is a DataFrame function by kind.
"""

import hashlib
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import functions as F

from tidegauge.operators import detectors, linear, skew

VERSION = 1
SCHEMA = (
    "name string, kind string, version int, numbers map<string, double>, "
    "arrays array<struct<name: string, shape: array<int>, values: array<double>>>, parameters bigint, digest string"
)


@dataclass(frozen=True)
class Model:
    """A fitted model of a registered kind."""

    kind: str
    numbers: dict
    arrays: dict = field(default_factory=dict)

    def parameter_count(self):
        return sum(np.asarray(a).size for a in self.arrays.values())

    def digest(self):
        """SHA-256 of kind, version, numbers and arrays in name order, doubles by their bytes."""
        text = hashlib.sha256(f"{self.kind}\0{VERSION}".encode())
        for name in sorted(self.numbers):
            text.update(f"\0n{name}\0".encode() + np.float64(self.numbers[name]).tobytes())
        for name in sorted(self.arrays):
            a = np.asarray(self.arrays[name], dtype="<f8")
            text.update(f"\0a{name}\0{a.shape}\0".encode() + a.tobytes())
        return text.hexdigest()

    def to_row(self, name):
        arrays = [(k, list(np.shape(a)), np.asarray(a, dtype=float).ravel().tolist()) for k, a in sorted(self.arrays.items())]
        numbers = {k: float(v) for k, v in self.numbers.items()}
        return name, self.kind, VERSION, numbers, arrays, self.parameter_count(), self.digest()


def from_row(row):
    """The model of a stored row; an unknown version or kind, or a row changed since it was written, is an error."""
    if row.version != VERSION:
        raise ValueError(f"model {row.name}: version {row.version} is not {VERSION}")
    if row.kind not in KINDS:
        raise ValueError(f"model {row.name}: unknown kind {row.kind}")
    arrays = {}
    for a in row.arrays:
        if math.prod(a["shape"]) != len(a["values"]):
            raise ValueError(f"model {row.name}: array {a['name']} does not fill its shape")
        arrays[a["name"]] = np.array(a["values"], dtype=float).reshape(a["shape"])
    model = Model(row.kind, dict(row.numbers), arrays)
    if model.digest() != row.digest or model.parameter_count() != row.parameters:
        raise ValueError(f"model {row.name}: the stored digest does not match")
    return model


def save(spark, models, folder):
    """Add named models to a registry folder. A model is as small as a driver solve, one row each."""
    rows = [model.to_row(name) for name, model in models.items()]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def load(spark, folder, name):
    """One model by name; only its row is read."""
    rows = spark.read.schema(SCHEMA).parquet(folder).where(F.col("name") == name).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{len(rows)} stored models are called {name}" if rows else f"no model is called {name}")
    return from_row(rows[0])


def _quantile(scores, quantile, digits):
    """Threshold from rounded training scores, rounded as they are, so that equal scores compare equal everywhere."""
    cut = skew.exact_quantiles(scores, [], "score", {"score": quantile})
    return float(_rounded(cut, digits).first().score)


def _rounded(df, digits):
    unit = float(10**digits)
    return df.withColumn("score", F.floor(F.col("score") * unit + 0.5) / unit)


def _score_persistence(frames, model):
    n = int(model.numbers["features"])
    change = F.zip_with("target", F.slice("context", F.size("context") - n + 1, n), lambda a, b: a - b)
    return detectors.persistence_score(frames, n).withColumn("evidence", change)


def _score_robust(frames, model):
    """Largest absolute scaled value of the target; location and scale are the model's arrays."""
    at = F.array(*[F.lit(float(x)) for x in model.arrays["location"]])
    by = F.array(*[F.lit(float(x)) for x in model.arrays["scale"]])
    z = F.zip_with(F.zip_with("target", at, lambda x, m: x - m), by, lambda x, s: x / s)
    return frames.withColumn("score", F.array_max(F.transform(z, F.abs))).withColumn("evidence", z)


def _score_ridge(frames, model):
    """Root mean square of what a linear map of the context leaves of the target."""
    w = np.vstack([model.arrays["weights"], model.arrays["intercept"][None, :]])
    predicted = linear.linear_map(w)(F.concat("context", F.array(F.lit(1.0))))
    left = F.zip_with("target", predicted, lambda y, p: y - p)
    sq = F.aggregate(left, F.lit(0.0), lambda s, x: s + x * x)
    return frames.withColumn("evidence", left).withColumn("score", F.sqrt(sq / F.size("target")))


def _latent(model):
    n = model.numbers
    return detectors.LatentModel(
        model.kind, int(n["features"]), tuple(model.arrays["center"]), model.arrays["components"], model.arrays["coefficients"],
        tuple(model.arrays["residual_scale"]), int(n["consensus_rank"]), n["threshold"],
    )


def _score_latent(frames, model):
    return detectors.score_latent(frames, _latent(model)).drop("alert")


#: Scoring function of each kind that can be restored.
KINDS = {
    "persistence": _score_persistence, "robust": _score_robust, "ridge": _score_ridge,
    "latent": _score_latent, "coherent": _score_latent,
}


def score(frames, model, digits=6):
    """Frames with ``score`` and strict ``alert``, whichever kind the model is of."""
    scored = _rounded(KINDS[model.kind](frames, model), digits)
    return scored.withColumn("alert", F.col("score") > F.lit(float(model.numbers["threshold"])))


def _calibrated(frames, kind, numbers, arrays, quantile, digits):
    bare = Model(kind, {**numbers, "threshold": math.inf}, arrays)
    cut = _quantile(score(frames, bare, digits), quantile, digits)
    return Model(kind, {**numbers, "threshold": cut}, arrays)


def fit_persistence(frames, features, quantile=0.99, digits=6):
    return _calibrated(frames, "persistence", {"features": features}, {}, quantile, digits)


def fit_robust(frames, scale, quantile=0.99, digits=6):
    """``scale``: (feature, location, scale) in feature order, as `frames.robust_scale` fits it."""
    rows = scale.orderBy("feature").collect()
    arrays = {"location": np.array([r.location for r in rows]), "scale": np.array([r.scale for r in rows])}
    return _calibrated(frames, "robust", {"features": len(rows)}, arrays, quantile, digits)


def fit_ridge(frames, features, lookback, ridge=1e-2, quantile=0.99, digits=6):
    """Ridge from the whole context to the target with a free intercept, from one Gram matrix."""
    d = lookback * features
    g = linear.gram_matrices(frames.withColumn("_j", F.concat("context", F.array(F.lit(1.0)), "target")), "_j", d + 1 + features)
    w = linear.solve_ridge(g, list(range(d + 1)), list(range(d + 1, d + 1 + features)), ridge, free=d)
    return _calibrated(frames, "ridge", {"features": features}, {"weights": w[:-1], "intercept": w[-1]}, quantile, digits)


def fit_latent(frames, features, lookback, coherent=False, quantile=0.99, digits=6, **options):
    m = detectors.fit_latent(frames, features, lookback, coherent=coherent, quantile=quantile, **options)
    arrays = {"center": m.center, "components": m.components, "coefficients": m.coefficients, "residual_scale": m.residual_scale}
    numbers = {"features": features, "consensus_rank": m.consensus_rank}
    return _calibrated(frames, m.kind, numbers, {k: np.array(v) for k, v in arrays.items()}, quantile, digits)
