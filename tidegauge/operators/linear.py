"""Linear models fitted from one distributed Gram matrix.

Rows stay on the executors: each partition adds up outer products of its rows,
the parts are summed by (i, j), and only the D x D result reaches the driver,
where D is the number of columns and is checked. Sub-models, ablations and errors
are read from the same matrix, so a family of fits costs one pass.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from tidegauge.session import materialize

MAX_WIDTH = 2_000
MAX_CELLS = 4_000_000


def gram(df, vector, keys=()):
    """Sum of outer products of an array column per key, as rows ``(keys, i, j, s)``."""
    keys = list(keys)
    rows = df.select(*keys, F.col(vector).alias("_v"))
    schema = StructType(
        [f for f in rows.schema.fields if f.name in keys]
        + [StructField("i", IntegerType()), StructField("j", IntegerType()),
           StructField("s", DoubleType())]
    )

    def partial(batches):
        sums = {}
        for pdf in batches:
            groups = pdf.groupby(keys, sort=False) if keys else [((), pdf)]
            for key, part in groups:
                x = np.stack(part["_v"].to_numpy())
                key = key if isinstance(key, tuple) else (key,)
                sums[key] = sums.get(key, 0.0) + x.T @ x
        for key, m in sums.items():
            d = len(m)
            out = {k: [v] * (d * d) for k, v in zip(keys, key)}
            out["i"] = np.repeat(np.arange(d, dtype=np.int32), d)
            out["j"] = np.tile(np.arange(d, dtype=np.int32), d)
            out["s"] = m.ravel()
            yield pd.DataFrame(out)

    parts = rows.mapInPandas(partial, schema)
    return parts.groupBy(*keys, "i", "j").agg(F.sum("s").alias("s"))


def gram_matrices(df, vector, width, keys=()):
    """The Gram matrix of each key on the driver; width and key count are checked."""
    if width > MAX_WIDTH:
        raise ValueError(f"{width} columns: more than {MAX_WIDTH} do not fit a driver solve")
    keys = list(keys)
    rows = gram(df, vector, keys).limit(MAX_CELLS + 1).toPandas()
    if len(rows) > MAX_CELLS:
        raise ValueError("too many groups for a driver solve")
    found = {}
    for key, part in rows.groupby(keys) if keys else [((), rows)]:
        m = np.zeros((width, width))
        m[part["i"], part["j"]] = part["s"]
        key = key if isinstance(key, tuple) else (key,)
        found[key[0] if len(key) == 1 else key] = m
    return found if keys else found[()]


@dataclass(frozen=True)
class Moments:
    """Rows, mean and centred product sums of some vectors."""

    n: float
    mean: np.ndarray
    m: np.ndarray

    def covariance(self, cols=None, ddof=0):
        cols = list(range(len(self.mean))) if cols is None else cols
        return self.mean[cols], self.m[np.ix_(cols, cols)] / (self.n - ddof)

    def ridge(self, inputs, targets, ridge):
        """Weights and the unpenalised intercept, from centred products."""
        xx = self.m[np.ix_(inputs, inputs)] + ridge * np.eye(len(inputs))
        w = np.linalg.solve(xx, self.m[np.ix_(inputs, targets)])
        return w, self.mean[targets] - self.mean[inputs] @ w


def _merged(parts):
    """One ``(n, mean, m)`` of several, pairwise, so that no large sum meets a small one more often than log n times."""
    parts = list(parts)
    while len(parts) > 1:
        joined = []
        for a, b in zip(parts[::2], parts[1::2]):
            n = a[0] + b[0]
            d = b[1] - a[1]
            joined.append((n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)))
        parts = joined + ([parts[-1]] if len(parts) % 2 else [])
    return parts[0]


MERGE = 64


def moments(df, vector, keys=()):
    """Centred moments per key, as rows ``(keys, n, mean, m)`` with ``m`` flattened; rows stay on the executors.

    A task merges its batches in pairs, the tasks' parts are merged ``MERGE`` at a time, so no task holds more than
    that many D x D tables of a key. Centring per batch keeps the digits that raw products lose when means are large.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(vector).alias("_v"))
    fields = [f for f in rows.schema.fields if f.name in keys]
    body = [StructField("n", DoubleType()), StructField("mean", ArrayType(DoubleType())), StructField("m", ArrayType(DoubleType()))]

    def frame(found):
        out = {k: [key[j] for key in found] for j, k in enumerate(keys)}
        out |= {"n": [p[0] for p in found.values()], "mean": [p[1] for p in found.values()], "m": [p[2].ravel() for p in found.values()]}
        return pd.DataFrame(out)

    def partial(batches):
        found = {}
        for pdf in batches:
            for key, part in pdf.groupby(keys, sort=False, dropna=False) if keys else [((), pdf)]:
                x = np.stack(part["_v"].to_numpy())
                mean = x.mean(axis=0)
                e = x - mean
                key = key if isinstance(key, tuple) else (key,)
                new = (float(len(x)), mean, e.T @ e)
                found[key] = _merged([found[key], new]) if key in found else new
            if len(found) > MERGE:
                yield frame(found)
                found = {}
        if found:
            yield frame(found)

    def unpack(pdf):
        return [(n, np.asarray(mean), np.asarray(m).reshape(len(mean), len(mean))) for n, mean, m in zip(pdf["n"], pdf["mean"], pdf["m"])]

    def merge(pdf):
        n, mean, m = _merged(unpack(pdf))
        head = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame({**head, "n": [n], "mean": [mean], "m": [m.ravel()]})

    parts = materialize(rows.mapInPandas(partial, StructType([*fields, *body])))
    count = parts.count()
    while count > MERGE:
        groups = -(-count // MERGE)
        dealt = parts.withColumn("_g", F.pmod(F.xxhash64("n", "mean"), F.lit(groups)))
        again = dealt.groupBy(*keys, "_g").applyInPandas(merge, StructType([*fields, *body]))
        parts = materialize(again)
        left = parts.count()
        if left == count:
            break
        count = left
    return parts.groupBy(*keys).applyInPandas(merge, StructType([*fields, *body]))


def one_moments(df, vector, width):
    """The moments of all rows, on the driver; the width is checked."""
    if width > MAX_WIDTH:
        raise ValueError(f"{width} columns: more than {MAX_WIDTH} do not fit a driver solve")
    r = moments(df, vector).first()
    return Moments(r.n, np.array(r.mean), np.array(r.m).reshape(width, width))


def keyed_fits(df, vector, keys, fit, schema):
    """Fit each key on an executor: ``fit(key values, Moments)`` gives rows of ``schema``. No key's matrix passes the driver."""

    def run(batches):
        for pdf in batches:
            for _, r in pdf.iterrows():
                width = len(r["mean"])
                found = Moments(r["n"], np.asarray(r["mean"]), np.asarray(r["m"]).reshape(width, width))
                yield fit(tuple(r[k] for k in keys), found)

    return moments(df, vector, keys).mapInPandas(run, schema)


def solve_ridge(g, inputs, targets, ridge, free=None):
    """Weights from Gram ``g``: ``inputs`` and ``targets`` are column positions.

    ``free`` is the unpenalised intercept column.
    """
    xx = g[np.ix_(inputs, inputs)]
    penalty = np.full(len(inputs), float(ridge))
    if free is not None:
        penalty[inputs.index(free)] = 0.0
    return np.linalg.solve(xx + np.diag(penalty), g[np.ix_(inputs, targets)])


def residual_mse(g, inputs, targets, weights, count):
    """Mean squared residual per target of any linear map, read from a Gram matrix."""
    xx, xy = g[np.ix_(inputs, inputs)], g[np.ix_(inputs, targets)]
    yy = np.diag(g)[targets]
    sse = yy - 2 * np.sum(weights * xy, axis=0) + np.sum(weights * (xx @ weights), axis=0)
    return np.maximum(sse, 0.0) / count


def linear_map(weights):
    """Vectorised ``x @ weights`` for an array column."""
    w = np.asarray(weights, dtype=np.float64)

    @F.pandas_udf("array<double>")
    def apply(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(x.to_numpy()) @ w))

    return apply


def covariance(g, cols, one, ddof=0):
    n = g[one, one]
    mean = g[np.ix_([one], cols)][0] / n
    cov = (g[np.ix_(cols, cols)] - n * np.outer(mean, mean)) / (n - ddof)
    return mean, cov


def principal_axes(cov, width):
    """Leading eigenvectors as rows, each signed so that its largest loading is positive."""
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:width]
    axes = vectors[:, order].T
    pick = np.argmax(np.abs(axes), axis=1)
    signs = np.sign(axes[np.arange(len(axes)), pick])
    return axes * np.where(signs == 0, 1.0, signs)[:, None], values[order]


def covariance_diagnostics(cov):
    """Effective ranks and spread of a covariance matrix."""
    values = np.maximum(np.linalg.eigvalsh(cov), 0.0)
    total = values.sum()
    p = values[values > 0] / total
    d = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    corr = cov / np.outer(d, d)
    off = np.abs(corr[~np.eye(len(cov), dtype=bool)])
    return {
        "participation_rank": float(total**2 / np.sum(values**2)),
        "entropy_rank": float(np.exp(-np.sum(p * np.log(p)))),
        "min_variance": float(np.min(np.diag(cov))),
        "mean_variance": float(np.mean(np.diag(cov))),
        "mean_abs_correlation": float(off.mean()),
    }


def reduced_rank(g, inputs, targets, ridge, free, rank):
    """Ridge weights projected on the leading directions of the fitted values."""
    w = solve_ridge(g, inputs, targets, ridge, free)
    fitted = w.T @ g[np.ix_(inputs, inputs)] @ w
    axes, _ = principal_axes(fitted, rank)
    return w @ axes.T @ axes


def contractive_low_rank(transition, rank, radius):
    """Best rank-k transition, shrunk so that its spectral radius stays at most ``radius``."""
    u, s, v = np.linalg.svd(transition, full_matrices=False)
    low = (u[:, :rank] * s[:rank]) @ v[:rank]
    found = float(np.max(np.abs(np.linalg.eigvals(low))))
    return low * (radius / found) if found > radius else low
