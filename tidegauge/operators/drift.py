"""Distances between samples of vectors: sliced Wasserstein, and RBF discrepancy from the standard Gaussian."""

import numpy as np
from pyspark.sql import functions as F

from tidegauge.operators import retrieval, skew


def projected(rows, directions):
    """``id, direction, x``: each vector's product with each of the given directions (lists of weights)."""
    def product(weights):
        w = F.array(*[F.lit(float(x)) for x in weights])
        return F.aggregate(F.zip_with("v", w, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)

    each = F.array(*[F.struct(F.lit(k).cast("bigint").alias("direction"), product(d).alias("x")) for k, d in enumerate(directions)])
    return rows.select("id", F.explode(each).alias("p")).select("id", "p.*")


def sliced_wasserstein(a, b, directions):
    """Squared 2-Wasserstein distance of two samples along each direction, for samples of any two sizes.

    In order, row i of n covers the share ((i - 1) / n, i / n] of its sample. Each row of the first sample meets the
    rows of the second whose shares overlap its own, weighted by the overlap, so n + m pairs in all. Ranks come from
    scans that are split where a direction has many rows, which is always.
    """
    def ranked(rows, rank, total, value):
        x = projected(rows, directions)
        counted = skew.running_count(x, ["direction"], ["x", "id"], F.col("x"), rank)
        sizes = x.groupBy("direction").agg(F.count(F.lit(1)).alias(total))
        # One row per given direction.
        return counted.withColumnRenamed("x", value).drop("id").join(F.broadcast(sizes), "direction")

    left, right = ranked(a, "i", "n", "x"), ranked(b, "j", "m", "y").drop("m")
    size = b.groupBy().agg(F.count(F.lit(1)).alias("m"))
    left = left.crossJoin(F.broadcast(size)).where("m > 0")
    meets = F.sequence(F.expr("((i - 1) * m) div n + 1"), F.expr("least(m, (i * m + n - 1) div n)"))
    pairs = left.withColumn("j", F.explode(meets)).join(right, ["direction", "j"])
    n, m = F.col("n").cast("double"), F.col("m").cast("double")
    share = F.least(F.col("i") / n, F.col("j") / m) - F.greatest((F.col("i") - 1) / n, (F.col("j") - 1) / m)
    gap = F.col("x") - F.col("y")
    return pairs.groupBy("direction").agg(F.sum(F.greatest(share, F.lit(0.0)) * gap * gap).alias("distance"))


def gaussian_prior_mmd(rows, width, bandwidth=None):
    """RBF discrepancy of a sample (``id, v``) from N(0, I), one row.

    The pair term needs every pair once a side; pairs meet block by block inside tasks that return one sum each, so work is
    quadratic and memory and output are not. The cross and prior terms have closed forms.
    """
    h = float(width if bandwidth is None else bandwidth)
    sample = rows.select("id", F.lit(0).alias("label"), F.col("v").alias("vector"))

    def sums(left, right):
        """The exponent as one product: the squares of both sides are two more components."""
        q, b = retrieval._vectors(left, "vector") / h, retrieval._vectors(right, "bank_vector")
        left_sq, right_sq = (q**2).sum(axis=1, keepdims=True) * (-h / 2), (b**2).sum(axis=1, keepdims=True) / (-2 * h)
        q, b = np.hstack([q, left_sq, np.ones_like(left_sq)]), np.hstack([b, np.ones_like(right_sq), right_sq])
        total = 0.0
        for j in range(0, len(b), retrieval.TILE_COLUMNS):
            part = b[j : j + retrieval.TILE_COLUMNS].T
            for i in range(0, len(q), retrieval.TILE_ROWS):
                x = q[i : i + retrieval.TILE_ROWS] @ part
                np.exp(np.minimum(x, 0.0, out=x), out=x)
                total += float(x.sum())
        return [[total]]

    pairs = retrieval._over_bank(sample, sample, sums, "s double").agg(F.sum("s").alias("s"))
    sq = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    cross = rows.agg(F.avg(F.exp(-sq / (2 * (h + 1)))).alias("c"), F.count(F.lit(1)).alias("n"))
    scale, prior = (h / (h + 1)) ** (width / 2), (h / (h + 2)) ** (width / 2)
    return pairs.crossJoin(F.broadcast(cross)).select((F.col("s") / (F.col("n") * F.col("n")) - 2 * scale * F.col("c") + prior).alias("mmd"))
