"""Small numeric expressions."""

import math

from pyspark.sql import functions as F


def fixed(x, digits=6):
    """Round half up by plain double arithmetic, the same in every engine."""
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x * F.lit(10.0**digits) + 0.5) / F.lit(10.0**digits)


def snap_counts(x, tolerance=1e-12):
    """Near-integers back to whole counts; others unchanged."""
    return F.when(F.abs(x - F.rint(x)) <= tolerance, F.rint(x)).otherwise(x)


def zero_event_upper_bound(n, confidence=0.95):
    """Exact upper bound of a rate after ``n`` trials with no event."""
    return 1 - F.pow(F.lit(1 - confidence), 1 / n)


#: Error of Stirling's formula for ln n!, at n = 0 to 15.
_STIRLING = [0.0, *(math.lgamma(n + 1.0) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) for n in range(1, 16))]


def _stirling_error(n):
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * n * n)) / (n * n)) / (n * n)) / n
    return F.when(n <= 15, F.get(F.array(*map(F.lit, _STIRLING)), n.cast("int"))).otherwise(series)


def binomial_term(k, n, p):
    """P(X = k) for X ~ Binomial(n, p), by logarithms, so large ``n`` does not underflow."""
    deviance = lambda x, mean: F.when(x > 0, x * F.log(x / mean)).otherwise(0.0) + mean - x
    logs = (
        _stirling_error(n) - _stirling_error(k) - _stirling_error(n - k)
        - deviance(k, n * p) - deviance(n - k, n * (1 - p)) + 0.5 * F.log(n / (2 * math.pi * k * (n - k)))
    )
    return F.when(k == 0, F.exp(n * F.log(1 - p))).when(k == n, F.exp(n * F.log(p))).otherwise(F.exp(logs))


def binomial_lower_tail(k, n, p):
    """P(X <= k) for X ~ Binomial(n, p).

    Terms are added from ``k`` away from the mean, above the mean for the other
    tail; past twelve standard deviations and a few terms more they no longer count,
    so their number grows with the square root of ``n``.
    """
    k = k.cast("double")
    below = k <= n * p
    edge = F.when(below, k).otherwise(k + 1)
    reach = F.ceil(12 * F.sqrt(n * p * (1 - p))) + 60
    room = F.when(below, k).otherwise(n - k - 1)
    steps = F.sequence(F.lit(0).cast("long"), F.greatest(F.least(reach, room), F.lit(0)).cast("long"))

    def step(state, i):
        at = F.when(below, edge - i).otherwise(edge + i)
        follow = F.when(below, at / (n - at + 1) * (1 - p) / p).otherwise((n - at) / (at + 1) * p / (1 - p))
        return F.struct((state["sum"] + state["term"]).alias("sum"), (state["term"] * follow).alias("term"))

    start = F.struct(F.lit(0.0).alias("sum"), binomial_term(edge, n, p).alias("term"))
    tail = F.aggregate(steps, start, step, lambda state: state["sum"])
    return F.when(k < 0, 0.0).when(k >= n, 1.0).when(below, tail).otherwise(1 - tail)


def random_hit_at_k(features, affected, k):
    """Chance that k random features hold an affected one: 1 - C(u,k)/C(n,k)."""
    unaffected = features - affected
    miss = F.aggregate(
        F.sequence(F.lit(0), F.lit(k - 1)),
        F.lit(1.0),
        lambda acc, j: acc * F.greatest(unaffected - j, F.lit(0)) / (features - j),
    )
    return 1 - miss


def pinball(prediction, target, quantile):
    error = target - prediction
    return F.greatest(quantile * error, (quantile - 1) * error)
