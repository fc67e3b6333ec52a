"""Linear transition models fitted from one Gram matrix, and their roll-outs.

A transition row holds ``state``, ``control``, ``action`` (entity-major) and
``next`` arrays. The joint vector is [state | control | action | 1 | next]; every
model below picks columns of the one Gram matrix of that vector.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidegauge.operators import linear
from tidegauge.operators.frames import framed, halo


@dataclass(frozen=True)
class Layout:
    """Column positions in the joint vector; one state value per entity."""

    entities: int
    controls: int
    action_width: int

    def state(self):
        return list(range(self.entities))

    def control(self):
        return [self.entities + c for c in range(self.controls)]

    def action(self, entity=None):
        base = self.entities + self.controls
        if entity is None:
            return [base + a for a in range(self.entities * self.action_width)]
        start = base + entity * self.action_width
        return list(range(start, start + self.action_width))

    @property
    def one(self):
        return self.entities + self.controls + self.entities * self.action_width

    def next(self):
        return [self.one + 1 + e for e in range(self.entities)]

    @property
    def width(self):
        return self.one + 1 + self.entities


def transitions(steps):
    """Pairs of consecutive steps; control and action at t act on the step to t + 1."""
    rows, w = halo(steps, ["run"], 0, 1)
    rows = rows.withColumns({"next": F.lead("state").over(w), "_at": F.lead("i").over(w)})
    return rows.where(F.col("_own") & (F.col("_at") == F.col("i") + 1)).drop("_own", "_block", "_at")


def joint_gram(rows, layout, keys=()):
    v = F.concat("state", "control", "action", F.array(F.lit(1.0)), "next")
    return linear.gram_matrices(rows.withColumn("_j", v), "_j", layout.width, keys)


def _full(layout, picked):
    """One weight matrix over [state | control | action | 1] from per-entity pieces."""
    w = np.zeros((layout.one + 1, layout.entities))
    for e, (inputs, weights) in picked.items():
        w[inputs, e] = weights[:, 0]
    return w


def fit_graph(g, layout, incoming, ridge=1e-2, actions=True):
    """Each entity from its incoming entities, the controls and its own action."""
    picked = {}
    for e, sources in enumerate(incoming):
        inputs = [*sources, *layout.control(), *(layout.action(e) if actions else []), layout.one]
        w = linear.solve_ridge(g, inputs, [layout.next()[e]], ridge, free=layout.one)
        picked[e] = (inputs, w)
    return _full(layout, picked)


def fit_dense(g, layout, ridge=1e-2, actions=True, masked=()):
    """All entities from all inputs; ``masked`` inputs are left out (an ablation)."""
    inputs = [*layout.state(), *layout.control(), *(layout.action() if actions else []), layout.one]
    inputs = [p for p in inputs if p not in set(masked)]
    w = np.zeros((layout.one + 1, layout.entities))
    w[inputs] = linear.solve_ridge(g, inputs, layout.next(), ridge, free=layout.one)
    return w


def fit_low_rank(g, layout, rank, radius=0.98, ridge=1e-2):
    w = fit_dense(g, layout, ridge)
    n = layout.entities
    w[:n] = linear.contractive_low_rank(w[:n], rank, radius)
    return w


def fit_graph_residual(g, layout, base, neighbours, ridge=1e-2):
    """Ridge of the base model's residual on one-hop inputs, read from the same Gram."""
    inputs_all = list(range(layout.one + 1))
    picked = {}
    for e, near in enumerate(neighbours):
        inputs = [*near, *layout.control(), *layout.action(e), layout.one]
        xx = g[np.ix_(inputs, inputs)]
        xr = g[np.ix_(inputs, [layout.next()[e]])] - g[np.ix_(inputs, inputs_all)] @ base[:, [e]]
        penalty = np.full(len(inputs), ridge)
        penalty[-1] = 0.0
        picked[e] = (inputs, np.linalg.solve(xx + np.diag(penalty), xr))
    return _full(layout, picked)


def one_step_mse(g, layout, w):
    inputs = list(range(layout.one + 1))
    return linear.residual_mse(g, inputs, layout.next(), w, g[layout.one, layout.one])


def rollout(rows, layout, w, correction=None, bound=None):
    """Roll forward from ``state`` over ``controls`` and ``actions`` of each future step.

    The horizon is a bounded loop over a batch of rows inside a task; no observed
    future state is read. Adds ``prediction``: horizon x entities, flat.
    """
    e, c, a = layout.entities, layout.controls, layout.entities * layout.action_width

    @F.pandas_udf("array<double>")
    def roll(state: pd.Series, controls: pd.Series, actions: pd.Series) -> pd.Series:
        x = np.stack(state.to_numpy())
        u = np.stack(controls.to_numpy()).reshape(len(x), -1, c)
        v = np.stack(actions.to_numpy()).reshape(len(x), -1, a)
        out = []
        for h in range(u.shape[1]):
            design = np.hstack([x, u[:, h], v[:, h], np.ones((len(x), 1))])
            x = design @ w
            if correction is not None:
                x = x + np.clip(design @ correction, -bound, bound)
            out.append(x)
        return pd.Series(list(np.stack(out, axis=1).reshape(len(x), -1)))

    return rows.withColumn("prediction", roll("state", "controls", "actions"))


def persistence_rollout(rows, horizon):
    """The last state, repeated."""
    return rows.withColumn("prediction", F.flatten(F.array_repeat("state", horizon)))


def rollout_frames(steps, horizon):
    """State at i, controls and actions of i .. i + h - 1, and the observed i + 1 .. i + h."""
    near = (0, horizon - 1)
    columns = {"_c": ("control", *near), "_a": ("action", *near), "_f": ("state", 1, horizon)}
    return framed(steps, ["run"], 0, horizon, columns).select(
        "run", "i", "state", F.flatten("_c").alias("controls"), F.flatten("_a").alias("actions"), F.flatten("_f").alias("observed"),
    )


def errors_long(rows, layout):
    """Squared error per (run, i, step, entity)."""
    sq = F.zip_with("prediction", "observed", lambda p, o: (p - o) * (p - o))
    return rows.select("run", "i", F.posexplode(sq).alias("p", "sq")).select(
        "run", "i", (F.expr(f"p div {layout.entities}") + 1).alias("step"),
        (F.col("p") % layout.entities).alias("entity"), "sq",
    )
