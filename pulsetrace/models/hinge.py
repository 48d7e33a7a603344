"""How far a linear support vector machine is from the best: a lower bound of its loss from the dual.

For weights a_i between 0 and 1/n, the mean hinge loss of any plane (u, b) is at least
sum a_i - u.v - b s with v = sum a_i y_i x_i and s = sum a_i y_i, so at least sum a_i - R |(v, s)| for planes of norm up
to R. The weights come from the loss smoothed over a width: a_i = clip((1 - margin_i) / width, 0, 1) / n. Newton steps on that loss, one aggregate
each, bring (v, s) to zero, first for a wide band, then for ever narrower ones. Features are standardised first; the
hinge does not notice.
"""

from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTHS = tuple(2.0**-k for k in range(-2, 8))
ROUNDS = 12  # at most, for each width
CLOSE = 0.005  # how near the bound comes to the best loss seen before the search ends


@dataclass
class Certificate:
    """``loss`` is the plane's own; no plane of up to ``reach`` times its norm has less than ``bound``."""

    rows: int
    loss: float
    bound: float
    reach: float

    @property
    def gap(self) -> float:
        return self.loss - self.bound


def certificate(
    rows: DataFrame, features: list[str], weights, intercept: float, reach: float = 10.0, widths=WIDTHS,
    copies: str | None = None,
) -> Certificate:
    """The certificate of a plane over ``rows`` (features and ``label``, 1 or another).

    ``copies`` names a column that tells how many equal rows a row stands for.
    """
    rows = rows.withColumn("_n", F.lit(1.0) if copies is None else F.col(copies).cast("double"))
    spread = weighted_spread(rows, features, "_n")
    weights = np.array(weights, float)
    mean = np.array([spread[f"m_{c}"] for c in features], float)
    scale = np.array([spread[f"s_{c}"] or 1.0 for c in features], float)
    side = F.when(F.col("label") == 1, 1.0).otherwise(-1.0)
    scaled = rows.select(
        *[((F.col(c) - F.lit(float(m))) / F.lit(float(s))).alias(f"z{i}") for i, (c, m, s) in enumerate(zip(features, mean, scale))],
        F.lit(1.0).alias(f"z{len(features)}"), side.alias("y"), "_n",
    )
    names = [f"z{i}" for i in range(len(features) + 1)]
    own = np.append(weights * scale, intercept + float(weights @ mean))
    limit = reach * max(float(np.linalg.norm(own)), 1.0)
    start = _sums(scaled, names, own, widths[-1])
    loss, best, at = start["hinge"], start["sum"] - limit * float(np.linalg.norm(start["v"])), np.zeros(len(names))
    least, part = loss, 1.0
    for width in widths:
        got = _sums(scaled, names, at, width)
        for _ in range(ROUNDS):
            size = float(np.linalg.norm(got["v"]))
            least, best = min(least, got["hinge"]), max(best, got["sum"] - limit * size)
            if size * limit < width / 100:
                break
            damped = got["h"] + (1e-7 * np.trace(got["h"]) + 1e-7) * np.eye(len(names))
            move, part = np.linalg.solve(damped, got["v"]), min(1.0, 4 * part)
            while True:
                new = _sums(scaled, names, at + part * move, width)
                if new["smooth"] <= got["smooth"] - 1e-4 * part * float(got["v"] @ move) or part < 1e-3:
                    break
                part /= 4
            if new["smooth"] >= got["smooth"]:
                break
            at, got = at + part * move, new
        if least - best < CLOSE:
            break
    return Certificate(spread["n"], float(loss), float(best), reach)


def weighted_spread(rows: DataFrame, columns: list[str], copies: str) -> dict:
    """``n`` and per column the mean ``m_`` and the deviation ``s_`` (of a population) of rows that stand for ``copies`` rows."""
    means = rows.agg(F.sum(copies).cast("long").alias("n"), *[mean(F.col(c), copies).alias(f"m_{c}") for c in columns]).first()
    if not means["n"]:
        return {"n": 0, **{f"{k}_{c}": None for k in "ms" for c in columns}}
    off = {c: F.col(c) - F.lit(means[f"m_{c}"]) for c in columns}
    found = rows.agg(*[F.sqrt(mean(off[c] * off[c], copies)).alias(f"s_{c}") for c in columns]).first() if columns else None
    return {**means.asDict(), **(found.asDict() if found else {})}


def mean(value, copies: str):
    return F.sum(value * F.col(copies)) / F.sum(copies)


def _sums(scaled: DataFrame, names: list[str], plane: np.ndarray, width: float) -> dict:
    """Means over the rows at ``plane``: the hinge, the smoothed one with its slope and curvature, and the weights."""
    margin = sum((F.lit(float(w)) * F.col(c) for w, c in zip(plane, names)), F.lit(0.0))
    short = scaled.select(*names, "y", "_n", (1 - F.col("y") * margin).alias("short"))
    share = F.least(F.greatest(F.col("short") / width, F.lit(0.0)), F.lit(1.0))
    inside = F.when((F.col("short") > 0) & (F.col("short") < width), 1.0).otherwise(0.0)
    staged = short.select(*names, "y", "_n", "short", share.alias("a"), inside.alias("inside"))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    avg = partial(mean, copies="_n")
    got = staged.agg(
        avg(F.greatest("short", F.lit(0.0))), avg(F.col("a") * F.col("short") - F.col("a") * F.col("a") * (width / 2)),
        avg(F.col("a")), *[avg(F.col("a") * F.col("y") * F.col(c)) for c in names],
        *[avg(F.col("inside") * F.col(names[i]) * F.col(names[j])) for i, j in pairs],
    ).first()
    h = np.zeros((len(names), len(names)))
    for (i, j), value in zip(pairs, got[3 + len(names):]):
        h[i, j] = h[j, i] = value / width
    return {"hinge": got[0], "smooth": got[1], "sum": got[2], "v": np.array(got[3 : 3 + len(names)]), "h": h}
