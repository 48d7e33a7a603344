"""What a fitted model must satisfy, as one row: its own arithmetic redone with column expressions.

``known`` has the feature columns and labels of the training rows, ``scored`` those and the predictions of the test
rows. Where ``known`` has a column ``COPIES``, a row stands for so many equal ones. ``mismatches`` counts rows whose prediction differs from the exported parameters applied to the feature
columns. The other column says whether the fit got somewhere: for a linear machine, whether a step in any single
parameter still lowers the training loss; for a perceptron, whether its training loss lies below what the class
shares alone give.
"""

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models import network
from ..models.forest import node_table, with_votes
from ..models.hinge import certificate, mean, weighted_spread
from ..models.training import FittedModel
from ..sources.layout import COPIES

STEP = 0.05  # in standard deviations of a feature
TOLERANCE = 0.002  # of the mean hinge loss, which is 1 before a fit


def _mismatches(scored: DataFrame, expected) -> tuple[int, int]:
    differ = F.count_if(F.col("prediction") != expected)
    return tuple(scored.agg(F.count("*"), differ).first())


def _counted(known: DataFrame) -> DataFrame:
    return known if COPIES in known.columns else known.withColumn(COPIES, F.lit(1).cast("long"))


def _spread(known: DataFrame, names: list[str]) -> tuple[DataFrame, dict]:
    """``known`` with its copies, and the deviation (of a sample) of every column."""
    known = _counted(known)
    found = weighted_spread(known, names, COPIES)
    n = found["n"] or 0
    return known, {c: found[f"s_{c}"] * math.sqrt(n / (n - 1)) if n > 1 else None for c in names}


def linear_check(model: FittedModel, known: DataFrame, scored: DataFrame) -> DataFrame:
    """(rows, mismatches, improvable) of a linear support vector machine."""
    names, weights = model.spec.features, list(model.estimator.coefficients)
    intercept = model.estimator.intercept

    def margin(w, b):
        return sum((F.lit(float(x)) * F.col(c) for x, c in zip(w, names)), F.lit(float(b)))

    rows, mismatches = _mismatches(scored, F.when(margin(weights, intercept) > 0, 1.0).otherwise(0.0))
    known, spread = _spread(known, names)
    steps = [(weights, intercept)]
    for sign in (STEP, -STEP):
        steps.append((weights, intercept + sign))
        for i, c in enumerate(names):
            if spread[c]:
                moved = [*weights]
                moved[i] += sign / spread[c]
                steps.append((moved, intercept))
    side = F.when(F.col("label") == 1, 1.0).otherwise(-1.0)
    losses = [mean(F.greatest(F.lit(0.0), 1 - side * margin(w, b)), COPIES) for w, b in steps]
    base, *others = known.agg(*[x.alias(f"loss_{i}") for i, x in enumerate(losses)]).first()
    return _row(rows, mismatches, "improvable", min(others) < base - TOLERANCE)


GAP = 0.1  # of the mean hinge loss; fits come within 0.06 of the bound on a hundred rows, 0.02 on a thousand
AGREES = 1e-3  # the gradient's norm against the slope along it
STEP_ALONG = 1e-7


def svm_certificate(model: FittedModel, known: DataFrame) -> DataFrame:
    """(rows, optimal): whether the loss is proven to lie within ``GAP`` of the best."""
    found = certificate(
        _counted(known), model.spec.features, list(model.estimator.coefficients), model.estimator.intercept, copies=COPIES
    )
    return SparkSession.active().createDataFrame(
        [(found.rows, found.bound <= found.loss <= found.bound + GAP)], "rows long, optimal boolean"
    )


def forest_check(model: FittedModel, scored: DataFrame) -> DataFrame:
    """(rows, mismatches): predictions redone from the forest's table of nodes."""
    depth = int(model.estimator.getOrDefault("maxDepth"))
    voted = with_votes(scored, node_table(model), model.spec.features, depth)
    found = _mismatches(voted, F.col("voted"))
    return SparkSession.active().createDataFrame([tuple(found)], "rows long, mismatches long")


def perceptron_check(model: FittedModel, known: DataFrame, scored: DataFrame) -> DataFrame:
    """(rows, mismatches, beats_prior) of a multilayer perceptron."""
    layers, features = _layers(model), model.spec.features
    rows, mismatches = _mismatches(network.with_expected(scored, layers, features), F.col("expected"))
    known = _counted(known)
    n, ones = known.agg(F.sum(COPIES), F.sum(F.col("label") * F.col(COPIES))).first()
    (loss,) = network.mean_losses(known, [layers], features, weight=COPIES)
    entropy = -sum(k / n * math.log(k / n) for k in (ones, n - ones) if k)
    return _row(rows, mismatches, "beats_prior", loss < entropy - 1e-3)


def gradient_check(model: FittedModel, known: DataFrame) -> DataFrame:
    """(rows, agrees, falls): the gradient's norm against the loss a little up and down along it, and the loss
    against that of weights drawn at random, from which a fit starts."""
    features, weights = model.spec.features, np.array(model.estimator.weights, float)
    widths = model.estimator.getOrDefault("layers")
    known = _counted(known)
    gradient, loss, n = network.mean_gradient(known, network.layers_of(widths, weights), features, weight=COPIES)
    norm = float(np.linalg.norm(gradient))
    # Features are as wide as bytes sent, so the step is short; the loss is summed to some 15 digits.
    step = STEP_ALONG / max(1.0, norm) * gradient / max(norm, 1e-300)
    drawn = np.random.default_rng(1).normal(0, 0.3, len(weights))
    up, down, start = network.mean_losses(
        known, [network.layers_of(widths, w) for w in (weights + step, weights - step, drawn)], features,
        weight=COPIES,
    )
    length = float(np.linalg.norm(step))
    slope = (up - down) / (2 * length) if length else 0.0
    return SparkSession.active().createDataFrame(
        [(n, abs(slope - norm) <= AGREES * max(norm, 1e-2), loss < start)], "rows long, agrees boolean, falls boolean"
    )


def _layers(model: FittedModel) -> network.Layers:
    return network.layers_of(model.estimator.getOrDefault("layers"), model.estimator.weights)


def _row(rows, mismatches, name, value):
    return SparkSession.active().createDataFrame(
        [(rows, mismatches, bool(value))], f"rows long, mismatches long, {name} boolean"
    )
