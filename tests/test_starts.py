"""k-means from several starts at once, against numpy and MLlib."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from pulsetrace.models import starts as S


def rows(seed=1, n=400, width=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 8, (5, width))
    return np.round(centres[rng.integers(0, 5, n)] + rng.normal(0, 2, (n, width)), 1)


def frame(spark, x, parts=3):
    df = spark.createDataFrame([(list(map(float, r)),) for r in x], "a array<double>").repartition(parts)
    return df.select(array_to_vector("a").alias("features"))


def lloyd(x, centres, max_iter, tol):
    centres = np.array(centres, float)
    for step in range(max_iter):
        near = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        new = np.array([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
        far = ((new - centres) ** 2).sum(1).max()
        centres = new
        if far <= tol * tol:
            return centres, step + 1
    return centres, max_iter


@pytest.mark.parametrize("max_iter, tol", [(20, 1e-4), (3, 1e-4), (100, 0.0)])
def test_every_start_ends_where_it_would_alone(spark, max_iter, tol):
    x = np.concatenate([rows(), rows()[:150]])  # repeated rows
    rng = np.random.default_rng(2)
    given = {s: x[rng.choice(len(x), 4, replace=False)].tolist() for s in range(6)}
    given[9] = [*x[:3].tolist(), [1e6, 1e6, 1e6]]  # a centre that no row is nearest to
    points = S.weighted_points(frame(spark, x))
    assert points.count() == len(np.unique(x, axis=0)) and points.agg(F.sum("w")).first()[0] == len(x)
    for found in S.fit_starts(points, given, max_iter, tol):
        centres, rounds = lloyd(x, given[found.seed], max_iter, tol)
        assert found.rounds == rounds
        assert np.allclose(found.centres, centres, atol=1e-9)
        gaps = ((x[:, None] - centres) ** 2).sum(2)
        assert found.cost == pytest.approx(gaps.min(1).sum(), rel=1e-9)
        near = gaps.argmin(1).tolist()
        scored = spark.createDataFrame(
            [(r, c) for r, c in zip(x.tolist(), near, strict=True)], "a array<double>, prediction int"
        ).select(array_to_vector("a").alias("features"), "prediction")
        assert found.silhouette == pytest.approx(ClusteringEvaluator().evaluate(scored), abs=1e-9)


def test_first_centres_do_not_depend_on_the_layout(spark):
    x = rows(3)
    chosen = [S.first_centres(S.weighted_points(frame(spark, x, n)), range(8), 4) for n in (1, 7)]
    assert chosen[0] == chosen[1]
    known = set(map(tuple, x.tolist()))
    for centres in chosen[0].values():
        assert len(set(map(tuple, centres))) == 4 and all(tuple(c) in known for c in centres)
    assert len({str(c) for c in chosen[0].values()}) > 5


def test_first_centres_follow_weight_and_distance(spark):
    x = [[0.0]] * 60 + [[1.0]] * 30 + [[10.0]] * 10
    points = S.weighted_points(frame(spark, x))
    n = 600
    first = [c[0][0] for c in S.first_centres(points, range(n), 1).values()]
    assert [abs(first.count(v) / n - p) < 0.07 for v, p in ((0.0, 0.6), (1.0, 0.3), (10.0, 0.1))] == [True] * 3
    second = [c[1][0] for c in S.first_centres(points, range(n), 2).values() if c[0][0] == 0.0]
    share = 30 * 1 / (30 * 1 + 10 * 100)
    assert abs(second.count(1.0) / len(second) - share) < 0.05 and 0.0 not in second
    even = [c[1][0] for c in S.first_centres(points, range(n), 2, far=False).values() if c[0][0] == 0.0]
    assert abs(even.count(1.0) / len(even) - 0.75) < 0.1


def test_fewer_rows_than_centres(spark):
    points = S.weighted_points(frame(spark, [[1.0, 2.0]] * 5))
    (start,) = S.fit_starts(points, S.first_centres(points, [1], 3))
    assert start.centres == [[1.0, 2.0]] * 3 and start.cost == 0 and start.silhouette is None
    assert S.fit_starts(points, {}) == [] and S.first_centres(points.limit(0), [1, 2], 2) == {}


def test_a_single_row_of_its_own_cluster_counts_zero(spark):
    x = np.array([[0.0], [1.0], [50.0]])
    (start,) = S.fit_starts(S.weighted_points(frame(spark, x)), {1: [[0.0], [50.0]]})
    a, b = 1.0, 2500.0
    assert start.silhouette == pytest.approx((1 - a / b + 1 - a / 2401.0 + 0) / 3, abs=1e-12)


def test_as_good_as_mllib(spark):
    x = rows(5, 600)
    points = S.weighted_points(frame(spark, x))
    best = min(s.cost for s in S.fit_starts(points, S.first_centres(points, range(10), 5)))
    theirs = min(KMeans(k=5, seed=s).fit(frame(spark, x)).summary.trainingCost for s in range(3))
    assert best <= theirs * 1.001


def test_a_round_is_one_scan_for_all_starts(spark):
    points = S.weighted_points(frame(spark, rows()))
    given = {s: [[float(s)] * 3, [float(-s)] * 3] for s in range(1, 11)}
    plan = S.assigned(points, given).groupBy("seed", "cluster").agg(F.sum("w"))._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert text.count("Scan parquet") == 1 and "Join" not in text and "ArrowEval" not in text
