"""Fitted models outside MLlib: forests as node tables, networks as expressions, bounds of the hinge loss."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_models import QUICK, connections, groups

from pulsetrace.models import network as N
from pulsetrace.models.forest import node_table, with_votes
from pulsetrace.models.hinge import certificate
from pulsetrace.models.specs import SPECS
from pulsetrace.models.training import fit

# Down from the root by one row per level: the tree is walked in SQL, from its table alone.
WALK = """
WITH RECURSIVE walk AS (
  SELECT r.id, n.tree, n.node FROM rows r, nodes n WHERE n.node = 0
  UNION ALL
  SELECT a.id, a.tree, CASE WHEN coalesce(list_contains(n.categories, r.x[n.feature + 1]), r.x[n.feature + 1] <= n.threshold)
    THEN n."left" ELSE n."right" END
  FROM walk a JOIN nodes n ON n.tree = a.tree AND n.node = a.node JOIN rows r ON r.id = a.id WHERE n."left" >= 0),
votes AS (
  SELECT a.id, sum(n.shares[1] ORDER BY a.tree) AS v0, sum(n.shares[2] ORDER BY a.tree) AS v1
  FROM walk a JOIN nodes n ON n.tree = a.tree AND n.node = a.node WHERE n."left" < 0 GROUP BY a.id)
SELECT r.id, CASE WHEN v1 > v0 THEN 1e0 ELSE 0e0 END AS voted, r.prediction FROM rows r JOIN votes USING (id)"""


def noisy(df):
    """Labels that no feature decides, so that trees grow deep."""
    return df.withColumn("label", F.pmod(F.xxhash64(*df.columns), F.lit(2)).cast("int"))


@pytest.mark.parametrize("name, make", [("conn_random_forest", connections), ("group_random_forest", groups)])
def test_a_forest_s_table_gives_its_predictions(spark, name, make):
    for df in (make(spark), noisy(make(spark))):
        spec = SPECS[name].with_params(numTrees=7)
        model = fit(spec, df)
        scored = model.score(df)
        nodes = node_table(model)
        trees = model.estimator.trees
        assert nodes.count() == sum(t.numNodes for t in trees) and nodes.select("tree").distinct().count() == len(trees)
        voted = with_votes(scored, nodes, spec.features, max(t.depth for t in trees))
        assert voted.where("voted <> prediction").isEmpty() and voted.count() == df.count()
        x = F.array(*[F.col(c).cast("double") for c in spec.features]).alias("x")
        rows = scored.select(F.monotonically_increasing_id().alias("id"), x, "prediction").toArrow()
        con = duckdb.connect()
        con.register("rows", rows)
        con.register("nodes", nodes.toArrow())
        walked = con.execute(WALK).fetchall()
        assert len(walked) == rows.num_rows and all(a == b for _, a, b in walked)
        if name.startswith("conn"):
            assert nodes.where("categories IS NOT NULL AND threshold IS NULL").count() > 0


def test_a_forest_over_the_limit_is_refused(spark):
    df = groups(spark)
    spec = SPECS["group_random_forest"].with_params(numTrees=2)
    model = fit(spec, df)
    with pytest.raises(ValueError, match="nodes"):
        with_votes(model.score(df), node_table(model), spec.features, max_nodes=1)


def test_signals_are_those_of_the_network(spark):
    df = connections(spark)
    spec = SPECS["conn_perceptron"].with_params(**QUICK["conn_perceptron"])
    model = fit(spec, df)
    layers = N.layers_of(model.estimator.getOrDefault("layers"), model.estimator.weights)
    scored = model.score(df)
    for r in scored.select("rawPrediction", *spec.features).collect():
        x = np.array([[float(v) for v in r[1:]]])
        assert np.allclose(r[0].toArray(), N.signals(x, layers)[-1][0], rtol=1e-9, atol=1e-9)
    redone = N.with_expected(scored, layers, spec.features)
    assert redone.where("prediction <> expected").isEmpty() and redone.count() == df.count()


def test_the_gradient_equals_differences_of_the_loss(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(0, 1, (60, 3)), rng.integers(0, 2, 60)
    df = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y)], "p double, q double, r double, label int")
    widths = [3, 4, 2]
    flat = rng.normal(0, 0.7, 3 * 4 + 4 + 4 * 2 + 2)

    def mean_loss(w):
        signal = x
        layers = N.layers_of(widths, w)
        for k, (matrix, bias) in enumerate(layers):
            signal = signal @ matrix.T + bias
            if k + 1 < len(layers):
                signal = 1 / (1 + np.exp(-signal))
        return np.mean(np.log(np.exp(signal).sum(1)) - signal[np.arange(len(y)), y])

    for parts in (1, 7):
        gradient, loss, n = N.mean_gradient(df.repartition(parts), N.layers_of(widths, flat), ["p", "q", "r"])
        assert n == 60 and loss == pytest.approx(mean_loss(flat), rel=1e-12)
        step = 1e-6 * np.eye(len(flat))
        assert np.allclose(gradient, [(mean_loss(flat + s) - mean_loss(flat - s)) / 2e-6 for s in step], atol=1e-8)
    others = [flat, 2 * flat, 0 * flat]
    found = N.mean_losses(df, [N.layers_of(widths, w) for w in others], ["p", "q", "r"])
    assert found == pytest.approx([mean_loss(w) for w in others], rel=1e-12)


def hinge(x, y, w, b):
    return np.maximum(0, 1 - y * (x @ w + b)).mean()


def test_no_plane_lies_below_the_bound(spark):
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.normal(50, 20, 400), rng.normal(0, 0.1, 400)])
    y = np.where(x[:, 0] / 20 + x[:, 1] * 10 + rng.normal(0, 1.5, 400) > 2.5, 1, -1)
    df = spark.createDataFrame([(*map(float, a), int(b > 0)) for a, b in zip(x, y)], "p double, q double, label int")
    w, b = np.array([0.02, 3.0]), -1.0
    found = certificate(df, ["p", "q"], w, b)
    assert found.rows == 400 and found.loss == pytest.approx(hinge(x, y, w, b), rel=1e-12)
    scale, mean = x.std(0), x.mean(0)
    best = np.inf
    for _ in range(20_000):
        u = rng.normal(0, 1.5, 2) / scale
        best = min(best, hinge(x, y, u, rng.normal(0, 1) - u @ mean))
    assert found.bound <= best <= found.bound + 0.03 and found.gap > 0


def test_a_bad_plane_is_not_certified(spark):
    df = groups(spark)
    spec = SPECS["group_linear_svm"]
    rows = df.select(*spec.features, "label")
    good = fit(spec, df).estimator
    assert certificate(rows, spec.features, good.coefficients, good.intercept).gap < 0.05
    assert certificate(rows, spec.features, [0.0] * len(spec.features), 0.0).gap > 0.05
