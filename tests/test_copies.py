"""Fits and checks on counted rows against the same rows one by one."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F
from test_models import connections, groups

from pulsetrace.models import network as N
from pulsetrace.models import training as T
from pulsetrace.models.descent import minimise
from pulsetrace.models.hinge import certificate
from pulsetrace.models.specs import SPECS
from pulsetrace.operators.indexing import category_counts
from pulsetrace.sources.layout import COPIES, counted_rows, stable_layout, weighted_layout


def repeated(df, n=30):
    return df.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(n)))).drop("_k")


def mllib(spec, df):
    rows = stable_layout(T.read_rows(spec, df))
    features = T.fit_features(spec, rows)
    return T._estimator(spec, features).fit(T._vectors(spec, features, rows))


@pytest.mark.parametrize("name, make", [("conn_perceptron", connections), ("group_perceptron", groups)])
def test_a_perceptron_goes_the_way_of_mllib(spark, name, make):
    spec, df = SPECS[name].with_params(maxIter=6), make(spark, 384)  # whole blocks of MLlib's
    model = T.fit(spec, df).estimator
    assert np.allclose(model.weights.toArray(), mllib(spec, df).weights.toArray(), rtol=1e-9, atol=1e-9)
    assert model.getOrDefault("maxIter") == 6
    again = T.fit(spec, repeated(df).repartition(7)).estimator
    assert np.allclose(model.weights.toArray(), again.weights.toArray(), rtol=1e-6, atol=1e-6)


def test_a_perceptron_reads_distinct_rows(spark, monkeypatch):
    df = repeated(connections(spark, 20))
    held = {}
    monkeypatch.setattr(N, "minimise", lambda f, start, *_: held.update(at=f(start)) or start)
    spec = SPECS["conn_perceptron"]
    T.fit(spec, df)
    counted = T.laid_out(spec, T.read_rows(spec, df))
    assert counted.count() == 20 and counted.agg(F.sum(COPIES)).first()[0] == 600
    monkeypatch.undo()
    flat = T.fit(spec.with_params(maxIter=0), df).estimator.weights.toArray()
    features = T.fit_features(spec, df).score(df, drop_nulls=False)
    slope, loss, n = N.mean_gradient(features, N.layers_of([9, 18, 18, 2], flat), spec.features)
    assert n == 600 and held["at"][0] == pytest.approx(loss, rel=1e-12) and np.allclose(held["at"][1], slope)


def test_a_pass_over_packed_rows_sums_what_the_rows_give(spark):
    rng, widths = np.random.default_rng(3), [4, 18, 18, 2]
    n = 2 * N.AT_ONCE + 77  # whole chunks and what is left over
    x = np.column_stack([rng.integers(0, 3, n), rng.integers(0, 90_000, n), rng.integers(-9, 9, n) / 4, rng.normal(size=n)])
    y, w = rng.integers(0, 2, n), rng.integers(1, 2000, n)
    rows = spark.createDataFrame(
        [(Vectors.dense(a), int(b), int(c)) for a, b, c in zip(x, y, w)], ["features", "label", COPIES]
    ).coalesce(1)
    packed = N._packed(rows, COPIES).select("kinds", "size", "rows")
    assert {r.kinds for r in packed.collect()} == {"bifdbh"}
    layers = N.layers_of(widths, rng.normal(0, 0.3, 4 * 18 + 18 + 18 * 18 + 18 + 18 * 2 + 2) / 50)
    want = N._part(x, y, w.astype(float), [layers], True)
    found = N.swept(packed.toArrow().to_batches(), layers)
    assert np.allclose(found, want, rtol=1e-12, atol=1e-9) and N.swept([], layers) is None
    far = N.layers_of(widths, rng.normal(0, 1e6, len(want) - 1))  # signals of 0 and 1
    assert np.allclose(N.swept(packed.toArrow().to_batches(), far), N._part(x, y, w.astype(float), [far], True))


def test_a_pass_reads_narrow_columns_in_equal_tasks(spark, monkeypatch):
    df = spark.range(40_000).select(
        F.array(*[(F.col("id") % (k + 2)).cast("double") for k in range(9)]).alias("x"), (F.col("id") % 2).alias("label"),
        F.lit(1).alias(COPIES),
    ).repartition(16)
    vectors = df.select(array_to_vector("x").alias("features"), "label", COPIES)
    blocks = N._packed(vectors, COPIES)
    size, rows, number = blocks.agg(F.sum(F.length("rows")), F.sum("size"), F.count("*")).first()
    assert rows == 40_000 and size <= 12 * rows  # eight bytes each were 84
    dealt = N._dealt(blocks, number, 16)
    found = [r[0] for r in dealt.groupBy(F.spark_partition_id()).agg(F.sum("size")).select("sum(size)").collect()]
    assert sum(found) == 40_000 and len(found) == 8 and max(found) < 1.1 * min(found)
    monkeypatch.setattr(N, "BLOCKS_PER_TASK", 1)
    assert N._dealt(blocks, number, 16).rdd.getNumPartitions() == 16
    assert N._dealt(blocks, 1, 1).rdd.getNumPartitions() == 1


@pytest.mark.parametrize("values, kind", [
    ([0, -128, 127], "b"), ([0, 128], "h"), ([0, -40_000], "i"), ([0.5, 2.0**40], "f"), ([0.1], "d"), ([float(2**53)], "f"),
    ([2.0**53 - 1], "d"), ([1e300], "d"),
])
def test_columns_are_narrowed_without_loss(values, kind):
    column = np.array(values, float)
    short = N._narrow(column)
    assert short.dtype.char == kind and np.array_equal(short.astype(float), column)


def test_labels_that_are_no_classes_are_refused(spark):
    for label in (F.lit(-1), F.lit(2), F.lit(None).cast("int")):
        with pytest.raises(Exception, match="label"):
            T.fit(SPECS["conn_perceptron"], connections(spark, 20).withColumn("label", label))


def test_descent_ends_at_the_least_value():
    scale = np.array([1.0, 30.0, 400.0])
    bowl = lambda x: (float(scale @ (x - 1) ** 2), 2 * scale * (x - 1))
    assert np.allclose(minimise(bowl, np.zeros(3), 100, 1e-12), 1, atol=1e-4)
    assert np.array_equal(minimise(bowl, np.zeros(3), 0), np.zeros(3))


@pytest.mark.parametrize("name, make", [("conn_linear_svm", connections), ("group_linear_svm", groups)])
def test_a_linear_fit_reads_copies_as_weights(spark, name, make, monkeypatch):
    monkeypatch.setattr(T, "HELD", 500)
    spec, df = SPECS[name].with_params(maxIter=5), repeated(make(spark, 100), 100)
    counted = T.laid_out(spec, T.read_rows(spec, df))
    assert counted.count() <= 600 and counted.agg(F.sum(COPIES), F.max(COPIES)).first() == (10_000, 20)
    found, want = T.fit(spec, df).estimator, mllib(spec, df)
    assert np.allclose(found.coefficients, want.coefficients, rtol=0.02, atol=1e-4)
    few = T.laid_out(spec, T.read_rows(spec, make(spark, 100)))
    assert few.count() == 100 and few.agg(F.max(COPIES)).first()[0] == 1


def test_checks_of_counted_rows_are_those_of_the_rows(spark):
    spec, df = SPECS["group_linear_svm"], repeated(groups(spark, 100), 7)
    rows = df.select(*spec.features, "label")
    weights = np.linspace(-1, 1, len(spec.features))
    plain, short = certificate(rows, spec.features, weights, 0.5), certificate(
        counted_rows(rows), spec.features, weights, 0.5, copies=COPIES)
    assert short.rows == plain.rows == 700
    assert (short.loss, short.bound) == pytest.approx((plain.loss, plain.bound), rel=1e-9)
    columns = ["proto", "history"]
    each = repeated(connections(spark, 50))
    assert sorted(category_counts(counted_rows(each.select(*columns)), columns).collect()) == sorted(
        category_counts(each, columns).collect())


def test_few_distinct_rows_are_dealt_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr("pulsetrace.sources.layout._BLOCKS_PER_TASK", 1)
    monkeypatch.setattr("pulsetrace.sources.layout._COPIES_PER_ROW", 100)
    df = spark.range(2000).select(F.lit(1).alias("a"))
    dealt = stable_layout(df, 100)
    assert dealt._jdf.queryExecution().logical().toString().count("RepartitionByExpression") == 2
    assert dealt.count() == 2000 and dealt.rdd.getNumPartitions() == 20
    assert weighted_layout(df.limit(0)).count() == weighted_layout(df.limit(0), 10).count() == 0
