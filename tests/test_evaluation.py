"""Metrics from one grouped count, against MLlib's evaluators; clusters against brute force."""

import random

import numpy as np
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from pulsetrace.fixed_values import CLASS_NAMES
from pulsetrace.operators import clusters as C
from pulsetrace.operators import evaluation as E

MLLIB = {
    "accuracy": "accuracy",
    "weighted_precision": "weightedPrecision",
    "f1": "f1",
    "weighted_recall": "weightedRecall",
}


def scored(spark, pairs):
    return spark.createDataFrame(
        [(a, float(b)) for a, b in pairs], "label int, prediction double"
    )


def random_pairs(seed, labels, predictions, n=300):
    rng = random.Random(seed)
    return [(rng.choice(labels), rng.choice(predictions)) for _ in range(n)]


@pytest.mark.parametrize(
    "pairs",
    [
        random_pairs(1, [0, 1], [0, 1]),
        random_pairs(2, [0, 0, 0, 1], [0]),
        random_pairs(3, [0, 1], [1, 2]),
        random_pairs(4, range(6), range(5)),
        [(0, 0)],
    ],
)
def test_metrics_equal_mllib(spark, pairs):
    df = scored(spark, pairs)
    row = E.metrics(E.confusion(df)).first()
    for ours, theirs in MLLIB.items():
        want = MulticlassClassificationEvaluator(labelCol="label", metricName=theirs).evaluate(df)
        assert row[ours] == pytest.approx(want, abs=1e-12), ours
    for label in {a for a, _ in pairs} & {0, 1}:
        want = MulticlassClassificationEvaluator(
            labelCol="label", metricName="truePositiveRateByLabel", metricLabel=label
        ).evaluate(df)
        assert row[f"tpr_{label}"] == pytest.approx(want, abs=1e-12)


def test_rate_of_an_absent_class_is_null(spark):
    row = E.metrics(E.confusion(scored(spark, [(0, 0), (0, 1)]))).first()
    assert row["tpr_0"] == 0.5 and row["tpr_1"] is None
    rates = E.detection_rates(E.confusion(scored(spark, [(0, 0), (0, 1)]))).collect()
    assert [(r.label, r.tpr) for r in rates] == [(0, 0.5)]


def test_no_rows_give_null_metrics(spark):
    row = E.metrics(E.confusion(scored(spark, []))).first()
    assert all(v is None for v in row)


def test_confusion_forms_and_error_slices(spark):
    df = scored(spark, [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 0)] * 3 + [(1, 1)])
    cells = E.confusion(df)
    wide = {r.label: (r.predicted_0, r.predicted_1) for r in E.confusion_wide(cells).collect()}
    one = {r.label: (r.predicted_0, r.predicted_other) for r in E.confusion_wide(cells, [0]).collect()}
    assert one == {0: (5, 2), 1: (3, 1)}
    assert wide == {0: (5, 2), 1: (3, 1)}
    named = {(r[0], r[1]): r[2] for r in E.named_confusion(E.confusion(df)).collect()}
    good, bad = CLASS_NAMES[0], CLASS_NAMES[1]
    assert named == {(good, good): 5, (good, bad): 2, (bad, good): 3, (bad, bad): 1}
    assert E.missed_detections(df).count() == 3 and E.false_alarms(df).count() == 2
    ids = df.withColumn("prediction", F.col("prediction").cast("int"))
    assert dict(E.prediction_counts(ids).dtypes)["prediction"] == "double"
    assert {r[0]: r[1] for r in E.prediction_counts(ids).collect()} == {0.0: 8, 1.0: 3}


def brute_silhouette(points, clusters):
    points, clusters = np.array(points), np.array(clusters)
    dist = ((points[:, None, :] - points[None, :, :]) ** 2).sum(-1)
    out = []
    for i, own in enumerate(clusters):
        same = (clusters == own).sum()
        if same == 1:
            out.append(0.0)
            continue
        a = dist[i][clusters == own].sum() / (same - 1)
        b = min(dist[i][clusters == c].mean() for c in set(clusters) if c != own)
        out.append((b - a) / max(a, b))
    return np.mean(out)


def vector_frame(spark, points, clusters):
    rows = [(list(map(float, p)), int(c)) for p, c in zip(points, clusters)]
    return spark.createDataFrame(rows, "x array<double>, prediction int").select(
        array_to_vector("x").alias("features"), "prediction"
    )


def test_silhouette_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    points, clusters = rng.normal(size=(80, 4)), rng.integers(0, 3, 80)
    clusters[-1] = 3  # a cluster of one
    got = C.silhouette(vector_frame(spark, points, clusters))
    assert got == pytest.approx(brute_silhouette(points, clusters), abs=1e-9)


def test_silhouette_of_one_cluster_is_none(spark):
    assert C.silhouette(vector_frame(spark, [[1.0], [2.0]], [0, 0])) is None


def test_cluster_map_and_alignment(spark):
    df = scored(spark, [(1, 0)] * 3 + [(0, 0)] + [(0, 1)] * 2 + [(1, 1)] * 2)
    label_map = C.cluster_label_map(df)
    assert {r[0]: r[1] for r in label_map.collect()} == {0.0: 1, 1.0: 0}  # tie: smaller label
    aligned = C.align_clusters(df, label_map)
    assert aligned.columns == df.columns and aligned.count() == df.count()
    assert aligned.where("label = prediction").count() == 5
