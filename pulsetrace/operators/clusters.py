"""Cluster quality and the map from cluster ids to classes."""

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def silhouette(df: DataFrame, features: str = "features", prediction: str = "prediction"):
    """Mean silhouette on squared Euclidean distance; None with fewer than two clusters."""
    evaluator = ClusteringEvaluator(
        featuresCol=features,
        predictionCol=prediction,
        metricName="silhouette",
        distanceMeasure="squaredEuclidean",
    )
    # Stops at the first row of a second cluster, so it reads few rows unless there is only one.
    first = df.select(prediction).first()
    if first is None or df.where(F.col(prediction) != first[0]).isEmpty():
        return None
    return evaluator.evaluate(df)


def cluster_label_map(df: DataFrame) -> DataFrame:
    """Most frequent label of each cluster, the smaller label on a tie."""
    cells = df.groupBy("prediction", "label").count()
    best = F.max_by("label", F.struct(F.col("count"), -F.col("label")))
    return cells.groupBy("prediction").agg(best.alias("majority_label"))


def align_clusters(df: DataFrame, label_map: DataFrame) -> DataFrame:
    """Replace cluster ids by the label of ``label_map``, which has one row per cluster."""
    named = df.join(F.broadcast(label_map), "prediction", "left")
    return named.withColumn("prediction", F.col("majority_label").cast("double")).select(df.columns)
