"""Evaluation of scored rows.

One grouped count of (label, prediction) is the only pass over the scored rows;
every metric is computed from those few cells.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import CLASS_NAMES
from ..functions.columns import class_name, share


def label_and_prediction(df: DataFrame) -> DataFrame:
    """The two evaluation columns, cluster ids and classes alike as doubles."""
    return df.select(F.col("label"), F.col("prediction").cast("double").alias("prediction"))


def prediction_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("prediction").cast("double").alias("prediction")).count()


def confusion(df: DataFrame) -> DataFrame:
    """Confusion matrix in long form: label, prediction, count."""
    return label_and_prediction(df).groupBy("label", "prediction").count()


def confusion_wide(cells: DataFrame, classes: Sequence[int] = (0, 1)) -> DataFrame:
    """``confusion`` with one column per predicted class and one for every other prediction.

    The columns of a row add up to the rows of its label.
    """
    def counted(hit):
        return F.coalesce(F.sum(F.when(hit, F.col("count"))), F.lit(0))

    known = F.coalesce(F.col("prediction").isin(*map(float, classes)), F.lit(False))
    wide = [counted(F.col("prediction") == float(c)).alias(f"predicted_{c}") for c in classes]
    return cells.groupBy("label").agg(*wide, counted(~known).alias("predicted_other"))


def named_confusion(cells: DataFrame, names: Mapping[int, str] = CLASS_NAMES) -> DataFrame:
    """``confusion`` with display names for both classes."""
    return cells.select(
        class_name("label", names).alias("label"),
        class_name("prediction", names).alias("prediction"),
        "count",
    )


def class_rates(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per class: rows, predicted rows, hits, precision, recall and F1, from ``confusion``.

    Precision and F1 are 0 for a class that is never predicted; recall is null
    for a class without rows. ``by`` names further columns of the cells that tell models apart.
    """
    sides = F.explode(
        F.array(
            F.struct(
                F.col("label").cast("double").alias("class"),
                F.col("count").alias("rows"),
                F.lit(0).cast("long").alias("predicted"),
                F.when(F.col("label") == F.col("prediction"), F.col("count"))
                .otherwise(0).alias("hits"),
            ),
            F.struct(
                F.col("prediction").alias("class"),
                F.lit(0).cast("long").alias("rows"),
                F.col("count").alias("predicted"),
                F.lit(0).cast("long").alias("hits"),
            ),
        )
    ).alias("side")
    sums = (
        cells.select(*by, sides)
        .groupBy(*by, F.col("side.class").alias("class"))
        .agg(*[F.sum(f"side.{c}").alias(c) for c in ("rows", "predicted", "hits")])
    )
    return sums.select(
        "*",
        F.coalesce(share(F.col("hits"), F.col("predicted")), F.lit(0.0)).alias("precision"),
        share(F.col("hits"), F.col("rows")).alias("recall"),
        F.coalesce(share(2 * F.col("hits"), F.col("rows") + F.col("predicted")), F.lit(0.0))
        .alias("f1"),
    )


def metrics(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row (for each value of ``by``): accuracy, weighted precision, weighted F1, weighted recall, detection rates."""
    rates = class_rates(cells, by)

    def weighted(value):
        return share(F.sum(F.col("rows") * value), F.sum("rows"))

    def detection_rate(label):
        return F.max(F.when(F.col("class") == label, F.col("recall")))

    return (rates.groupBy(*by) if by else rates).agg(
        share(F.sum("hits"), F.sum("rows")).alias("accuracy"),
        weighted(F.col("precision")).alias("weighted_precision"),
        weighted(F.col("f1")).alias("f1"),
        weighted(F.coalesce("recall", F.lit(0.0))).alias("weighted_recall"),
        detection_rate(0.0).alias("tpr_0"),
        detection_rate(1.0).alias("tpr_1"),
    )


def detection_rates(cells: DataFrame) -> DataFrame:
    """True-positive rate of every class that has rows."""
    return class_rates(cells).where(F.col("rows") > 0).select(
        F.col("class").cast("int").alias("label"), F.col("recall").alias("tpr")
    )


def missed_detections(df: DataFrame) -> DataFrame:
    """Beacon rows scored benign, all columns."""
    return df.where((F.col("label") == 1) & (F.col("prediction") == 0))


def false_alarms(df: DataFrame) -> DataFrame:
    """Benign rows scored as beacons, all columns."""
    return df.where((F.col("label") == 0) & (F.col("prediction") == 1))
