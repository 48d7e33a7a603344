"""Confusion matrices, metrics, error slices and cluster quality on rule-based predictions."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..models.specs import SPECS
from ..models.training import fit_features
from ..operators import evaluation as E
from ..operators.clusters import cluster_label_map, silhouette
from ..fixed_values import CLASS_NAMES
from . import standins as S
from .label_queries import LABELLED, labelled_connections
from .registry import query
from .scan_queries import rounded
from .sql import METRIC_NAMES, index_cte, indexed_cte, metrics_ctes, silhouette_ctes

PLACES = 9


def rule_scored(spark, sf_dir):
    """Connections labelled by destination and scored by a fixed rule."""
    beacon = F.col("service").isin("http", "ssl") & (F.col("orig_pkts") >= 36)
    return labelled_connections(spark, sf_dir).withColumn(
        "prediction", F.when(beacon, 1.0).otherwise(0.0)
    )


RULE = LABELLED + """,
rule_scored AS (
  SELECT *, CASE WHEN service IN ('http', 'ssl') AND orig_pkts >= 36
    THEN 1e0 ELSE 0e0 END AS prediction FROM conn_labelled)"""


def vector_scored(spark, sf_dir):
    """Vectors with ten labels, predicted by the position of their largest component."""
    best = (F.array_position("embedding", F.array_max("embedding")) - 1) % 10
    return S.vectors(spark, sf_dir).withColumn("prediction", best.cast("int"))


VECTOR = """WITH
vector_scored AS (
  SELECT *, (list_position(embedding, list_max(embedding)) - 1) % 10 AS prediction
  FROM embeddings)"""

ROUNDED_METRICS_SQL = "SELECT " + ", ".join(
    f"round({m}, {PLACES}) AS {m}" for m in METRIC_NAMES
) + " FROM metrics"


@query(RULE + 'SELECT label, prediction, count(*) AS "count" FROM rule_scored GROUP BY ALL')
def confusion_matrix(spark, sf_dir):
    return E.confusion(rule_scored(spark, sf_dir))


@query(RULE + """SELECT label, count(*) FILTER (prediction = 0) AS predicted_0,
  count(*) FILTER (prediction = 1) AS predicted_1, CAST(0 AS BIGINT) AS predicted_other
FROM rule_scored GROUP BY label""")
def confusion_pivot(spark, sf_dir):
    return E.confusion_wide(E.confusion(rule_scored(spark, sf_dir)))


@query(VECTOR + "SELECT label, " + ", ".join(
    f"count(*) FILTER (prediction = {c}) AS predicted_{c}" for c in range(6)
) + """, count(*) FILTER (prediction > 5) AS predicted_other FROM vector_scored GROUP BY label""")
def confusion_pivot_ten_classes(spark, sf_dir):
    """Six named columns; the predictions of the other four classes stay in one more."""
    return E.confusion_wide(E.confusion(vector_scored(spark, sf_dir)), range(6))


def _named(column):
    return f"CASE {column} WHEN 0 THEN '{CLASS_NAMES[0]}' ELSE '{CLASS_NAMES[1]}' END"


@query(RULE + f"""SELECT {_named("label")} AS label, {_named("prediction")} AS prediction,
  count(*) AS "count" FROM rule_scored GROUP BY ALL""")
def confusion_named(spark, sf_dir):
    return E.named_confusion(E.confusion(rule_scored(spark, sf_dir)))


@query(VECTOR + """SELECT CAST(prediction AS DOUBLE) AS prediction, count(*) AS "count"
FROM vector_scored GROUP BY ALL""")
def prediction_counts(spark, sf_dir):
    return E.prediction_counts(vector_scored(spark, sf_dir))


@query(RULE + "," + metrics_ctes("rule_scored") + ROUNDED_METRICS_SQL)
def metrics_all(spark, sf_dir):
    cells = E.confusion(rule_scored(spark, sf_dir))
    return rounded(E.metrics(cells), METRIC_NAMES, PLACES)


@query(VECTOR + "," + metrics_ctes("vector_scored") + ROUNDED_METRICS_SQL)
def metrics_ten_classes(spark, sf_dir):
    cells = E.confusion(vector_scored(spark, sf_dir))
    return rounded(E.metrics(cells), METRIC_NAMES, PLACES)


@query(VECTOR + "," + metrics_ctes("vector_scored") + f"""
SELECT class, rows, predicted, hits, round(precision, {PLACES}) AS precision,
  round(recall, {PLACES}) AS recall, round(f1, {PLACES}) AS f1 FROM rates""")
def rates_by_class(spark, sf_dir):
    cells = E.confusion(vector_scored(spark, sf_dir))
    return rounded(E.class_rates(cells), ("precision", "recall", "f1"), PLACES)


@query(RULE + "," + metrics_ctes("rule_scored") + f"""
SELECT CAST(class AS INTEGER) AS label, round(recall, {PLACES}) AS tpr FROM rates WHERE rows > 0""")
def tpr_by_label(spark, sf_dir):
    rates = E.detection_rates(E.confusion(rule_scored(spark, sf_dir)))
    return rounded(rates, ["tpr"], PLACES)


@query(RULE + f"SELECT {S.CONN_ROW}, label, prediction FROM rule_scored WHERE label = 1 AND prediction = 0")
def missed_detections(spark, sf_dir):
    return E.missed_detections(rule_scored(spark, sf_dir)).drop("seen", "source_file")


@query(RULE + f"SELECT {S.CONN_ROW}, label, prediction FROM rule_scored WHERE label = 0 AND prediction = 1")
def false_alarms(spark, sf_dir):
    return E.false_alarms(rule_scored(spark, sf_dir)).drop("seen", "source_file")


@query(VECTOR + """,
cells AS (SELECT prediction, label, count(*) AS n FROM vector_scored GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY prediction ORDER BY n DESC, label) AS r FROM cells)
SELECT CAST(prediction AS INTEGER) AS prediction, label AS majority_label FROM ranked WHERE r = 1""")
def cluster_majority_labels(spark, sf_dir):
    return cluster_label_map(vector_scored(spark, sf_dir))


def _score_row(spark, value):
    return spark.range(1).select(F.round(F.lit(value).cast("double"), 6).alias("silhouette"))


@query("""WITH points AS (
  SELECT vec_id AS id, label AS cluster, unnest(range(1, 65)) AS dim,
    CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),"""
       + silhouette_ctes("points") + "SELECT round(silhouette, 6) AS silhouette FROM silhouette")
def silhouette_vectors(spark, sf_dir):
    """Silhouette of the labels as clusters, over all vectors."""
    df = S.vectors(spark, sf_dir).select(
        array_to_vector("embedding").alias("features"), F.col("label").alias("prediction")
    )
    return _score_row(spark, silhouette(df))


@query(LABELLED + "," + index_cte("ip", "conn_labelled", "proto") + ","
       + index_cte("isv", "conn_labelled", "service") + ","
       + index_cte("ih", "conn_labelled", "history") + ","
       + indexed_cte("conn_x", "conn_labelled", {"proto": "ip", "service": "isv", "history": "ih"})
       + """,
numbered AS (SELECT *, row_number() OVER () AS id FROM conn_x),
points AS (
  SELECT id, label AS cluster, unnest([1, 2, 3]) AS dim,
    unnest([proto_index, service_index, history_index]) AS x FROM numbered),"""
       + silhouette_ctes("points") + "SELECT round(silhouette, 6) AS silhouette FROM silhouette")
def silhouette_connections(spark, sf_dir):
    """Silhouette of the two classes over the three category indexes of all connections."""
    rows = labelled_connections(spark, sf_dir)
    scored = fit_features(SPECS["conn_kmeans"], rows).score(rows)
    return _score_row(spark, silhouette(scored.withColumn("prediction", F.col("label"))))
