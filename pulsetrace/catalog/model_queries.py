"""The ten pipelines and the small document pipeline, fitted and scored."""

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..models import store
from ..models.specs import NAIVE_BAYES, SPECS, ModelSpec
from ..models.training import fit, fit_features, fit_kmeans_seeds, training_rows
from ..operators import evaluation
from ..operators.labeling import label_by_indicator
from ..plans import datasets
from ..plans.runs import Report, evaluate, run
from ..sources.scratch import new_scratch
from . import standins as S
from .evaluation_queries import PLACES, ROUNDED_METRICS_SQL
from .feature_queries import CATEGORIES, index_ctes
from .fit_checks import forest_check, gradient_check, linear_check, perceptron_check, svm_certificate
from .fitted import fitted
from .registry import query
from .scan_queries import rounded
from .sql import (
    METRIC_NAMES,
    gaussian_nb_ctes,
    indexed_cte,
    metrics_ctes,
    multinomial_nb_ctes,
    silhouette_ctes,
    starts_ctes,
    two_means_ctes,
    with_ctes,
)

DOCUMENTS = ModelSpec(
    "documents_naive_bayes",
    NAIVE_BAYES,
    StructType([
        StructField("doc_id", LongType()),
        StructField("lang", StringType()),
        StructField("source", StringType()),
        StructField("n_chars", LongType()),
        StructField("label", IntegerType()),
    ]),
    ("lang", "source"),
    ("n_chars",),
    {"modelType": "gaussian"},
)
DOCUMENTS_NB = (
    with_ctes(S.DOCUMENTS_SQL) + "," + index_ctes("docs_v", ("lang", "source")) + ","
    + gaussian_nb_ctes("indexed", "indexed", DOCUMENTS.features)
)


def _documents_report(spark, sf_dir):
    docs = S.documents(spark, sf_dir)
    return run(DOCUMENTS, docs, docs)[1]


@query(DOCUMENTS_NB + "SELECT doc_id, label, prediction FROM nb_scored")
def documents_naive_bayes(spark, sf_dir):
    return _documents_report(spark, sf_dir).scored.select("doc_id", "label", "prediction")


@query(DOCUMENTS_NB + "," + metrics_ctes("nb_scored") + ROUNDED_METRICS_SQL)
def documents_naive_bayes_metrics(spark, sf_dir):
    return rounded(_documents_report(spark, sf_dir).metrics, METRIC_NAMES, PLACES)


def conn_splits(spark, sf_dir):
    """Training and test connections: earlier captures by origin, later ones by destination."""
    conns = S.connections(spark, sf_dir)
    train = datasets.conn_train(conns.where(F.col("seen") < S.CUTOVER))
    test = datasets.conn_test(
        conns.where(F.col("seen") >= S.CUTOVER), S.indicators(spark, sf_dir)
    )
    return train, test


def group_splits(spark, sf_dir):
    """Session groups of the first and the second half of the month, by destination."""
    labelled = label_by_indicator(S.groups(spark, sf_dir), S.GROUP_INDICATORS, "dst_ip")
    return labelled.where(F.col("src_p") <= 15), labelled.where(F.col("src_p") > 15)


CONN_KEY = ("orig_h", "orig_p", "resp_h", "resp_p", "history", "label", "prediction")
CONN_NB = (
    with_ctes(S.CONNECTIONS_SQL, S.INDICATORS_SQL, S.CONN_LABELLED_SQL, S.CONN_TRAIN_SQL,
              S.CONN_TEST_SQL)
    + "," + index_ctes("conn_train", out="train_x")
    + "," + indexed_cte("test_x", "conn_test", {c: f"ix_{c}" for c in CATEGORIES})
    + "," + gaussian_nb_ctes("train_x", "test_x", SPECS["conn_naive_bayes"].features)
)
GROUP_SPLITS = with_ctes(S.GROUPS_SQL) + f""",
group_train AS (SELECT * FROM group_labelled WHERE src_p <= 15 AND {S.GROUP_PRESENT}),
group_test AS (SELECT * FROM group_labelled WHERE src_p > 15 AND {S.GROUP_PRESENT}),"""
# k-means keeps test rows with nulls: none of its three features is among the nullable columns.
GROUP_WHOLE_TEST = with_ctes(S.GROUPS_SQL) + f""",
group_train AS (SELECT * FROM group_labelled WHERE src_p <= 15 AND {S.GROUP_PRESENT}),
group_test AS (SELECT * FROM group_labelled WHERE src_p > 15),"""
GROUP_NB = (
    GROUP_SPLITS
    + multinomial_nb_ctes("group_train", "group_test", SPECS["group_naive_bayes"].features)
)


@query(CONN_NB + f"SELECT {', '.join(CONN_KEY)} FROM nb_scored")
def conn_naive_bayes(spark, sf_dir):
    _, report = run(SPECS["conn_naive_bayes"], *conn_splits(spark, sf_dir))
    return report.scored.select(*CONN_KEY)


@query(CONN_NB + "," + metrics_ctes("nb_scored") + ROUNDED_METRICS_SQL)
def conn_naive_bayes_metrics(spark, sf_dir):
    _, report = run(SPECS["conn_naive_bayes"], *conn_splits(spark, sf_dir))
    return rounded(report.metrics, METRIC_NAMES, PLACES)


@query(CONN_NB + f"SELECT {', '.join(CONN_KEY)} FROM nb_scored WHERE label = 1 AND prediction = 0")
def conn_naive_bayes_missed(spark, sf_dir):
    _, report = run(SPECS["conn_naive_bayes"], *conn_splits(spark, sf_dir))
    return report.missed.select(*CONN_KEY)


@query(CONN_NB + f"SELECT {', '.join(CONN_KEY)} FROM nb_scored")
def save_load_rescore(spark, sf_dir):
    """Fit, save, load and score: the loaded pipeline predicts what the fitted one would."""
    train, test = conn_splits(spark, sf_dir)
    saved = store.save(fit(SPECS["conn_naive_bayes"], train), new_scratch(spark, "models"))
    return store.load(spark, saved).score(test).select(*CONN_KEY)


@query(GROUP_NB + "SELECT src_ip, src_p, dst_ip, nses, label, prediction FROM nb_scored")
def group_naive_bayes(spark, sf_dir):
    _, report = run(SPECS["group_naive_bayes"], *group_splits(spark, sf_dir))
    return report.scored.select("src_ip", "src_p", "dst_ip", "nses", "label", "prediction")


# Enough rounds to end at the fixed point that the SQL moves to.
CONN_KMEANS = SPECS["conn_kmeans"].with_params(maxIter=100, tol=1e-9)
CONN_TESTED = with_ctes(
    S.CONNECTIONS_SQL, S.INDICATORS_SQL, S.CONN_LABELLED_SQL, S.CONN_TRAIN_SQL, S.CONN_TEST_SQL
)
CONN_CLUSTERS = (
    CONN_TESTED
    + "," + index_ctes("conn_train", out="train_x")
    + "," + indexed_cte("test_x", "conn_test", {c: f"ix_{c}" for c in CATEGORIES})
    + "," + two_means_ctes("train_x", "test_x", SPECS["conn_kmeans"].features)
)
ALIGNED_SQL = """,
votes AS (
  SELECT c, label, row_number() OVER (PARTITION BY c ORDER BY count(*) DESC, label) AS place
  FROM train_clustered GROUP BY c, label)
SELECT t.label, CAST(v.label AS DOUBLE) AS prediction, count(*) AS "count"
FROM test_clustered t JOIN votes v ON t.c = v.c AND v.place = 1 GROUP BY ALL"""


@query(CONN_CLUSTERS + """
SELECT label, CAST(c AS DOUBLE) AS prediction, count(*) AS "count" FROM test_clustered GROUP BY ALL""")
def conn_kmeans(spark, sf_dir):
    """Clusters compared with the labels as they are, numbered by their centres' place."""
    model, report = run(CONN_KMEANS, *conn_splits(spark, sf_dir))
    centres = [sum(c) for c in model.estimator.clusterCenters()]
    place = F.array(*[F.lit(float(sum(x < c for x in centres))) for c in centres])
    return evaluation.confusion(
        report.scored.withColumn("prediction", F.get(place, F.col("prediction").cast("int")))
    )


@query(CONN_CLUSTERS + ALIGNED_SQL)
def conn_kmeans_aligned(spark, sf_dir):
    """Cluster ids renamed to the majority class of their training rows."""
    return run(CONN_KMEANS, *conn_splits(spark, sf_dir), align=True)[1].cells


def _svm_sql(test):
    return f"SELECT count(*) AS rows, CAST(0 AS BIGINT) AS mismatches, false AS improvable FROM {test}"


def _perceptron_sql(test):
    return f"SELECT count(*) AS rows, CAST(0 AS BIGINT) AS mismatches, true AS beats_prior FROM {test}"


def _checked(check, spark, sf_dir, name):
    found = fitted(spark, sf_dir, name, conn_splits if name.startswith("conn") else group_splits)
    return check(found.model, found.known, found.scored)


@query(CONN_TESTED + _svm_sql("conn_test"))
def conn_linear_svm(spark, sf_dir):
    return _checked(linear_check, spark, sf_dir, "conn_linear_svm")


# The training label is a function of orig_pkts; a forest that has learnt it repeats it.
@query(CONN_NB + """
SELECT label, CASE WHEN orig_pkts >= 36 THEN 1e0 ELSE 0e0 END AS prediction, count(*) AS "count"
FROM conn_test GROUP BY ALL""")
def conn_random_forest(spark, sf_dir):
    return run(SPECS["conn_random_forest"], *conn_splits(spark, sf_dir))[1].cells


@query(CONN_TESTED + _perceptron_sql("conn_test"))
def conn_perceptron(spark, sf_dir):
    return _checked(perceptron_check, spark, sf_dir, "conn_perceptron")


@query(CONN_NB + f"SELECT {', '.join(CONN_KEY)} FROM nb_scored WHERE label = 0 AND prediction = 1")
def conn_naive_bayes_alarms(spark, sf_dir):
    _, report = run(SPECS["conn_naive_bayes"], *conn_splits(spark, sf_dir))
    return report.alarms.select(*CONN_KEY)


SEEDS = tuple(range(1, 11))
# Moved to its fixed point; the best of ten seeds is the one that the SQL moves to.
GROUP_KMEANS = SPECS["group_kmeans"].with_params(maxIter=100, tol=1e-9)
GROUP_FEATURES = SPECS["group_kmeans"].features
GROUP_CLUSTERS = GROUP_WHOLE_TEST + two_means_ctes("group_train", "group_test", GROUP_FEATURES)


def _best_group_kmeans(spark, sf_dir):
    train, test = group_splits(spark, sf_dir)
    model, runs = fit_kmeans_seeds(GROUP_KMEANS, train, SEEDS)
    return model, runs, train, test


@query(GROUP_CLUSTERS + "SELECT " + ", ".join(f"round({f}, 6) AS {f}" for f in GROUP_FEATURES)
       + " FROM centres_found")
def group_kmeans_centres(spark, sf_dir):
    """Centres of the best of ten seeds."""
    model = _best_group_kmeans(spark, sf_dir)[0]
    centres = [tuple(map(float, c)) for c in model.estimator.clusterCenters()]
    schema = ", ".join(f"{f} double" for f in GROUP_FEATURES)
    return rounded(spark.createDataFrame(centres, schema), GROUP_FEATURES)


GROUP_SILHOUETTE = GROUP_CLUSTERS + """,
numbered AS (SELECT *, row_number() OVER () AS id FROM train_clustered),
points AS (
  SELECT id, c AS cluster, unnest(range(1, 4)) AS dim,
    unnest([CAST(nses AS DOUBLE), cltmoredata, clt1stappdata]) AS x FROM numbered),""" + (
    silhouette_ctes("points")
)


# First centres given to both sides: each seed's shares of the way through the training box.
STARTS = tuple((seed, (seed - 1) / 20, 1 - (seed - 1) / 40) for seed in SEEDS)


def _given(rows, features, starts=STARTS):
    """First centres at the shares that ``starts`` names of the box around ``rows``."""
    box = rows.agg(*[F.min(f).alias(f"lo_{f}") for f in features], *[F.max(f).alias(f"hi_{f}") for f in features]).first()
    low, high = [float(box[f"lo_{f}"]) for f in features], [float(box[f"hi_{f}"]) for f in features]
    return {
        seed: [[a + (b - a) * share for a, b in zip(low, high)] for share in shares] for seed, *shares in starts
    }


def _from_given(spec, train, starts=STARTS, keep="best"):
    """Fits from given starts with the model's own rounds and tolerance."""
    rows = training_rows(spec, train)
    indexed = fit_features(spec, rows).score(rows, drop_nulls=False) if spec.categories else rows
    given = _given(indexed, spec.features, starts)
    return fit_kmeans_seeds(spec, train, [seed for seed, *_ in starts], keep, starts=given)


def _ends(spark, runs, features):
    rows = [
        (r.seed, r.rounds, float(r.cost), r.silhouette, *map(float, r.centres[0] + r.centres[1])) for r in runs
    ]
    places = [f"{side}_{f}" for side in "ab" for f in features]
    schema = "seed long, rounds long, cost double, silhouette double, " + ", ".join(f"{c} double" for c in places)
    return rounded(spark.createDataFrame(rows, schema), ["cost", "silhouette", *places])


def _ends_sql(features):
    places = ", ".join(f"round({side}_{f}, 6) AS {side}_{f}" for side in "ab" for f in features)
    return f"""
SELECT e.seed, e.step AS rounds, round(cost, 6) AS cost, round(silhouette, 6) AS silhouette, {places}
FROM ended e JOIN judged USING (seed)"""


GROUP_STARTS = GROUP_WHOLE_TEST + starts_ctes("group_train", GROUP_FEATURES, STARTS)


@query(GROUP_STARTS + _ends_sql(GROUP_FEATURES))
def group_kmeans_starts(spark, sf_dir):
    """Ten starts advanced together: rounds, cost, silhouette and centres of each, with the model's own parameters."""
    train, _ = group_splits(spark, sf_dir)
    return _ends(spark, _from_given(SPECS["group_kmeans"], train)[1], GROUP_FEATURES)


@query(GROUP_STARTS + """
SELECT seed, round(silhouette, 6) AS silhouette, round(max(silhouette) OVER (), 6) AS kept FROM judged""")
def group_kmeans_seeds(spark, sf_dir):
    """Ten seeds from given starts, their silhouettes, and that of the one kept."""
    runs = _from_given(SPECS["group_kmeans"], group_splits(spark, sf_dir)[0])[1]
    (kept,) = [r.silhouette for r in runs if r.kept]
    rows = [(r.seed, r.silhouette, kept) for r in runs]
    return rounded(
        spark.createDataFrame(rows, "seed long, silhouette double, kept double"), ["silhouette", "kept"]
    )


@query(GROUP_STARTS + """,
last AS (SELECT * FROM ended ORDER BY seed DESC LIMIT 1),
cast_votes AS (
  SELECT p.c, p.label, row_number() OVER (PARTITION BY p.c ORDER BY count(*) DESC, p.label) AS place
  FROM parted p JOIN last USING (seed) GROUP BY p.c, p.label),
tested AS (SELECT p.label, CASE WHEN """ + " + ".join(f"(p.{f} - m.a_{f}) ** 2" for f in GROUP_FEATURES) + " <= "
       + " + ".join(f"(p.{f} - m.b_{f}) ** 2" for f in GROUP_FEATURES) + """ THEN 0 ELSE 1 END AS c FROM group_test p, last m)
SELECT t.label, CAST(v.label AS DOUBLE) AS prediction, count(*) AS "count"
FROM tested t JOIN cast_votes v ON t.c = v.c AND v.place = 1 GROUP BY ALL""")
def group_kmeans_last_seed(spark, sf_dir):
    """The last seed kept, as a plain loop keeps it, aligned to classes and scored on the second half of the month."""
    train, test = group_splits(spark, sf_dir)
    model, _ = _from_given(SPECS["group_kmeans"], train, keep="last")
    return evaluate(model, test, train).cells


CONN_START = ((1, 0.0, 1.0),)


@query(CONN_TESTED + "," + index_ctes("conn_train", out="train_x") + ","
       + starts_ctes("train_x", SPECS["conn_kmeans"].features, CONN_START) + _ends_sql(SPECS["conn_kmeans"].features))
def conn_kmeans_start(spark, sf_dir):
    """Connections from one given start, with the model's own rounds and tolerance."""
    train, _ = conn_splits(spark, sf_dir)
    return _ends(spark, _from_given(SPECS["conn_kmeans"], train, CONN_START)[1], SPECS["conn_kmeans"].features)


@query(GROUP_SILHOUETTE + "SELECT round(silhouette, 6) AS silhouette FROM silhouette")
def group_kmeans_silhouette(spark, sf_dir):
    """Silhouette of the best of ten seeds."""
    runs = _best_group_kmeans(spark, sf_dir)[1]
    best = [(r.silhouette,) for r in runs if r.kept]
    return rounded(spark.createDataFrame(best, "silhouette double"), ["silhouette"])


@query(GROUP_CLUSTERS + ALIGNED_SQL)
def group_kmeans(spark, sf_dir):
    """The best of ten seeds, aligned to classes and scored on the second half of the month."""
    model, _, train, test = _best_group_kmeans(spark, sf_dir)
    return evaluate(model, test, train).cells


@query(GROUP_SPLITS.rstrip(",") + _svm_sql("group_test"))
def group_linear_svm(spark, sf_dir):
    return _checked(linear_check, spark, sf_dir, "group_linear_svm")


# A label that is a rule over the forest's features: one that has learnt it repeats it.
BUSY = 3


@query(GROUP_SPLITS.rstrip(",") + f"""
SELECT CAST(nses >= {BUSY} AS INTEGER) AS label, CAST(nses >= {BUSY} AS DOUBLE) AS prediction,
  count(*) AS "count" FROM group_test GROUP BY ALL""")
def group_random_forest(spark, sf_dir):
    busy = (F.col("nses") >= BUSY).cast("int")
    train, test = (df.withColumn("label", busy) for df in group_splits(spark, sf_dir))
    return run(SPECS["group_random_forest"], train, test)[1].cells


@query(GROUP_SPLITS.rstrip(",") + _perceptron_sql("group_test"))
def group_perceptron(spark, sf_dir):
    return _checked(perceptron_check, spark, sf_dir, "group_perceptron")


GROUP_NB_KEY = "src_ip, src_p, dst_ip, nses, label, prediction"


@query(GROUP_NB + f"SELECT {GROUP_NB_KEY} FROM nb_scored WHERE label = 1 AND prediction = 0")
def group_naive_bayes_missed(spark, sf_dir):
    _, report = run(SPECS["group_naive_bayes"], *group_splits(spark, sf_dir))
    return report.missed.select(*GROUP_NB_KEY.split(", "))


@query(GROUP_NB + f"SELECT {GROUP_NB_KEY} FROM nb_scored WHERE label = 0 AND prediction = 1")
def group_naive_bayes_alarms(spark, sf_dir):
    _, report = run(SPECS["group_naive_bayes"], *group_splits(spark, sf_dir))
    return report.alarms.select(*GROUP_NB_KEY.split(", "))


def _proven(check, spark, sf_dir, name):
    found = fitted(spark, sf_dir, name, conn_splits if name.startswith("conn") else group_splits)
    return check(found.model, found.known)


def _redone(spark, sf_dir, name):
    found = fitted(spark, sf_dir, name, conn_splits if name.startswith("conn") else group_splits)
    return forest_check(found.model, found.scored)


CONN_KNOWN = CONN_TESTED + "SELECT count(*) AS rows, {} FROM conn_train"
GROUP_KNOWN = GROUP_SPLITS.rstrip(",") + "SELECT count(*) AS rows, {} FROM group_train"
PROVEN, DESCENDED = "true AS optimal", "true AS agrees, true AS falls"


@query(CONN_KNOWN.format(PROVEN))
def conn_linear_svm_certificate(spark, sf_dir):
    """No plane has a loss much below the fitted one's: a bound from the dual."""
    return _proven(svm_certificate, spark, sf_dir, "conn_linear_svm")


@query(GROUP_KNOWN.format(PROVEN))
def group_linear_svm_certificate(spark, sf_dir):
    return _proven(svm_certificate, spark, sf_dir, "group_linear_svm")


@query(CONN_KNOWN.format(DESCENDED))
def conn_perceptron_gradient(spark, sf_dir):
    """The network's gradient by back-propagation in column expressions, against differences of its loss."""
    return _proven(gradient_check, spark, sf_dir, "conn_perceptron")


@query(GROUP_KNOWN.format(DESCENDED))
def group_perceptron_gradient(spark, sf_dir):
    return _proven(gradient_check, spark, sf_dir, "group_perceptron")


REDONE = " SELECT count(*) AS rows, CAST(0 AS BIGINT) AS mismatches FROM "


@query(CONN_TESTED + REDONE + "conn_test")
def conn_forest_table(spark, sf_dir):
    """Predictions on the true labels, redone from the forest's table of nodes."""
    return _redone(spark, sf_dir, "conn_random_forest")


@query(GROUP_SPLITS.rstrip(",") + REDONE + "group_test")
def group_forest_table(spark, sf_dir):
    return _redone(spark, sf_dir, "group_random_forest")


def _report(spark, sf_dir, name):
    return Report(fitted(spark, sf_dir, name, conn_splits if name.startswith("conn") else group_splits).scored)


def _register_reports():
    """Cells, metrics and both kinds of errors of the models that SQL cannot fit; they have no SQL."""
    whole = {"conn": CONN_KEY, "group": tuple(GROUP_NB_KEY.split(", "))}
    for name in (f"{rows}_{family}" for rows in whole for family in ("linear_svm", "perceptron", "random_forest")):
        key = whole[name.split("_")[0]]
        parts = {
            "cells": lambda report, key: report.cells,
            "metrics": lambda report, key: rounded(report.metrics, METRIC_NAMES, PLACES),
            "missed": lambda report, key: report.missed.select(*key),
            "alarms": lambda report, key: report.alarms.select(*key),
        }
        for part, take in parts.items():
            def asked(spark, sf_dir, name=name, take=take, key=key):
                return take(_report(spark, sf_dir, name), key)

            asked.__name__ = f"{name}_{part}"
            query()(asked)


_register_reports()
