"""Labels, class filters, unions and class counts."""

from pyspark.sql import functions as F

from ..fixed_values import BEACON_SERVICES, CONN_BENIGN_CAPTURES
from ..functions.columns import capture_stem, file_extension
from ..operators.labeling import (
    indicator_hits,
    keep_services,
    label_all,
    label_by_indicator,
    label_by_origin,
    union_classes,
)
from ..operators.rows import class_summary, drop_null_rows, of_class
from ..plans import datasets
from . import standins as S
from .registry import query
from .scan_queries import GROUP_ROUNDED_SQL, ROUNDED_GROUP, rounded
from .sql import with_ctes

ORIGIN = with_ctes(S.CONNECTIONS_SQL, S.CONN_TRAIN_SQL)
LABELLED = with_ctes(S.CONNECTIONS_SQL, S.INDICATORS_SQL, S.CONN_LABELLED_SQL)
FORCE_SHUFFLE = -1  # a byte limit nothing fits under


def labelled_connections(spark, sf_dir):
    return label_by_indicator(
        S.connections(spark, sf_dir), S.indicators(spark, sf_dir), "resp_h"
    )


@query(with_ctes(S.CONNECTIONS_SQL) + """
SELECT source_file,
  regexp_extract(source_file, '([^/.]*)\\.[^/]*$', 1) AS stem,
  regexp_extract(source_file, '\\.([^.]*)$', 1) AS extension, count(*) AS n
FROM conn_v GROUP BY ALL""")
def capture_names(spark, sf_dir):
    """File name to capture name and extension, with rows per file."""
    return (
        S.connections(spark, sf_dir)
        .groupBy("source_file")
        .agg(F.count("*").alias("n"))
        .select(
            "source_file",
            capture_stem("source_file").alias("stem"),
            file_extension("source_file").alias("extension"),
            "n",
        )
    )


@query(ORIGIN + "SELECT orig_h, orig_p, resp_h, source_file, label FROM conn_origin")
def origin_label(spark, sf_dir):
    labelled = label_by_origin(S.connections(spark, sf_dir), CONN_BENIGN_CAPTURES)
    return labelled.select("orig_h", "orig_p", "resp_h", "source_file", "label")


@query(ORIGIN + """
SELECT orig_h, orig_p, resp_h, service, label FROM conn_origin
WHERE label = 0 OR service IN ('http', 'ssl')""")
def service_filter_train(spark, sf_dir):
    labelled = label_by_origin(S.connections(spark, sf_dir), CONN_BENIGN_CAPTURES)
    kept = keep_services(labelled, BEACON_SERVICES)
    return kept.select("orig_h", "orig_p", "resp_h", "service", "label")


@query(ORIGIN + f"SELECT {S.CONN_ROW}, label FROM conn_train")
def conn_train_dataset(spark, sf_dir):
    """The training connections: label, service filter and kept columns in one pass."""
    return datasets.conn_train(
        S.connections(spark, sf_dir).where(F.col("seen") < S.CUTOVER)
    )


@query(with_ctes(S.CONNECTIONS_SQL, S.INDICATORS_SQL, S.CONN_LABELLED_SQL, S.CONN_TEST_SQL)
       + f"SELECT {S.CONN_ROW}, label FROM conn_test")
def conn_test_dataset(spark, sf_dir):
    return datasets.conn_test(
        S.connections(spark, sf_dir).where(F.col("seen") >= S.CUTOVER),
        S.indicators(spark, sf_dir),
    )


@query(with_ctes(S.GROUPS_SQL) + f"SELECT {GROUP_ROUNDED_SQL}, label FROM group_labelled")
def group_test_dataset(spark, sf_dir):
    return rounded(
        datasets.group_test(S.groups(spark, sf_dir), S.GROUP_INDICATORS), ROUNDED_GROUP
    )


@query(ORIGIN + """
SELECT conn_state, service, label, count(*) AS n FROM conn_origin
WHERE label = 0 OR service IN ('http', 'ssl') GROUP BY ALL""")
def train_union(spark, sf_dir):
    """Benign and malicious frames kept apart, labelled, and united by column name."""
    conns = label_by_origin(S.connections(spark, sf_dir), CONN_BENIGN_CAPTURES)
    benign = label_all(of_class(conns, 0).drop("label"), 0)
    beacons = keep_services(label_all(of_class(conns, 1).drop("label"), 1), BEACON_SERVICES)
    both = union_classes(benign, beacons.select(*reversed(beacons.columns)))
    return both.groupBy("conn_state", "service", "label").agg(F.count("*").alias("n"))


@query(LABELLED + "SELECT orig_h, orig_p, resp_h, label FROM conn_labelled")
def indicator_label(spark, sf_dir):
    return labelled_connections(spark, sf_dir).select("orig_h", "orig_p", "resp_h", "label")


@query(LABELLED + "SELECT orig_h, orig_p, resp_h, label FROM conn_labelled")
def indicator_label_salted(spark, sf_dir):
    """The same labels by the route for address lists too large to broadcast: a splittable join."""
    labelled = label_by_indicator(
        S.connections(spark, sf_dir), S.indicators(spark, sf_dir), "resp_h", FORCE_SHUFFLE
    )
    return labelled.select("orig_h", "orig_p", "resp_h", "label")


@query(LABELLED + """
SELECT orig_h, orig_p, resp_h, resp_p, service, orig_bytes FROM conn_v
WHERE resp_h IN (SELECT ip FROM ioc)""")
def indicator_hits_rows(spark, sf_dir):
    hits = indicator_hits(S.connections(spark, sf_dir), S.indicators(spark, sf_dir), "resp_h")
    return hits.select("orig_h", "orig_p", "resp_h", "resp_p", "service", "orig_bytes")


@query(with_ctes(S.GROUPS_SQL) + f"SELECT {GROUP_ROUNDED_SQL} FROM group_v WHERE {S.GROUP_PRESENT}")
def null_row_drop(spark, sf_dir):
    return rounded(drop_null_rows(S.groups(spark, sf_dir)), ROUNDED_GROUP)


@query(LABELLED + """
SELECT label, count(*) AS rows, count(*) FILTER (service = 'ssl') AS ssl_rows
FROM conn_labelled GROUP BY label""")
def conn_class_summary(spark, sf_dir):
    return class_summary(labelled_connections(spark, sf_dir))


@query(with_ctes(S.GROUPS_SQL) + "SELECT label, count(*) AS rows FROM group_labelled GROUP BY label")
def group_class_summary(spark, sf_dir):
    labelled = label_by_indicator(S.groups(spark, sf_dir), S.GROUP_INDICATORS, "dst_ip")
    return class_summary(labelled, service=None)


@query(LABELLED + """
SELECT orig_h, orig_p, resp_h, orig_bytes FROM conn_labelled
WHERE label = 1 AND service = 'ssl'""")
def class_split_ssl(spark, sf_dir):
    rows = of_class(labelled_connections(spark, sf_dir), 1, "ssl")
    return rows.select("orig_h", "orig_p", "resp_h", "orig_bytes")
