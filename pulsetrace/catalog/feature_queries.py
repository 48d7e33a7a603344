"""Category indexes and feature vectors."""

from dataclasses import replace

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..models.specs import SPECS
from ..models.training import fit_features
from ..operators.indexing import category_counts, fit_bounded_index, fit_index, index_name, least_share
from ..operators.indexing import index_pairs as distinct_pairs
from ..operators.rows import drop_null_rows
from . import standins as S
from .registry import query
from .scan_queries import rounded
from .sql import index_cte, indexed_cte, with_ctes

CATEGORIES = ("proto", "service", "history")
CONN = with_ctes(S.CONNECTIONS_SQL)


def index_ctes(source: str, columns=CATEGORIES, out: str = "indexed", apply_to: str | None = None):
    ctes = [index_cte(f"ix_{c}", source, c) for c in columns]
    applied = indexed_cte(out, apply_to or source, {c: f"ix_{c}" for c in columns})
    return ",".join([*ctes, applied])


def elements(df, names):
    """Vector elements as columns, in vector order."""
    values = vector_to_array("features")
    return [values[i].alias(name) for i, name in enumerate(names)]


@query(CONN + """,
category_rows AS (
  SELECT 'proto' AS "column", proto AS value FROM conn_v
  UNION ALL SELECT 'service', service FROM conn_v
  UNION ALL SELECT 'history', history FROM conn_v)
SELECT "column", value, count(*) AS "count" FROM category_rows GROUP BY ALL""")
def category_frequency(spark, sf_dir):
    return category_counts(S.connections(spark, sf_dir), CATEGORIES)


INDEXED_COLUMNS = ["orig_h", "orig_p", "resp_h", *CATEGORIES, *map(index_name, CATEGORIES)]


@query(CONN + "," + index_ctes("conn_v") + "SELECT " + ", ".join(INDEXED_COLUMNS) + " FROM indexed")
def string_index(spark, sf_dir):
    conns = S.connections(spark, sf_dir)
    return fit_index(conns, CATEGORIES).transform(conns).select(*INDEXED_COLUMNS)


@query(CONN + "," + index_ctes("conn_v") + "SELECT " + ", ".join(INDEXED_COLUMNS) + " FROM indexed")
def string_index_tables(spark, sf_dir):
    """The same indexes by the route for vocabularies too large for the driver."""
    conns = S.connections(spark, sf_dir)
    return fit_index(conns, CATEGORIES, max_driver_labels=0).transform(conns).select(*INDEXED_COLUMNS)


TRACKED_VALUES = 1024


@query(CONN + f""",
history_counts AS (SELECT history, count(*) AS n FROM conn_v WHERE history IS NOT NULL GROUP BY history),
cut AS (SELECT ceil(sum(n) * {least_share(TRACKED_VALUES)!r}) AS least FROM history_counts),
frequent AS (
  SELECT history, CAST(row_number() OVER (ORDER BY n DESC, history) - 1 AS DOUBLE) AS place
  FROM history_counts, cut WHERE n >= least)
SELECT h.history, coalesce(f.place, (SELECT CAST(count(*) AS DOUBLE) FROM frequent)) AS history_index, h.n AS rows
FROM history_counts h LEFT JOIN frequent f USING (history)""")
def string_index_bounded(spark, sf_dir):
    """Values above a cut as the exact index has them, the rare ones under one more: from a sketch of a fixed size."""
    conns = S.connections(spark, sf_dir).select("history")
    index, _ = fit_bounded_index(conns, ["history"], TRACKED_VALUES)
    found = index.transform(conns).where("history IS NOT NULL")
    return found.groupBy("history", "history_index").agg(F.count("*").alias("rows"))


@query(CONN + ",\none_capture AS (SELECT * FROM conn_v WHERE source_file = 'beacon-AO.log'),"
       + index_ctes("one_capture", apply_to="conn_v")
       + "SELECT " + ", ".join(INDEXED_COLUMNS) + " FROM indexed")
def string_index_unseen(spark, sf_dir):
    """Fitted on one capture, applied to all rows: values it lacks get the extra index."""
    conns = S.connections(spark, sf_dir)
    index = fit_index(conns.where(F.col("source_file") == "beacon-AO.log"), CATEGORIES)
    return index.transform(conns).select(*INDEXED_COLUMNS)


INVALID_KEPT = """
SELECT orig_h, orig_p, resp_h, history, x.idx AS history_index, route
FROM conn_v c JOIN ix_history x ON c.history = x.value, (VALUES ('metadata'), ('table')) r(route)"""


TRACKED_VALUES = 1024


@query(CONN + f""",
history_counts AS (SELECT history, count(*) AS n FROM conn_v WHERE history IS NOT NULL GROUP BY history),
cut AS (SELECT ceil(sum(n) * {least_share(TRACKED_VALUES)!r}) AS least FROM history_counts),
frequent AS (
  SELECT history, CAST(row_number() OVER (ORDER BY n DESC, history) - 1 AS DOUBLE) AS place
  FROM history_counts, cut WHERE n >= least)
SELECT h.history, coalesce(f.place, (SELECT CAST(count(*) AS DOUBLE) FROM frequent)) AS history_index, h.n AS rows
FROM history_counts h LEFT JOIN frequent f USING (history)""")
def string_index_bounded(spark, sf_dir):
    """Values above a cut as the exact index has them, the rare ones under one more: from a sketch of a fixed size."""
    conns = S.connections(spark, sf_dir).select("history")
    index, _ = fit_bounded_index(conns, ["history"], TRACKED_VALUES)
    found = index.transform(conns).where("history IS NOT NULL")
    return found.groupBy("history", "history_index").agg(F.count("*").alias("rows"))


@query(CONN + ",\none_capture AS (SELECT * FROM conn_v WHERE source_file = 'beacon-AO.log'),"
       + index_cte("ix_history", "one_capture", "history") + INVALID_KEPT)
def string_index_skip_unseen(spark, sf_dir):
    """``handle_invalid='skip'`` on both routes: rows with a value the fit has not seen go."""
    conns = S.connections(spark, sf_dir)
    seen = conns.where(F.col("source_file") == "beacon-AO.log")
    parts = [
        fit_index(seen, ["history"], limit, "skip").transform(conns)
        .select("orig_h", "orig_p", "resp_h", "history", "history_index", F.lit(route).alias("route"))
        for route, limit in (("metadata", None), ("table", 0))
    ]
    return parts[0].unionByName(parts[1])


@query(CONN + "," + index_cte("ix_history", "conn_v", "history")
       + "SELECT value AS history, idx AS history_index FROM ix_history")
def index_pairs(spark, sf_dir):
    conns = S.connections(spark, sf_dir)
    return distinct_pairs(fit_index(conns, ["history"]).transform(conns), "history")


@query(CONN + "," + index_ctes("conn_v") + """
SELECT 'proto_index' AS feature, value, CAST(idx AS BIGINT) AS position FROM ix_proto
UNION ALL SELECT 'service_index', value, CAST(idx AS BIGINT) FROM ix_service
UNION ALL SELECT 'history_index', value, CAST(idx AS BIGINT) FROM ix_history
UNION ALL SELECT 'proto_index', '__unknown', count(*) FROM ix_proto
UNION ALL SELECT 'service_index', '__unknown', count(*) FROM ix_service
UNION ALL SELECT 'history_index', '__unknown', count(*) FROM ix_history""")
def nominal_metadata(spark, sf_dir):
    """The category list each index column carries for the tree learners."""
    conns = S.connections(spark, sf_dir)
    schema = fit_index(conns, CATEGORIES).transform(conns).schema
    rows = [
        (name, value, position)
        for name in map(index_name, CATEGORIES)
        for position, value in enumerate(schema[name].metadata["ml_attr"]["vals"])
    ]
    return spark.createDataFrame(rows, "feature string, value string, position long")


NB = SPECS["conn_naive_bayes"]


@query(CONN + "," + index_ctes("conn_v") + """
SELECT orig_h, orig_p, resp_h, proto_index AS f_proto, service_index AS f_service,
  history_index AS f_history, CAST(orig_bytes AS DOUBLE) AS f_bytes, CAST(orig_pkts AS DOUBLE) AS f_pkts
FROM indexed""")
def assembled_features(spark, sf_dir):
    conns = S.connections(spark, sf_dir)
    rows = fit_features(NB, conns).score(conns)
    names = ["f_proto", "f_service", "f_history", "f_bytes", "f_pkts"]
    return rows.select("orig_h", "orig_p", "resp_h", *elements(rows, names))


SCALED = replace(SPECS["group_kmeans"], scale=True)


@query(with_ctes(S.GROUPS_SQL) + f""",
present AS (SELECT * FROM group_v WHERE {S.GROUP_PRESENT}),
spread AS (
  SELECT stddev_samp(nses) AS s0, stddev_samp(cltmoredata) AS s1, stddev_samp(clt1stappdata) AS s2
  FROM present)
SELECT src_ip, src_p, dst_ip, round(nses / s0, 6) AS f_nses,
  round(cltmoredata / s1, 6) AS f_more, round(clt1stappdata / s2, 6) AS f_first
FROM present, spread""")
def standard_scaled(spark, sf_dir):
    """Optional scaling stage: unit standard deviation, not centred."""
    rows = drop_null_rows(S.groups(spark, sf_dir))
    scaled = fit_features(SCALED, rows).score(rows)
    names = ["f_nses", "f_more", "f_first"]
    out = scaled.select("src_ip", "src_p", "dst_ip", *elements(scaled, names))
    return rounded(out, names)


ONE_HOT = replace(
    SPECS["conn_naive_bayes"], categories=("proto", "service"), numbers=("orig_pkts",), one_hot=True
)
_PROTO_COLUMNS = [f"proto_{i}" for i in range(2)]
_SERVICE_COLUMNS = [f"service_{i}" for i in range(3)]


def _hot(column, names):
    return ", ".join(
        f"CASE WHEN {column} = {i} THEN 1e0 ELSE 0e0 END AS {name}" for i, name in enumerate(names)
    )


@query(CONN + "," + index_ctes("conn_v", ("proto", "service")) + f"""
SELECT orig_h, orig_p, resp_h, {_hot("proto_index", _PROTO_COLUMNS)},
  {_hot("service_index", _SERVICE_COLUMNS)}, CAST(orig_pkts AS DOUBLE) AS f_pkts FROM indexed""")
def one_hot_features(spark, sf_dir):
    """Optional one-hot stage: one slot per category, none for unseen values."""
    conns = S.connections(spark, sf_dir)
    rows = fit_features(ONE_HOT, conns).score(conns)
    names = [*_PROTO_COLUMNS, *_SERVICE_COLUMNS, "f_pkts"]
    return rows.select("orig_h", "orig_p", "resp_h", *elements(rows, names))
