"""Scans, sinks, typed rows and the quarantine.

The log text these queries read is written by Spark from the whole tables, once
per session and data folder, with unset, empty and over-long fields and short and wide lines in it.
"""

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models.specs import SPECS
from ..operators.labeling import label_by_indicator
from ..operators.rows import drop_columns, preview
from ..schemas import (
    CONN,
    CONN_DROPPED_COLUMNS,
    CONN_LOG_COLUMNS,
    DOTTED_NAMES,
    GROUP,
    GROUP_LOG_COLUMNS,
    without_label,
)
from ..sources.datasets import read_labelled, read_labelled_csv, write_labelled
from ..sources.logs import read_conn_logs, read_group_logs
from ..sources.scratch import new_scratch
from ..sources.typed import accept_rows, landed_schema, parse_typed, quarantine, reject_rows
from . import standins as S
from .registry import query
from .sql import with_ctes

NB_REQUIRED = [c for c in SPECS["conn_naive_bayes"].required if c != "label"]

# Which lines get an unset, an empty, an over-long, a missing and an additional field; the text is read both
# by Spark and by the check.
UNSET_BYTES = "resp_bytes = 0"
EMPTY_DURATION = "duration = 0"
LONG_TRANSFER = "orig_pkts = 50"
SHORT_LINE = "(orig_pkts = 1 AND resp_pkts = 7)"
WIDE_LINE = "(orig_pkts = 2 AND resp_pkts = 7)"
EXTRA_BYTES = 90_000_000_000


def conn_text_fields(conns: DataFrame, *more: str) -> DataFrame:
    """All 21 log fields of every connection as text, and the columns ``more`` as they are."""
    bytes_text = (
        F.when(F.expr(UNSET_BYTES), "-")
        .when(F.expr(LONG_TRANSFER), (F.col("orig_bytes") + EXTRA_BYTES).cast("string"))
        .otherwise(F.col("orig_bytes").cast("string"))
    )
    given = {
        "ts": F.date_format("seen", "yyyy-MM-dd"),
        "uid": F.concat_ws("-", F.lit("C"), "orig_h", "orig_p"),
        "duration": F.when(F.expr(EMPTY_DURATION), "").otherwise(F.col("duration").cast("string")),
        "orig_bytes": bytes_text,
        "missed_bytes": F.lit("0"),
    }
    unset = {c: F.lit("-") for c in ("local_orig", "local_resp", "tunnel_parents")}
    return conns.select(
        *[
            given.get(c, unset.get(c, F.col(c).cast("string") if c in conns.columns else None))
            .alias(c)
            for c in CONN_LOG_COLUMNS
        ],
        F.expr(SHORT_LINE).alias("short"),
        F.expr(WIDE_LINE).alias("wide"),
        *more,
    )


@cache
def _conn_log_folder(app: str, spark: SparkSession, sf_dir: str) -> str:
    path = new_scratch(spark, "conn-log")
    fields = conn_text_fields(S.connections(spark, sf_dir))
    whole = F.concat_ws("\t", *CONN_LOG_COLUMNS)
    lines = fields.select(
        F.when(F.col("short"), F.concat_ws("\t", *CONN_LOG_COLUMNS[:-1]))
        .when(F.col("wide"), F.concat(whole, F.lit("\tmore")))
        .otherwise(whole)
        .alias("value")
    )
    comments = S.table(spark, sf_dir, "orders").select(
        F.concat_ws("\t", F.lit("#open"), F.col("o_orderkey").cast("string")).alias("value")
    )
    lines.union(comments).write.text(path, compression="gzip")
    return path


@cache
def _group_log_folder(app: str, spark: SparkSession, sf_dir: str) -> str:
    path = new_scratch(spark, "group-log")
    fields = [
        F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in GROUP_LOG_COLUMNS
    ]
    S.groups(spark, sf_dir).select(F.concat_ws(",", *fields).alias("value")).write.text(path)
    return path


def conn_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_conn_logs(
        spark, _conn_log_folder(spark.sparkContext.applicationId, spark, sf_dir)
    )


def group_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_group_logs(
        spark, _group_log_folder(spark.sparkContext.applicationId, spark, sf_dir)
    )


CONN_LINES_SQL = S.CONNECTIONS_SQL + f""",
conn_lines AS (
  SELECT * REPLACE (
    CASE WHEN {EMPTY_DURATION} THEN NULL ELSE duration END AS duration,
    CASE WHEN {UNSET_BYTES} THEN NULL
      WHEN {LONG_TRANSFER} THEN orig_bytes + {EXTRA_BYTES} ELSE orig_bytes END AS orig_bytes),
    {UNSET_BYTES} AS unset_bytes, {WIDE_LINE} AS wide_line
  FROM conn_v)"""


@query(with_ctes(CONN_LINES_SQL) + f"""
SELECT {S.CONN_ROW} FROM conn_lines WHERE NOT unset_bytes AND NOT wide_line""")
def conn_scan_typed(spark, sf_dir):
    """Text log to typed rows, by the columns naive Bayes needs."""
    kept = drop_columns(conn_logs(spark, sf_dir), CONN_DROPPED_COLUMNS)
    return accept_rows(kept, without_label(CONN), NB_REQUIRED)


@query(with_ctes(CONN_LINES_SQL) + """
SELECT orig_h, orig_p, resp_h, history,
  concat_ws(',', CASE WHEN unset_bytes THEN 'orig_bytes' END,
    CASE WHEN wide_line THEN 'corrupt_line' END) AS bad_columns,
  CASE WHEN unset_bytes THEN '-' WHEN orig_pkts = 50 THEN CAST(orig_bytes AS VARCHAR)
    ELSE CAST(orig_bytes AS VARCHAR) END AS orig_bytes
FROM (SELECT * REPLACE (CAST(orig_p AS VARCHAR) AS orig_p) FROM conn_lines)
WHERE unset_bytes OR wide_line""")
def conn_scan_rejected(spark, sf_dir):
    """The quarantine of the same scan: text and the names of the bad columns."""
    bad = reject_rows(conn_logs(spark, sf_dir), without_label(CONN), NB_REQUIRED)
    return bad.select("orig_h", "orig_p", "resp_h", "history", "bad_columns", "orig_bytes")


@query(with_ctes(CONN_LINES_SQL) + """
SELECT orig_h, orig_p, resp_h, history, orig_bytes, wide_line AS wrong_width,
  CASE WHEN unset_bytes THEN '-' END AS orig_bytes_text
FROM conn_lines WHERE unset_bytes OR wide_line""")
def conn_quarantine_landed(spark, sf_dir):
    """Typed once and written, then the rows a model cannot use, with the text they held."""
    schema = without_label(CONN)
    path = new_scratch(spark, "conn-landed")
    write_labelled(parse_typed(conn_logs(spark, sf_dir), schema), path)
    landed = read_labelled(spark, path, landed_schema(schema))
    bad = F.col("bad_values")
    return quarantine(landed, NB_REQUIRED).select(
        "orig_h", "orig_p", "resp_h", "history", "orig_bytes",
        F.map_contains_key(bad, "corrupt_line").alias("wrong_width"),
        bad["orig_bytes"].alias("orig_bytes_text"),
    )


# Sums and deviations depend on the order of addition; the other numbers are compared exactly.
ROUNDED_GROUP = ("dur", "dur_mean", "dur_std", "int_std")
EXACT_GROUP = "src_ip, src_p, dst_ip, dst_p, proto, nses, cltmoredata, clt1stappdata, int_mean"


def rounded(df: DataFrame, columns, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


GROUP_ROUNDED_SQL = EXACT_GROUP + ", " + ", ".join(
    f"round({c}, 6) AS {c}" for c in ROUNDED_GROUP
)


@query(with_ctes(S.GROUPS_SQL) + f"SELECT {GROUP_ROUNDED_SQL} FROM group_v")
def group_scan_typed(spark, sf_dir):
    """Comma-separated text to typed session-group rows; 'nan' texts become null."""
    return rounded(accept_rows(group_logs(spark, sf_dir), without_label(GROUP)), ROUNDED_GROUP)


LABELLED_CONN = with_ctes(S.CONNECTIONS_SQL, S.INDICATORS_SQL, S.CONN_LABELLED_SQL)


@query(LABELLED_CONN + f"SELECT {S.CONN_ROW}, label FROM conn_labelled")
def labelled_conn_csv(spark, sf_dir):
    """Labelled connections written as CSV under the log's own names, read with a header check."""
    path = new_scratch(spark, "conn-csv")
    labelled = label_by_indicator(
        S.connections(spark, sf_dir), S.indicators(spark, sf_dir), "resp_h"
    )
    write_labelled(labelled.select(*CONN.names), path, "csv", DOTTED_NAMES)
    return accept_rows(read_labelled_csv(spark, path, CONN), CONN)


@query(with_ctes(S.GROUPS_SQL) + f"SELECT {GROUP_ROUNDED_SQL}, label FROM group_labelled")
def labelled_group_csv(spark, sf_dir):
    path = new_scratch(spark, "group-csv")
    labelled = label_by_indicator(S.groups(spark, sf_dir), S.GROUP_INDICATORS, "dst_ip")
    write_labelled(labelled, path, "csv")
    return rounded(accept_rows(read_labelled_csv(spark, path, GROUP), GROUP), ROUNDED_GROUP)


@query(LABELLED_CONN + f"SELECT {S.CONN_ROW}, label FROM conn_labelled")
def labelled_conn_parquet(spark, sf_dir):
    path = new_scratch(spark, "conn-parquet")
    labelled = label_by_indicator(
        S.connections(spark, sf_dir), S.indicators(spark, sf_dir), "resp_h"
    )
    write_labelled(labelled.select(*CONN.names), path)
    return read_labelled(spark, path, CONN)


@query(with_ctes(S.CONNECTIONS_SQL) + f"""
SELECT {S.CONN_ROW} FROM conn_v
ORDER BY CAST(orig_h AS BIGINT), orig_p, resp_h, resp_p, orig_bytes, resp_bytes, history LIMIT 25""")
def preview_rows(spark, sf_dir):
    """Console preview: the first 25 rows in a stated order."""
    rows = S.connections(spark, sf_dir).drop("seen", "source_file")
    order = [F.col("orig_h").cast("long"), "orig_p", "resp_h", "resp_p", "orig_bytes",
             "resp_bytes", "history"]
    return preview(rows, 25, order)
