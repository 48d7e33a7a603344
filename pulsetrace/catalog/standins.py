"""Network-log shaped frames from the driver's tables, each with its SQL twin.

The tables hold no network logs, so line items stand in for connections, event
groups for session groups, and documents for a labelled categorical set. Every
frame is built from all rows of its tables.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CUTOVER = "2000-01-01"  # captures before this day train, later ones test


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as connections.

    Transfers of many packets go to listed destinations (suppliers in fives) and others do not,
    but for one line in seven, which goes where it goes: the test label depends on the features
    that the training label depends on, and not on them alone.
    """
    items = table(spark, sf_dir, "lineitem")
    supplier = F.col("l_suppkey")
    destination = (
        F.when(F.col("l_linenumber") == 7, supplier)
        .when(F.col("l_quantity") >= 36, F.greatest(supplier - supplier % 5, F.lit(5)))
        .when(supplier % 5 == 0, supplier - 1)
        .otherwise(supplier)
    )
    quantity = F.col("l_quantity").cast("int")
    base = items.select(
        F.col("l_orderkey").cast("string").alias("orig_h"),
        F.col("l_linenumber").alias("orig_p"),
        destination.cast("long").cast("string").alias("resp_h"),
        F.col("l_partkey").cast("int").alias("resp_p"),
        F.when(F.col("l_linestatus") == "O", "tcp").otherwise("udp").alias("proto"),
        F.when(F.col("l_returnflag") == "A", "http")
        .when(F.col("l_returnflag") == "R", "ssl")
        .otherwise("-").alias("service"),
        F.col("l_tax").alias("duration"),
        F.floor("l_extendedprice").alias("orig_bytes"),
        F.floor(F.col("l_extendedprice") * F.col("l_discount")).alias("resp_bytes"),
        F.concat("l_returnflag", "l_linestatus").alias("conn_state"),
        F.concat("l_returnflag", "l_linestatus", quantity.cast("string")).alias("history"),
        quantity.cast("long").alias("orig_pkts"),
        F.col("l_linenumber").cast("long").alias("resp_pkts"),
        F.col("l_shipdate").alias("seen"),
    )
    capture = (
        F.when(F.col("orig_pkts") < 18, "cicids17-normal.log")
        .when(F.col("orig_pkts") < 36, "logs/ctu-normal-20.labeled.log")
        .otherwise(F.concat(F.lit("beacon-"), "conn_state", F.lit(".log")))
    )
    return base.select(
        "orig_h", "orig_p", "resp_h", "resp_p", "proto", "service", "duration",
        "orig_bytes", "resp_bytes", "conn_state", "history", "orig_pkts",
        (F.col("orig_bytes") + 40 * F.col("orig_pkts")).alias("orig_ip_bytes"),
        "resp_pkts",
        (F.col("resp_bytes") + 40 * F.col("resp_pkts")).alias("resp_ip_bytes"),
        capture.alias("source_file"),
        "seen",
    )


CONNECTIONS_SQL = """
conn_base AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS orig_h, l_linenumber AS orig_p,
    CAST(CASE WHEN l_linenumber = 7 THEN l_suppkey
      WHEN l_quantity >= 36 THEN greatest(l_suppkey - l_suppkey % 5, 5)
      WHEN l_suppkey % 5 = 0 THEN l_suppkey - 1 ELSE l_suppkey END AS VARCHAR) AS resp_h,
    CAST(l_partkey AS INTEGER) AS resp_p,
    CASE WHEN l_linestatus = 'O' THEN 'tcp' ELSE 'udp' END AS proto,
    CASE l_returnflag WHEN 'A' THEN 'http' WHEN 'R' THEN 'ssl' ELSE '-' END AS service,
    l_tax AS duration,
    CAST(floor(l_extendedprice) AS BIGINT) AS orig_bytes,
    CAST(floor(l_extendedprice * l_discount) AS BIGINT) AS resp_bytes,
    l_returnflag || l_linestatus AS conn_state,
    l_returnflag || l_linestatus || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS history,
    CAST(l_quantity AS BIGINT) AS orig_pkts,
    CAST(l_linenumber AS BIGINT) AS resp_pkts,
    l_shipdate AS seen
  FROM lineitem),
conn_v AS (
  SELECT *, orig_bytes + 40 * orig_pkts AS orig_ip_bytes,
    resp_bytes + 40 * resp_pkts AS resp_ip_bytes,
    CASE WHEN orig_pkts < 18 THEN 'cicids17-normal.log'
      WHEN orig_pkts < 36 THEN 'logs/ctu-normal-20.labeled.log'
      ELSE 'beacon-' || conn_state || '.log' END AS source_file
  FROM conn_base)"""


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth supplier as the list of malicious destinations."""
    suppliers = table(spark, sf_dir, "supplier").where(F.col("s_suppkey") % 5 == 0)
    return suppliers.select(F.col("s_suppkey").cast("string").alias("ip"))


INDICATORS_SQL = """
ioc AS (SELECT DISTINCT CAST(s_suppkey AS VARCHAR) AS ip FROM supplier WHERE s_suppkey % 5 = 0)"""

CONN_ROW = (
    "orig_h, orig_p, resp_h, resp_p, proto, service, duration, orig_bytes, resp_bytes, "
    "conn_state, history, orig_pkts, orig_ip_bytes, resp_pkts, resp_ip_bytes"
)

# The labelled splits, as plans.datasets.conn_train / conn_test make them.
CONN_TRAIN_SQL = f"""
conn_origin AS (
  SELECT *, CASE WHEN source_file IN ('cicids17-normal.log', 'logs/ctu-normal-20.labeled.log')
    THEN 0 ELSE 1 END AS label FROM conn_v),
conn_train AS (
  SELECT {CONN_ROW}, label FROM conn_origin
  WHERE seen < TIMESTAMP '{CUTOVER}' AND (label = 0 OR service IN ('http', 'ssl')))"""
CONN_LABELLED_SQL = """
conn_labelled AS (
  SELECT c.*, CASE WHEN i.ip IS NULL THEN 0 ELSE 1 END AS label
  FROM conn_v c LEFT JOIN ioc i ON c.resp_h = i.ip)"""
CONN_TEST_SQL = f"""
conn_test AS (SELECT {CONN_ROW}, label FROM conn_labelled WHERE seen >= TIMESTAMP '{CUTOVER}')"""


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one user, type and day as a session group; spread columns are null in groups of one."""
    clock = (
        F.hour("ts") * 3600
        + F.minute("ts") * 60
        + F.extract(F.lit("SECOND"), F.col("ts")).cast("double")
    )
    events = table(spark, sf_dir, "events").select(
        "user_id", "event_type", "value", F.to_date("ts").alias("day"), clock.alias("clock")
    )
    return (
        events.groupBy("user_id", "event_type", "day")
        .agg(
            F.sum("value").alias("dur"),
            F.count("*").cast("int").alias("nses"),
            (F.max("value") * F.length("event_type")).alias("cltmoredata"),
            F.min("value").alias("clt1stappdata"),
            F.avg("value").alias("dur_mean"),
            F.stddev_samp("value").alias("dur_std"),
            F.try_divide(F.max("clock") - F.min("clock"), F.count("*") - 1).alias("int_mean"),
            F.stddev_samp("clock").alias("int_std"),
        )
        .select(
            F.col("user_id").cast("string").alias("src_ip"),
            F.dayofmonth("day").alias("src_p"),
            F.col("event_type").alias("dst_ip"),
            F.length("event_type").alias("dst_p"),
            F.lit(6).alias("proto"),
            "dur", "nses", "cltmoredata", "clt1stappdata",
            "dur_mean", "dur_std", "int_mean", "int_std",
        )
    )


GROUPS_SQL = """
clocked AS (
  SELECT *, hour(ts) * 3600 + minute(ts) * 60 + microsecond(ts) / 1e6 AS clock FROM events),
group_base AS (
  SELECT user_id, event_type, CAST(ts AS DATE) AS day,
    sum(value) AS dur, CAST(count(*) AS INTEGER) AS nses,
    max(value) * length(event_type) AS cltmoredata, min(value) AS clt1stappdata,
    avg(value) AS dur_mean, stddev_samp(value) AS dur_std,
    (max(clock) - min(clock)) / nullif(count(*) - 1, 0) AS int_mean,
    stddev_samp(clock) AS int_std
  FROM clocked GROUP BY user_id, event_type, CAST(ts AS DATE)),
group_v AS (
  SELECT CAST(user_id AS VARCHAR) AS src_ip, CAST(day(day) AS INTEGER) AS src_p,
    event_type AS dst_ip, CAST(length(event_type) AS INTEGER) AS dst_p, 6 AS proto,
    dur, nses, cltmoredata, clt1stappdata, dur_mean, dur_std, int_mean, int_std
  FROM group_base),
group_labelled AS (
  SELECT *, CASE WHEN dst_ip IN ('click', 'error') THEN 1 ELSE 0 END AS label FROM group_v)"""
GROUP_INDICATORS = ("click", "error")
GROUP_ROW = (
    "src_ip, src_p, dst_ip, dst_p, proto, dur, nses, cltmoredata, clt1stappdata, "
    "dur_mean, dur_std, int_mean, int_std"
)
GROUP_PRESENT = " AND ".join(
    f"{c} IS NOT NULL" for c in ("dur", "dur_mean", "dur_std", "int_mean", "int_std")
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: two categories, one number, the quality label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return docs.join(labels, "doc_id")


DOCUMENTS_SQL = """
docs_v AS (
  SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
