"""From a folder of raw captures to labelled rows, and captures landed in runs.

The folder is written by Spark from the whole line item table, once per session and data folder: every capture under
names of its own kind, in as many files as tasks wrote, beside a sub-folder and files that are no captures.
"""

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import capture_stem
from ..operators.labeling import keep_services, label_by_origin
from ..schemas import CONN_LOG_COLUMNS
from ..sources.landing import current, land, read_landed
from ..sources.logs import SOURCE_FILE, read_conn_logs
from ..sources.scratch import new_scratch
from . import standins as S
from .registry import query
from .scan_queries import conn_text_fields
from .sql import with_ctes

# What a capture is told by, and the names of its files; "#" stands for their numbers.
CAPTURES = {
    "orig_pkts < 18": "cicids17-normal.#.log",
    "orig_pkts < 36": "ctu-normal-20.labeled.#.log",
    "conn_state = 'AF'": "_beacon-AF.#.log",
    "conn_state = 'NF'": ".beacon-NF.#.log",
    "conn_state = 'NO'": "beacon-NO.#",
    "TRUE": "beacon-RF.pcap.#.log",
}
JUNK = {"supplier": (".", "DS_Store"), "part": ("", "old.#.DS_Store"), "nation": ("inner/", "deep.#.log")}
STEM_SQL = "CASE " + " ".join(
    f"WHEN {rule} THEN '{name.split('.')[0]}'" for rule, name in CAPTURES.items()
) + " END"
BENIGN = ("cicids17-normal", "ctu-normal-20")


def _text(spark: SparkSession, df: DataFrame, folder: str, names: dict[str, str], on: str) -> None:
    """Write the lines of ``df`` (value and a key column), each key's files under the name pattern of that key."""
    parts = new_scratch(spark, "parts")
    df.write.partitionBy(on).text(parts)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new = jvm.org.apache.hadoop.fs.Path
    files = new(parts).getFileSystem(conf)
    for key, name in names.items():
        at = new(f"{parts}/{on}={key}")
        if not files.exists(at):
            continue
        to = new(f"{folder}/{name}")
        files.mkdirs(to.getParent())
        for n, status in enumerate(sorted(s.getPath().toString() for s in files.listStatus(at))):
            files.rename(new(status), new(f"{folder}/{name.replace('#', str(n))}"))


@cache
def _captures(app: str, spark: SparkSession, sf_dir: str) -> str:
    folder = new_scratch(spark, "captures")
    rules = list(CAPTURES)
    key = F.expr("CASE " + " ".join(f"WHEN {rule} THEN 'c{i}'" for i, rule in enumerate(rules)) + " END")
    conns = S.connections(spark, sf_dir).withColumn("capture", key)
    lines = conn_text_fields(conns, "capture").select(F.concat_ws("\t", *CONN_LOG_COLUMNS).alias("value"), "capture")
    # Headers in one capture only; the others have neither header nor footer.
    opened = S.table(spark, sf_dir, "orders").select(
        F.concat_ws("\t", F.lit("#open"), F.col("o_orderkey").cast("string")).alias("value"), F.lit("c0").alias("capture")
    )
    names = {f"c{i}": name for i, name in enumerate(CAPTURES.values())}
    _text(spark, lines.union(opened), folder, names, "capture")
    for i, (table, (place, name)) in enumerate(JUNK.items()):
        df = S.table(spark, sf_dir, table)
        junk = df.select(F.col(df.columns[0]).cast("string").alias("value"), F.lit(f"j{i}").alias("capture"))
        _text(spark, junk.coalesce(1) if "#" not in name else junk, folder, {f"j{i}": place + name}, "capture")
    return folder


def captures(spark: SparkSession, sf_dir: str) -> str:
    return _captures(spark.sparkContext.applicationId, spark, sf_dir)


def _per_capture(logs: DataFrame) -> DataFrame:
    labelled = keep_services(label_by_origin(logs, BENIGN), ("http", "ssl"))
    sent = F.col("orig_pkts").try_cast("long")
    return labelled.groupBy(capture_stem(SOURCE_FILE).alias("capture"), "label").agg(
        F.count("*").alias("rows"), F.sum(sent).alias("packets")
    )


PER_CAPTURE_SQL = with_ctes(S.CONNECTIONS_SQL) + f""",
named AS (SELECT *, {STEM_SQL} AS capture FROM conn_v)
SELECT capture, CASE WHEN capture IN {BENIGN} THEN 0 ELSE 1 END AS label, count(*) AS rows,
  CAST(sum(orig_pkts) AS BIGINT) AS packets
FROM named WHERE capture IN {BENIGN} OR service IN ('http', 'ssl') GROUP BY ALL"""


@query(PER_CAPTURE_SQL)
def capture_folder_dataset(spark, sf_dir):
    """Rows and packets of every capture of a folder, read once and labelled by the names of its files."""
    return _per_capture(read_conn_logs(spark, captures(spark, sf_dir)))


@query(PER_CAPTURE_SQL)
def captures_landed_twice(spark, sf_dir):
    """The same captures landed in two runs: the second finds nothing new, and a run that broke off is not seen."""
    folder, target = captures(spark, sf_dir), new_scratch(spark, "landed")
    if not land(spark, folder, target) or land(spark, folder, target):
        raise AssertionError("the second run has read captures again")
    broken = read_conn_logs(spark, folder)
    broken.write.parquet(f"{target}/lines/99999999-broken", compression="zstd")  # lines without a manifest
    return _per_capture(read_landed(spark, target))


@query(with_ctes(S.CONNECTIONS_SQL) + f""",
named AS (SELECT *, {STEM_SQL} AS capture FROM conn_v)
SELECT capture, CAST(count(*) AS BIGINT) AS lines FROM named GROUP BY ALL""")
def capture_manifest(spark, sf_dir):
    """Lines of every capture as the manifest of a landing has them."""
    target = new_scratch(spark, "landed")
    land(spark, captures(spark, sf_dir), target)
    return current(spark, target).groupBy(capture_stem("name").alias("capture")).agg(F.sum("lines").alias("lines"))
