"""Captures landed in runs: a rerun reads only what is new, and a run that did not end is not seen.

Each run writes the lines of its captures to a folder of its own and then one manifest: path, size, time of change, lines
and digest of every capture. Only runs with a complete manifest count. A capture that has changed since is landed
again, and the lines of its newest run replace those before; one that is gone keeps its lines.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .logs import CORRUPT, READERS, SOURCE_FILE, capture_files, scan_files, shown_copies, skipped

MANIFEST = "run string, path string, name string, size long, changed long, lines long, digest decimal(38,0)"


def manifest(spark: SparkSession, target: str) -> DataFrame:
    """One row per capture and complete run."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(f"{target}/manifest")
    files = folder.getFileSystem(conf)
    runs = [s.getPath() for s in files.listStatus(folder)] if files.exists(folder) else []
    done = [r.toString() for r in runs if files.exists(jvm.org.apache.hadoop.fs.Path(r, "_SUCCESS"))]
    if not done:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(*done)


def current(spark: SparkSession, target: str) -> DataFrame:
    """The manifest's newest row of every capture."""
    newest = Window.partitionBy("path").orderBy(F.desc("run"))
    ranked = manifest(spark, target).withColumn("_place", F.row_number().over(newest))
    return ranked.where("_place = 1").drop("_place")


def land(spark: SparkSession, folder: str | list[str], target: str, kind: str = "conn") -> list[str]:
    """Land the captures of ``folder`` that are new or changed since they were landed; their names.

    Listing a folder and its manifest is the driver's; lines are read and written by tasks.
    """
    rows = capture_files(spark, folder)
    if not rows:
        return []
    if len({name for _, name, _, _ in rows}) < len(rows):
        raise ValueError("captures of several folders must differ in their names")
    listed = spark.createDataFrame(rows, "path string, name string, size long, changed long")
    known = current(spark, target).select("path", "size", "changed")
    new = [r["path"] for r in listed.join(known, ["path", "size", "changed"], "left_anti").select("path").collect()]
    if not new:
        return []
    run = f"{_next_number(spark, target):08d}-{uuid.uuid4().hex[:8]}"
    wanted = [r for r in rows if r[0] in set(new)]
    plain = [path for path, name, _, _ in wanted if not skipped(name)]
    paths = [*plain, *shown_copies(spark, [(path, name) for path, name, _, _ in wanted if skipped(name)])]
    lines = scan_files(*READERS[kind](spark), paths)
    lines.write.parquet(f"{target}/lines/{run}", compression="zstd")
    landed = spark.read.schema(lines.schema).parquet(f"{target}/lines/{run}")
    fields = [c for c in landed.columns if c != SOURCE_FILE]
    # Equal whatever the order of lines, and combined in the map tasks.
    per_file = landed.groupBy(F.col(SOURCE_FILE).alias("name")).agg(
        F.count("*").alias("lines"), F.sum(F.xxhash64(*fields).cast("decimal(38,0)")).alias("digest")
    )
    named = spark.createDataFrame(wanted, "path string, name string, size long, changed long")
    noted = named.join(per_file, "name", "left").select(
        F.lit(run).alias("run"), "path", "name", "size", "changed", F.coalesce("lines", F.lit(0)).alias("lines"), "digest"
    )
    noted.coalesce(1).write.parquet(f"{target}/manifest/{run}")
    return [name for _, name, _, _ in wanted]


def _next_number(spark, target) -> int:
    last = manifest(spark, target).agg(F.max("run")).first()[0]
    return int(last.split("-")[0]) + 1 if last else 1


def read_landed(spark: SparkSession, target: str, kind: str = "conn") -> DataFrame:
    """The lines of every landed capture, from the newest run that holds it."""
    runs = [r["run"] for r in current(spark, target).select("run").distinct().orderBy("run").collect()]
    _, columns, _ = READERS[kind](spark)
    schema = ", ".join(f"{c} string" for c in (*columns, CORRUPT, SOURCE_FILE))
    if not runs:
        return spark.createDataFrame([], schema)
    lines = spark.read.schema(schema).parquet(*[f"{target}/lines/{run}" for run in runs])
    run = F.substring_index(F.substring_index(F.input_file_name(), "/", -2), "/", 1)
    # As many rows as captures: a list of files, never of lines.
    newest = current(spark, target).select("run", F.col("name").alias(SOURCE_FILE))
    return lines.withColumn("run", run).join(newest, ["run", SOURCE_FILE], "left_semi").select(*lines.columns)
