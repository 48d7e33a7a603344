"""What the corpus operators share: reading, held-out remainders, written intermediate tables."""

from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import new_scratch


_ROOT = str(Path(__file__).resolve().parents[2])


ARROW_ROWS = 1000
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Settings of the session that the Python stages count on.

    Workers find this package where the driver has it (a job that ships it needs no path), and
    Arrow batches hold ``ARROW_ROWS`` rows at most, because rows are whole texts.
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", _ROOT)
    rows = int(spark.conf.get(_ARROW))
    if rows <= 0 or rows > ARROW_ROWS:
        spark.conf.set(_ARROW, str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(mod: int) -> Column:
    """crc32 of the document id as text, modulo ``mod``; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod


def held_out(mod: int, at: int) -> Column:
    """Whether the document is kept out of training; a null id is not held out."""
    return F.coalesce(remainder(mod) == at, F.lit(False))


def whole_text() -> Column:
    return F.coalesce("text", F.lit(""))


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written to a new folder below ``spark.checkpoint.dir`` and read back.

    It cuts the lineage: a lost executor costs no more than the tasks since then.
    """
    path = new_scratch(df.sparkSession, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame, name: str, partition: str | None = None) -> tuple[DataFrame, str]:
    """Like ``written``, with the folder; the shuffle files behind ``df`` go when the table is complete.

    ``partition`` names the last column, whose values get folders of their own.
    """
    spark = df.sparkSession
    path, before = new_scratch(spark, name), spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(partition) if partition else writer).parquet(path)
    finally:
        spark.conf.set(_TIDY, before) if before is not None else spark.conf.unset(_TIDY)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that ``settled`` wrote; for one whose successor is complete."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def numbered(docs: DataFrame, name: str = "doc") -> DataFrame:
    """``docs`` with a number of its own for every row, in the order of ids.

    It is the id itself unless ids repeat or are null; then all rows are sorted by id (null last)
    and text, numbered, and written.
    """
    rows = docs.withColumn(name, F.col("doc_id").cast("long"))
    if rows.groupBy(name).count().where(f"count > 1 OR {name} IS NULL").isEmpty():
        return rows
    ordered = docs.orderBy(F.asc_nulls_last("doc_id"), F.asc_nulls_first("text"))
    return written(ordered.withColumn(name, F.monotonically_increasing_id()), "numbered")


def new_name(docs: DataFrame, name: str) -> str:
    """``name``, longer where a column of ``docs`` has it."""
    while name in docs.columns:
        name += "_"
    return name


def batch_rows(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most ``rows`` rows, so that one batch of long texts stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def arrow_schema(**columns: pa.DataType) -> pa.Schema:
    return pa.schema(list(columns.items()))
