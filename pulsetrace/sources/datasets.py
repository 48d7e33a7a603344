"""Labelled datasets on disk: parquet by default, CSV for exchange."""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from ..fixed_values import NA_TOKENS
from ..schemas import DOTTED_NAMES
from .logs import CORRUPT, text_fields, text_schema

ROW_NUMBER = "row_number"


def write_labelled(
    df: DataFrame, path: str, fmt: str = "parquet", names: Mapping[str, str] | None = None
) -> None:
    """Overwrite ``path``; CSV gets a header and never a row-number column."""
    if names:
        df = df.toDF(*[names.get(c, c) for c in df.columns])
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def read_labelled_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType,
    names: Mapping[str, str] = DOTTED_NAMES,
    na_tokens: Sequence[str] = NA_TOKENS,
    row_number_column: bool = False,
) -> DataFrame:
    """CSV with a header, as text fields ready for ``accept_rows``.

    The header is checked against ``schema``: a file with other or additional
    columns fails instead of shifting values. Files that carry a leading
    nameless row-number column are read with ``row_number_column=True``.
    """
    columns = list(schema.names)
    if row_number_column:
        # The header's first name is empty, so the check by name cannot apply.
        read = text_schema([ROW_NUMBER, *columns])
    else:
        read = StructType(
            [StructField(names.get(c, c), StringType(), True) for c in columns]
            + [StructField(CORRUPT, StringType(), True)]
        )
    raw = spark.read.option("columnPruning", False).csv(
        path,
        schema=read,
        header=True,
        enforceSchema=row_number_column,
        mode="PERMISSIVE",
        columnNameOfCorruptRecord=CORRUPT,
    )
    if not row_number_column:
        back = {names.get(c, c): c for c in columns}
        raw = raw.withColumnsRenamed(back)
    return text_fields(raw, columns, na_tokens)


def read_labelled(spark: SparkSession, path: str | list[str], schema: StructType) -> DataFrame:
    """Labelled parquet, under the fixed schema."""
    paths = [path] if isinstance(path, str) else path
    return spark.read.schema(schema).parquet(*paths)
