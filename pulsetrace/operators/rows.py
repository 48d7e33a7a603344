"""Row filters, projections, previews and class counts."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def drop_null_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null or NaN in any of ``columns`` (default: all)."""
    return df.na.drop("any", subset=list(columns) if columns else None)


def of_class(df: DataFrame, label: int, service: str | None = None) -> DataFrame:
    """The rows of one class, optionally of one service."""
    rows = df.where(F.col("label") == label)
    return rows if service is None else rows.where(F.col("service") == service)


def class_summary(df: DataFrame, service: str | None = "ssl") -> DataFrame:
    """Rows per class and, for connection rows, those of one service, in one pass."""
    counts = [F.count("*").alias("rows")]
    if service is not None:
        counts.append(F.count_if(F.col("service") == service).alias(f"{service}_rows"))
    return df.groupBy("label").agg(*counts)


def preview(df: DataFrame, n: int = 20, order_by: Sequence[str] | None = None) -> DataFrame:
    """First ``n`` rows; with ``order_by`` each task keeps only its own ``n``."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)
