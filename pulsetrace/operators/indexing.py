"""Category indexes ordered by descending frequency, ties by value.

Frequencies are counted by a shuffle with map-side combine, one scan for all
columns. A small vocabulary becomes a ``StringIndexerModel``; one over the limit
stays a distributed table and is applied by a join.
"""

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.layout import COPIES
from ..sources.scratch import new_scratch
from .lookup import broadcast_size, lookup

# Vocabularies up to this size go through the driver into model metadata; larger ones are tables
# with the same result. None puts all of them into metadata.
MAX_DRIVER_LABELS = 20_000
TRACKED = 1 << 14  # values a sketch follows
SKETCH_ERROR = 3.5  # its error in rows, times the values it follows, over all rows
_ENTRY_BYTES = 72  # of a row beside its value
RANKED = "value string, count long, index double, column string"
_POSITION_BITS = 33  # monotonically_increasing_id: partition number above, position below


def index_name(column: str) -> str:
    return f"{column}_index"


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per (column, value); nulls are not categories. Counted rows are as many as their copies."""
    own = [COPIES] if COPIES in df.columns else []
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns], *own)
    return (
        text.unpivot(own, list(columns), "column", "value")
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg((F.sum(COPIES) if own else F.count("*")).alias("count"))
    )


@dataclass
class IndexTable:
    """A vocabulary as a written table (value, count, index), with its rows and bytes."""

    df: DataFrame
    rows: int
    size: int


def read_index_table(spark: SparkSession, path: str) -> IndexTable:
    df = spark.read.parquet(path)
    return IndexTable(df, df.count(), broadcast_size(df.select("value", "index")))


def rank_values(counts: DataFrame, path: str) -> DataFrame:
    """(column, value, count, index) for the counts of any columns, written to ``path``.

    Nothing is gathered in one task: one range-partitioned sort for all columns is written out, so
    that partition numbers and positions are settled; then a value's rank is its
    partition's start in its column, a cumulative sum over one number per partition, plus its
    place among the partition's values of that column.
    """
    sorted_path = f"{path}-sorted"
    counts.select("column", "value", "count").orderBy("column", F.desc("count"), "value").withColumn(
        "position", F.monotonically_increasing_id()
    ).write.mode("overwrite").parquet(sorted_path)
    written = counts.sparkSession.read.parquet(sorted_path).select(
        "column",
        "value",
        "count",
        F.shiftright("position", _POSITION_BITS).alias("part"),
        F.col("position").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).alias("place"),
    )
    # One row per partition of the sort and column: small whatever the number of values.
    sizes = written.groupBy("column", "part").agg(F.count("*").alias("size"), F.min("place").alias("first"))
    before = W.partitionBy("column").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("size").over(before), F.lit(0))
    starts = sizes.select("column", "part", (earlier - F.col("first")).alias("start"))
    ranked = written.join(F.broadcast(starts), ["column", "part"])
    ranked.select(
        "column", "value", "count", (F.col("start") + F.col("place")).cast("double").alias("index")
    ).write.mode("overwrite").partitionBy("column").parquet(path)
    return counts.sparkSession.read.schema(RANKED).parquet(path)


def apply_index_table(
    df: DataFrame, table: IndexTable, column: str, handle_invalid: str = "keep", **options
) -> DataFrame:
    """Add ``<column>_index`` from an index table; no pass over the table is needed beforehand.

    Unseen and null values get the number of categories (``keep``), lose their row (``skip``)
    or fail the query when they are met (``error``).
    """
    name = index_name(column)
    dim = table.df.select(F.col("value").alias(column), F.col("index").alias(name))
    found = lookup(df, dim, column, "left", size=table.size, **options)
    if handle_invalid == "skip":
        return found.where(F.col(name).isNotNull())
    if handle_invalid == "error":
        said = F.concat(F.lit(f"{column}: unseen value "), F.coalesce(F.col(column).cast("string"), F.lit("null")))
        return found.withColumn(name, F.coalesce(name, F.raise_error(said).cast("double")))
    return found.withColumn(name, F.coalesce(name, F.lit(float(table.rows))))


@dataclass
class CategoryIndex:
    """Fitted indexes: ``models`` for small vocabularies, ``tables`` for the others."""

    models: list[StringIndexerModel] = field(default_factory=list)
    tables: dict[str, IndexTable] = field(default_factory=dict)
    handle_invalid: str = "keep"

    def transform(self, df: DataFrame) -> DataFrame:
        for model in self.models:
            df = model.transform(df)
        return self.apply_tables(df)

    def apply_tables(self, df: DataFrame) -> DataFrame:
        for column, table in self.tables.items():
            df = apply_index_table(df, table, column, self.handle_invalid)
        return df


def fit_index(
    df: DataFrame,
    columns: Sequence[str],
    max_driver_labels: int | None = MAX_DRIVER_LABELS,
    handle_invalid: str = "keep",
) -> CategoryIndex:
    """Index every column; ``handle_invalid`` (keep, skip, error) is for unseen and null values."""
    spark: SparkSession = df.sparkSession
    counts = category_counts(df, columns).persist()
    try:
        sizes = dict.fromkeys(columns, (0, 0))
        row = F.octet_length("value") + _ENTRY_BYTES
        found = counts.groupBy("column").agg(F.count("*").alias("rows"), F.sum(row).alias("bytes"))
        sizes.update((r["column"], (r["rows"], r["bytes"])) for r in found.collect())
        small = [c for c in columns if max_driver_labels is None or sizes[c][0] <= max_driver_labels]
        labels = {c: [] for c in small}
        rows = counts.where(F.col("column").isin(*small)).collect() if small else []
        for r in sorted(rows, key=lambda r: (-r["count"], r["value"])):
            labels[r["column"]].append(r["value"])
        # One model per column: a joint model would pad the label lists to one length.
        models = [
            StringIndexerModel.from_labels(
                labels[c], inputCol=c, outputCol=index_name(c), handleInvalid=handle_invalid
            )
            for c in small
        ]
        large = [c for c in columns if c not in labels]
        tables = {}
        if large:
            ranked = rank_values(counts.where(F.col("column").isin(*large)), new_scratch(spark, "index"))
            tables = {
                c: IndexTable(ranked.where(F.col("column") == c).drop("column"), *sizes[c]) for c in large
            }
    finally:
        counts.unpersist()
    return CategoryIndex(models, tables, handle_invalid)


@dataclass(frozen=True)
class Cut:
    """Values of a column that hold at least ``rows`` of its rows are indexed; the others share the last index."""

    rows: int
    kept: int


def least_share(tracked: int) -> float:
    """The share of rows above which a sketch of ``tracked`` values misses none (its error bound)."""
    return SKETCH_ERROR / tracked


def fit_bounded_index(
    df: DataFrame, columns: Sequence[str], tracked: int = TRACKED, handle_invalid: str = "keep"
) -> tuple[CategoryIndex, dict[str, Cut]]:
    """Indexes whose size does not grow with the number of values, and their cuts.

    One scan builds a mergeable heavy-hitter sketch per column, a second one counts the values that it names. Those at or
    above the cut are indexed as ``fit_index`` would index them; rarer ones get the index of unseen values.
    """
    if tracked & (tracked - 1):
        raise ValueError("tracked must be a power of two, as the sketch's table is")
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    most = int(tracked / SKETCH_ERROR) + 2  # no more values can lie above the cut, null included
    sketch = [
        F.call_function("approx_top_k", F.col(c), F.lit(most), F.lit(tracked)).alias(c) for c in columns
    ]
    found = text.agg(*sketch, *[F.count(c).alias(f"_n{i}") for i, c in enumerate(columns)]).first()
    named = [(c, r["item"]) for c in columns for r in (found[c] or []) if r["item"] is not None]
    cuts = {c: math.ceil(found[f"_n{i}"] * least_share(tracked)) for i, c in enumerate(columns)}
    labels: dict[str, list[str]] = {c: [] for c in columns}
    if named:
        asked = df.sparkSession.createDataFrame(named, "column string, value string")
        values = text.unpivot([], list(columns), "column", "value")
        counted = values.join(F.broadcast(asked), ["column", "value"]).groupBy("column", "value").count()
        for r in sorted(counted.collect(), key=lambda r: (-r["count"], r["value"])):
            if r["count"] >= cuts[r["column"]]:
                labels[r["column"]].append(r["value"])
    models = [
        StringIndexerModel.from_labels(
            labels[c], inputCol=c, outputCol=index_name(c), handleInvalid=handle_invalid
        )
        for c in columns
    ]
    return CategoryIndex(models, {}, handle_invalid), {c: Cut(cuts[c], len(labels[c])) for c in columns}


def index_pairs(df: DataFrame, column: str) -> DataFrame:
    """Distinct (value, index) pairs of an indexed frame."""
    return df.select(column, index_name(column)).distinct()
