"""Partition layout before work that passes over the rows many times."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import new_scratch

ROWS_PER_TASK = 50_000
COPIES = "_copies"
_COPIES_PER_ROW = 1_000
_BLOCKS_PER_TASK = 2_000


def counted_rows(df: DataFrame) -> DataFrame:
    """The distinct rows of ``df`` and how often each occurs (``COPIES``), written; ``df`` is read once."""
    path = new_scratch(df.sparkSession, "layout")
    counts = df.groupBy(*df.columns).agg(F.count("*").alias(COPIES))
    counts.write.parquet(path)
    return df.sparkSession.read.schema(counts.schema).parquet(path)


def _counted(df: DataFrame) -> DataFrame:
    return df if COPIES in df.columns else counted_rows(df)


def _number(counted: DataFrame) -> int:
    return counted.agg(F.coalesce(F.sum(COPIES), F.lit(0))).first()[0]


def _in_blocks(counted: DataFrame, size: int) -> DataFrame:
    """Every row once for each ``size`` of its copies, with the place of the first and the last (``_first``, ``_last``)."""
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(COPIES) - 1) / size)))
    blocks = counted.withColumn("_block", block).withColumn("_first", F.col("_block") * size)
    return blocks.withColumn("_last", F.least(F.col("_first") + size, F.col(COPIES)) - 1)


def stable_layout(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Same rows in the same partitions and order on every run and every machine.

    The number of partitions follows from the number of rows alone, and a row's partition from its
    values: a forest draws its samples per partition, so its trees then depend on the data
    only. Copies of a row are counted before the shuffle and dealt out one by one after
    it, so a row that is repeated often does not meet in one task; nor do the copies of few distinct rows, which
    go to as many tasks as they fill before they are dealt. ``df`` may be counted already.
    """
    columns = [c for c in df.columns if c != COPIES]
    counted = _counted(df)
    rows = _number(counted)
    blocks = _in_blocks(counted, _COPIES_PER_ROW)
    if rows > rows_per_task:
        tasks = -(-rows // (_COPIES_PER_ROW * _BLOCKS_PER_TASK)) + 1
        blocks = blocks.repartition(tasks, F.xxhash64(*columns, "_block"))
    each = blocks.withColumn("_copy", F.explode(F.sequence("_first", "_last")))
    keys = [*columns, "_copy"]
    dealt = each.select(*keys).repartition(max(1, -(-rows // rows_per_task)), F.xxhash64(*keys))
    return dealt.sortWithinPartitions(*keys).select(*columns)


def weighted_layout(df: DataFrame, held: int | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``stable_layout`` of the distinct rows, with the number of copies that each stands for (``COPIES``).

    With ``held``, no row stands for more than one in ``held`` of all: one repeated more often is there several times. So
    tables of up to ``held`` rows are laid out copy by copy, and others in about ``held`` rows and the distinct ones.
    """
    columns = [c for c in df.columns if c != COPIES]
    counted = _counted(df)
    if held is not None:
        blocks = _in_blocks(counted, max(1, _number(counted) // held))
        counted = blocks.select(*columns, F.col("_first").alias("_copy"), (F.col("_last") - F.col("_first") + 1).alias(COPIES))
    else:
        counted = counted.select(*columns, F.lit(0).cast("long").alias("_copy"), COPIES)
    keys = [*columns, "_copy"]
    dealt = counted.repartition(max(1, -(-counted.count() // rows_per_task)), F.xxhash64(*keys))
    return dealt.sortWithinPartitions(*keys).select(*columns, COPIES)
