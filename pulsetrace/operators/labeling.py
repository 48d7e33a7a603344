"""Class labels: by capture of origin for training rows, by destination for test rows."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import capture_stem
from ..sources.logs import SOURCE_FILE
from .lookup import BROADCAST_BYTES, lookup

# An address list written out in a program is tested in place; see label_by_indicator.
INLINE_INDICATORS = 10_000


def label_by_origin(
    df: DataFrame, benign_captures: Sequence[str], file_name: str = SOURCE_FILE
) -> DataFrame:
    """0 for rows of a benign capture, 1 for rows of any other file."""
    benign = capture_stem(file_name).isin(*benign_captures)
    return df.withColumn("label", F.when(benign, 0).otherwise(1))


def label_all(df: DataFrame, label: int) -> DataFrame:
    return df.withColumn("label", F.lit(label))


def label_by_indicator(
    df: DataFrame,
    indicators: Sequence[str] | DataFrame,
    on: str,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """1 where the destination ``on`` is a listed address, else 0.

    A short literal list becomes a hash-set test inside the scan stage: no join
    and no exchange. A one-column DataFrame of addresses is looked up.
    """
    if not isinstance(indicators, DataFrame):
        if len(indicators) <= INLINE_INDICATORS:
            hit = F.coalesce(F.col(on).isin(*indicators), F.lit(False))
            return df.withColumn("label", hit.cast("int"))
        indicators = df.sparkSession.createDataFrame([(x,) for x in indicators], f"{on} string")
    listed = _distinct_addresses(indicators, on).withColumn("_listed", F.lit(1))
    found = lookup(df, listed, on, "left", broadcast_bytes, shrink=True)
    return found.select(*df.columns, F.coalesce("_listed", F.lit(0)).alias("label"))


def indicator_hits(
    df: DataFrame, indicators: DataFrame, on: str, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Only the rows whose destination is listed."""
    listed = _distinct_addresses(indicators, on)
    hits = lookup(df, listed, on, "left_semi", broadcast_bytes, shrink=True)
    return hits.select(*df.columns)


def _distinct_addresses(indicators, on):
    address = indicators.columns[0]
    return indicators.select(F.col(address).alias(on)).where(F.col(on).isNotNull()).distinct()


def keep_services(df: DataFrame, services: Sequence[str], label: int = 1) -> DataFrame:
    """Drop rows of class ``label`` whose service is not listed; other classes stay whole."""
    listed = F.coalesce(F.col("service").isin(*services), F.lit(False))
    return df.where((F.col("label") != label) | listed)


def union_classes(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of all frames, columns matched by name."""
    out = first
    for other in others:
        out = out.unionByName(other)
    return out
