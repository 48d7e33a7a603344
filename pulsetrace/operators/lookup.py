"""Left lookup of a dimension by key, broadcast only after its size is known."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import new_scratch

BROADCAST_BYTES = 64 * 1024 * 1024
_ROW_OVERHEAD = 64


def broadcast_size(dim: DataFrame) -> int:
    """Bytes of the dimension's whole rows, measured over all of them."""
    columns = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in dim.columns]
    return dim.agg(F.coalesce(F.sum(sum(columns, F.lit(_ROW_OVERHEAD))), F.lit(0))).first()[0]


def seen_keys(facts: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """The part of ``dim`` whose keys occur in ``facts``, written out.

    Reads one fact column and shuffles its distinct values only. A list of many
    addresses that meets few of them shrinks to a size that can be broadcast.
    """
    path = new_scratch(facts.sparkSession, "seen-keys")
    dim.join(facts.select(key).distinct(), key, "left_semi").write.parquet(path)
    return facts.sparkSession.read.parquet(path)


def lookup(
    facts: DataFrame,
    dim: DataFrame,
    key: str,
    how: str = "left",
    broadcast_bytes: int = BROADCAST_BYTES,
    shrink: bool = False,
    size: int | None = None,
) -> DataFrame:
    """Join ``facts`` to ``dim``, whose ``key`` values are distinct.

    With ``shrink``, a dimension over the limit is first cut to the keys that
    occur. One still over it is joined by a sort-merge join: its other side may be split, so
    adaptive execution deals a hot key's fact rows to as many tasks as their bytes fill.
    ``size`` is the dimension's size in bytes where the caller knows it.
    """
    added = [] if how == "left_semi" else [c for c in dim.columns if c != key]
    small = (broadcast_size(dim) if size is None else size) <= broadcast_bytes
    if shrink and not small:
        dim = seen_keys(facts, dim, key)
        small = broadcast_size(dim) <= broadcast_bytes
    joined = facts.join(F.broadcast(dim) if small else dim.hint("merge"), key, how)
    return joined.select(*facts.columns, *added)
