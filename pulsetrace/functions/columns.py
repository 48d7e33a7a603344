from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType


def capture_stem(file_name: Column | str) -> Column:
    """Last path part of a file name, up to its first dot."""
    name = F.col(file_name) if isinstance(file_name, str) else file_name
    return F.substring_index(F.substring_index(name, "/", -1), ".", 1)


def file_extension(file_name: Column | str) -> Column:
    """Text after the last dot of a file name."""
    name = F.col(file_name) if isinstance(file_name, str) else file_name
    return F.substring_index(name, ".", -1)


def na_to_null(column: Column, tokens: Sequence[str]) -> Column:
    return F.when(~column.isin(*tokens), column)


def typed(column: Column, kind: DataType) -> Column:
    """The field read as ``kind``; text that does not parse becomes null."""
    return column if isinstance(kind, StringType) else column.try_cast(kind)


def is_malformed(column: Column, kind: DataType) -> Column:
    """True where the field holds text that is not a value of ``kind``."""
    if isinstance(kind, StringType):
        return F.lit(False)
    return column.isNotNull() & column.try_cast(kind).isNull()


def class_name(column: Column | str, names: Mapping[int, str]) -> Column:
    """Class number to display name; other numbers keep their text."""
    value = F.col(column) if isinstance(column, str) else column
    pairs = list(names.items())
    out = F.when(value == pairs[0][0], pairs[0][1])
    for number, name in pairs[1:]:
        out = out.when(value == number, name)
    return out.otherwise(value.cast("string"))


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double; null where whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))
