"""Raw log scans: one read per directory, every field as text."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..fixed_values import NA_TOKENS
from ..functions.columns import file_extension, na_to_null
from ..schemas import CONN_LOG_COLUMNS, GROUP_LOG_COLUMNS
from .scratch import new_scratch
from .workers import importable

CORRUPT = "corrupt_line"
SOURCE_FILE = "source_file"
SHOWN = "_="  # before the names of copies of captures that Spark would skip


def read_conn_logs(
    spark: SparkSession, path: str | list[str], na_tokens: Sequence[str] = NA_TOKENS
) -> DataFrame:
    """Tab-separated connection logs; lines that begin with ``#`` are headers or footers."""
    return scan_files(*_conn_reader(spark), _visible(spark, path), na_tokens)


def read_group_logs(
    spark: SparkSession, path: str | list[str], na_tokens: Sequence[str] = NA_TOKENS
) -> DataFrame:
    """Comma-separated session-group files without a header."""
    return scan_files(*_group_reader(spark), _visible(spark, path), na_tokens)


def _conn_reader(spark):
    return spark.read.option("sep", "\t").option("comment", "#"), CONN_LOG_COLUMNS, "\t"


def _group_reader(spark):
    return spark.read, GROUP_LOG_COLUMNS, ","


READERS = {"conn": _conn_reader, "group": _group_reader}


def text_schema(columns: Sequence[str]) -> StructType:
    """All-text schema; a line with another number of fields is also kept whole, in ``CORRUPT``."""
    return StructType([StructField(name, StringType(), True) for name in (*columns, CORRUPT)])


def text_fields(
    df: DataFrame, columns: Sequence[str], na_tokens: Sequence[str], sep: str = ","
) -> DataFrame:
    """Fields with unset ones as null; ``CORRUPT`` holds lines with too many fields.

    A line with too few is kept: its last fields are null, and each model's own list of
    required columns decides what that means.
    """
    # Spark refuses scans that need nothing but the corrupt line, such as a count of the others;
    # naming a field beside it avoids that.
    line = F.coalesce(F.col(CORRUPT), F.col(columns[0]))
    wide = F.size(F.split(F.col(CORRUPT), sep)) > len(df.columns) - 1
    return df.select(
        *[na_to_null(F.col(c), na_tokens).alias(c) for c in columns],
        F.when(F.col(CORRUPT).isNotNull() & wide, line).alias(CORRUPT),
        shown_name(F.col("_metadata.file_name")).alias(SOURCE_FILE),
    )


def shown_name(file_name: Column) -> Column:
    """A capture's own name, also where the file is a copy under a name that Spark reads."""
    return F.when(file_name.startswith(SHOWN), F.substr(file_name, F.lit(len(SHOWN) + 1))).otherwise(file_name)


def capture_files(spark: SparkSession, path: str | list[str]) -> list[tuple[str, str, int, int]]:
    """(path, name, size, time of change) of the regular files directly in a folder, without ``DS_Store``."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, out = jvm.org.apache.hadoop.fs.Path, []
    for name in [path] if isinstance(path, str) else path:
        files = new(name).getFileSystem(conf)
        for found in files.globStatus(new(name)) or []:
            for status in files.listStatus(found.getPath()):
                file = status.getPath()
                if status.isFile() and file.getName().rsplit(".", 1)[-1] != "DS_Store":
                    out.append((file.toString(), file.getName(), status.getLen(), status.getModificationTime()))
    return sorted(out)


def skipped(name: str) -> bool:
    """Whether Spark takes a file of this name for a marker of its own."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def shown_copies(spark: SparkSession, files: Sequence[tuple[str, str]]) -> list[str]:
    """Paths of copies of (path, name) whose names Spark reads, in the scratch folder.

    Tasks copy them, one file each, a block at a time, where Python's file systems know both places;
    otherwise Hadoop's own copy does.
    """
    if not files:
        return []
    folder = new_scratch(spark, "shown")
    pairs = [(path, f"{folder}/{SHOWN}{name}") for path, name in files]
    if all(_known_place(x) for x in (pairs[0][0], folder)):
        importable(spark)
        rows = spark.createDataFrame(pairs, "path string, copy string")
        rows.repartition(len(pairs), "path").mapInArrow(_copied, "bytes long").agg(F.sum("bytes")).collect()
        return [copy for _, copy in pairs]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs
    for path, copy in pairs:
        one, other = fs.Path(path), fs.Path(copy)
        fs.FileUtil.copy(one.getFileSystem(conf), one, other.getFileSystem(conf), other, False, conf)
    return [copy for _, copy in pairs]


def _place(path: str):
    """(file system, path) for Python; ``file:/x`` and plain paths are local ones."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def _known_place(path: str) -> bool:
    try:
        _place(path)
    except Exception:  # no such scheme, or its library is missing
        return False
    return True


def _copied(batches):
    """Copies whole under another name first, so that a task that is run again leaves one whole file."""
    import shutil
    import uuid

    import pyarrow as pa

    for batch in batches:
        sizes = []
        for path, copy in zip(*(c.to_pylist() for c in batch.columns)):
            (source, at), (target, to) = _place(path), _place(copy)
            target.create_dir(to.rsplit("/", 1)[0], recursive=True)
            part = f"{to.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
            with source.open_input_stream(at) as read, target.open_output_stream(part) as write:
                shutil.copyfileobj(read, write, 1 << 20)
                sizes.append(write.tell())
            target.move(part, to)
        yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64())], ["bytes"])


def _visible(spark: SparkSession, path: str | list[str]) -> list[str]:
    """``path`` and copies of the captures in its folders that Spark would skip, ``_x`` and ``.x``."""
    hidden = [(file, name) for file, name, _, _ in capture_files(spark, path) if skipped(name)]
    return [*([path] if isinstance(path, str) else path), *shown_copies(spark, hidden)]


def scan_files(reader, columns, sep, paths, na_tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """The fields of all files at ``paths``, which Spark must be able to see."""
    # Without pruning a line's width is checked whichever columns are read later.
    raw = reader.option("columnPruning", False).csv(
        paths, schema=text_schema(columns), mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT
    )
    # Spark skips sub-folders by itself; this drops "<name>.DS_Store" too.
    df = text_fields(raw, columns, na_tokens, sep)
    return df.where(file_extension(SOURCE_FILE) != "DS_Store")
