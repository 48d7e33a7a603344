"""Where a job may put intermediate files, and their removal."""

import atexit
import re
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession

_made: dict[str, list[str]] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Only where that is unset and all tasks run in the driver's own process, as in tests, is it
    a temporary folder of this process; the session's settings are left alone.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return _process_folder()


@cache
def _process_folder() -> str:
    path = tempfile.mkdtemp(prefix="pulsetrace-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def new_scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the scratch root."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove_scratch(spark: SparkSession) -> None:
    """Delete the folders this application took from ``new_scratch``; for the end of a job."""
    jvm, context = spark.sparkContext._jvm, spark.sparkContext._jsc
    for name in _made.pop(spark.sparkContext.applicationId, []):
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(context.hadoopConfiguration()).delete(path, True)
