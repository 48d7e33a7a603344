"""What the stand-in logs and landings write."""

import glob

from __spark_entry__ import SMOKE_DIR
from pulsetrace.catalog.capture_queries import captures
from pulsetrace.catalog.scan_queries import _conn_log_folder
from pulsetrace.sources.landing import land


def test_logs_and_landed_lines_are_compressed(spark, tmp_path):
    folder = _conn_log_folder(spark.sparkContext.applicationId, spark, SMOKE_DIR)
    assert glob.glob(f"{folder}/part-*.gz") and not glob.glob(f"{folder}/part-*.txt")
    assert land(spark, captures(spark, SMOKE_DIR), str(tmp_path))
    assert glob.glob(f"{tmp_path}/lines/*/*.zstd.parquet")
