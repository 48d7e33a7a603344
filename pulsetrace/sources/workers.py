"""What Python code inside tasks needs to find this package."""

from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> None:
    """Workers find the package where the driver has it; a job that ships it needs no path."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", _ROOT)
