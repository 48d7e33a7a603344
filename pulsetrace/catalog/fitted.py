"""Models fitted once per session, data folder and pipeline.

The queries about one model share its fit and the counted training rows, which are one scan of the training rows. Test
rows are scored where they are read; training rows are written whole only for a query that asks for them.
"""

from dataclasses import dataclass
from functools import cache, cached_property

from pyspark.sql import DataFrame, SparkSession

from ..models.specs import NAIVE_BAYES, SPECS, ModelSpec
from ..models.training import FittedModel, fit, read_rows
from ..operators.rows import drop_null_rows
from ..sources.layout import counted_rows
from ..sources.scratch import new_scratch


@dataclass
class Fitted:
    spec: ModelSpec
    model: FittedModel
    test: DataFrame
    counted: DataFrame | None = None

    @cached_property
    def known(self) -> DataFrame:
        """The distinct training rows by the columns that the model reads, indexes included, with their copies."""
        return self.model.score(self.counted, drop_nulls=False)

    @property
    def scored(self) -> DataFrame:
        """All test rows and their predictions."""
        own = [c for c in self.spec.features if c not in self.spec.schema.names]
        return self.model.score(self.test).select(*self.spec.schema.names, *own, "prediction")


@cache
def _fitted(app: str, spark: SparkSession, sf_dir: str, name: str, splits) -> Fitted:
    spec = SPECS[name]
    train, test = splits(spark, sf_dir)
    counted = None if spec.family == NAIVE_BAYES else counted_rows(read_rows(spec, train))
    return Fitted(spec, fit(spec, train, counted=counted), test, counted)


def fitted(spark: SparkSession, sf_dir: str, name: str, splits) -> Fitted:
    return _fitted(spark.sparkContext.applicationId, spark, sf_dir, name, splits)


@cache
def _written(app: str, spark: SparkSession, sf_dir: str, splits, kept: tuple[str, ...] | None, columns: tuple[str, ...]) -> DataFrame:
    rows = splits(spark, sf_dir)[0]
    rows = (rows if kept is None else drop_null_rows(rows, list(kept))).select(*columns)
    path = new_scratch(spark, "train")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def written_train(spark: SparkSession, sf_dir: str, name: str, splits) -> DataFrame:
    """The training rows of a pipeline, whole and written once for all pipelines that keep the same ones."""
    spec = SPECS[name]
    kept = tuple(spec.required) if spec.drop_nulls else None
    return _written(spark.sparkContext.applicationId, spark, sf_dir, splits, kept, tuple(spec.schema.names))
