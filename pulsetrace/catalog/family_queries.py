"""All pipelines together: scored in one scan, and saved, loaded and scored again."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models import store
from ..models.specs import SPECS
from ..models.training import fit
from ..operators import evaluation
from ..plans.runs import cells_of_all, metrics_of_all
from ..sources.scratch import new_scratch
from . import standins as S
from .evaluation_queries import PLACES
from .fitted import Fitted, fitted, written_train
from .model_queries import CONN_TESTED, GROUP_WHOLE_TEST, conn_splits, group_splits
from .registry import query
from .scan_queries import rounded
from .sql import METRIC_NAMES

CONN_MODELS = [name for name in SPECS if name.startswith("conn")]
GROUP_MODELS = [name for name in SPECS if name.startswith("group")]


def _all(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, Fitted]:
    splits = conn_splits if names is CONN_MODELS else group_splits
    return {name: fitted(spark, sf_dir, name, splits) for name in names}


def _test_rows(spark, sf_dir, names) -> DataFrame:
    return (conn_splits if names is CONN_MODELS else group_splits)(spark, sf_dir)[1]


def _one_scan(spark, sf_dir, names):
    """Rows per model, and cells that differ from those of its own run."""
    found = _all(spark, sf_dir, names)
    together = cells_of_all({n: f.model for n, f in found.items()}, _test_rows(spark, sf_dir, names))
    alone = None
    for name, f in found.items():
        cells = evaluation.confusion(f.scored).select(F.lit(name).alias("model"), "label", "prediction", "count")
        alone = cells if alone is None else alone.unionByName(cells)
    both = together.withColumn("side", F.lit(1)).unionByName(alone.withColumn("side", F.lit(-1)))
    cells = both.groupBy("model", "label", "prediction").agg(
        F.sum(F.when(F.col("side") == 1, F.col("count")).otherwise(0)).alias("n"),
        F.sum(F.col("side") * F.col("count")).alias("difference"),
    )
    return cells.groupBy("model").agg(
        F.sum("n").alias("rows"), F.count_if(F.col("difference") != 0).alias("differing_cells")
    )


def _rows_sql(tests: dict[str, str], zero: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS model, count(*) AS rows, CAST(0 AS BIGINT) AS {zero} FROM {test}" for name, test in tests.items()
    )


def _group_test(name):
    whole = "SELECT * FROM group_test"
    return "group_test" if not SPECS[name].drop_test_nulls else f"({whole} WHERE {S.GROUP_PRESENT})"


CONN_TESTS = {name: "conn_test" for name in CONN_MODELS}
GROUP_TESTS = {name: _group_test(name) for name in GROUP_MODELS}


@query(CONN_TESTED + _rows_sql(CONN_TESTS, "differing_cells"))
def conn_models_in_one_scan(spark, sf_dir):
    """Five models of connections, scored and counted together as each would be alone."""
    return _one_scan(spark, sf_dir, CONN_MODELS)


@query(GROUP_WHOLE_TEST.rstrip(",") + _rows_sql(GROUP_TESTS, "differing_cells"))
def group_models_in_one_scan(spark, sf_dir):
    return _one_scan(spark, sf_dir, GROUP_MODELS)


@query()
def conn_models_metrics(spark, sf_dir):
    """A row of metrics per model of connections; no SQL fits them."""
    models = {n: f.model for n, f in _all(spark, sf_dir, CONN_MODELS).items()}
    return rounded(metrics_of_all(models, _test_rows(spark, sf_dir, CONN_MODELS)), METRIC_NAMES, PLACES)


@query()
def group_models_metrics(spark, sf_dir):
    models = {n: f.model for n, f in _all(spark, sf_dir, GROUP_MODELS).items()}
    return rounded(metrics_of_all(models, _test_rows(spark, sf_dir, GROUP_MODELS)), METRIC_NAMES, PLACES)


def _saved(spark, found: Fitted, train: DataFrame, name: str) -> DataFrame:
    """One row: rows, and those whose prediction the saved and loaded pipeline changes."""
    path = store.save(found.model, new_scratch(spark, "models"), train)
    loaded = store.load(spark, path, train)
    again = loaded.score(found.scored.select(*found.spec.schema.names, F.col("prediction").alias("before")))
    return again.agg(
        F.lit(name).alias("model"), F.count("*").alias("rows"),
        F.count_if(F.col("prediction").cast("double") != F.col("before").cast("double")).alias("mismatches"),
    )


def _saved_all(spark, sf_dir, names):
    splits = conn_splits if names is CONN_MODELS else group_splits
    train = {name: written_train(spark, sf_dir, name, splits) for name in names}
    rows = [_saved(spark, f, train[name], name) for name, f in _all(spark, sf_dir, names).items()]
    if names is CONN_MODELS:
        by = "conn_naive_bayes"
        known = fitted(spark, sf_dir, by, conn_splits)
        tables = fit(SPECS[by], train[by], max_driver_labels=0)  # every vocabulary as a table
        rows.append(_saved(spark, Fitted(known.spec, tables, known.test), train[by], f"{by}, tables"))
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


@query(CONN_TESTED + _rows_sql(CONN_TESTS | {"conn_naive_bayes, tables": "conn_test"}, "mismatches"))
def conn_save_load(spark, sf_dir):
    """Every family of connections saved with its rows' fingerprint, loaded for these rows, and scored again."""
    return _saved_all(spark, sf_dir, CONN_MODELS)


@query(GROUP_WHOLE_TEST.rstrip(",") + _rows_sql(GROUP_TESTS, "mismatches"))
def group_save_load(spark, sf_dir):
    return _saved_all(spark, sf_dir, GROUP_MODELS)
