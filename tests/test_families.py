"""Several models in one scan, and models saved with the fingerprint of their rows."""

import pytest
from pyspark.sql import functions as F
from test_models import QUICK, connections, groups

from pulsetrace.models import store
from pulsetrace.models.specs import SPECS
from pulsetrace.models.training import fit
from pulsetrace.operators import evaluation
from pulsetrace.plans.runs import cells_of_all, evaluate, metrics_of_all


def models(df, prefix):
    names = [n for n in SPECS if n.startswith(prefix) and "perceptron" not in n]
    return {n: fit(SPECS[n].with_params(**QUICK.get(n, {})), df) for n in names}


@pytest.mark.parametrize("prefix, make", [("conn", connections), ("group", groups)])
def test_metrics_together_are_those_of_single_runs(spark, prefix, make):
    df = make(spark)
    found = models(df, prefix)
    column = "orig_bytes" if prefix == "conn" else "int_std"
    tested = df.unionByName(df.limit(7).withColumn(column, F.lit(None).cast(df.schema[column].dataType))) if prefix == "group" else df
    together = {r["model"]: r.asDict() for r in metrics_of_all(found, tested).collect()}
    assert set(together) == set(found)
    for name, model in found.items():
        alone = evaluate(model, tested)
        assert together[name] == pytest.approx({"model": name, **alone.metrics.first().asDict()}, nan_ok=True)
        own = sorted(map(tuple, alone.cells.collect()), key=str)
        mine = cells_of_all({name: model}, tested).drop("model").collect()
        assert sorted(map(tuple, mine), key=str) == own


def test_the_plan_reads_the_rows_once(spark, tmp_path):
    groups(spark).write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    plan = cells_of_all(models(groups(spark), "group"), df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange") <= 2 and "Join" not in plan


def test_a_model_is_loaded_for_the_rows_it_was_fitted_to(spark, tmp_path):
    df = groups(spark)
    spec = SPECS["group_naive_bayes"]
    path = store.save(fit(spec, df), str(tmp_path), df)
    assert store.load(spark, path, df.repartition(5)).spec == spec
    for other in (df.limit(df.count() - 1), df.union(df.limit(1)), df.withColumn("nses", F.col("nses") + 1)):
        with pytest.raises(ValueError, match="fitted to"):
            store.load(spark, path, other)
    assert store.load(spark, path).spec == spec
    bare = store.save(fit(spec, df), str(tmp_path / "bare"))
    with pytest.raises(ValueError, match="does not name"):
        store.load(spark, bare, df)


def test_fingerprints_tell_schemas_apart_and_take_empty_tables(spark):
    spec = SPECS["group_naive_bayes"]
    df = groups(spark)
    one, other = store.fingerprint(spec, df), store.fingerprint(spec, df.withColumn("nses", F.col("nses").cast("long")))
    assert one["schema"] != other["schema"] and one["rows"] == other["rows"]
    assert store.fingerprint(spec, df.limit(0)) == {"rows": 0, "schema": one["schema"], "digest": "0"}


def test_metrics_by_model_need_no_other_column(spark):
    cells = spark.createDataFrame([("a", 0, 0.0, 3), ("a", 1, 0.0, 1), ("b", 1, 1.0, 2)], "model string, label int, prediction double, count long")
    rows = {r["model"]: r for r in evaluation.metrics(cells, ["model"]).collect()}
    assert rows["a"]["accuracy"] == 0.75 and rows["b"]["accuracy"] == 1.0 and rows["b"]["tpr_0"] is None
