"""Registered queries against their SQL over whole tables, and the shape of their plans."""

import pytest

from __spark_entry__ import SMOKE_DIR, entry, oracle_sql, queries
from oracle import compare, duck

# The corpus operators have tests of their own; most have no SQL form.
FITS = [f"{rows}_{family}" for rows in ("conn", "group") for family in ("linear_svm", "perceptron", "random_forest")]
# Reports on fits that SQL cannot make.
FREE = {f"{fit}_{part}" for fit in FITS for part in ("cells", "metrics", "missed", "alarms")}
FREE |= {"conn_models_metrics", "group_models_metrics"}
OWN = [name for name in queries() if name != "pipeline" and not name.startswith("op") and name not in FREE]


@pytest.fixture(scope="module")
def con():
    return duck(SMOKE_DIR)


def test_every_query_has_sql_but_the_reports_on_fits():
    assert set(queries()) >= FREE and not FREE & set(oracle_sql())
    assert set(OWN) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("fit", FITS)
def test_reports_cover_every_test_row(spark, con, fit):
    asked = lambda part: queries()[f"{fit}_{part}"](spark, SMOKE_DIR)
    cells = {(r["label"], r["prediction"]): r["count"] for r in asked("cells").collect()}
    rows = con.execute(oracle_sql()[f"{fit.split('_')[0]}_models_in_one_scan"]).fetchall()
    assert sum(cells.values()) == {model: n for model, n, _ in rows}[fit]
    assert asked("missed").count() == cells.get((1, 0.0), 0) and asked("alarms").count() == cells.get((0, 1.0), 0)
    hits = sum(n for (label, prediction), n in cells.items() if label == prediction)
    assert asked("metrics").first()["accuracy"] == pytest.approx(hits / sum(cells.values()), abs=1e-9)


@pytest.mark.parametrize("name", sorted(OWN))
def test_query_equals_sql(spark, con, name):
    rows, bad, _ = compare(spark, con, name, SMOKE_DIR)
    assert rows > 0 and bad == []


def test_group_kmeans_scores_every_test_row(spark, con):
    cells = queries()["group_kmeans"](spark, SMOKE_DIR).collect()
    want = con.execute(
        f"SELECT count(*) FROM ({oracle_sql()['group_test_dataset']}) WHERE src_p > 15"
    ).fetchall()[0][0]
    assert sum(c["count"] for c in cells) == want


def test_entry(spark):
    row = entry(spark).collect()
    assert len(row) == 1 and 0 <= row[0]["accuracy"] <= 1


def test_no_query_plans_a_cartesian_product(spark):
    for name in ("indicator_label", "indicator_label_salted", "string_index_tables", "metrics_all",
                 "cluster_majority_labels", "conn_test_dataset", "documents_naive_bayes"):
        plan = queries()[name](spark, SMOKE_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_scans_read_only_the_columns_in_use(spark):
    plan = queries()["conn_class_summary"](spark, SMOKE_DIR)._jdf.queryExecution().executedPlan()
    schemas = [x.split(">")[0] for x in plan.toString().split("ReadSchema: struct<")[1:]]
    read = [sorted(c.split(":")[0] for c in x.split(",")) for x in schemas]
    assert ["l_linenumber", "l_quantity", "l_returnflag", "l_suppkey"] in read
    assert all(len(columns) <= 4 for columns in read)
    plan = queries()["documents_naive_bayes"](spark, SMOKE_DIR)._jdf.queryExecution().executedPlan()
    assert "text:string" not in plan.toString()
