"""Whole jobs on small folders: build, fit, evaluate, in both file formats."""

import pytest

from pulsetrace import jobs
from pulsetrace.fixed_values import CONN_INDICATORS, GROUP_INDICATORS
from pulsetrace.models import store
from pulsetrace.operators import evaluation
from pulsetrace.plans import datasets
from pulsetrace.schemas import CONN, GROUP
from pulsetrace.sources.logs import read_conn_logs
from pulsetrace.sources.typed import accept_rows
from test_sources import HEADER, line, log_folder

BEACON = {"service": "ssl", "history": "ShADad", "orig_bytes": "900", "orig_pkts": "90"}
WEB = {"service": "http", "history": "DdA", "orig_bytes": "10", "orig_pkts": "2"}


@pytest.fixture(scope="module")
def conn_folders(tmp_path_factory):
    root = tmp_path_factory.mktemp("conn")
    train = log_folder(
        root / "train",
        cicids17_normal__log=HEADER + [line(**WEB) for _ in range(30)] + [line(**WEB, duration="-"), "#close"],
        amazon__log=HEADER + [line(**BEACON) for _ in range(20)]
        + [line(**{**BEACON, "service": "dns"}), line(**{**BEACON, "orig_bytes": "-"}), "#close"],
    )
    test = log_folder(
        root / "test",
        mixed__log=HEADER
        + [line(**BEACON, resp_h=CONN_INDICATORS[0]) for _ in range(4)]
        + [line(**WEB, resp_h=CONN_INDICATORS[-1])]
        + [line(**WEB) for _ in range(6)]
        + [line(**BEACON, orig_h=CONN_INDICATORS[1])]
        + ["#close"],
    )
    return train, test, str(root / "out")


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_conn_jobs(spark, conn_folders, fmt):
    train, test, out = conn_folders
    out = f"{out}-{fmt}"
    summary = jobs.build(spark, "conn", train, test, out, fmt)
    counts = {(r["split"], int(r["label"])): (r["rows"], r["ssl_rows"]) for r in summary.collect()}
    assert counts == {
        ("train", 0): (31, 0), ("train", 1): (21, 21), ("test", 0): (7, 1), ("test", 1): (5, 4),
    }
    saved = jobs.fit_job(spark, "conn_naive_bayes", f"{out}/train", f"{out}/models", fmt=fmt)
    report = jobs.evaluate_job(spark, saved, f"{out}/test", f"{out}/report", fmt=fmt)
    cells = {(r["label"], r["prediction"]): r["count"] for r in report.cells.collect()}
    assert cells == {(1, 1.0): 4, (1, 0.0): 1, (0, 0.0): 6, (0, 1.0): 1}
    assert spark.read.parquet(f"{out}/report/missed").count() == 1
    assert spark.read.parquet(f"{out}/report/alarms").count() == 1
    metrics = spark.read.parquet(f"{out}/report/metrics").first()
    assert metrics["accuracy"] == pytest.approx(10 / 12) and metrics["tpr_1"] == pytest.approx(0.8)
    assert spark.read.parquet(f"{out}/report/confusion").count() == 4


def test_evaluation_reads_the_scored_rows_once_for_all_counts(spark, conn_folders, monkeypatch):
    train, test, out = conn_folders
    out = f"{out}-scans"
    jobs.build(spark, "conn", train, test, out)
    saved = jobs.fit_job(spark, "conn_naive_bayes", f"{out}/train", f"{out}/models")
    counted = []
    count = evaluation.confusion
    monkeypatch.setattr(evaluation, "confusion", lambda df: counted.append(df) or count(df))
    report = jobs.evaluate_job(spark, saved, f"{out}/test", f"{out}/report")
    for result in (report.cells, report.named_cells, report.metrics):
        assert "/report/scored" not in result._jdf.queryExecution().executedPlan().toString()
    assert len(counted) == 1
    assert spark.read.parquet(f"{out}/report/cells").count() == report.cells.count() == 4


def test_fit_parameters_reach_the_estimator(spark, conn_folders):
    train, test, out = conn_folders
    out = f"{out}-params"
    jobs.build(spark, "conn", train, test, out)
    jobs.main(["fit", "conn_random_forest", "--data", f"{out}/train", "--models", f"{out}/models",
               "--param", "numTrees=2", "--param", "maxDepth=3", "--max-driver-labels", "1",
               "--rows-per-task", "10"])
    model = store.load(spark, f"{out}/models/conn_random_forest")
    assert model.estimator.getNumTrees == 2 and model.spec.params["maxDepth"] == 3
    with pytest.raises(ValueError, match="max_bins"):
        jobs.fit_job(spark, "conn_random_forest", f"{out}/train", f"{out}/models", max_bins=1)


def test_each_model_drops_only_its_own_unusable_rows(spark, conn_folders):
    train, test, out = conn_folders
    jobs.build(spark, "conn", train, test, f"{out}-rows")
    for required, rows in ((["proto"], 52), (["orig_bytes"], 51), (["duration", "orig_bytes"], 50)):
        assert jobs.load_labelled(spark, f"{out}-rows/train", CONN, required).count() == rows


def test_conn_kmeans_job_with_alignment(spark, conn_folders):
    train, test, out = conn_folders
    jobs.build(spark, "conn", train, test, f"{out}-km")
    saved = jobs.fit_job(spark, "conn_kmeans", f"{out}-km/train", f"{out}-km/models", seeds=[1, 2])
    report = jobs.evaluate_job(
        spark, saved, f"{out}-km/test", f"{out}-km/report", align_with=f"{out}-km/train"
    )
    assert report.metrics.first()["accuracy"] == pytest.approx(10 / 12)


def test_group_jobs(spark, tmp_path):
    def row(dst, scale, tail=""):
        return f"192.0.2.1,1,{dst},443,6," + ",".join(str(scale + i) for i in range(7)) + f",{tail or scale}"

    folders = {}
    for split, files in {
        "train": {"cicids17.csv": [row("198.51.100.1", 1)] * 20 + [row("198.51.100.1", 1, "nan")],
                  "beacons.set1.csv": [row("198.51.100.2", 500)] * 12},
        "test": {"mixed.csv": [row(GROUP_INDICATORS[0], 500)] * 3 + [row("198.51.100.9", 1)] * 5
                 + [row("198.51.100.9", 1, "x")]},
    }.items():
        folder = tmp_path / split
        folder.mkdir()
        for name, lines in files.items():
            (folder / name).write_text("\n".join(lines) + "\n")
        folders[split] = str(folder)
    out = str(tmp_path / "out")
    summary = jobs.build(spark, "group", folders["train"], folders["test"], out)
    counts = {(r["split"], r["label"]): r["rows"] for r in summary.collect()}
    assert counts == {("train", 0): 21, ("train", 1): 12, ("test", 0): 6, ("test", 1): 3}
    saved = jobs.fit_job(spark, "group_random_forest", f"{out}/train", f"{out}/models")
    report = jobs.evaluate_job(spark, saved, f"{out}/test", f"{out}/report")
    cells = {(r["label"], r["prediction"]): r["count"] for r in report.cells.collect()}
    assert cells == {(0, 0.0): 5, (1, 1.0): 3}  # the row with a malformed number is left out
    assert set(GROUP.names) <= set(report.scored.columns)


def test_dataset_plans_need_no_shuffle(spark, conn_folders):
    logs = read_conn_logs(spark, conn_folders[0])
    for labelled in (datasets.conn_train(logs), datasets.conn_test(logs)):
        text = accept_rows(labelled, CONN, ["proto", "service", "history"])._jdf
        assert "Exchange" not in text.queryExecution().executedPlan().toString()


def test_command_line(spark, conn_folders, capsys):
    train, test, out = conn_folders
    out = f"{out}-cli"
    jobs.main(["build", "conn", "--train", train, "--test", test, "--out", out])
    jobs.main(["fit", "conn_naive_bayes", "--data", f"{out}/train", "--models", f"{out}/models"])
    jobs.main(["evaluate", "--model", f"{out}/models/conn_naive_bayes", "--data", f"{out}/test",
               "--out", f"{out}/report"])
    assert "accuracy" in capsys.readouterr().out
