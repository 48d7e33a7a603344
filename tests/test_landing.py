"""Captures landed in runs, and hidden captures copied by tasks."""

import os

import pytest
from pyspark.sql import functions as F
from test_sources import line, log_folder, uids

from pulsetrace.sources import logs as L
from pulsetrace.sources.landing import current, land, manifest, read_landed


@pytest.fixture
def folder(tmp_path):
    path = log_folder(tmp_path / "logs", a__log=["#open", line(uid="a1"), line(uid="a2")], b__log=[line(uid="b1")])
    (tmp_path / "logs" / "_c.log").write_text(line(uid="c1") + "\n")
    (tmp_path / "logs" / ".d.log").write_text(line(uid="d1") + "\n")
    (tmp_path / "logs" / "x.DS_Store").write_text("junk\n")
    (tmp_path / "logs" / "inner").mkdir()
    return path


def test_a_rerun_reads_new_captures_only(spark, folder, tmp_path):
    target = str(tmp_path / "landed")
    assert uids(read_landed(spark, target)) == []
    assert land(spark, folder, target) == [".d.log", "_c.log", "a.log", "b.log"]
    assert land(spark, folder, target) == []
    (tmp_path / "logs" / "e.log").write_text(line(uid="e1") + "\n")
    assert land(spark, folder, target) == ["e.log"]
    assert uids(read_landed(spark, target)) == ["a1", "a2", "b1", "c1", "d1", "e1"]
    whole = L.read_conn_logs(spark, folder)
    assert read_landed(spark, target).exceptAll(whole).isEmpty() and whole.exceptAll(read_landed(spark, target)).isEmpty()
    noted = {r["name"]: r for r in current(spark, target).collect()}
    assert {n: r["lines"] for n, r in noted.items()} == {".d.log": 1, "_c.log": 1, "a.log": 2, "b.log": 1, "e.log": 1}
    assert noted["a.log"]["size"] == os.path.getsize(tmp_path / "logs" / "a.log")


def test_a_changed_capture_replaces_its_lines(spark, folder, tmp_path):
    target = str(tmp_path / "landed")
    land(spark, folder, target)
    before = {r["name"]: r["digest"] for r in current(spark, target).collect()}
    (tmp_path / "logs" / "a.log").write_text(line(uid="a3") + "\n")
    (tmp_path / "logs" / "b.log").unlink()
    assert land(spark, folder, target) == ["a.log"]
    assert uids(read_landed(spark, target)) == ["a3", "b1", "c1", "d1"]
    after = {r["name"]: r["digest"] for r in current(spark, target).collect()}
    assert {n for n in after if after[n] != before[n]} == {"a.log"}
    assert manifest(spark, target).count() == 5


def test_a_run_that_broke_off_is_not_seen(spark, folder, tmp_path):
    target = str(tmp_path / "landed")
    land(spark, folder, target)
    (tmp_path / "logs" / "e.log").write_text(line(uid="e1") + "\n")
    # Lines without a manifest, then a manifest that was not written to its end.
    read_landed(spark, target).write.parquet(f"{target}/lines/00000002-lost")
    broken = manifest(spark, target).withColumn("run", F.lit("00000002-lost"))
    broken.write.parquet(f"{target}/manifest/00000002-lost")
    os.remove(f"{target}/manifest/00000002-lost/_SUCCESS")
    assert uids(read_landed(spark, target)) == ["a1", "a2", "b1", "c1", "d1"]
    assert land(spark, folder, target) == ["e.log"]
    assert uids(read_landed(spark, target)) == ["a1", "a2", "b1", "c1", "d1", "e1"]


def test_empty_folders_and_equal_names(spark, tmp_path, folder):
    (tmp_path / "none").mkdir()
    assert land(spark, str(tmp_path / "none"), str(tmp_path / "landed")) == []
    other = log_folder(tmp_path / "other", a__log=[line(uid="z")])
    with pytest.raises(ValueError, match="differ"):
        land(spark, [folder, other], str(tmp_path / "landed"))


def test_group_captures(spark, tmp_path):
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "one.csv").write_text(",".join(["1"] * len(L.GROUP_LOG_COLUMNS)) + "\n")
    target = str(tmp_path / "landed")
    assert land(spark, str(tmp_path / "g"), target, "group") == ["one.csv"]
    assert read_landed(spark, target, "group").count() == 1


def test_hidden_captures_keep_their_names_and_all_their_bytes(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    many = "\n".join(line(uid=f"u{i}") for i in range(30_000)) + "\n"  # more than one block
    for name in ("_big.log", ".dot.log"):
        (tmp_path / "logs" / name).write_text(many)
    found = L.read_conn_logs(spark, str(tmp_path / "logs")).groupBy("source_file").count().collect()
    assert {r["source_file"]: r["count"] for r in found} == {"_big.log": 30_000, ".dot.log": 30_000}


def test_hidden_captures_are_copied_by_hadoop_where_python_knows_no_file_system(spark, tmp_path, monkeypatch):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "_c.log").write_text(line(uid="c1") + "\n")
    monkeypatch.setattr(L, "_known_place", lambda path: False)
    assert uids(L.read_conn_logs(spark, str(tmp_path / "logs"))) == ["c1"]


@pytest.mark.parametrize("name, hidden", [("_x", True), ("_x=1", False), (".x", True), ("x_", False), ("_=.x", False)])
def test_names_that_spark_skips(name, hidden):
    assert L.skipped(name) is hidden
