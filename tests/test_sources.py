"""Log scans, typed rows, quarantine and dataset files, on literal lines."""

import pytest
from pyspark.sql import functions as F

from pulsetrace.schemas import (
    CONN,
    CONN_DROPPED_COLUMNS,
    CONN_LOG_COLUMNS,
    DOTTED_NAMES,
    GROUP,
    without_label,
)
from pulsetrace.sources import datasets as D
from pulsetrace.sources import typed as T
from pulsetrace.sources.logs import CORRUPT, read_conn_logs, read_group_logs
from pulsetrace.sources.scratch import new_scratch

HEADER = [f"#line {i}" for i in range(8)]
BASE = {
    "ts": "1.5", "uid": "C1", "orig_h": "192.0.2.1", "orig_p": "5000", "resp_h": "198.51.100.7",
    "resp_p": "443", "proto": "tcp", "service": "ssl", "duration": "0.25", "orig_bytes": "100",
    "resp_bytes": "200", "conn_state": "SF", "local_orig": "-", "local_resp": "-",
    "missed_bytes": "0", "history": "ShADadFf", "orig_pkts": "5", "orig_ip_bytes": "300",
    "resp_pkts": "4", "resp_ip_bytes": "360", "tunnel_parents": "-",
}


def line(**changes):
    return "\t".join({**BASE, **changes}[c] for c in CONN_LOG_COLUMNS)


def log_folder(path, **files):
    path.mkdir()
    for name, lines in files.items():
        (path / name.replace("__", ".").replace("_", "-")).write_text("\n".join(lines) + "\n")
    return str(path)


@pytest.fixture
def edge_logs(spark, tmp_path):
    folder = log_folder(
        tmp_path / "logs",
        amazon__log=HEADER + [
            line(uid="whole"),
            line(uid="unset-number", orig_bytes="-"),
            line(uid="unset-category", service="-"),
            line(uid="empty-number", duration=""),
            line(uid="long-number", orig_bytes="99999999999"),
            line(uid="short-line").rsplit("\t", 1)[0],
            line(uid="wide-line") + "\tmore",
            line(uid="fraction", orig_bytes="1.5"),
            "#close",
        ],
        no_footer__log=HEADER + [line(uid="last", duration="NaN")],
    )
    (tmp_path / "logs" / "_b.log").write_text(line(uid="shown") + "\n")
    (tmp_path / "logs" / ".DS_Store").write_text("x\ty\n")
    (tmp_path / "logs" / "old.DS_Store").write_text("x\ty\n")
    (tmp_path / "logs" / "inner").mkdir()
    (tmp_path / "logs" / "inner" / "deep.log").write_text(line(uid="deep") + "\n")
    return read_conn_logs(spark, folder)


def uids(df):
    return sorted(r["uid"] for r in df.select("uid").collect())


def test_scan_drops_comment_lines_and_keeps_every_other_line(edge_logs):
    assert uids(edge_logs) == sorted([
        "whole", "unset-number", "unset-category", "empty-number", "long-number", "short-line",
        "wide-line", "fraction", "last", "shown",
    ])


def test_scan_names_the_file_and_the_lines_of_wrong_width(edge_logs):
    rows = {r["uid"]: r for r in edge_logs.select("uid", CORRUPT, "source_file").collect()}
    assert rows["whole"][CORRUPT] is None and rows["whole"]["source_file"] == "amazon.log"
    assert rows["last"]["source_file"] == "no-footer.log"
    assert rows["short-line"][CORRUPT] is None and rows["wide-line"][CORRUPT]
    assert rows["shown"]["source_file"] == "_b.log"
    assert edge_logs.where(F.col(CORRUPT).isNotNull()).count() == 1


SCHEMA = without_label(CONN)


def kept(df, required):
    """uids of accepted rows, carried in the proto field."""
    marked = df.withColumn("proto", F.col("uid"))
    return [r["proto"] for r in T.accept_rows(marked, SCHEMA, required).collect()]


def test_required_columns_decide_which_rows_survive(edge_logs):
    everything = {
        "whole", "unset-category", "empty-number", "long-number", "last", "short-line", "shown",
    }
    assert set(kept(edge_logs, SCHEMA.names)) == everything
    assert set(kept(edge_logs, ["proto", "service"])) == everything | {"unset-number", "fraction"}


def test_row_count_does_not_depend_on_the_columns_read(edge_logs):
    good = T.accept_rows(edge_logs, SCHEMA)
    assert good.count() == 7
    for column in ("service", "orig_bytes", "resp_h"):
        assert len(good.select(column).collect()) == 7
    assert good.groupBy("proto").count().collect()[0]["count"] == 7


def test_typed_values(edge_logs):
    good = T.accept_rows(edge_logs, SCHEMA, ["proto"])
    assert good.schema == SCHEMA
    by_bytes = {r["orig_bytes"] for r in good.collect()}
    assert 99999999999 in by_bytes and None in by_bytes
    assert good.where("service = '-'").count() == 1
    assert good.where("duration is null").count() == 2  # empty and the NaN text


def test_accept_and_reject_share_all_rows(edge_logs):
    for required in (SCHEMA.names, ["proto"], ["orig_bytes"]):
        good = T.accept_rows(edge_logs, SCHEMA, required).count()
        assert good + T.reject_rows(edge_logs, SCHEMA, required).count() == edge_logs.count()
    reasons = T.reject_rows(edge_logs, SCHEMA, ["orig_bytes"]).select(T.REASON).collect()
    assert sorted(r[0] for r in reasons) == [CORRUPT, "orig_bytes", "orig_bytes"]


def test_parse_once_then_choose_each_models_rows(spark, edge_logs):
    path = new_scratch(spark, "landed")
    D.write_labelled(T.parse_typed(edge_logs, SCHEMA), path)
    landed = D.read_labelled(spark, path, T.landed_schema(SCHEMA))
    assert landed.count() == 10
    for required in (SCHEMA.names, ["proto"], ["orig_bytes", "resp_bytes"]):
        want = T.accept_rows(edge_logs, SCHEMA, required)
        assert T.population(landed, required).exceptAll(want).count() == 0
        assert T.population(landed, required).count() == want.count()
    bad = T.quarantine(landed, ["orig_bytes"]).select(T.BAD_VALUES).collect()
    texts = sorted(r[0].get("orig_bytes", "") for r in bad)
    assert texts == ["", "-", "1.5"]


def test_a_short_line_loses_only_what_it_lacks(spark, tmp_path):
    fields = line().split("\t")
    folder = log_folder(tmp_path / "short", a__log=["\t".join(fields[:n]) for n in (21, 20, 17, 3)])
    logs = read_conn_logs(spark, folder)
    assert logs.where(F.col(CORRUPT).isNotNull()).isEmpty()
    rows = T.accept_rows(logs, SCHEMA, ["proto", "service"]).collect()
    assert len(rows) == 4
    assert [sum(v is None for v in r) for r in sorted(rows, key=lambda r: -sum(v is None for v in r))] == [14, 3, 0, 0]


def test_group_scan(spark, tmp_path):
    folder = tmp_path / "groups"
    folder.mkdir()
    (folder / "cicids17.csv").write_text(
        "192.0.2.1,1,198.51.100.7,443,6,1.5,2,0.5,0.25,0.75,nan,1.0,\n"
        "192.0.2.1,1,198.51.100.7,443,six,1.5,2,0.5,0.25,0.75,0.1,1.0,0.2\n"
    )
    logs = read_group_logs(spark, str(folder))
    row = T.accept_rows(logs, without_label(GROUP)).collect()
    assert len(row) == 1 and row[0]["dur_std"] is None and row[0]["int_std"] is None
    assert row[0]["proto"] == 6 and row[0]["dur"] == 1.5


def labelled(edge_logs):
    return edge_logs.drop(*CONN_DROPPED_COLUMNS, CORRUPT, "source_file").withColumn(
        "label", F.lit("0")
    ).select(*CONN.names)


def test_csv_round_trip_keeps_the_logs_own_names(spark, edge_logs, tmp_path):
    path = str(tmp_path / "csv")
    D.write_labelled(labelled(edge_logs), path, "csv", DOTTED_NAMES)
    header = next((tmp_path / "csv").glob("part-*")).read_text().splitlines()[0]
    assert header.startswith("id.orig_h,id.orig_p,id.resp_h,id.resp_p,proto")
    back = D.read_labelled_csv(spark, path, CONN)
    assert back.drop(CORRUPT, "source_file").exceptAll(labelled(edge_logs)).count() == 0


def test_csv_with_other_columns_fails_full_or_pruned(spark, edge_logs, tmp_path):
    path = tmp_path / "indexed.csv"
    names = [DOTTED_NAMES.get(c, c) for c in CONN.names]
    rows = [[str(v) for v in r] for r in labelled(edge_logs).limit(2).collect()]
    lines = [",".join(["", *names])] + [",".join([str(i), *r]) for i, r in enumerate(rows)]
    path.write_text("\n".join(lines) + "\n")
    for columns in (CONN.names, ["label"]):
        with pytest.raises(Exception, match="(?i)header|length"):
            D.read_labelled_csv(spark, str(path), CONN).select(*columns).collect()
    numbered = D.read_labelled_csv(spark, str(path), CONN, row_number_column=True)
    assert [r["label"] for r in numbered.collect()] == ["0", "0"]
    assert {r["resp_h"] for r in numbered.collect()} == {"198.51.100.7"}


def test_scratch_is_below_the_checkpoint_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        assert new_scratch(spark, "x").startswith(root.rstrip("/"))
    assert new_scratch(spark, "x") != new_scratch(spark, "x")
