"""Labels, service filter, unions, null rows, class counts, lookups."""

from pyspark.sql import functions as F

from pulsetrace.fixed_values import (
    CONN_BENIGN_CAPTURES,
    CONN_INDICATORS,
    GROUP_INDICATORS,
)
from pulsetrace.functions.columns import capture_stem
from pulsetrace.operators import labeling as L
from pulsetrace.operators import rows as R
from pulsetrace.operators.lookup import broadcast_size, lookup

HIT, MISS = "203.0.113.9", "198.51.100.1"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_indicator_lists():
    assert len(CONN_INDICATORS) == len(set(CONN_INDICATORS)) == 33
    assert len(GROUP_INDICATORS) == 29 and set(GROUP_INDICATORS) < set(CONN_INDICATORS)


def flows(spark):
    return spark.createDataFrame(
        [("a", HIT), ("b", MISS), (HIT, MISS), ("d", None), ("a", HIT)],
        "orig_h string, resp_h string",
    )


def test_only_the_destination_counts(spark):
    want = sorted([("a", 1), ("b", 0), (HIT, 0), ("d", 0), ("a", 1)])
    listed = spark.createDataFrame([(HIT,), (HIT,), ("203.0.113.10",), (None,)], "ip string")
    for labelled in (
        L.label_by_indicator(flows(spark), [HIT], "resp_h"),
        L.label_by_indicator(flows(spark), listed, "resp_h"),
        L.label_by_indicator(flows(spark), listed, "resp_h", broadcast_bytes=-1),
    ):
        assert labelled.columns == ["orig_h", "resp_h", "label"]
        assert sorted((r.orig_h, r.label) for r in labelled.collect()) == want
    for limit in (10**6, -1):
        hits = L.indicator_hits(flows(spark), listed, "resp_h", limit)
        assert hits.columns == ["orig_h", "resp_h"] and hits.count() == 2


def test_literal_list_needs_no_join(spark):
    text = plan(L.label_by_indicator(flows(spark), CONN_INDICATORS, "resp_h"))
    assert "Join" not in text and "Exchange" not in text


def test_address_list_is_broadcast_only_below_its_limit(spark):
    facts = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    dim = spark.range(100).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v"))
    assert 100 * 60 < broadcast_size(dim) < 100 * 80
    assert "BroadcastHashJoin" in plan(lookup(facts, dim, "k"))
    assert "BroadcastHashJoin" not in plan(lookup(facts, dim, "k", size=10**12))
    merged = lookup(facts, dim, "k", broadcast_bytes=100)
    assert "SortMergeJoin" in plan(merged) and "BroadcastHashJoin" not in plan(merged)
    assert merged.where("v = 1").count() == 100 and merged.count() == 1000
    assert merged.exceptAll(lookup(facts, dim, "k")).isEmpty()


def test_the_size_of_a_list_counts_all_its_columns(spark):
    wide = spark.range(10).select(F.col("id").cast("string").alias("k"), F.repeat(F.lit("x"), 10_000).alias("v"))
    assert broadcast_size(wide) > 100_000
    assert broadcast_size(wide.where("k = 'none'")) == 0


def test_a_hot_key_is_dealt_to_more_tasks_the_more_rows_it_has(spark):
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m",
    }
    before = {k: spark.conf.get(k) for k in settings}
    dim = spark.range(1000).select(F.col("id").cast("string").alias("k"), F.lit(7).alias("v"))
    tasks = []
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for hot in (50_000, 400_000):
            facts = spark.range(0, hot + 5_000, 1, 16).select(
                F.when(F.col("id") < hot, "5").otherwise((F.col("id") % 1000).cast("string")).alias("k"),
                F.sha2(F.col("id").cast("string"), 256).alias("other"),
            )
            joined = lookup(facts, dim, "k", broadcast_bytes=-1)
            rows = joined.select("k", "v", "other", F.spark_partition_id().alias("task")).collect()
            assert len(rows) == hot + 5_000 and {r["v"] for r in rows} == {7}
            tasks.append(len({r["task"] for r in rows if r["k"] == "5"}))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert 1 < tasks[0] < tasks[1]


def test_a_large_list_that_meets_few_addresses_is_cut_and_broadcast(spark):
    listed = spark.range(2000).select(F.concat(F.lit("x"), "id").alias("ip")).union(
        spark.createDataFrame([(HIT,)], "ip string")
    )
    labelled = L.label_by_indicator(flows(spark), listed, "resp_h", broadcast_bytes=1000)
    assert "BroadcastHashJoin" in plan(labelled) and labelled.where("label = 1").count() == 2
    many = spark.range(2000).select(F.concat(F.lit("x"), "id").alias("resp_h"))
    labelled = L.label_by_indicator(many, listed, "resp_h", broadcast_bytes=1000)
    assert "SortMergeJoin" in plan(labelled) and labelled.where("label = 1").count() == 2000


def test_origin_label_uses_the_name_up_to_the_first_dot(spark):
    files = ["cicids17-normal.log", "ctu-normal-20.binetflow.labeled.log", "amazon.log",
             "train/cicids17-normal.log", "cicids17-normal-2.log"]
    df = spark.createDataFrame([(f,) for f in files], "source_file string")
    labelled = L.label_by_origin(df, CONN_BENIGN_CAPTURES)
    assert [r.label for r in labelled.collect()] == [0, 0, 1, 0, 1]
    stems = [r[0] for r in df.select(capture_stem("source_file")).collect()]
    assert stems[1] == "ctu-normal-20" and stems[3] == "cicids17-normal"


def test_service_filter_spares_benign_rows(spark):
    df = spark.createDataFrame(
        [(0, "-"), (0, None), (1, "ssl"), (1, "http"), (1, "dns"), (1, None)],
        "label int, service string",
    )
    kept = L.keep_services(df, ["http", "ssl"])
    assert sorted((r.label, r.service or "") for r in kept.collect()) == [
        (0, ""), (0, "-"), (1, "http"), (1, "ssl"),
    ]


def test_union_matches_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    b = spark.createDataFrame([("y", 2)], "s string, n int")
    assert sorted(tuple(r) for r in L.union_classes(a, b, b).collect()) == [
        (1, "x"), (2, "y"), (2, "y"),
    ]


def test_null_rows_and_class_counts(spark):
    df = spark.createDataFrame(
        [(0, "ssl", 1.0), (0, "-", None), (1, "ssl", float("nan")), (1, None, 2.0)],
        "label int, service string, x double",
    )
    assert R.drop_null_rows(df).count() == 1 + 0
    assert R.drop_null_rows(df, ["x"]).count() == 2
    assert R.of_class(df, 1).count() == 2 and R.of_class(df, 1, "ssl").count() == 1
    counts = {r["label"]: (r["rows"], r["ssl_rows"]) for r in R.class_summary(df).collect()}
    assert counts == {0: (2, 1), 1: (2, 1)}
    assert R.preview(df, 2).count() == 2
