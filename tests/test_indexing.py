"""Category indexes against MLlib's own StringIndexer, and the distributed route."""

import math
import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from pulsetrace.models.specs import SPECS
from pulsetrace.models.training import fit
from pulsetrace.operators import indexing as I
from pulsetrace.operators.indexing import category_counts, fit_bounded_index, fit_index
from pulsetrace.sources.scratch import new_scratch


def frame(spark, seed=0, rows=4000):
    rng = random.Random(seed)
    data = [
        (rng.choice("ab"), rng.choice(["http", "ssl", "-", None, "dns"]),
         f"h{int(rng.paretovariate(0.7)) % 500}")
        for _ in range(rows)
    ]
    return spark.createDataFrame(data, "proto string, service string, history string")


COLUMNS = ("proto", "service", "history")


def index_columns(df):
    return df.select(*COLUMNS, *map(I.index_name, COLUMNS))


@pytest.mark.parametrize("limit", [I.MAX_DRIVER_LABELS, 4, 0])
def test_same_indexes_as_mllib_by_both_routes(spark, limit):
    train, other = frame(spark), frame(spark, 1)
    other = other.union(spark.createDataFrame([("new", None, "h-new")], other.schema))
    names = [I.index_name(c) for c in COLUMNS]
    want = StringIndexer(
        inputCols=list(COLUMNS), outputCols=names, handleInvalid="keep"
    ).fit(train).transform(other)
    index = I.fit_index(train, COLUMNS, max_driver_labels=limit)
    got = index_columns(index.transform(other))
    assert set(index.tables) == {c for c in COLUMNS if {"proto": 2, "service": 4}.get(c, 99) > limit}
    assert got.exceptAll(index_columns(want)).count() == 0
    assert got.count() == other.count()


def test_labels_are_not_padded_to_one_length(spark):
    index = I.fit_index(frame(spark), COLUMNS)
    assert [len(m.labels) for m in index.models][:2] == [2, 4]
    assert all(None not in m.labels for m in index.models)


def test_unseen_and_null_get_the_number_of_categories(spark):
    train = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    test = spark.createDataFrame([("b",), ("zzz",), (None,)], "c string")
    for limit in (100, 0):
        out = I.fit_index(train, ["c"], max_driver_labels=limit).transform(test)
        assert sorted(r["c_index"] for r in out.collect()) == [1.0, 2.0, 2.0]


@pytest.mark.parametrize("limit", [None, 100, 0])
def test_invalid_values_by_both_routes(spark, limit):
    train = spark.createDataFrame([("a",), ("a",), ("b",)], "c string")
    test = spark.createDataFrame([("b",), ("zzz",), (None,), ("a",)], "c string")
    fitted = lambda how: I.fit_index(train, ["c"], limit, how).transform(test)
    assert sorted(r["c_index"] for r in fitted("keep").collect()) == [0.0, 1.0, 2.0, 2.0]
    assert sorted(r["c_index"] for r in fitted("skip").collect()) == [0.0, 1.0]
    with pytest.raises(Exception, match="(?i)unseen|null"):
        fitted("error").collect()


def test_tables_are_applied_without_a_job(spark):
    df = frame(spark)
    index = I.fit_index(df, COLUMNS, max_driver_labels=0)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("apply", "apply")
    try:
        index.transform(df)
        assert not tracker.getJobIdsForGroup("apply")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_column_of_nulls_has_no_categories(spark):
    df = spark.createDataFrame([("a", None), ("b", None)], "c string, d string")
    for limit in (100, 0):
        out = I.fit_index(df, ["c", "d"], max_driver_labels=limit).transform(df)
        assert {r["d_index"] for r in out.collect()} == {0.0}


def test_metadata_marks_the_index_as_nominal(spark):
    out = I.fit_index(frame(spark), ["service"]).transform(frame(spark))
    attribute = out.schema["service_index"].metadata["ml_attr"]
    assert attribute["type"] == "nominal" and attribute["vals"][-1] == "__unknown"


def test_rank_over_many_sorted_partitions(spark):
    values = spark.range(0, 5000, 1, 7).select(
        F.format_string("v%05d", F.col("id")).alias("value"),
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 4 + 1).alias("count"),
    )
    other = values.where("value < 'v02000'")
    both = values.withColumn("column", F.lit("b")).unionByName(other.withColumn("column", F.lit("a")))
    ranked = I.rank_values(both, new_scratch(spark, "rank")).collect()
    for column, n in (("a", 2000), ("b", 5000)):
        order = sorted((r for r in ranked if r["column"] == column), key=lambda r: (-r["count"], r["value"]))
        assert [r["index"] for r in order] == [float(i) for i in range(n)]


def test_category_counts_and_pairs(spark):
    df = frame(spark)
    rows = df.collect()
    got = {(r["column"], r["value"]): r["count"] for r in I.category_counts(df, COLUMNS).collect()}
    want = Counter((c, r[c]) for r in rows for c in COLUMNS if r[c] is not None)
    assert got == want
    pairs = I.index_pairs(I.fit_index(df, ["proto"]).transform(df), "proto")
    assert pairs.count() == 2


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from(["", " ", "a", "A", "é", "ß", "Z-", "\t", "日本"]), min_size=1, max_size=30))
def test_any_text_ranks_by_count_then_value(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    counts = Counter(values)
    order = sorted(counts, key=lambda v: (-counts[v], v))
    for limit in (100, 0):
        out = I.fit_index(df, ["c"], max_driver_labels=limit).transform(df).distinct().collect()
        assert {r["c"]: int(r["c_index"]) for r in out} == {v: i for i, v in enumerate(order)}


def skewed(spark, n=20_000):
    """Values with falling frequencies and a long tail of rare ones; a few nulls."""
    i = F.col("id")
    value = (
        F.when(i % 1000 == 999, F.lit(None)).when(i % 2 == 0, F.concat(F.lit("top"), (i % 20).cast("string")))
        .when(i % 5 == 1, F.concat(F.lit("mid"), (i % 150).cast("string"))).otherwise(F.concat(F.lit("rare"), i.cast("string")))
    )
    return spark.range(n).select(value.alias("a"), (i % 3).cast("string").alias("b")).repartition(7)


def test_bounded_index_is_the_exact_one_above_the_cut(spark):
    df = skewed(spark)
    exact = {m.getInputCol(): list(m.labels) for m in fit_index(df, ["a", "b"], None).models}
    counts = {(r["column"], r["value"]): r["count"] for r in category_counts(df, ["a", "b"]).collect()}
    for tracked in (256, 2048):
        index, cuts = fit_bounded_index(df, ["a", "b"], tracked)
        for model in index.models:
            column = model.getInputCol()
            rows = df.where(F.col(column).isNotNull()).count()
            assert cuts[column].rows == math.ceil(rows * 3.5 / tracked)
            want = [v for v in exact[column] if counts[column, v] >= cuts[column].rows]
            assert list(model.labels) == want and cuts[column].kept == len(want) > 0
        got = index.transform(df)
        rare = got.where("a LIKE 'rare%' OR a IS NULL").select("a_index").distinct().collect()
        assert [r[0] for r in rare] == [float(cuts["a"].kept)]


def test_bounded_index_of_odd_tables(spark):
    empty = skewed(spark).limit(0)
    index, cuts = fit_bounded_index(empty, ["a"], 256)
    assert cuts["a"].kept == 0 and index.transform(empty).count() == 0
    nulls = spark.range(5).select(F.lit(None).cast("string").alias("a"))
    assert fit_bounded_index(nulls, ["a"], 256)[1]["a"].kept == 0
    with pytest.raises(ValueError, match="power of two"):
        fit_bounded_index(nulls, ["a"], 1000)


def test_a_forest_fits_on_a_bounded_index(spark):
    i = F.col("id")
    df = spark.range(4000).select(
        F.lit("tcp").alias("proto"), F.lit("ssl").alias("service"),
        F.when(i % 2 == 0, F.concat(F.lit("h"), (i % 10).cast("string"))).otherwise(F.concat(F.lit("x"), i.cast("string"))).alias("history"),
        *[i.cast("long").alias(c) for c in ("orig_bytes", "resp_bytes", "orig_pkts", "orig_ip_bytes", "resp_pkts")],
        (i % 2).cast("int").alias("label"),
    )
    spec = SPECS["conn_random_forest"].with_params(numTrees=2, maxBins=32)
    model = fit(spec, df, tracked=256)
    assert model.estimator.getOrDefault("maxBins") == 32  # 2,005 values, six bins
    scored = model.score(df)
    assert scored.where("prediction <> label").count() == 0
