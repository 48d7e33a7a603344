"""Vector near-duplicates against all pairs."""

import numpy as np
from pulsetrace.llm import vectors as V
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.95):
    unit = []
    for _, v in rows:
        x = None if not v or None in v else np.array(v, np.float32).astype(float)
        ok = x is not None and np.isfinite(x).all() and x.any()
        unit.append(x / np.linalg.norm(x) if ok else None)
    links = {i: set() for i in range(len(rows))}
    for i, a in enumerate(unit):
        for j, b in enumerate(unit[:i]):
            if a is not None and b is not None and len(a) == len(b) and a @ b >= cosine:
                links[i].add(j)
                links[j].add(i)
    out, done = {}, set()
    for i in links:
        if i in done:
            continue
        group, todo = set(), [i]
        while todo:
            k = todo.pop()
            if k not in group:
                group.add(k)
                todo += links[k]
        done |= group
        low = min(rows[k][0] for k in group)
        out |= {rows[k][0]: (len(links[k]), low, rows[k][0] == low) for k in group}
    return out


def sample(n=600, d=16, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(60, d))
    x = base[rng.integers(0, 60, n)] + rng.normal(scale=0.12, size=(n, d)) * rng.integers(0, 2, (n, 1))
    return [(int(i), [float(f) for f in v]) for i, v in enumerate(x)]


ODD = [
    (9001, None), (9002, []), (9003, [0.0] * 16), (9004, [1.0] * 15 + [None]), (9005, [float("nan")] + [1.0] * 15),
    (9006, [float("inf")] * 16), (9007, [1.0, 2.0]), (9008, [2.0, 4.0]), (9009, [1e-30] * 16), (9010, [1e30] * 16),
    (9011, [0.0] * 16),
]


def test_links_and_components(spark):
    rows = sample() + ODD
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumn("cid", F.lit("clash")).repartition(5)
    want = brute(rows)
    for cell, lists in ((128, 128), (16, 600)):
        got = {r[0]: tuple(r)[1:] for r in V.near_duplicates(df, cell=cell, rows_per_list=lists).collect()}
        assert set(got) == set(want)
        assert all(got[i][0] <= want[i][0] for i in want)  # no link that is not one
        assert sum(r[0] for r in got.values()) >= 0.9 * sum(r[0] for r in want.values())
        for i in range(9001, 9012):
            assert got[i] == want[i]
    assert got[9008] == (1, 9007, False)


def test_all_lists_within_the_radius_lose_no_link(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(300, 12))
    away = rng.normal(size=(900, 12)) * rng.uniform(0, 0.35, (900, 1))  # many pairs near the threshold
    x = base[rng.integers(0, 300, 900)] + away
    rows = [(int(i), [float(np.float32(f)) for f in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    want = brute(rows)
    got = {r[0]: tuple(r)[1:] for r in V.near_duplicates(df, probes=None, rows_per_list=8).collect()}
    assert got == want and sum(r[0] for r in want.values()) > 500
    few = {r[0]: tuple(r)[1:] for r in V.near_duplicates(df, probes=2, rows_per_list=8).collect()}
    assert sum(r[0] for r in few.values()) < sum(r[0] for r in want.values())


def test_a_group_of_copies_and_repeated_ids(spark):
    rows = [(i, [1.0, 0.0, 0.5], 0) for i in range(300)] + [(7, [1.0, 0.0, 0.5], 0), (None, [1.0, 0.0, 0.5], 0)]
    got = V.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert len(got) == 302 and {r["n_links"] for r in got} == {301} and {r["component_id"] for r in got} == {0}
    assert sum(r["kept"] for r in got) == 1


def test_tables_without_links(spark):
    none = spark.createDataFrame([(1, None, 0), (None, [], 0)], SCHEMA)
    got = [tuple(r) for r in V.near_duplicates(none).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 1, True), (None, 0, None, False)], key=str)
    assert V.near_duplicates(none.limit(0)).count() == 0
