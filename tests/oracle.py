"""Run a registered query and its SQL on the same tables and compare all rows."""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from __spark_entry__ import oracle_sql, queries  # noqa: E402


TYPES = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else x + 0.0
    return x


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_value(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda row: tuple((x is None, str(type(x)), x if x is not None else 0)
                                               for x in row))


def compare(spark, con, name: str, sf_dir: str):
    """(rows, differing rows, seconds); differing rows is None where there is no SQL."""
    start = time.time()
    df = queries()[name](spark, sf_dir)
    got = _rows(df.columns, df.collect())
    seconds = time.time() - start
    sql = oracle_sql().get(name)
    if sql is None:
        return len(got), None, seconds
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    types = sorted((d[0], str(d[1])) for d in result.description)
    assert types == sorted((c, TYPES[t]) for c, t in df.dtypes), (name, types, df.dtypes)
    want = _rows(columns, result.fetchall())
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    bad += [(a, None) for a in got[len(want):]] + [(None, b) for b in want[len(got):]]
    return len(got), bad, seconds


if __name__ == "__main__":
    from conftest import session

    sf_dir = sys.argv[1]
    names = sys.argv[2:] or list(queries())
    spark, con, failed = session(), duck(sf_dir), []
    for name in names:
        try:
            rows, bad, seconds = compare(spark, con, name, sf_dir)
        except Exception as error:  # report every query, then fail
            print(f"{name:32} ERROR {str(error)[:1500]}", flush=True)
            failed.append(name)
            continue
        state = "rows only" if bad is None else ("ok" if not bad else f"{len(bad)} DIFFER {bad[:2]}")
        print(f"{name:32} {rows:7} rows {seconds:6.1f}s  {state}", flush=True)
        if bad:
            failed.append(name)
    print("failed:", failed)
    sys.exit(bool(failed))
