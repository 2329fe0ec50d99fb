"""Run registered queries and their SQL side by side: ``python tests/oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import decimal
import math
import os
import sys
import tempfile
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def compare(spark, con, sf_dir, name, query, text):
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    rel = con.sql(text)
    want = rows_of(rel.columns, rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns), (name, df.columns, rel.columns)
    kinds = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    sql_kinds = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert kinds == sql_kinds, (name, kinds, sql_kinds)
    if got != want:
        extra = [r for r in got if r not in set(want)][:3] if len(got) < 50000 else got[:3]
        missing = [r for r in want if r not in set(got)][:3] if len(want) < 50000 else want[:3]
        raise AssertionError(f"{name}: {len(got)} rows against {len(want)}\n  only Spark {extra}\n  only SQL {missing}")
    return len(got)


def main():
    from pyspark.sql import SparkSession

    from tickloom.plans import registry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(registry.QUERIES)
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false").config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="checkpoints-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = database(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            if name in registry.SQL:
                rows = compare(spark, con, sf_dir, name, registry.QUERIES[name], registry.SQL[name])
                print(f"{name}: {rows} rows equal, {time.time() - start:.1f} s", flush=True)
            else:
                rows = registry.QUERIES[name](spark, sf_dir).count()
                print(f"{name}: {rows} rows (no SQL), {time.time() - start:.1f} s", flush=True)
        except Exception as error:  # report and go on with the next query
            failed += 1
            print(f"{name}: FAILED {str(error)[:1500]}", flush=True)
    print(f"{len(names) - failed} of {len(names)} ok")


if __name__ == "__main__":
    main()
