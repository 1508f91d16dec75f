"""Run registered queries beside their SQL and compare rows."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from .oracle import ORACLE
from .queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            connection.execute(f"create view {name} as select * from '{path}'")
    return connection


def _key(row: tuple) -> tuple:
    return tuple((v is None, repr(v)) for v in row)


def differences(spark: SparkSession, sf_dir: str, name: str, shown: int = 3) -> list[str]:
    """What sets the two results apart; empty if they agree."""
    mine = QUERIES[name](spark, sf_dir)
    names = sorted(mine.columns)
    rows = sorted((tuple(r[n] for n in names) for r in mine.collect()), key=_key)
    relation = duck(sf_dir).sql(ORACLE[name])
    if sorted(relation.columns) != names:
        return [f"columns {names} and {sorted(relation.columns)}"]
    order = [relation.columns.index(n) for n in names]
    others = sorted((tuple(r[i] for i in order) for r in relation.fetchall()), key=_key)
    found = []
    if len(rows) != len(others):
        found.append(f"{len(rows)} rows and {len(others)}")
    kinds = dict(zip(relation.columns, map(str, relation.types), strict=True))
    spark_kinds = dict(mine.dtypes)
    for n in names:
        pair = (spark_kinds[n].split("(")[0], kinds[n].lower().split("(")[0])
        same = {
            ("string", "varchar"), ("int", "integer"), ("timestamp_ntz", "timestamp"),
        }
        if pair[0] != pair[1] and pair not in same:
            found.append(f"type of {n}: {spark_kinds[n]} and {kinds[n]}")
    for a, b in zip(rows, others, strict=False):
        if repr(a) != repr(b):
            parts = [(n, x, y) for n, x, y in zip(names, a, b, strict=True) if repr(x) != repr(y)]
            found.append(str(parts[:4]))
            if len(found) >= shown:
                break
    return found


def main(spark: SparkSession, sf_dir: str, wanted: list[str]) -> None:
    for name in wanted or QUERIES:
        begin = time.time()
        try:
            found = differences(spark, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            found = [f"{type(error).__name__}: {str(error)[:800]}"]
        print(f"{'ok  ' if not found else 'DIFF'} {name} {time.time() - begin:.1f}s", flush=True)
        for line in found:
            print("    ", line[:1200], flush=True)


if __name__ == "__main__":
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    main(session, sys.argv[1], sys.argv[2:])
