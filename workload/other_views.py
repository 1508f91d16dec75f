"""Inputs derived from the driver's ``events``, ``customer`` and ``orders`` tables.

As in ``listings_view``, the expressions are SQL that both engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_ID, _USER = "cast(event_id as string)", "cast(user_id as string)"

LOAD_EVENTS = {
    "event_id": "event_id",
    "event": "case event_id % 10 "
    f"when 0 then '{{\"s3Bucket\":\"b' || {_USER} || '\",\"s3Key\":\"raw%2Flistings+' || {_ID} || '.csv\"}}' "
    f"when 1 then '{{\"detail\":{{\"bucket\":{{\"name\":\"b' || {_USER} || '\"}},\"object\":{{\"key\":\"raw/' || {_ID} || '.csv\"}}}}}}' "
    f"when 2 then '{{\"detail\":{{\"s3Bucket\":\"c' || {_USER} || '\",\"s3Key\":\"k' || {_ID} || '\",\"target\":\"SQLite\",\"pruneTable\":true}}}}' "
    f"when 3 then '{{\"s3Key\":\"bad%zz' || {_ID} || '\"}}' "
    f"when 4 then '{{\"s3Bucket\":\"b' || {_USER} || '\"}}' "
    f"when 5 then '{{\"detail\":\"text\",\"s3Bucket\":\"d\",\"s3Key\":' || {_ID} || ',\"pruneTargetTable\":\"FALSE\"}}' "
    "when 6 then '{\"detail\":{},\"s3Bucket\":\"x\",\"s3Key\":\"y\"}' "
    f"when 7 then '{{\"s3Bucket\":\"e\",\"bucket\":\"plain\",\"object\":{{\"key\":\"k%20' || {_ID} || '\"}},\"action\":\"sqlite\"}}' "
    "when 8 then 'no json' "
    "else '{\"s3Bucket\":null,\"bucket\":{\"name\":\"n\"},\"object\":{\"key\":\"caf%C3%A9+x.csv\"},\"target\":\"other\",\"pruneTable\":\"yes\"}' end",
}

_STAMP = "cast(ts as string)"
TEMPORAL_TEXT = {
    "event_id": "event_id",
    "stamp_text": f"case event_id % 9 when 0 then substr({_STAMP}, 1, 19) "
    f"when 1 then replace({_STAMP}, ' ', 'T') when 2 then substr({_STAMP}, 1, 10) "
    f"when 3 then '2024-02-31' || substr({_STAMP}, 11, 9) when 4 then '0000-00-00 00:00:00' "
    f"when 5 then substr({_STAMP}, 1, 19) || '.25 and more' when 6 then 'random text' "
    f"when 7 then substr({_STAMP}, 1, 11) || '24:00:00' else substr({_STAMP}, 1, 19) end",
    "span_text": "case when event_id % 7 = 0 then '-' else '' end || "
    f"cast(event_id % 900 as string) || ':' || lpad(cast(event_id % 60 as string), 2, '0') || ':' || "
    "case when event_id % 11 = 0 then 'x' else cast(user_id % 60 as string) end "
    "|| case when event_id % 5 = 0 then '.5' else '' end",
    "clock_text": "cast(event_id % 26 as string) || ':' || cast(event_id % 61 as string) || ':' || "
    "lpad(cast(user_id % 60 as string), 2, '0') || case when event_id % 3 = 0 then '.125' else '' end",
    "day_text": f"case event_id % 5 when 0 then substr({_STAMP}, 1, 10) when 1 then '2007-02-31' "
    "when 2 then '2024-' || cast(1 + event_id % 12 as string) || '-' || cast(1 + event_id % 31 as string) "
    "when 3 then 'never' else '0000-00-00' end",
}

POLLS = {
    "run_id": "user_id",
    "ts": "event_id",
    "metric": "case event_type when 'click' then 'cpuUser' when 'view' then 'cpuKernel' "
    "when 'purchase' then 'cpuIdle' when 'signup' then 'pageFaults' else 'majorPageFaults' end",
    "value": "cast(floor(value * 100) as bigint)",
}

RUNS = {
    "run_id": "c_custkey",
    "functionMemory": "128 + c_custkey % 80 * 128",
    "cpuUserDelta": "c_custkey * 7 % 5000",
    "cpuKernelDelta": "c_custkey * 3 % 900",
    "userRuntime": "c_custkey % 5000",
}


def view(spark: SparkSession, sf_dir: str, table: str, columns: dict[str, str]) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return rows.selectExpr(*(f"{e} as {n}" for n, e in columns.items()))


def view_sql(table: str, columns: dict[str, str]) -> str:
    return f"select {', '.join(f'{e} as {n}' for n, e in columns.items())} from {table}"
