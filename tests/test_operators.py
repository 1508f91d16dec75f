"""Sequence, replication, merges, events and counters on small inputs."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hearthline import operators as ops


def test_sequence_with_a_hot_key(spark):
    random.seed(7)
    ids = [random.choice(["5", "5", "x", "12", "007", str(random.randrange(1000)), "9" * 40]) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(ids)), "n int, id string").repartition(7)
    rows = ops.add_sequence(df, position=["n"]).orderBy("sequential_id").collect()
    expected = sorted(enumerate(ids), key=lambda r: (int(r[1]) if r[1].isdigit() else 0, r[0]))
    assert [r.sequential_id for r in rows] == list(range(1, 3001))
    assert [(r.n, r.id) for r in rows] == expected


def test_sequence_spreads_equal_keys(spark):
    df = spark.range(0, 20000, 1, 8).select(F.lit("5").alias("id"), F.col("id").alias("n"))
    numbered = ops.add_sequence(df)
    assert numbered.agg(F.min("sequential_id"), F.max("sequential_id")).first()[:] == (1, 20000)
    assert numbered.select("sequential_id").distinct().count() == 20000


def test_sequence_of_nothing(spark):
    assert ops.add_sequence(spark.createDataFrame([], "id string")).count() == 0


@settings(max_examples=5, deadline=None)
@given(ids=st.lists(st.sampled_from(["1", "02", "a", "", "77", "5 "]), min_size=1, max_size=30))
def test_sequence_is_a_permutation(spark, ids):
    df = spark.createDataFrame(list(enumerate(ids)), "n int, id string")
    numbers = [r.sequential_id for r in ops.add_sequence(df, position=["n"]).collect()]
    assert sorted(numbers) == list(range(1, len(ids) + 1))


def test_replicate(spark):
    rows = [("3", "u/rooms/3"), ("007", "u/rooms/007"), ("abc", "u/rooms/9")]
    df = spark.createDataFrame(rows, "id string, listing_url string")
    copies = ops.replicate(df, 2, copy_column="copy").collect()
    assert sorted((r.copy, r.id, r.listing_url) for r in copies) == sorted(
        [
            (0, "3", "u/rooms/3"), (0, "7", "u/rooms/7"), (0, "abc", "u/rooms/9"),
            (1, "10", "u/rooms/10"), (1, "14", "u/rooms/14"), (1, "abc", "u/rooms/9"),
        ]
    )


def test_replicated_digit_ids_are_unique(spark):
    df = spark.range(1, 501).select(F.col("id").cast("string"))
    copies = ops.replicate(df, 6)
    assert copies.count() == 3000 and copies.distinct().count() == 3000


def test_replicate_keeps_what_is_not_a_number(spark):
    df = spark.createDataFrame([(None, "u"), ("", ""), ("-4", "u/rooms/-4")], "id string, listing_url string")
    copies = ops.replicate(df, 2).collect()
    assert sorted((r.id or "", r.listing_url) for r in copies) == [
        ("", ""), ("", ""), ("", "u"), ("", "u"), ("-4", "u/rooms/-4"), ("-4", "u/rooms/-4"),
    ]


def test_largest_id(spark):
    df = spark.createDataFrame([(v,) for v in ["7", " 12 ", "x", "1.5", None, "-3", "1_0"]], "id string")
    assert df.agg(ops.largest_id("id")).first()[0] == 12
    assert df.where("id = 'x'").agg(ops.largest_id("id")).first()[0] == 0


def test_upsert_takes_the_newest_change(spark):
    target = spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string")
    changes = spark.createDataFrame([(2, "a", 1), (2, "b", 3), (2, "c", 2), (3, None, 1)], "k int, v string, at int")
    merged = ops.upsert(target, changes, ["k"], "at").collect()
    assert sorted((r.k, r.v) for r in merged if r.v) == [(1, "old"), (2, "b")]
    assert [r.v for r in merged if r.k == 3] == [None]


def test_upsert_adds_every_change_without_a_key(spark):
    target = spark.createDataFrame([(1, "old")], "k int, v string")
    changes = spark.createDataFrame([(None, "a", 1), (None, "b", 1), (1, "c", 1)], "k int, v string, at int")
    merged = ops.upsert(target, changes, ["k"], "at").collect()
    assert sorted((r.k or 0, r.v) for r in merged) == [(0, "a"), (0, "b"), (1, "c")]


def test_upsert_with_a_hot_key(spark):
    target = spark.range(10).select(F.col("id").alias("k"), F.lit(-1).cast("bigint").alias("v"))
    hot = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, 4).otherwise(F.col("id") % 50).cast("bigint").alias("k"),
        F.col("id").alias("v"),
    )
    merged = {r.k: r.v for r in ops.upsert(target, hot, ["k"], "v").collect()}
    expected = dict.fromkeys(range(10), -1)
    for i in range(30000):
        expected[4 if i % 3 == 0 else i % 50] = i
    assert merged == expected


def test_only_new_rows(spark):
    batch = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    target = spark.createDataFrame([(1,)], "k int")
    assert [r.k for r in ops.only_new_rows(batch, target, ["k"]).collect()] == [2, 2]


EVENTS = [
    ('{"detail":{"s3Bucket":"b","object":{"key":"a%2Fb+c.csv"}}}', ("b", "a/b c.csv", "typed_table", True, False)),
    ('{"s3Bucket":"b","s3Key":"k%zz"}', ("b", "k%zz", "typed_table", True, False)),
    (
        '{"detail":"x","s3Bucket":5,"s3Key":"k","target":"SQLITE","pruneTable":"TRUE"}',
        ("5", "k", "text_table", True, True),
    ),
    ('{"bucket":{"name":"n"},"s3Key":"k","pruneTargetTable":"yes"}', ("n", "k", "typed_table", False, False)),
    ('{"detail":{},"s3Bucket":"b","s3Key":"k"}', None),
    ('{"s3Key":"k"}', None),
    ("junk", None),
]


def test_manifest(spark):
    df = spark.createDataFrame([(i, e) for i, (e, _) in enumerate(EVENTS)], "i int, event string")
    found = {r.i: tuple(r)[2:] for r in ops.load_manifest(df).collect()}
    assert found == {i: wanted for i, (_, wanted) in enumerate(EVENTS) if wanted}
    assert {r.i for r in ops.rejected_events(df).collect()} == {i for i, (_, w) in enumerate(EVENTS) if not w}
    with_default = ops.load_manifest(df, default_bucket="inbox").where("i = 5").first()
    assert (with_default.bucket, with_default.object_key) == ("inbox", "k")


def test_counter_deltas(spark):
    polls = [("a", 1, "cpuUser", 5.0), ("a", 3, "cpuUser", 9.0), ("a", 2, "cpuUser", 7.0), ("b", 1, "cpuIdle", 1.0)]
    df = spark.createDataFrame(polls, "run_id string, ts bigint, metric string, value double")
    rows = {r.run_id: r for r in ops.counter_deltas(df).collect()}
    assert rows["a"].cpuUserDelta == 4.0 and rows["a"].cpuIdleDelta is None
    assert rows["b"].cpuIdleDelta == 0.0 and len(rows["b"]) == 13


@pytest.mark.parametrize(("memory", "used", "runtime"), [(1792, 1900, 1000), (3584, 100, 1000), (128, 0, 10)])
def test_size_advice(spark, memory, used, runtime):
    df = spark.createDataFrame([(memory, used, 0, runtime)], ["functionMemory", "cpuUserDelta", "cpuKernelDelta", "userRuntime"])
    row = ops.size_advice(df).first()
    available, utilized = memory / 1792, used / runtime
    base = available * 1.1 if available - utilized < 0.1 else utilized
    assert row.availableCPUs == round(available, 3) and row.utilizedCPUs == round(utilized, 3)
    assert row.recommendedMemory == min(max(round(0.000556 * base + 0.012346), 128), 10240)


def test_places_do_not_put_all_rows_in_one_task(spark):
    from workload.queries import in_order

    rows = spark.range(5000).selectExpr("(id * 7919) % 5000 as k", "repeat('x', 50) as wide")
    got = in_order(rows.repartitionByRange(6, "k").sortWithinPartitions("k"))
    assert {(r.k + 1, r.place) for r in got.collect()} == {(i, i) for i in range(1, 5001)}
    windows = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in line]
    assert windows and not any("_slot" in line for line in windows)
    assert dict(got.dtypes)["place"] == "bigint"


def test_replicate_ids_of_any_length(spark):
    random.seed(11)
    ids = [str(random.randrange(10 ** (n - 1), 10**n)) for n in (1, 9, 17, 18, 19, 36, 37, 38, 39, 54, 70, 71, 72, 90) for _ in range(4)]
    ids += ["9" * n for n in (17, 18, 19, 38, 53, 54, 70, 71)] + ["0", "000", "0" * 80 + "5"]
    for longest in (18, 19, 38, 71, 90):
        kept = [i for i in ids if len(i) <= longest]
        top = max(map(int, kept))
        got = ops.replicate(spark.createDataFrame([(i,) for i in kept], "id string"), 3, copy_column="copy").collect()
        assert sorted(r.id for r in got) == sorted(str(int(i) + k * top) for i in kept for k in range(3))
