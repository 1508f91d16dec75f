"""The shape of physical plans: what must not creep in unnoticed."""

import re

import pytest
from pyspark.sql import functions as F

from hearthline import operators as ops
from hearthline import plans, sources
from workload.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def target(spark, tmp_path):
    raw = spark.createDataFrame([("1", "$50"), ("2", "$100")], "id string, price string")
    path = str(tmp_path / "target")
    plans.load_listings(spark, ops.transform_listings(raw), str(tmp_path / "staging"), path)
    return sources.read_target(spark, path)


def test_transform_of_a_table_does_not_shuffle(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").cast("string"), F.lit("$5").alias("price"))
    rows.repartition(16).write.parquet(str(tmp_path / "raw"))
    raw = spark.read.parquet(str(tmp_path / "raw"))
    for variant in ("base", "scale"):
        assert "Exchange" not in physical(ops.transform_listings(raw, variant))
    assert "Exchange" not in physical(ops.typed_listings(ops.transform_listings(raw)))


def test_reports_read_the_columns_they_use(target):
    columns = {
        plans.summary: {"price", "review_scores_rating"},
        plans.top_neighbourhoods: {"neighbourhood", "price", "review_scores_rating"},
        plans.price_categories: {"price_category"},
        plans.room_type_breakdown: {"room_type_simplified", "price", "review_scores_rating"},
    }
    for report, used in columns.items():
        read = re.search(r"ReadSchema: struct<(.*?)>", physical(report(target))).group(1)
        assert {c.split(":")[0] for c in read.split(",") if ":" in c} == used


def test_top_list_is_a_top_k_after_partial_counts(target):
    plan = physical(plans.top_neighbourhoods(target))
    assert "TakeOrderedAndProject" in plan and "partial_count" in plan
    assert "rangepartitioning" not in plan


def test_price_filter_reaches_the_scan(target):
    plan = physical(target.where("price > 60").select("id"))
    assert "PushedFilters: [IsNotNull(price), GreaterThan(price,60.00)]" in plan


def test_upsert_counts_down_before_the_shuffle(spark, tmp_path):
    for name in ("target", "changes"):
        spark.createDataFrame([(1, 2)], "k int, v int").write.parquet(str(tmp_path / name))
    target, changes = (spark.read.parquet(str(tmp_path / n)) for n in ("target", "changes"))
    plan = physical(ops.upsert(target, changes, ["k"], "v"))
    assert "partial_max" in plan and "Window" not in plan
    assert plan.count("FileScan") == 2  # one of each input


def test_csv_reader_leaves_the_text_where_it_is_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,v\n1,"a\nb"\n2,c\n' * 1)
    plan = physical(sources.read_raw_listings(spark, str(tmp_path)))
    assert "Exchange hashpartitioning" not in plan and "Sort" not in plan and plan.count("FileScan text") == 1


def test_replication_does_not_join(spark):
    rows = spark.createDataFrame([("1", "u")], "id string, listing_url string")
    plan = physical(ops.replicate(rows, 3))
    assert "Generate explode" in plan and "Join" not in plan


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_python_rows_and_no_cross_joins(spark, name):
    plan = physical(QUERIES[name](spark, SF_DIR))
    for operator in ("EvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in plan


def test_long_ids_are_dealt_out_before_they_are_multiplied(spark):
    plan = physical(QUERIES["replicate_long_ids"](spark, SF_DIR))
    assert "Exchange hashpartitioning(c_custkey" in plan.split("Generate explode")[-1]


def test_copies_add_texts_that_are_multiplied_once(spark):
    plan = physical(ops.replicate(spark.createDataFrame([("1",)], "id string"), 3))
    assert "lambdafunction" not in plan[plan.index("Generate explode") :].split("Subquery")[0]


def test_known_keys_move_no_whole_rows(spark, tmp_path):
    wide = spark.range(3000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.repeat(F.lit("x"), 500).alias("text"))
    for name in ("batch", "target"):
        wide.write.parquet(str(tmp_path / name))
    batch, target = (spark.read.parquet(str(tmp_path / n)) for n in ("batch", "target"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2000b")  # less than the target's keys, more than no new ones
    try:
        new = ops.only_new_rows(batch, target, ["k"])
        assert "hashpartitioning" not in physical(new) and new.count() == 1  # the row without a key
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_view_compiles(spark, tmp_path):
    """A generated method that is too long is interpreted row by row, without a word in the result."""
    orders = spark.range(200).selectExpr(
        "id as o_orderkey", "id % 7 as o_custkey", "id * 1.5D as o_totalprice", "date '2024-01-01' as o_orderdate", "'1-URGENT' as o_orderpriority"
    )
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        for name in ("cleaned_listings", "typed_listings", "price_categories", "all_bad_rows"):
            QUERIES[name](spark, str(tmp_path)).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
