"""The registered queries: each reads whole driver tables through the library."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthline import functions as fn
from hearthline import operators as ops
from hearthline import plans, sources, streaming
from hearthline.schema import LISTING_COLUMNS
from hearthline.session import child_names, scratch_path, stored, tune
from hearthline.sources.tables import staging_rows

from .listings_view import raw_listings
from .other_views import LOAD_EVENTS, POLLS, RUNS, TEMPORAL_TEXT, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

REPORT_COLUMNS = [
    "neighbourhood",
    "price",
    "review_scores_rating",
    "price_category",
    "room_type_simplified",
]

# CSV files between jobs: text takes many times the disk of the tables it comes from.
PACKED = "gzip"
QUALITY_COLUMNS = ["price", "review_scores_rating", "host_is_superhost", "instant_bookable"]


def query(run: Query) -> Query:
    """Register ``run`` under its name."""

    def tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(tune(spark), sf_dir)

    QUERIES[run.__name__] = tuned
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cleaned(
    spark: SparkSession, sf_dir: str, variant: str = "scale", columns: list[str] | None = None, parts: int | None = None
) -> DataFrame:
    return ops.transform_listings(raw_listings(spark, sf_dir, parts=parts), variant, columns)


def staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned listings as the text a staging table holds."""
    return sources.listing_text(cleaned(spark, sf_dir))


def typed(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    return ops.typed_listings(cleaned(spark, sf_dir, columns=columns))


def report_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five typed columns the reports read."""
    return typed(spark, sf_dir, REPORT_COLUMNS)


def in_order(df: DataFrame) -> DataFrame:
    """The rows with their ``place`` in the order they come in.

    As in ``add_sequence``: rows are written once with their partition and place there,
    and only a row per partition is put in one order and broadcast.
    """
    slots = stored(df.withColumn("_slot", F.monotonically_increasing_id()), "ordered")
    slots = slots.withColumn("_part", F.shiftright("_slot", 33))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        slots.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    )
    place = F.col("_before") + F.col("_slot").bitwiseAND((1 << 33) - 1) + 1
    return slots.join(F.broadcast(offsets), "_part").select(*df.columns, place.alias("place"))


def as_doubles(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def csv_copy(spark: SparkSession, sf_dir: str) -> str:
    """The raw view as CSV files in the shared folder."""
    path = scratch_path(spark, "raw") + "/listings.csv"
    sources.write_text_csv(raw_listings(spark, sf_dir), path, compression=PACKED)
    return path


def arriving(spark: SparkSession, sf_dir: str, least: int) -> int:
    """Files to arrive: ``least`` of them, or as many as hold their rows in files of bounded size."""
    rows = table(spark, sf_dir, "orders").count()
    return max(least, -(-rows * 10 // (sources.FILE_ROWS * 9)))  # hashing deals out unevenly


# Reports


@query
def price_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.price_categories(report_input(spark, sf_dir))


@query
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = plans.summary(report_input(spark, sf_dir))
    return as_doubles(report, "avg_price", "min_price", "max_price", "avg_rating")


@query
def summary_without_unrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = plans.summary(report_input(spark, sf_dir), zero_as_null=True)
    return as_doubles(report, "avg_price", "min_price", "max_price", "avg_rating")


@query
def top_neighbourhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_doubles(plans.top_neighbourhoods(report_input(spark, sf_dir)), "avg_price", "avg_rating")


@query
def room_type_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_doubles(plans.room_type_breakdown(report_input(spark, sf_dir)), "avg_price", "avg_rating")


@query
def state_counts_any_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-insensitive grouping, as a case-insensitive collation gives."""
    rows = typed(spark, sf_dir, ["state", "price", "review_scores_rating"])
    rows = rows.withColumnRenamed("state", "neighbourhood")
    groups = plans.top_neighbourhoods(rows, limit=2**31 - 1, collation="UTF8_LCASE")
    return groups.select(
        F.lower(F.col("neighbourhood").cast("string")).alias("state"), "num_listings"
    )


@query
def full_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.report_rows(report_input(spark, sf_dir))


@query
def full_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.report_json(report_input(spark, sf_dir))


@query
def data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.data_quality(cleaned(spark, sf_dir, "base", QUALITY_COLUMNS))


# Gates and projections


@query
def row_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_listings(spark, sf_dir)
    parts = [
        ops.row_accounting(raw, v).select(F.lit(v).alias("variant"), "*")
        for v in ("base", "scale", "arch")
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def cleaned_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark, sf_dir)


@query
def cleaned_listings_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark, sf_dir, "base")


@query
def absent_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults of columns the input does not have."""
    raw = raw_listings(spark, sf_dir).select("id", "name", "price")
    parts = [
        ops.transform_listings(raw, v).select(F.lit(v).alias("variant"), *LISTING_COLUMNS)
        for v in ("base", "scale")
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def typed_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(spark, sf_dir)


@query
def typed_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows by way of staging text."""
    return ops.typed_listings(stored(staging(spark, sf_dir), "staging"))


@query
def typed_raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guarded casts on text that was never cleaned."""
    return ops.typed_listings(staging_rows(raw_listings(spark, sf_dir)))


@query
def bad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.bad_rows(staging_rows(raw_listings(spark, sf_dir)))


@query
def all_bad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.bad_rows(staging_rows(raw_listings(spark, sf_dir)), limit=None)


# Functions


@query
def clean_document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return documents.select(
        "doc_id",
        fn.clean_text("text").alias("text"),
        fn.clean_text("text", 1000).alias("description"),
        fn.clean_text("text", 200).alias("name"),
    )


@query
def clean_conversation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", fn.clean_text("text", 100).alias("host_name"))


@query
def clean_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_listings(spark, sf_dir).select(
        "id",
        fn.clean_price("price").alias("price"),
        fn.clean_price("security_deposit").alias("security_deposit"),
        fn.clean_float("latitude").alias("latitude"),
        fn.clean_float("review_scores_rating").alias("review_scores_rating"),
        fn.clean_int("beds").alias("beds"),
        fn.clean_int("maximum_nights").alias("maximum_nights"),
        fn.clean_percentage("host_response_rate").alias("host_response_rate"),
        fn.clean_percentage("host_acceptance_rate").alias("host_acceptance_rate"),
    )


@query
def number_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubles as positional text, across seven orders of size."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        "o_orderkey",
        fn.float_text("o_totalprice").alias("total"),
        fn.float_text(F.col("o_totalprice") * 1000).alias("thousands"),
        fn.float_text(F.floor("o_totalprice") / 1024).alias("fraction"),
    )


@query
def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_listings(spark, sf_dir)
    return raw.select(
        "id",
        fn.parse_flag("host_is_superhost").alias("host_is_superhost"),
        fn.parse_flag("host_identity_verified").alias("host_identity_verified"),
        fn.parse_flag("has_availability").alias("has_availability"),
        fn.is_professional_host(fn.clean_int("host_listings_count")).alias("is_professional_host"),
        fn.has_cleaning_fee(fn.clean_price("cleaning_fee")).alias("has_cleaning_fee"),
    )


@query
def clean_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_listings(spark, sf_dir)
    return raw.select(
        "id",
        *(fn.clean_date(c).alias(c) for c in ("host_since", "first_review", "last_review")),
    )


@query
def amenity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = fn.count_items("amenities").alias("amenities")
    return raw_listings(spark, sf_dir).groupBy(items).agg(F.count("*").alias("num_listings"))


@query
def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [
        "price_category",
        "review_category",
        "host_category",
        "availability_category",
        "room_type_simplified",
    ]
    rows = cleaned(spark, sf_dir, columns=names)
    return rows.groupBy(*names).agg(F.count("*").alias("num_listings"))


@query
def price_per_guest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact cent rounding of every line price over one to sixteen guests."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        fn.price_per_guest("l_extendedprice", F.col("l_partkey") % 17).alias("price_per_guest"),
    )


@query
def typed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_listings(spark, sf_dir)
    return raw.select(
        "id",
        fn.typed_date("host_since").alias("host_since"),
        fn.is_null_token("host_since").alias("is_null_token"),
        fn.typed_integer("bedrooms").alias("bedrooms"),
        fn.typed_integer("bedrooms", lenient=True).alias("bedrooms_lenient"),
    )


def in_sql(rows: DataFrame, keep: str, columns: dict[str, str]) -> DataFrame:
    """``columns`` as SQL over ``rows``, with the column functions under the names ``hl_...``."""
    spark = rows.sparkSession
    fn.register_sql_functions(spark, "hl_")
    return spark.sql(f"select {keep}, {', '.join(f'{e} as {n}' for n, e in columns.items())} from {{rows}}", rows=rows)


@query
def listings_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned, derived and typed columns by SQL functions."""
    columns = {
        "price": "hl_clean_price(price)",
        "latitude": "hl_clean_float(latitude)",
        "beds": "hl_clean_int(beds)",
        "host_response_rate": "hl_clean_percentage(host_response_rate)",
        "host_is_superhost": "hl_parse_flag(host_is_superhost)",
        "is_professional_host": "hl_is_professional_host(hl_clean_int(host_listings_count))",
        "has_cleaning_fee": "hl_has_cleaning_fee(hl_clean_price(cleaning_fee))",
        "first_review": "hl_clean_date(first_review)",
        "amenities": "hl_count_items(amenities)",
        "host_since": "hl_typed_date(host_since)",
        "bedrooms": "hl_typed_integer(bedrooms)",
    }
    return in_sql(raw_listings(spark, sf_dir), "id", columns)


@query
def decode_dates_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = {"value": "hl_decode_date(day_text).value", "raw": "hl_decode_date(day_text).raw"}
    return in_sql(view(spark, sf_dir, "events", TEMPORAL_TEXT), "event_id", decoded)


@query
def decode_datetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "events", TEMPORAL_TEXT)
    decoded = rows.select("event_id", fn.decode_datetime("stamp_text").alias("t"))
    return decoded.select("event_id", "t.value", "t.day", "t.raw")


@query
def decode_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "events", TEMPORAL_TEXT)
    decoded = rows.select("event_id", fn.decode_interval("span_text").alias("t"))
    total = (
        F.extract(F.lit("DAY"), "t.value").cast("decimal(20,6)") * 86400
        + F.extract(F.lit("HOUR"), "t.value") * 3600
        + F.extract(F.lit("MINUTE"), "t.value") * 60
        + F.extract(F.lit("SECOND"), "t.value")
    )
    return decoded.select("event_id", total.cast("double").alias("seconds"), "t.raw")


@query
def decode_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "events", TEMPORAL_TEXT)
    decoded = rows.select("event_id", fn.decode_time("clock_text").alias("t"))
    return decoded.select("event_id", "t.value", "t.raw")


@query
def decode_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "events", TEMPORAL_TEXT)
    decoded = rows.select("event_id", fn.decode_date("day_text").alias("t"))
    return decoded.select("event_id", "t.value", "t.raw")


@query
def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch seconds of the session's wall clock, back to date, time and timestamp."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1000000
    rows = table(spark, sf_dir, "events").select("event_id", seconds.alias("t"))
    return rows.select(
        "event_id",
        fn.date_from_ticks("t").alias("day"),
        fn.time_from_ticks("t").alias("clock"),
        fn.timestamp_from_ticks("t").alias("stamp"),
    )


# Scale-up, sequence, merges


@query
def largest_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_listings(spark, sf_dir)
    return raw.agg(ops.largest_id("id").cast("bigint").alias("largest_id"))


@query
def replicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.replicate(raw_listings(spark, sf_dir), 4, copy_column="copy")


@query
def scale_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.scale_summary(raw_listings(spark, sf_dir))


@query
def scale_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "scales")
    rows = plans.write_scales(spark, csv_copy(spark, sf_dir), folder, compression=PACKED)
    return rows.select("multiplier", "records")


@query
def scale_file_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the doubled file holds, read back."""
    folder = scratch_path(spark, "scales")
    rows = plans.write_scales(spark, csv_copy(spark, sf_dir), folder, [2], compression=PACKED)
    return sources.read_raw_listings(spark, rows.where("multiplier = 2").first().path)


@query
def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    keyed = events.select(
        F.when(F.col("event_type") == "error", "n/a")
        .otherwise(F.col("user_id").cast("string"))
        .alias("id"),
        "event_id",
    )
    return ops.add_sequence(keyed, position=["event_id"])


@query
def order_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns, and the place of each row in the order."""
    return in_order(ops.order_by_id(raw_listings(spark, sf_dir, position=True), position=["_row"])).drop("_row")


@query
def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the ordered reports with their places."""
    rows = stored(report_input(spark, sf_dir), "report-input")
    reports = {
        "price_categories": plans.price_categories(rows),
        "top_neighbourhoods": plans.top_neighbourhoods(rows),
        "room_type_breakdown": plans.room_type_breakdown(rows),
    }
    parts = [
        in_order(df).select(F.lit(name).alias("report"), F.col(df.columns[0]).alias("label"), "num_listings", "place")
        for name, df in reports.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def insert_new_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price")
    )
    target = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return ops.only_new_rows(batch, target, ["id"])


@query
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    changes = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") * 2).alias("c_custkey"),
        F.col("o_totalprice").alias("c_acctbal"),
        F.col("o_orderpriority").alias("c_mktsegment"),
        "o_orderdate",
        "o_orderkey",
    )
    return ops.upsert(target, changes, ["c_custkey"], F.struct("o_orderdate", "o_orderkey"))


@query
def upsert_awkward_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NULL versions, equal versions and missing keys among the changes."""
    target = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    order = F.col("o_orderkey")
    changes = table(spark, sf_dir, "orders").select(
        F.when(order % 50 != 0, F.col("o_custkey") * 2).alias("c_custkey"),
        F.concat("o_orderpriority", order.cast("string")).alias("c_mktsegment"),
        F.when(order % 3 != 0, order % 4).alias("version"),
    )
    return ops.upsert(target, changes, ["c_custkey"], "version")


@query
def stored_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table after two upserts that rewrite the files they touch."""
    path = scratch_path(spark, "keyed")
    sources.write_keyed(
        table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), path, "c_custkey", file_rows=500
    )
    orders = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") * 2).alias("c_custkey"),
        F.col("o_totalprice").alias("c_acctbal"),
        F.col("o_orderpriority").alias("c_mktsegment"),
        F.struct("o_orderdate", "o_orderkey").alias("version"),
    )
    sources.upsert_keyed(orders, path, "version", file_rows=500)
    suppliers = table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") * 3).alias("c_custkey"),
        F.col("s_acctbal").alias("c_acctbal"),
        F.col("s_name").alias("c_mktsegment"),
        F.col("s_suppkey").alias("version"),
    )
    sources.upsert_keyed(suppliers, path, "version", file_rows=500)
    return sources.read_keyed(spark, path)


@query
def replicate_long_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of ids of up to 50 digits."""
    key = F.col("c_custkey")
    digits = F.concat(key.cast("string"), F.expr("repeat('9', cast(c_custkey % 45 as int))"))
    # One row group is one task; rows are dealt out before they are multiplied.
    dealt = table(spark, sf_dir, "customer").select("c_custkey").repartition("c_custkey")
    rows = dealt.select(F.when(key % 3 == 0, key.cast("string")).otherwise(digits).alias("id"))
    urls = rows.withColumn("listing_url", F.concat(F.lit("u/rooms/"), "id", F.lit("?x")))
    return ops.replicate(urls, 3, copy_column="copy")


def _digest(statements: DataFrame) -> DataFrame:
    return statements.withColumn("text", F.md5("text"))


@query
def insert_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of at most 1,024,000 bytes, in four streams."""
    # One row group is one task; rows are dealt out before they become text.
    rows = table(spark, sf_dir, "lineitem").repartition("l_orderkey", "l_linenumber").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", F.col("l_shipdate").cast("date").alias("l_shipdate")
    )
    stream = F.col("l_orderkey") % 4
    return _digest(ops.insert_statements(rows, "items", ["l_orderkey", "l_linenumber"], streams=4, stream=stream))


@query
def replace_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small statements over whole texts with quotes, some of which are longer than a statement may be."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    stream = F.coalesce(F.col("doc_id") % 3, F.lit(0))
    return _digest(
        ops.insert_statements(
            rows, "documents", ["doc_id"], streams=3, stream=stream, verb="REPLACE", limit=4000,
            ending="AS new ON DUPLICATE KEY UPDATE text = new.text",
        )
    )


@query
def oversized_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounting of prices beyond the gate, some beyond any double."""
    order = F.col("o_orderkey")
    price = (
        F.when(order % 4 == 0, F.lit("$5.005"))
        .when(order % 4 == 1, F.concat(F.repeat(F.lit("9"), 320), F.lit(".125")))
        .when(order % 4 == 2, F.concat(F.repeat(F.lit("9"), 30), F.lit(".125")))
        .otherwise(F.lit("$10000.01"))
    )
    raw = table(spark, sf_dir, "orders").select(order.cast("string").alias("id"), F.lit("n").alias("name"), price.alias("price"))
    parts = [ops.row_accounting(raw, v).select(F.lit(v).alias("variant"), "*") for v in ("base", "scale", "arch")]
    return reduce(DataFrame.unionByName, parts)


# Events and counters


@query
def load_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = ops.load_manifest(view(spark, sf_dir, "events", LOAD_EVENTS))
    return manifest.drop("event")


@query
def load_manifest_default_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = view(spark, sf_dir, "events", LOAD_EVENTS)
    return ops.load_manifest(events, default_bucket="inbox").drop("event")


@query
def rejected_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.rejected_events(view(spark, sf_dir, "events", LOAD_EVENTS))


@query
def counter_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    polls = view(spark, sf_dir, "events", POLLS)
    names = ["cpuUser", "cpuKernel", "cpuIdle", "pageFaults", "majorPageFaults"]
    return ops.counter_deltas(polls, names)


@query
def size_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.size_advice(view(spark, sf_dir, "customer", RUNS))


# Jobs: files and tables in the shared folder


@query
def awkward_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes within and behind fields, breaks inside quotes, short and long records, many files."""
    order = F.col("o_orderkey")
    kinds = [
        F.concat(F.lit('5" wide,"a, ""b"""'), F.lit(",z")),
        F.concat(F.lit('"line\nbreak ",x"y'), F.lit(",z,extra")),
        F.concat(F.lit('"closed"after,"q"""'), F.lit("")),
        F.concat(F.lit(",,"), F.col("o_orderpriority")),
    ]
    record = F.lit(None).cast("string")
    for k, kind in enumerate(kinds):
        record = F.when(order % 4 == k, F.concat(order.cast("string"), F.lit(","), kind)).otherwise(record)
    rows = table(spark, sf_dir, "orders").select(F.floor(order / 5000).alias("file"), record.alias("record"))
    files = rows.groupBy("file").agg(F.array_join(F.collect_list("record"), "\r\n").alias("records"))
    path = scratch_path(spark, "awkward")
    text = files.select("file", F.concat(F.lit("id,a,b,c\r\n"), "records").alias("value"))
    text.repartition("file").write.partitionBy("file").text(path)
    return sources.read_text_table(spark, f"{path}/*")


@query
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.read_raw_listings(spark, csv_copy(spark, sf_dir))


@query
def text_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file with untidy header names as an all-text table."""
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("customer id"),
        F.col("c_name").alias(" name"),
        F.col("c_mktsegment").alias("segment (market)"),
    )
    path = scratch_path(spark, "text")
    sources.write_text_csv(customers, f"{path}/in.csv")
    for _ in range(2):  # a repeat replaces its own rows
        plans.load_text_table(spark, f"{path}/in.csv", f"{path}/table")
    return sources.read_text_loads(spark, f"{path}/table")


@query
def transform_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV in, cleaned CSV out, read back as text."""
    folder = scratch_path(spark, "clean")
    result = plans.run_transform(spark, csv_copy(spark, sf_dir), folder, compression=PACKED)
    return sources.read_raw_listings(spark, result.output)


@query
def transform_job_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "clean")
    result = plans.run_transform(spark, raw_listings(spark, sf_dir), folder, variant="base", compression=PACKED)
    counts = ("raw_count", "clean_count", "removed_count", "error_count", "records_processed")
    run = result.metrics.frame(spark)
    return run.select(*(F.col("attributes")[c].cast("bigint").alias(c) for c in counts))


@query
def parquet_transform_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed Parquet between the stages, in place of CSV text."""
    path = scratch_path(spark, "clean")
    raw = raw_listings(spark, sf_dir)
    result = plans.run_transform(spark, raw, f"{path}/clean", as_parquet=True)
    rows = spark.read.parquet(result.output)
    plans.load_listings(spark, rows, f"{path}/staging", f"{path}/target")
    return sources.read_target(spark, f"{path}/target")


@query
def numbered_transform_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "clean")
    raw = raw_listings(spark, sf_dir, position=True)
    result = plans.run_transform(spark, raw, folder, variant="arch", architecture="any", compression=PACKED)
    return sources.read_raw_listings(spark, result.output)


@query
def transform_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of what transforms write, and that nothing is left where no row survives."""
    raw = stored(raw_listings(spark, sf_dir), "raw")
    rows = []
    for variant in ("base", "scale", "arch"):
        for kind, source in (("some", raw), ("none", raw.withColumn("price", F.lit("0")))):
            folder = scratch_path(spark, "outputs")
            try:
                done = plans.run_transform(
                    spark, source, folder, variant=variant, source_name="l_2x.csv", architecture="any",
                    now=datetime(2024, 3, 4, 5, 6, 7), compression=PACKED,
                )
                rows.append((variant, kind, done.output.rsplit("/", 1)[1], done.metrics.attributes["clean_count"]))
            except plans.NoValidRecords:
                rows.append((variant, kind, None, len(child_names(spark, folder))))
    return spark.createDataFrame(rows, "variant string, kind string, name string, n bigint")


@query
def load_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage 1 to 2 through staging, then the target as the reports read it."""
    path = scratch_path(spark, "load")
    plans.load_listings(spark, cleaned(spark, sf_dir), f"{path}/staging", f"{path}/target")
    return sources.read_target(spark, f"{path}/target")


@query
def load_job_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replace, append, then append new ids only: what each load reports."""
    path = scratch_path(spark, "load")
    raw = staging_rows(raw_listings(spark, sf_dir))
    rows = stored(raw, "raw")
    metrics = f"{path}/metrics"
    loads = {"replace": {"prune": True}, "append": {"prune": False}}
    loads["new_only"] = {"prune": False, "new_only": True}
    for name, options in loads.items():
        plans.load_listings(
            spark,
            rows,
            f"{path}/staging",
            f"{path}/target",
            load_id=name,
            metrics_path=metrics,
            **options,
        )
    total = sources.read_target(spark, f"{path}/target").count()
    runs = spark.read.parquet(metrics)
    a = F.col("attributes")
    return runs.select(
        a["load_id"].alias("load_id"),
        a["staging_count"].cast("bigint").alias("staging_count"),
        a["inserted"].cast("bigint").alias("inserted"),
        a["bad_rows_shown"].cast("bigint").alias("bad_rows_shown"),
        F.lit(total).cast("bigint").alias("target_rows"),
    )


@query
def three_stage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV to cleaned CSV, to typed table, to the price report."""
    path = scratch_path(spark, "stages")
    result = plans.run_transform(spark, csv_copy(spark, sf_dir), f"{path}/clean", variant="base", compression=PACKED)
    plans.load_listings(spark, result.output, f"{path}/staging", f"{path}/target")
    listings = sources.read_target(spark, f"{path}/target")
    return as_doubles(plans.room_type_breakdown(listings), "avg_price", "avg_rating")


@query
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps each job times and the marks it sets, as recorded in the metrics table."""
    path = scratch_path(spark, "metrics")
    raw = raw_listings(spark, sf_dir).select("id", "name", "price", "room_type")
    result = plans.run_transform(spark, raw, f"{path}/clean", as_parquet=True)
    result.metrics.append(spark, f"{path}/runs")
    rows = spark.read.parquet(result.output)
    places = (f"{path}/staging", f"{path}/target")
    plans.load_listings(spark, rows, *places, metrics_path=f"{path}/runs")
    plans.run_report(sources.read_target(spark, places[1]), metrics_path=f"{path}/runs")
    runs = spark.read.parquet(f"{path}/runs")
    timed = runs.select("operation", F.explode("timings_ms").alias("step", "ms"))
    marks = runs.select("operation", F.explode("attributes").alias("step", "ms"))
    marks = marks.where(F.col("step").rlike("^(start|end)_"))
    steps = timed.unionByName(marks.withColumn("ms", F.col("ms").cast("double")))
    named = steps.select("operation", "step", (F.col("ms") >= 0).alias("measured"))
    parts = F.aggregate(
        F.map_values(F.map_filter("timings_ms", lambda k, _: k != "total")), F.lit(0.0), lambda a, v: a + v
    )
    within = runs.select("operation", F.lit("sum of steps").alias("step"), (parts <= F.col("timings_ms")["total"] + 1).alias("measured"))
    order = ["start_read", "end_read", "start_transform", "end_transform", "start_save", "end_save"]
    marked = [F.col("attributes")[name].cast("double") for name in order]
    rising = reduce(lambda a, b: a & b, (a <= b for a, b in zip(marked, marked[1:])))
    ordered = runs.where("operation = 'transform'").select("operation", F.lit("marks in order").alias("step"), rising.alias("measured"))
    return named.unionByName(within).unionByName(ordered)


@query
def arriving_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files taken in as a stream give the same typed rows as one batch load."""
    path = scratch_path(spark, "arrivals")
    files = arriving(spark, sf_dir, 4)
    sources.write_listings_csv(cleaned(spark, sf_dir, parts=files), f"{path}/in", PACKED)
    run = streaming.load_arrivals(
        spark,
        f"{path}/in",
        staging_path=f"{path}/staging",
        target_path=f"{path}/target",
        reject_path=f"{path}/rejects",
        checkpoint=f"{path}/checkpoint",
        max_files=files - files // 4,  # two batches: 3 of 4 files, then the rest
    )
    run.awaitTermination()
    return sources.read_target(spark, f"{path}/target")


@query
def arriving_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "arrivals")
    files = arriving(spark, sf_dir, 4)
    sources.write_text_csv(raw_listings(spark, sf_dir, parts=files), f"{path}/in", compression=PACKED)
    run = streaming.transform_arrivals(
        spark,
        f"{path}/in",
        output_path=f"{path}/out",
        checkpoint=f"{path}/checkpoint",
        variant="base",
        max_files=files - files // 4,
        compression=PACKED,
    )
    run.awaitTermination()
    out = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    rows = out.csv(f"{path}/out")
    return rows.groupBy("price_category", "room_type_simplified").agg(
        F.count("*").alias("num_listings"),
        F.sum(F.col("price").cast("decimal(20,2)")).cast("double").alias("price"),
    )


@query
def arriving_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records of streamed transforms; one file of the batch ends inside quotes."""
    path = scratch_path(spark, "arrivals")
    raw = raw_listings(spark, sf_dir)
    sources.write_text_csv(raw, f"{path}/in/good.csv", compression=PACKED)
    bad = spark.createDataFrame([("1", '"never closed')], "id string, name string")
    bad.write.option("header", True).option("quote", "\0").csv(f"{path}/in/bad.csv")
    run = streaming.transform_arrivals(
        spark,
        f"{path}/in/*",
        output_path=f"{path}/out",
        checkpoint=f"{path}/checkpoint",
        failed_path=f"{path}/failed",
        metrics_path=f"{path}/runs",
        compression=PACKED,
    )
    run.awaitTermination()
    a = F.col("attributes")
    counts = ("raw_count", "clean_count", "removed_count", "error_count")
    runs = spark.read.parquet(f"{path}/runs").where(a["error"].isNull())
    sums = runs.agg(*(F.sum(a[c].cast("bigint")).cast("bigint").alias(c) for c in counts))
    failed = spark.read.parquet(f"{path}/failed").agg((F.count(F.lit(1)) > 0).alias("kept_aside"))
    return sums.withColumn("kept_aside", failed.scalar())


@query
def arriving_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One output per file, named after it; the same files taken again by another stream change nothing."""
    path = scratch_path(spark, "arrivals")
    raw = raw_listings(spark, sf_dir)
    part = F.pmod(F.length(fn.strip("neighbourhood")), F.lit(3))
    sources.write_text_csv(raw.withColumn("part", part), f"{path}/in", by="part", compression=PACKED)
    files = spark.read.format("binaryFile").load(f"{path}/in/*").select("path")
    at_once = max(2, -(-files.count() // 8))  # eight batches at most, however many files there are
    for checkpoint in ("first", "again"):
        streaming.transform_arrivals(
            spark, f"{path}/in/*", output_path=f"{path}/out", checkpoint=f"{path}/{checkpoint}", max_files=at_once,
            compression=PACKED,
        ).awaitTermination()
    part_of = F.regexp_extract("path", "part=([0-9]+)", 1)
    names = files.select(part_of.alias("part"), streaming.arrival_output("path").alias("output"))
    out = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"{path}/out")
    counts = out.groupBy("output").agg(F.count(F.lit(1)).alias("rows"))
    return names.join(counts, "output", "left").groupBy("part").agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("clean_rows")
    )


@query
def replayed_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per listing after a load that fails behind its commit and a stream that starts anew."""
    path = scratch_path(spark, "arrivals")
    files = arriving(spark, sf_dir, 3)
    sources.write_listings_csv(cleaned(spark, sf_dir, parts=files), f"{path}/in", PACKED)

    def run(checkpoint: str, metrics: str) -> None:
        streaming.load_arrivals(
            spark, f"{path}/in", staging_path=f"{path}/staging", target_path=f"{path}/target",
            reject_path=f"{path}/rejects", checkpoint=f"{path}/{checkpoint}", metrics_path=metrics, max_files=files - files // 3,
        ).awaitTermination()

    try:
        run("first", "nowhere://cannot/be/written")  # fails with the first batch committed
    except StreamingQueryException:
        pass
    run("first", f"{path}/runs")
    run("second", f"{path}/runs")
    held = sources.read_target(spark, f"{path}/target").groupBy("id").agg(F.count(F.lit(1)).alias("copies"))
    return held.groupBy("copies").agg(F.count(F.lit(1)).alias("listings"))


@query
def event_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads as events ask for them, run twice: replaced rows, counted text, rejects aside."""
    path = scratch_path(spark, "events")
    rows = staging_rows(raw_listings(spark, sf_dir))
    sources.write_text_csv(sources.listing_text(rows), f"{path}/in/all.csv", compression=PACKED)
    sources.write_text_csv(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), f"{path}/in/nations.csv")
    wanted = [
        '{"s3Bucket": "in", "s3Key": "all.csv", "pruneTargetTable": "false"}',
        '{"s3Bucket": "in", "s3Key": "nations.csv", "target": "sqlite"}',
        '{"s3Key": "nowhere.csv"}',
    ]
    events = spark.createDataFrame([(e,) for e in wanted], "event string")
    for _ in range(2):
        plans.load_from_events(
            spark,
            events,
            lambda bucket, key: f"{path}/{bucket}/{key}",
            staging_path=f"{path}/staging",
            target_path=f"{path}/target",
            text_path=f"{path}/text",
            metrics_path=f"{path}/runs",
            reject_path=f"{path}/rejects",
        )
    a = F.col("attributes")
    runs = spark.read.parquet(f"{path}/runs").agg(F.max(a["rows_loaded"].cast("bigint")).alias("rows_loaded"))
    count = F.count(F.lit(1))
    counted = {
        "target_rows": sources.read_target(spark, f"{path}/target"),
        "text_rows": sources.read_text_loads(spark, f"{path}/text"),
        "rejected": spark.read.parquet(f"{path}/rejects"),
    }
    return runs.withColumns({name: rows.agg(count).scalar() for name, rows in counted.items()})
