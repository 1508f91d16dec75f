"""CSV dialect, staging and target tables, and the jobs over them."""

import csv
import gzip
import io
import json
import random
from datetime import datetime
from itertools import product
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hearthline import operators as ops
from hearthline import plans, sources, streaming
from hearthline.schema import LISTING_COLUMNS, RAW_COLUMNS, SEQUENCE_COLUMN
from hearthline.session import shared_root
from hearthline.sources import csv_records
from hearthline.sources.csv_records import leaves_inside

HEADER = "id,name,price,host_id,city,description,zipcode\r\n"
AWKWARD = (
    HEADER.encode()
    + b'1,"a, ""b""\r\n c ",$5,9,Seattle,x,98101\r\n'
    + b'2,"ends in \\",$6,9,,"y, z",98102\r\n'
    + b"\r\n"
    + b"3,short,$7,9\r\n"
    + b"4,long,$8,9,Seattle,x,98101,extra,more\r\n"
    + b"5,b\xffad,$9,9,Seattle,x,98101\r\n"
    + b"  ,,$5,9,Seattle,x,98101\r\n"
    + b" ,named,$5,9,Seattle,x,98101\r\n"
    + b"6,free,$0,9,Seattle,x,98101\r\n"
    + b'7,dear,"$10,001",9,Seattle,x,98101\r\n'
    + b"8,trailing,$5,9,Seattle,,\r\n"
    + b"9,short too,$5,9,Seattle,\r\n"
)


@pytest.fixture
def awkward(tmp_path):
    path = tmp_path / "listings.csv"
    path.write_bytes(AWKWARD)
    return str(path)


def by_id(rows):
    return {r["id"].strip(): r for r in rows}


def test_reader_keeps_records_whole(spark, awkward):
    rows = sources.read_raw_listings(spark, awkward).collect()
    assert len(rows) == 11
    found = by_id(rows)
    # The parser reads a file's own line end as \n inside quotes too.
    assert found["1"]["name"] == 'a, "b"\n c '
    assert (found["2"]["name"], found["2"]["city"], found["2"]["description"]) == ("ends in \\", "", "y, z")
    assert (found["3"]["host_id"], found["3"]["city"], found["3"]["zipcode"]) == ("9", None, None)
    assert found["4"]["zipcode"] == "98101"
    assert found["5"]["name"] == "bad"
    assert (found["8"]["description"], found["8"]["zipcode"]) == ("", "")
    assert (found["9"]["description"], found["9"]["zipcode"]) == ("", None)


def test_reader_agrees_with_the_csv_module(spark, awkward):
    text = AWKWARD.decode("utf-8", errors="ignore").replace("\r\n", "\n")
    expected = list(csv.DictReader(text.splitlines(keepends=True)))
    names = text.split("\n")[0].split(",")
    rows = sources.read_raw_listings(spark, awkward, position=True).orderBy("_row").collect()
    assert [tuple(r[n] for n in names) for r in rows] == [tuple(e[n] for n in names) for e in expected]


def python_rows(data, end):
    """What Python's csv makes of the bytes of a file, its own line end read as LF."""
    text = data.decode("utf-8", errors="ignore").removeprefix("\ufeff").replace(end, "\n")
    return [r for r in csv.reader(io.StringIO(text, newline="\n")) if r][1:]


def messy(seed, end, many=50):
    rng = random.Random(seed)
    pieces = [
        "plain", "", '"a, b"', '"x ""y"" z"', f'"line{end}break"', f'"{end}{end}"', '"long ' + "w " * 30 + '"', "\\",
        '5" wide', 'x"', 'a"b"c', '"closed"after', '"closed" "again"', 'x""', '""', '"""q"""', "\x01", "\x010,\x011", "\u00e9",
    ]
    rows = [f"{i},{rng.choice(pieces)},{rng.choice(pieces)}" for i in range(many)]
    rows += ["60", '"61","q"', "", "62,a,b,extra,more", "63,,"]
    rng.shuffle(rows)
    return rows


def split_by(spark, size):
    settings = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0"}
    settings["spark.sql.files.minPartitionNum"] = "1"
    for key, value in settings.items():
        spark.conf.set(key, value)
    return settings


@pytest.mark.parametrize("size", [7, 16, 40, 100, 1 << 27])
@pytest.mark.parametrize(("end", "last"), [("\r\n", True), ("\n", False), ("\r", True)])
def test_records_are_those_of_the_csv_module(spark, tmp_path, size, end, last):
    """Files read whole or in splits of any size give the rows of Python's csv."""
    expected = []
    for k, header in enumerate(["id,v,z", "ID,V,Z"]):
        rows = messy(size + k, end, many=10 if size < 40 else 50) + (['70,"cr\rx","cr\r\nlf"'] if end == "\n" else [])
        data = (header + end + end.join(rows) + end * last).encode()
        data = b"\xef\xbb\xbf" + data if k == 1 else data
        (tmp_path / f"{k}.csv").write_bytes(data)
        expected += [tuple((r + [None] * 3)[:3]) for r in python_rows(data, end)]
    settings = split_by(spark, size)
    try:
        read = sources.read_raw_listings(spark, str(tmp_path), position=True)
        rows = read.orderBy("_file", "_block", "_row").collect()
        assert [tuple(r)[:3] for r in rows] == expected
    finally:
        for key in settings:
            spark.conf.unset(key)


@pytest.mark.parametrize("size", [9, 1 << 27])
def test_an_open_quote_is_an_error(spark, tmp_path, size):
    (tmp_path / "a.csv").write_bytes(b'id,v\n1,"never closed\n' + b"2,x\n" * 400)
    settings = split_by(spark, size)
    try:
        with pytest.raises(Exception, match="never closed"):
            sources.read_raw_listings(spark, str(tmp_path)).collect()
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_lines_as_records(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'\nid,v\n1,"a, b"\n2,5" wide\n\n3\n')
    rows = sources.read_raw_listings(spark, str(tmp_path), multiline=False).collect()
    assert sorted(map(tuple, rows)) == [("1", "a, b"), ("2", '5" wide'), ("3", None)]


def test_files_of_one_folder_end_lines_in_their_own_ways(spark, tmp_path):
    header = "id,v," + "z" * 70_000  # longer than any prefix one might look at
    for k, end in enumerate(["\n", "\r\n", "\r"]):
        text = end.join([header, f'{k}0,"a{end}b",x', f"{k}1,plain,y", ""])
        (tmp_path / f"{k} x.csv").write_bytes(text.encode())
    for size in (1 << 15, 1 << 27):
        settings = split_by(spark, size)
        try:
            rows = sorted(map(tuple, sources.read_raw_listings(spark, str(tmp_path)).collect()))
        finally:
            for key in settings:
                spark.conf.unset(key)
        assert rows == sorted(r for k in range(3) for r in [(f"{k}0", "a\nb", "x"), (f"{k}1", "plain", "y")])
    by_line = sources.read_raw_listings(spark, str(tmp_path / "1 x.csv"), multiline=False)
    assert by_line.count() == 3


def test_byte_order_mark_is_dropped(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbf" + AWKWARD)
    assert sources.header_names(spark, str(tmp_path / "a.csv"))[0] == "id"


def test_accounting_of_awkward_rows(spark, awkward):
    raw = sources.read_raw_listings(spark, awkward)
    scale = ops.row_accounting(raw, "scale").first().asDict()
    assert scale == {"raw_count": 11, "clean_count": 5, "removed_count": 6, "error_count": 2}
    kept = by_id(ops.transform_listings(raw).collect())
    assert set(kept) == {"1", "2", "4", "5", "8"}
    assert kept["1"]["name"] == 'a, "b" c'
    assert kept["2"]["city"] == ""
    assert kept["1"]["state"] == "WA"  # no such column in the file
    assert kept["1"]["bed_type"] == "Unknown" and kept["1"]["maximum_nights"] == 365


def test_gate_order_differs_between_variants(spark):
    rows = [(None, "n", "free"), (" ", None, "free"), (" ", "", "$5"), ("1", "n", "$10,000"), ("1", "n", "$10,000.01")]
    raw = spark.createDataFrame(rows, "id string, name string, price string")
    scale = ops.row_accounting(raw, "scale").first()
    base = ops.row_accounting(raw, "base").first()
    assert (scale.clean_count, scale.error_count) == (1, 0)
    assert (base.clean_count, base.error_count) == (1, 2)


def test_variants_differ_on_absent_and_apt(spark):
    raw = spark.createDataFrame([("1", "$9", "Studio apt")], "id string, price string, room_type string")
    base = ops.transform_listings(raw, "base").first()
    scale = ops.transform_listings(raw, "scale").first()
    assert (base.accommodates, scale.accommodates) == (0, 1)
    assert (base.price_per_guest, scale.price_per_guest) == (9.0, 9.0)
    assert (base.room_type_simplified, scale.room_type_simplified) == ("Entire", "Other")


def test_names(spark, tmp_path):
    assert sources.sanitized_names(["a b", " x ", "", "\xe9"]) == ["a_b", "x", "col", "_"]
    with pytest.raises(ValueError, match="clash"):
        sources.sanitized_names(["a b", "a-b"])
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError, match="no header"):
        sources.read_text_table(spark, str(tmp_path / "empty.csv"))


def test_output_names():
    now = datetime(2024, 3, 4, 5, 6, 7)
    assert sources.output_name("scale", now, "listings_2x.csv") == "clean_listings_2x_20240304_050607.csv"
    assert sources.output_name("arch", now, architecture="arm64") == "clean_listings_arm64_20240304_050607.csv"
    assert sources.output_name("base", now) == "clean_listings_20240304_050607.csv"


def test_csv_text_reads_back(spark, tmp_path):
    values = ['q"uote', "com,ma", "line\nbreak", " blanks ", "back\\slash\\", "", "tab\t", "cr\rx", "cr\r\nlf", '"', "\xe9"]
    df = spark.createDataFrame([(str(i), v, "end") for i, v in enumerate(values)], "id string, v string, z string")
    path = str(tmp_path / "out.csv")
    sources.write_text_csv(df.coalesce(1), path)
    back = sources.read_raw_listings(spark, path).collect()
    assert {r.id: r.v for r in back} == {str(i): v for i, v in enumerate(values)}
    assert {r.z for r in back} == {"end"}


def test_transform_job(spark, awkward, tmp_path):
    now = datetime(2024, 3, 4, 5, 6, 7)
    result = plans.run_transform(spark, awkward, str(tmp_path / "clean"), now=now)
    assert result.output.endswith("/clean_listings_20240304_050607.csv")
    run = result.metrics.record()
    assert (run["raw_count"], run["clean_count"], run["removed_count"], run["error_count"]) == (11, 5, 6, 2)
    assert run["avg_price"] == round((5 + 6 + 8 + 9 + 5) / 5, 2)
    marks = ["start_read", "end_read", "start_transform", "end_transform", "start_save", "end_save"]
    assert [run[m] for m in marks] == sorted(run[m] for m in marks)
    back = sources.read_raw_listings(spark, result.output)
    assert back.columns == LISTING_COLUMNS and back.count() == 5
    assert {r.price for r in back.collect()} == {"5.0", "6.0", "8.0", "9.0"}


def test_numbered_transform_keeps_ties_in_file_order(spark, tmp_path):
    lines = ["id,name,price"] + [f"{i},row {n},$5" for n, i in enumerate(["10", "9", "x", "9", "007", "y", "10"])]
    (tmp_path / "listings.csv").write_text("\n".join(lines) + "\n")
    result = plans.run_transform(
        spark, str(tmp_path / "listings.csv"), str(tmp_path / "out"), variant="arch", architecture="arm64"
    )
    back = sources.read_raw_listings(spark, result.output)
    assert back.columns == [SEQUENCE_COLUMN, *LISTING_COLUMNS]
    rows = sorted(back.collect(), key=lambda r: int(r[SEQUENCE_COLUMN]))
    assert [r.name for r in rows] == ["row 2", "row 5", "row 4", "row 1", "row 3", "row 0", "row 6"]
    assert [int(r[SEQUENCE_COLUMN]) for r in rows] == list(range(1, 8))
    # The load goes by header name, so the extra first column does not shift the rest.
    plans.load_listings(spark, result.output, str(tmp_path / "st"), str(tmp_path / "tg"))
    target = sources.read_target(spark, str(tmp_path / "tg")).collect()
    assert {r.id for r in target} == {"10", "9", "x", "007", "y"}


def test_nothing_is_written_without_valid_rows(spark, tmp_path):
    (tmp_path / "listings.csv").write_text("id,price\n1,$0\n")
    with pytest.raises(plans.NoValidRecords):
        plans.run_transform(spark, str(tmp_path / "listings.csv"), str(tmp_path / "out"))
    assert not list((tmp_path / "out").glob("*"))


def listing_rows(spark, ids, price="5"):
    raw = spark.createDataFrame([(str(i), f"${price}") for i in ids], "id string, price string")
    return ops.transform_listings(raw)


def target_ids(spark, path):
    return sorted(int(r.id) for r in sources.read_target(spark, path).collect())


def test_load_modes(spark, tmp_path):
    staging, target = str(tmp_path / "staging"), str(tmp_path / "target")

    def load(ids, **options):
        return plans.load_listings(spark, listing_rows(spark, ids), staging, target, **options)

    assert load([1, 2]).metrics.attributes["inserted"] == 2
    assert load([3], prune=False, load_id="a").metrics.attributes["inserted"] == 1
    assert target_ids(spark, target) == [1, 2, 3]
    load([3, 4], prune=False, load_id="a")  # the same load again
    assert target_ids(spark, target) == [1, 2, 3, 4]
    result = load([2, 5], prune=False, new_only=True)
    assert (result.metrics.attributes["staging_count"], result.metrics.attributes["inserted"]) == (2, 1)
    assert target_ids(spark, target) == [1, 2, 3, 4, 5]
    load([9])
    assert target_ids(spark, target) == [9]


def test_failed_load_leaves_the_target(spark, tmp_path, monkeypatch):
    staging, target, metrics = (str(tmp_path / n) for n in ("staging", "target", "metrics"))
    plans.load_listings(spark, listing_rows(spark, [1, 2]), staging, target)
    from hearthline.plans import load as load_module

    def broken(rows, lenient):
        return rows.select(F.raise_error(F.lit("boom")).cast("string").alias("id"))

    monkeypatch.setattr(load_module, "typed_listings", broken)
    with pytest.raises(Exception, match="boom"):
        plans.load_listings(spark, listing_rows(spark, [3]), staging, target, metrics_path=metrics)
    assert target_ids(spark, target) == [1, 2]
    assert "boom" in spark.read.parquet(metrics).first().attributes["error"]


def test_bad_rows(spark):
    rows = [("1", "x1", "$5"), ("2", "5", "abc"), ("3", None, "$5"), ("4", None, "abc"), ("5", "7", "$1,234.5")]
    staging = spark.createDataFrame(rows, "id string, host_id string, price string")
    assert [r.id for r in ops.bad_rows(staging).collect()] == ["1", "2", "4"]
    many = spark.range(200).select(F.col("id").cast("string"), F.lit("x").alias("host_id"), F.lit("1").alias("price"))
    assert ops.bad_rows(many).count() == 50 and ops.bad_rows(many, limit=None).count() == 200


def test_sub_scores_need_the_lenient_option(spark):
    raw = spark.createDataFrame([("1", "$5", "10")], "id string, price string, review_scores_accuracy string")
    cleaned = ops.transform_listings(raw)
    for staging in (cleaned, sources.listing_text(cleaned)):
        assert ops.typed_listings(staging).first().review_scores_accuracy is None
        assert ops.typed_listings(staging, lenient_int=True).first().review_scores_accuracy == 10


def test_text_table_keeps_empty_and_missing_apart(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,some name\n1,\n2\n")
    run = plans.load_text_table(spark, str(tmp_path / "a.csv"), str(tmp_path / "table"))
    assert run.record()["operation"] == "text_load"
    rows = {r.k: r.some_name for r in spark.read.parquet(str(tmp_path / "table")).collect()}
    assert rows == {"1": "", "2": None}


def test_streamed_loads_equal_one_batch_load(spark, tmp_path):
    folder = tmp_path / "in"
    cleaned = listing_rows(spark, range(40))
    sources.write_listings_csv(cleaned.repartition(4), str(folder))
    paths = {n: str(tmp_path / n) for n in ("staging", "target", "rejects", "checkpoint")}

    def run():
        streaming.load_arrivals(
            spark,
            str(folder),
            staging_path=paths["staging"],
            target_path=paths["target"],
            reject_path=paths["rejects"],
            checkpoint=paths["checkpoint"],
            max_files=1,
        ).awaitTermination()

    run()
    assert target_ids(spark, paths["target"]) == list(range(40))
    rejects = sources.read_part(spark, paths["target"], "rejects", "id string, host_id string, price string")
    assert rejects.count() == 40  # these listings have no host
    run()  # no new files, nothing changes
    assert target_ids(spark, paths["target"]) == list(range(40))
    sources.write_listings_csv(listing_rows(spark, [99]), str(tmp_path / "more"))
    for part in (tmp_path / "more").glob("part-*.csv"):
        part.rename(folder / f"late-{part.name}")
    run()
    assert target_ids(spark, paths["target"]) == [*range(40), 99]


def test_streamed_transform_equals_batch(spark, tmp_path):
    raw = spark.createDataFrame([(str(i), f"${i}") for i in range(20)], "id string, price string")
    sources.write_text_csv(raw.repartition(3), str(tmp_path / "in"))
    streaming.transform_arrivals(
        spark,
        str(tmp_path / "in"),
        output_path=str(tmp_path / "out"),
        checkpoint=str(tmp_path / "checkpoint"),
    ).awaitTermination()
    out = spark.read.option("header", True).csv(str(tmp_path / "out"))
    batch = sources.listing_text(ops.transform_listings(raw))
    assert sorted(r.id for r in out.collect()) == sorted(r.id for r in batch.collect())
    assert {r.price for r in out.collect()} == {f"{i}.0" for i in range(1, 20)}


def test_loads_follow_their_events(spark, tmp_path):
    for name, ids in {"a b.csv": [1, 2], "c.csv": [3], "d.csv": [4]}.items():
        sources.write_listings_csv(listing_rows(spark, ids), str(tmp_path / "in" / name))
    events = [
        '{"s3Bucket": "in", "s3Key": "a+b.csv"}',
        '{"detail": {"bucket": {"name": "in"}, "object": {"key": "c.csv"}, "pruneTargetTable": false}}',
        '{"s3Bucket": "in", "s3Key": "d.csv", "target": "SQLite"}',
        '{"s3Bucket": "in"}',
    ]
    df = spark.createDataFrame([(e,) for e in events], "event string").coalesce(1)
    runs = plans.load_from_events(
        spark,
        df,
        lambda bucket, key: str(tmp_path / bucket / key),
        staging_path=str(tmp_path / "staging"),
        target_path=str(tmp_path / "target"),
        text_path=str(tmp_path / "text"),
    )
    assert [r.operation for r in runs] == ["bulk_load", "bulk_load", "text_load"]
    assert target_ids(spark, str(tmp_path / "target")) == [1, 2, 3]
    assert [r.id for r in spark.read.parquet(str(tmp_path / "text")).collect()] == ["4"]


def test_files_with_another_header_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n")
    (tmp_path / "b.csv").write_text("name,id\nx,1\n")
    for size in ("128m", "1"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            with pytest.raises(Exception, match="header"):
                sources.read_raw_listings(spark, str(tmp_path)).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_write_scales(spark, tmp_path):
    rows = "".join(f"{i},https://h/rooms/{i},$5\n" for i in (3, 7))
    (tmp_path / "listings.csv").write_text("id,listing_url,price\n" + rows)
    summary = plans.write_scales(spark, str(tmp_path / "listings.csv"), str(tmp_path / "out"), [2])
    assert [(r.multiplier, r.records) for r in summary.orderBy("multiplier").collect()] == [(1, 2), (2, 4)]
    back = sources.read_raw_listings(spark, str(tmp_path / "out" / "listings_2x.csv"))
    assert sorted((r.id, r.listing_url) for r in back.collect()) == [
        ("10", "https://h/rooms/10"), ("14", "https://h/rooms/14"),
        ("3", "https://h/rooms/3"), ("7", "https://h/rooms/7"),
    ]


def test_report(spark, tmp_path):
    rows = [("1", "$50", "A"), ("2", "$100", "A"), ("3", "$400", "B")]
    raw = spark.createDataFrame(rows, "id string, price string, neighbourhood string")
    typed = ops.typed_listings(ops.transform_listings(raw))
    report = plans.run_report(typed, limit=1, metrics_path=str(tmp_path / "runs"))
    assert report["summary"]["total_listings"] == 3
    assert report["summary"]["min_price"] == 50.0
    assert [n["neighbourhood"] for n in report["top_neighbourhoods"]] == ["A"]
    assert {p["price_category"]: p["num_listings"] for p in report["price_categories"]} == {
        "budget": 1, "moderate": 1, "luxury": 1,
    }
    assert json.loads(json.dumps(report)) == report
    assert set(report["timings_ms"]) >= {"summary", "top_neighbourhoods", "total"}
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 1


def test_reports_on_an_empty_table(spark):
    raw = spark.createDataFrame([], "id string, price string")
    typed = ops.typed_listings(ops.transform_listings(raw))
    assert plans.summary(typed).first().total_listings == 0
    rows = plans.report_rows(typed).collect()
    assert [(r.section, r.num_listings) for r in rows] == [("summary", 0)]


def test_zero_ratings_count_unless_asked(spark):
    raw = spark.createDataFrame(
        [("1", "$5", "90"), ("2", "$5", "")], "id string, price string, review_scores_rating string"
    )
    typed = ops.typed_listings(ops.transform_listings(raw))
    assert float(plans.summary(typed).first().avg_rating) == 45.0
    assert float(plans.summary(typed, zero_as_null=True).first().avg_rating) == 90.0


def test_jdbc_options():
    options = sources.jdbc_options("jdbc:x", "t", key="id", key_range=(1, 100), partitions=4)
    assert options["partitionColumn"] == "id" and options["numPartitions"] == "4"
    assert "partitionColumn" not in sources.jdbc_options("jdbc:x", "t")


def test_shared_root_is_read_from_the_session(spark):
    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert RAW_COLUMNS == LISTING_COLUMNS[:60] and len(LISTING_COLUMNS) == 68


def target_rows(spark, path):
    return sorted(r.id for r in sources.read_target(spark, path).collect())


def test_a_failed_repeat_keeps_the_earlier_rows(spark, tmp_path):
    path = str(tmp_path / "target")
    rows = spark.createDataFrame([("1", "$50"), ("2", "$60")], "id string, price string")
    typed = ops.typed_listings(ops.transform_listings(rows))
    sources.append_target(typed, path, "a")
    sources.append_target(typed.limit(1), path, "b")
    broken = typed.withColumn("id", F.raise_error(F.lit("lost")).cast(typed.schema["id"].dataType))
    for write in (sources.append_target, sources.replace_target):
        with pytest.raises(Exception, match="lost"):
            write(broken, path, "a")
        assert len(target_rows(spark, path)) == 3
    sources.append_target(typed.limit(1), path, "a")  # a repeat replaces its own rows
    assert len(target_rows(spark, path)) == 2


def test_readers_see_the_old_table_or_the_new_one(spark, tmp_path):
    path = str(tmp_path / "target")
    rows = spark.createDataFrame([("1", "$50"), ("2", "$60")], "id string, price string")
    typed = ops.typed_listings(ops.transform_listings(rows))
    sources.append_target(typed, path, "a")
    before = sources.read_target(spark, path)
    sources.replace_target(typed.limit(1), path, "b")
    assert before.count() == 2 and sources.read_target(spark, path).count() == 1
    sources.vacuum_target(spark, path)
    assert set(sources.target_loads(spark, path)) == {"b"} and sources.read_target(spark, path).count() == 1
    assert [p.name for p in (tmp_path / "target" / "data").glob("*/*")] != []
    with pytest.raises(FileNotFoundError):
        sources.read_target(spark, str(tmp_path / "nothing"))


def test_a_numbered_transform_leaves_no_scratch(spark, tmp_path):
    (tmp_path / "listings.csv").write_text("id,name,price\n2,b,$5\n1,a,$6\n")
    root = Path(shared_root(spark))
    before = {p.name for p in root.iterdir()} if root.exists() else set()
    plans.run_transform(spark, str(tmp_path / "listings.csv"), str(tmp_path / "out"), variant="arch")
    assert {p.name for p in root.iterdir()} - before == set()


def test_numbered_arrivals_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="whole table"):
        streaming.transform_arrivals(
            spark, str(tmp_path), output_path="o", checkpoint="c", variant="arch"
        )


def test_ids_of_any_length_are_shifted(spark):
    ids = ["1", "9" * 39, "9" * 200, "12" * 60, "0", "x", "0" * 50 + "7"]
    rows = spark.createDataFrame([(i, f"u/rooms/{i}") for i in ids], "id string, listing_url string")
    top = int("9" * 200)
    wanted = [str(int(i) + k * top) if i.isdigit() else i for i in ids for k in range(3)]
    copies = ops.replicate(rows, 3)
    assert sorted(r.id for r in copies.collect()) == sorted(wanted)
    assert all(r.listing_url == f"u/rooms/{r.id}" for r in copies.collect())
    size = sum(len(i) + len(f"u/rooms/{i}") for i in wanted)
    assert ops.scale_summary(rows, [3]).where("multiplier = 3").first()[:] == (3, 21, size)


def test_largest_id_of_any_length(spark):
    rows = spark.createDataFrame([("9" * 39,), ("+1_" + "0" * 60,), ("-" + "5" * 90,), (None,)], "id string")
    assert rows.agg(ops.largest_id_text("id")).first()[0] == "1" + "0" * 60
    assert rows.where("id is null").agg(ops.largest_id_text("id")).first()[0] == "0"
    with pytest.raises(Exception, match="38 digits"):
        rows.agg(ops.largest_id("id")).collect()


def test_both_entrances_of_typing_agree(spark, awkward):
    cleaned = ops.transform_listings(sources.read_raw_listings(spark, awkward))
    direct = ops.typed_listings(cleaned).collect()
    staged = ops.typed_listings(sources.listing_text(cleaned)).collect()
    assert sorted(map(repr, direct)) == sorted(map(repr, staged))


def test_packed_files_hold_bounded_rows_and_read_alike(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("hearthline.sources.csv.FILE_ROWS", 7)
    rows = spark.createDataFrame([(str(i), f'a, "{i}"\nb') for i in range(50)], "id string, name string").coalesce(1)
    path = str(tmp_path / "in.csv")
    sources.write_text_csv(rows, path, compression="gzip")
    assert len(list((tmp_path / "in.csv").glob("part-*.csv.gz"))) == 8
    assert sorted(sources.read_raw_listings(spark, path).collect()) == sorted(rows.collect())


def test_scales_are_packed(spark, tmp_path):
    lines = "".join(f'{i},https://x/rooms/{i},$5,"{"words " * 200}"\n' for i in range(1, 200))
    (tmp_path / "listings.csv").write_text("id,listing_url,price,description\n" + lines)
    sizes = {}
    for kind in ("none", "gzip"):
        summary = plans.write_scales(spark, str(tmp_path / "listings.csv"), str(tmp_path / kind), [2], compression=kind)
        sizes[kind] = {r.multiplier: (r.records, r.size_mb) for r in summary.collect()}
        assert sources.read_raw_listings(spark, f"{tmp_path}/{kind}/listings_2x.csv").distinct().count() == 398
    assert sizes["gzip"][2][0] == sizes["none"][2][0] == 398 and sizes["gzip"][2][1] * 10 < sizes["none"][2][1]


def test_transform_writes_packed_files(spark, tmp_path):
    raw = spark.createDataFrame([(str(i), "n", f"${i}") for i in range(1, 9)], "id string, name string, price string")
    done = plans.run_transform(spark, raw, str(tmp_path / "out"), variant="arch", compression="gzip")
    assert list(Path(done.output.removeprefix("file:")).glob("part-*.csv.gz"))
    back = sources.read_raw_listings(spark, done.output)
    assert sorted(r.price for r in back.collect()) == sorted(f"{i}.0" for i in range(1, 9))


def test_lines_leave_quotes_open_as_csv_reads_them():
    for n in range(6):
        for chars in product('a",\r', repeat=n):
            line = "".join(chars)
            for inside in (False, True):
                text = ('"' if inside else "") + line.replace("\r", "r")
                # A second line is a record of its own unless the first has left a quote open.
                alone = len(list(csv.reader([f"{text}\n", "z\n"]))) == (2 if text else 1) or not text
                assert leaves_inside(line, inside) is not alone, (line, inside)


def test_a_bad_file_costs_few_runs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(16):
        (tmp_path / "in" / f"{k:02d}.csv").write_text("id,price\n" + ('9,"never closed\n' if k == 5 else f"{k + 1},$5\n"))
    streaming.transform_arrivals(
        spark, str(tmp_path / "in"), output_path=str(tmp_path / "out"), checkpoint=str(tmp_path / "checkpoint"),
        failed_path=str(tmp_path / "failed"), metrics_path=str(tmp_path / "runs"), compression="gzip",
    ).awaitTermination()
    aside = spark.read.parquet(str(tmp_path / "failed")).collect()
    assert [r.path.rsplit("/", 1)[1] for r in aside] == ["05.csv"] and "never closed" in aside[0].error
    runs = [r.attributes for r in spark.read.parquet(str(tmp_path / "runs")).collect()]
    assert len(runs) == 9
    assert sum(int(a["clean_count"]) for a in runs if a.get("error") is None) == 15
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 15


def test_packed_files_arrive(spark, tmp_path):
    sources.write_listings_csv(listing_rows(spark, range(20)).repartition(2), str(tmp_path / "in"), "gzip")
    streaming.load_arrivals(
        spark, str(tmp_path / "in"), staging_path=str(tmp_path / "staging"), target_path=str(tmp_path / "target"),
        reject_path=str(tmp_path / "rejects"), checkpoint=str(tmp_path / "checkpoint"), max_files=1,
    ).awaitTermination()
    assert target_ids(spark, str(tmp_path / "target")) == list(range(20))
    name = spark.range(1).select(streaming.arrival_output(F.lit("/in/a.csv.gz"))).first()[0]
    assert name.startswith("clean_a_") and name.endswith(".csv")


def scans(spark, read):
    """Jobs that ``read`` starts to find out about its files, and the plan it returns."""
    group = f"scans-{random.random()}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        df = read()
    finally:
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext._jsc.clearJobGroup()
    return jobs, df._jdf.queryExecution().executedPlan().toString()


def test_packed_files_are_read_once(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), f'a, "{i}"\r\nb') for i in range(50)], "id string, name string")
    path = str(tmp_path / "in.csv")
    sources.write_text_csv(rows, path, compression="gzip")
    jobs, plan = scans(spark, lambda: sources.read_raw_listings(spark, path))
    assert plan.count("FileScan") == plan.count("FileScan binaryFile") == 1 and "Join" not in plan
    assert jobs <= 4  # the header, and the kinds of files; no pass over the text
    assert sorted(sources.read_raw_listings(spark, path).collect()) == sorted(rows.collect())


@pytest.mark.parametrize("chunk", [64, 1 << 22])
@pytest.mark.parametrize("end", ["\r\n", "\n", "\r"])
def test_records_of_packed_files_are_those_of_the_csv_module(tmp_path, monkeypatch, end, chunk):
    monkeypatch.setattr(csv_records, "_CHUNK", chunk)
    for seed in range(20):
        rows = messy(seed, end) + ([] if seed % 2 else ["71,b\udcffad\udce2\udc82,�"])
        rows = [r for r in rows if seed % 3 or r != "62,a,b,extra,more"]
        rows += ['70,"cr\rx","cr\r\nlf"'] if end == "\n" and seed % 4 == 0 else []
        rows += ['72,"cr\r\nlf",x'] if end == "\n" and seed % 4 == 1 else []
        data = (f"id,V,z{end}" + end.join(rows)).encode("utf-8", "surrogateescape")
        data = b"\xef\xbb\xbf" + data if seed % 5 == 0 else data
        batch = pa.RecordBatch.from_arrays([pa.array(["f"]), pa.array([gzip.compress(data)])], ["file", "content"])
        found = [r for b in csv_records._unpacked(["id", "v", "z"], True, True)(iter([batch])) for r in b.to_pylist()]
        expected = [tuple((r + [None] * 3)[:3]) for r in python_rows(data.replace("�".encode(), b""), end)]
        assert [tuple(r.values())[:3] for r in found] == expected
        assert [r["_row"] for r in found] == list(range(len(found)))


def test_packed_and_plain_files_of_one_folder(spark, tmp_path):
    (tmp_path / "a, b.csv.gz").write_bytes(gzip.compress(b'id,v\n1,"x\ny"\n2\n'))
    (tmp_path / "c.csv").write_bytes(b"id,v\n3,z\n")
    read = sources.read_raw_listings(spark, str(tmp_path), position=True)
    assert sorted(map(tuple, read.select("id", "v").collect())) == [("1", "x\ny"), ("2", None), ("3", "z")]
    assert sorted(r._file.rsplit("/", 1)[1] for r in read.collect()) == ["a,%20b.csv.gz"] * 2 + ["c.csv"]
    for text, why in ((b'id,v\n4,"open\n5,x\n', "never closed"), (b'id,v\n4\n5,"open\n', "never closed"), (b"v,id\n4,x\n", "another header")):
        (tmp_path / "d.csv.gz").write_bytes(gzip.compress(text))
        with pytest.raises(Exception, match=why):
            sources.read_raw_listings(spark, str(tmp_path)).collect()


def test_few_packed_files_are_shared_by_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(csv_records, "SHARE_BYTES", 1 << 10)
    monkeypatch.setattr(csv_records, "_STRETCH", 7)
    monkeypatch.setattr(csv_records, "PACKED_TASKS", 8)
    rng = random.Random(5)
    rows = [(str(i), f'{rng.random()}, "x"\r\n{i}') for i in range(4000)]
    path = str(tmp_path / "in.csv")
    sources.write_text_csv(spark.createDataFrame(rows, "id string, name string").repartition(3), path, compression="gzip")
    read = sources.read_raw_listings(spark, path, position=True)
    assert sorted(map(tuple, read.select("id", "name").collect())) == sorted(rows)
    tasks = read.withColumn("task", F.spark_partition_id()).groupBy("_file").agg(F.count_distinct("task").alias("n"), F.count_distinct("_row").alias("rows"), F.max("_row").alias("last"))
    assert [(r.n, r.rows - r.last) for r in tasks.collect()] == [(3, 1)] * 3


def test_shares_of_a_file_are_all_its_rows(monkeypatch):
    monkeypatch.setattr(csv_records, "_STRETCH", 3)
    # A short row far behind makes the second parser take over, wherever the first had come to.
    data = b"id,v\n" + b"".join(b'%d,"a\n%d"\n' % (i, i) for i in range(500)) + b"500\n" + b"".join(b"%d,x\n" % i for i in range(501, 600))
    batch = pa.RecordBatch.from_arrays([pa.array(["f"]), pa.array([gzip.compress(data)])], ["file", "content"])
    found = []
    for share, chunk in enumerate((200, 1 << 22, 1000, 64)):
        monkeypatch.setattr(csv_records, "_CHUNK", chunk)
        found += [r for b in csv_records._unpacked(["id", "v"], True, True, share, 4)(iter([batch])) for r in b.to_pylist()]
    assert sorted(int(r["_0"]) for r in found) == list(range(600)) and all(int(r["_0"]) == r["_row"] for r in found)
