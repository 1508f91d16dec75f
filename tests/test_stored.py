"""Tables changed by key, statements of bounded size, slices of a key."""

import random
import sqlite3
from concurrent.futures import ThreadPoolExecutor
from functools import partial

import pytest
from pyspark.sql import functions as F

from hearthline import operators as ops
from hearthline import sources
from hearthline.session import child_names
from hearthline.sources import commits, keyed

CHANGES = "k long, v string, at int"


def table(spark, path):
    return sorted(((r.k, r.v) for r in sources.read_keyed(spark, path).collect()), key=repr)


@pytest.fixture
def numbers(spark, tmp_path):
    path = str(tmp_path / "numbers")
    rows = spark.range(1000).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    sources.write_keyed(rows, path, "k", file_rows=100)
    return path


def test_only_files_with_changed_keys_are_rewritten(spark, numbers):
    before = {r.name: (int(r.low), int(r.high), r.rows) for r in sources.keyed_files(spark, numbers).collect()}
    assert len(before) > 5 and sum(rows for *_, rows in before.values()) == 1000
    changes = spark.createDataFrame([(7, "a", 1), (7, "b", 2), (990, "c", 1)], CHANGES)
    rewritten = sources.upsert_keyed(changes, numbers, "at")
    held = {n for n, (low, high, _) in before.items() if low <= 7 <= high or low <= 990 <= high}
    assert set(rewritten) == held
    after = {r.name for r in sources.keyed_files(spark, numbers).collect()}
    assert after & set(before) == set(before) - held
    wanted = [(k, {7: "b", 990: "c"}.get(k, "old")) for k in range(1000)]
    assert table(spark, numbers) == sorted(wanted, key=repr)


def test_new_and_missing_keys_rewrite_nothing(spark, numbers):
    changes = spark.createDataFrame([(5000, "new", None), (None, "x", 1), (None, "x", 1)], CHANGES)
    assert sources.upsert_keyed(changes, numbers, "at") == []
    assert sources.read_keyed(spark, numbers).count() == 1003
    more = spark.createDataFrame([(None, "y", 1), (5000, "newer", 1)], CHANGES)
    assert len(sources.upsert_keyed(more, numbers, "at")) == 1
    extra = [(k, v) for k, v in table(spark, numbers) if v != "old"]
    assert extra == [(5000, "newer"), (None, "x"), (None, "x"), (None, "y")]


def test_nothing_to_change_makes_no_commit(spark, numbers):
    count = commits.next_number(spark, numbers)
    assert sources.upsert_keyed(spark.createDataFrame([], CHANGES), numbers, "at") == []
    assert commits.next_number(spark, numbers) == count


def test_an_empty_table_takes_changes(spark, tmp_path):
    path = str(tmp_path / "empty")
    sources.write_keyed(spark.createDataFrame([], "k long, v string"), path, "k")
    assert table(spark, path) == []
    sources.upsert_keyed(spark.createDataFrame([(1, "a", 1)], CHANGES), path, "at")
    assert table(spark, path) == [(1, "a")]
    with pytest.raises(FileNotFoundError):
        sources.read_keyed(spark, str(tmp_path / "none"))


def test_text_keys_and_odd_texts(spark, tmp_path):
    path = str(tmp_path / "texts")
    rows = spark.createDataFrame([("", 1), ("a b/%20\n", 1), ("\u00e9", 1), ("z" * 9000, 1)], "k string, v int")
    sources.write_keyed(rows, path, "k", file_rows=1)
    sources.upsert_keyed(spark.createDataFrame([("\u00e9", 2), ("", 2)], "k string, v int"), path, F.lit(1))
    assert {r.k: r.v for r in sources.read_keyed(spark, path).collect()} == {
        "": 2, "a b/%20\n": 1, "\u00e9": 2, "z" * 9000: 1,
    }


def test_a_failed_upsert_changes_nothing_and_can_run_again(spark, numbers, monkeypatch):
    before = table(spark, numbers)
    changes = spark.createDataFrame([(7, "a", 1), (2000, "n", 1)], CHANGES)

    def lost(*args, **kwargs):
        raise OSError("lost")

    monkeypatch.setattr(keyed, "commit", lost)
    with pytest.raises(OSError, match="lost"):
        sources.upsert_keyed(changes, numbers, "at")
    monkeypatch.undo()
    assert table(spark, numbers) == before
    sources.upsert_keyed(changes, numbers, "at")
    after = table(spark, numbers)
    assert (7, "a") in after and (2000, "n") in after and len(after) == 1001
    sources.vacuum_keyed(spark, numbers)
    assert table(spark, numbers) == after
    held = {r.name for r in sources.keyed_files(spark, numbers).collect()}
    left = {f"data/{d}/{n}" for d in child_names(spark, f"{numbers}/data") for n in child_names(spark, f"{numbers}/data/{d}")}
    assert {n for n in left if n.endswith(".parquet")} == held


def test_two_writers_lose_nothing(spark, numbers):
    def put(k):
        changes = spark.createDataFrame([(5, f"w{k}", 1), (100 + k, "w", 1), (3000 + k, "w", 1)], CHANGES)
        sources.upsert_keyed(changes, numbers, "at")

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(put, range(3)))
    after = dict(table(spark, numbers))
    assert all(after[100 + k] == "w" and after[3000 + k] == "w" for k in range(3))
    assert after[5] in ("w0", "w1", "w2") and len(after) == 1003 == len(table(spark, numbers))


def greedy(rows, before, after, limit):
    """Statements as one loop over all rows makes them."""
    texts, text = [], None
    for row in rows:
        if text is not None and len((text + "," + row + after).encode()) <= limit:
            text += "," + row
            continue
        if text is not None:
            texts.append(text + after)
        text = before + row
    return texts + ([text + after] if text is not None else [])


def test_statements_are_cut_by_bytes(spark):
    random.seed(3)
    rows = [(i, random.choice(["", "a'b", "c\\d", "\u00e9" * random.randrange(90), "x" * 700, None])) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, v string").repartition(5)
    got = ops.insert_statements(df, "t", ["k"], stream=F.lit(0), limit=600, ending="AS n").orderBy("statement").collect()

    def text(v):
        return "NULL" if v is None else "'" + v.replace("\\", "\\\\").replace("'", "''") + "'"

    wanted = greedy([f"({k}, {text(v)})" for k, v in rows], "INSERT INTO t (k, v) VALUES ", " AS n", 600)
    assert [r.text for r in got] == wanted
    assert [r.n_bytes for r in got] == [len(t.encode()) for t in wanted] and sum(r.n_rows for r in got) == 500
    assert all(r.n_bytes <= 600 or r.n_rows == 1 for r in got) and [r.statement for r in got] == list(range(len(got)))


def test_statements_of_kinds_of_values(spark):
    df = spark.sql(
        "select 1 as i, 2.5D as d, cast(1.50 as decimal(5,2)) as c, true as b, date'2024-01-02' as t, X'00ff' as x, "
        "cast(null as int) as n"
    )
    text = ops.insert_statements(df, "t", ["i"], verb="REPLACE").first().text
    assert text == "REPLACE INTO t (i, d, c, b, t, x, n) VALUES (1, 2.5, 1.50, true, '2024-01-02', X'00FF', NULL)"
    assert ops.insert_statements(df.where("i = 2"), "t", ["i"]).count() == 0
    with pytest.raises(Exception, match="no SQL text"):
        ops.insert_statements(spark.sql("select double('NaN') as d"), "t", ["d"]).collect()


def test_statements_insert_every_row(spark, tmp_path):
    path = str(tmp_path / "rows.db")
    with sqlite3.connect(path) as connection:
        connection.execute("create table t (k integer, v text)")
    rows = [(i % 40, f"it's \\ {i % 7}\n") for i in range(900)] + [(None, None)] * 2
    df = spark.createDataFrame(rows, "k int, v string")
    statements = ops.insert_statements(df, "t", ["k", "v"], streams=4, limit=500, backslashes=False)
    assert statements.select("stream").distinct().count() > 1
    ops.run_statements(statements, partial(sqlite3.connect, path, timeout=60))
    with sqlite3.connect(path) as connection:
        assert sorted(connection.execute("select k, v from t").fetchall(), key=repr) == sorted(rows, key=repr)


def test_slices_of_a_skewed_key(spark):
    keys = spark.range(40000).select((F.col("id") * F.col("id") * F.col("id")).alias("k"))
    conditions = sources.key_slices(keys, "k", 8)
    sizes = [keys.where(c).count() for c in conditions]
    assert len(sizes) == 8 and sum(sizes) == 40000 and max(sizes) < 2 * min(sizes)


def test_slices_with_repeats_and_without_keys(spark):
    keys = spark.range(900).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("k")).union(spark.range(500).selectExpr("7L"))
    sizes = [keys.where(c).count() for c in sources.key_slices(keys, "k", 6)]
    assert sum(sizes) == 1400 and len(sizes) <= 6
    assert sources.key_slices(keys.where("k is null"), "k", 6) == ["1 = 1"] == sources.key_slices(keys, "k", 1)


def test_statements_of_one_stream_are_cut_by_many_tasks(spark):
    random.seed(5)
    rows = [(i, random.choice("abc") * random.choice([1, 40, 90, 700])) for i in range(3000)]
    rows += [(None, "n"), (None, "n")] + [(7, "same")] * 200
    df = spark.createDataFrame(rows, "k int, v string").repartition(5)
    stream = F.when(F.col("k") > 2900, 1).when(F.col("k").isNotNull(), 0)
    ordered = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], f"({r[0]}, '{r[1]}')"))
    before = "INSERT INTO t (k, v) VALUES "
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small partitions are merged otherwise
    try:
        for limit in (40, 600, 20_000, 10**6):
            statements = ops.insert_statements(df, "t", ["k"], stream=stream, limit=limit)
            got = statements.withColumn("task", F.spark_partition_id()).orderBy("stream", "statement").collect()
            assert limit > 600 or len({r.task for r in got if r.stream == 0}) > 1
            for s in (0, 1, None):
                own = [r for r in ordered if (1 if r[0] > 2900 else 0) == s] if s is not None else rows[3000:3002]
                wanted = greedy([f"({'NULL' if k is None else k}, '{v}')" for k, v in own], before, "", limit)
                mine = [r for r in got if r.stream == s]
                assert [r.text for r in mine] == wanted and [r.statement for r in mine] == list(range(len(wanted)))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
