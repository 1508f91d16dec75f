"""The log of commits: many loads, many writers, and loads that fail at every step."""

import json
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import StreamingQueryException

from hearthline import operators as ops
from hearthline import plans, sources, streaming
from hearthline.schema import LISTING_COLUMNS
from hearthline.session import path_exists
from hearthline.sources import commits
from hearthline.streaming import arrivals


def typed_rows(spark, ids):
    rows = spark.createDataFrame([(str(i), "$50") for i in ids], "id string, price string")
    return ops.typed_listings(ops.transform_listings(rows))


def test_target_has_the_columns_of_the_schema(spark, tmp_path):
    path = str(tmp_path / "target")
    sources.append_target(typed_rows(spark, [1]), path, "2024-01-01")  # looks like a date, stays text
    table = sources.read_target(spark, path)
    assert table.columns == LISTING_COLUMNS
    loads = sources.read_target(spark, path, with_load=True)
    assert loads.columns == [*LISTING_COLUMNS, "load_id"] and loads.first().load_id == "2024-01-01"


def test_items_follow_their_last_entry(spark, tmp_path):
    path = str(tmp_path / "log")
    held = {}
    for k in range(3 * commits.SPAN + 5):
        entries = [("load", f"l{k % 50}", str(k)), ("file", f"f{k}", "x")]
        held[f"l{k % 50}"] = str(k)
        if k == 70:
            entries.insert(0, ("load", None, None))
            held = {f"l{k % 50}": str(k)}
        if k % 40 == 3:
            entries.append(("load", f"l{(k + 1) % 50}", None))
            held.pop(f"l{(k + 1) % 50}", None)
        assert commits.commit(spark, path, entries) == k
    now = {r.item: r.value for r in commits.items(spark, path, "load").collect()}
    assert now == held
    assert commits.items(spark, path, "file").count() == 3 * commits.SPAN + 5
    assert path_exists(spark, f"{path}/_commits/segments/{0:012d}-{commits.SPAN:012d}/_SUCCESS")
    # Lost segments and a lost hint cost time only.
    for part in (tmp_path / "log" / "_commits" / "segments").glob("*/_SUCCESS"):
        part.unlink()
    (tmp_path / "log" / "_commits" / "_folded").unlink()
    assert commits.next_number(spark, path) == 3 * commits.SPAN + 5
    assert {r.item: r.value for r in commits.items(spark, path, "load").collect()} == held


def test_two_hundred_thousand_loads_stay_readable(spark, tmp_path):
    path, many, span = str(tmp_path / "target"), 200_000, commits.SPAN
    log = tmp_path / "target" / "_commits"
    size = span * span
    pieces = [(k, size) for k in range(0, many - size + 1, size)]
    pieces += [(k, span) for k in range(len(pieces) * size, many, span)]
    assert sum(s for _, s in pieces) == many
    for first, size in pieces:
        folder = log / "segments" / f"{first:012d}-{first + size:012d}"
        folder.mkdir(parents=True)
        ids = range(first, first + size)
        table = pa.table(
            {
                "number": pa.array(ids, pa.int64()), "place": pa.array([0] * size, pa.int32()), "kind": ["load"] * size,
                "item": [f"old-{k}" for k in ids], "value": [f"data/{k}" for k in ids],
            }
        )
        pq.write_table(table, folder / "part.parquet")
        (folder / "_SUCCESS").touch()
    (log / "_folded").write_text(str(many))
    folder = sources.tables.write_try(typed_rows(spark, [1, 2]), path, "new")
    assert commits.commit(spark, path, [("load", "new", folder)]) == many
    loads = sources.target_loads(spark, path)
    assert len(loads) == many + 1 and loads["old-123456"] == "data/123456"
    sources.replace_target(typed_rows(spark, [3]), path, "last")
    assert [r.id for r in sources.read_target(spark, path).collect()] == [3] or [
        r.id for r in sources.read_target(spark, path).collect()
    ] == ["3"]


def test_writers_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "log")

    def write(k):
        return [commits.commit(spark, path, [("load", f"{k}-{i}", "x")]) for i in range(10)]

    with ThreadPoolExecutor(4) as pool:
        numbers = [n for found in pool.map(write, range(4)) for n in found]
    assert sorted(numbers) == list(range(40))
    assert commits.items(spark, path, "load").count() == 40


def stream(spark, tmp_path, checkpoint="checkpoint", **options):
    options = {"max_files": 3, **options}
    streaming.load_arrivals(
        spark, str(tmp_path / "in"), staging_path=str(tmp_path / "staging"), target_path=str(tmp_path / "target"),
        reject_path=str(tmp_path / "rejects"), checkpoint=str(tmp_path / checkpoint), **options,
    ).awaitTermination()


def cleaned_files(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), f"${i + 1}") for i in range(12)], "id string, price string")
    sources.write_listings_csv(ops.transform_listings(rows).repartition(3), str(tmp_path / "in"))


@pytest.mark.parametrize("step", ["write_try", "commit", "after the commit", "record"])
def test_every_row_once_whatever_step_fails(spark, tmp_path, monkeypatch, step):
    cleaned_files(spark, tmp_path)
    failed = str(tmp_path / "failed")
    with monkeypatch.context() as patch:
        real = arrivals.commit

        def lost(*_):
            raise OSError("lost")

        def committed_and_lost(*args):
            real(*args)
            raise OSError("lost")

        options = {}
        if step == "record":
            options["metrics_path"] = "nowhere://cannot/be/written"
        else:
            patch.setattr(arrivals, "commit" if "commit" in step else step, committed_and_lost if "after" in step else lost)
        with pytest.raises(StreamingQueryException):
            stream(spark, tmp_path, **options)
    stream(spark, tmp_path, failed_path=failed, metrics_path=str(tmp_path / "runs"))
    stream(spark, tmp_path, "another", metrics_path=str(tmp_path / "runs"))  # the same files again
    ids = sorted(int(r.id) for r in sources.read_target(spark, str(tmp_path / "target")).collect())
    assert ids == list(range(12))
    parts = {k: sources.read_part(spark, str(tmp_path / "target"), k, "id string").count() for k in ("staging", "rejects")}
    assert parts == {"staging": 12, "rejects": 12}
    assert not path_exists(spark, failed)


def test_a_bad_file_is_set_aside_and_the_others_are_loaded_once(spark, tmp_path):
    cleaned_files(spark, tmp_path)
    (tmp_path / "in" / "part-bad.csv").write_text('id,price\n1,"never closed\n')
    stream(spark, tmp_path, failed_path=str(tmp_path / "failed"), max_files=10)
    assert sources.read_target(spark, str(tmp_path / "target")).count() == 12
    aside = spark.read.parquet(str(tmp_path / "failed")).collect()
    assert len(aside) == 1 and aside[0].path.endswith("part-bad.csv")


def test_text_loads_are_named_after_their_source(spark, tmp_path):
    table = str(tmp_path / "table")
    for name, text in {"a.csv": "k,v\n1,x\n", "b.csv": "k,w\n2,y\n"}.items():
        (tmp_path / name).write_text(text)
        for _ in range(2):
            plans.load_text_table(spark, str(tmp_path / name), table)
    rows = sorted((r.k, r.v, r.w) for r in sources.read_text_loads(spark, table).collect())
    assert rows == [("1", "x", None), ("2", None, "y")]
    plans.load_text_table(spark, str(tmp_path / "b.csv"), table, prune=True)
    assert [r.asDict() for r in sources.read_text_loads(spark, table).collect()] == [{"k": "2", "w": "y"}]
    record = json.loads((tmp_path / "table" / "_commits" / f"{0:012d}.json").read_text())
    assert [e[0] for e in record] == ["load", "columns"]
