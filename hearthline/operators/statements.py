"""Multi-row statements of bounded size from the rows of a table."""

from __future__ import annotations

import sys
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    DataType,
    DateType,
    DoubleType,
    FloatType,
    StringType,
    TimestampNTZType,
    TimestampType,
)

from ..session import stored

# Executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: bytes of a statement at most.
STATEMENT_BYTES = 1_024_000
_COLUMNS = "stream int, statement bigint, n_rows bigint, n_bytes bigint, text string"


def sql_literal(c: Column, kind: DataType, backslashes: bool = True) -> Column:
    """A value as SQL text, NULL included. NaN and infinity have none and fail.

    ``backslashes`` says that the database takes a backslash in quotes for an escape.
    """
    text = c.cast("string")
    if isinstance(kind, (StringType, DateType, TimestampType, TimestampNTZType)):
        if backslashes:
            text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        text = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
    elif isinstance(kind, BinaryType):
        text = F.concat(F.lit("X'"), F.hex(c), F.lit("'"))
    elif isinstance(kind, (FloatType, DoubleType)):
        refused = F.raise_error(F.concat(F.lit("no SQL text for "), text)).cast("string")
        text = F.when(F.isnan(c) | F.abs(c).isin(float("inf")), refused).otherwise(text)
    return F.coalesce(text, F.lit("NULL"))


_ARROW = pa.schema(
    [("stream", pa.int32()), ("statement", pa.int64()), ("n_rows", pa.int64()), ("n_bytes", pa.int64()), ("text", pa.string())]
)


_SUMMARY = (
    "_part bigint, first bigint, last bigint, total bigint, firsts array<bigint>, "
    "room array<bigint>, size array<bigint>, started array<bigint>, tail_size bigint, tail_started bigint"
)
_ENTRY = "_part bigint, _room bigint, _owner bigint, _begin bigint"
# Stands for a stream that is NULL; streams are 32-bit numbers.
_NO_STREAM = 1 << 40
# monotonically_increasing_id keeps the row's place in its partition in 33 bits.
_PLACE_BITS = 33
# Bytes of a row that tell where it is dealt to.
_PREFIX = 64


def _chains(reach: np.ndarray, starts: np.ndarray, own: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Statements cut from each of ``starts`` on: first row of the last one, and how many there are.

    ``reach`` has the bytes of the rows before each row, each with a comma.
    """
    rows = len(reach) - 1
    following = np.maximum(np.searchsorted(reach, reach[:-1] + (limit - own + 1), "right") - 1, np.arange(1, rows + 1))
    last, number = starts.copy(), np.ones(len(starts), np.int64)
    while len(open_ := np.flatnonzero(following[last] < rows)):
        last[open_] = following[last[open_]]
        number[open_] += 1
    return last, number


def _summary(part: tuple, sizes: pa.Table, own: int, limit: int) -> pa.Table:
    """What one partition makes of a statement left open before it, for every size that may have.

    It takes the first rows that have room (``firsts``: bytes up to each place); ``room`` has from
    where on the partition ends otherwise: with a statement of ``size`` bytes open, after ``started``.
    A partition with several streams ends as its last one does.
    """
    sizes = sizes.sort_by("_slot")
    streams = sizes["stream"].cast(pa.int64()).fill_null(_NO_STREAM).to_numpy()
    lengths = sizes["_bytes"].cast(pa.int64()).to_numpy()
    turns = np.flatnonzero(np.diff(streams)) + 1

    def reached(rows: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(rows + 1)])

    reach = reached(lengths[: turns[0]] if len(turns) else lengths)
    firsts = reach[: max(np.searchsorted(reach, limit - own, "right"), 1)]
    starts = np.arange(min(len(firsts), len(reach) - 1))
    last, number = _chains(reach, starts, own, limit)
    changed = np.flatnonzero(np.diff(last, prepend=-1) | np.diff(number, prepend=-1))
    tail_size = tail_started = None
    if len(turns):
        tail = reached(lengths[turns[-1] :])
        end, count = _chains(tail, np.zeros(1, np.int64), own, limit)
        tail_size, tail_started = int(own + tail[-1] - tail[end[0]] - 1), int(count[0])
    found = {
        "_part": part[0].as_py(), "first": int(streams[0]), "last": int(streams[-1]), "total": int(reach[-1]),
        "firsts": firsts, "room": reach[starts[changed]], "size": own + reach[-1] - reach[last[changed]] - 1,
        "started": number[changed], "tail_size": tail_size, "tail_started": tail_started,
    }
    lists = {"firsts", "room", "size", "started"}
    kinds = [(n, pa.list_(pa.int64()) if n in lists else pa.int64()) for n in found]
    return pa.Table.from_pylist([found], pa.schema(kinds))


def _entries(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Along the partitions: room in the statement left open, the partition it began in, and the next number."""
    stream, size, number, owner = None, 0, 0, None
    for batch in batches:
        found = []
        for p in batch.to_pylist():
            goes_on = stream == p["first"]
            room = max(limit - size, 0) if goes_on else -1
            taken = goes_on and p["total"] <= room
            begin = number + 1 if goes_on and not taken else 0
            found.append({"_part": p["_part"], "_room": room, "_owner": owner, "_begin": begin})
            stream = p["last"]
            if p["tail_size"] is not None:
                size, number, owner = p["tail_size"], p["tail_started"] - 1, p["_part"]
            elif taken:
                size += p["total"]
            else:
                at = bisect_right(p["room"], max(room, 0)) - 1
                size, number, owner = p["size"][at], begin + p["started"][at] - 1, p["_part"]
        yield pa.RecordBatch.from_pylist(found, pa.schema([(n, pa.int64()) for n in ("_part", "_room", "_owner", "_begin")]))


def _cut(batches: Iterator[pa.RecordBatch], before: bytes, after: bytes, limit: int) -> Iterator[pa.RecordBatch]:
    """Statements of the groups of one partition; what is held is one statement and one batch.

    The first statement of a group has the number the group begins with, that of a later stream 0.
    """
    own = len(before) + len(after)
    group, stream, number, held, size = None, None, 0, [], own

    def statement() -> dict:
        text = before + b",".join(held) + after
        return {"stream": stream, "statement": number, "n_rows": len(held), "n_bytes": len(text), "text": text.decode()}

    for batch in batches:
        done = []
        columns = (batch.column(n).to_pylist() for n in ("_group", "_begin", "stream", "row"))
        for into, begin, at, row in zip(*columns, strict=True):
            if held and (into != group or at != stream or size + len(row) + 1 > limit):
                done.append(statement())
                number, held, size = number + 1 if at == stream else 0, [], own
            if into != group:
                number = begin
            size += len(row) + (1 if held else 0)
            group, stream = into, at
            held.append(row)
        if done:
            yield pa.RecordBatch.from_pylist(done, _ARROW)
    if held:
        yield pa.RecordBatch.from_pylist([statement()], _ARROW)


def insert_statements(
    df: DataFrame,
    table: str,
    order: list[str],
    *,
    streams: int = 16,
    stream: Column | None = None,
    verb: str = "INSERT",
    ending: str = "",
    limit: int = STATEMENT_BYTES,
    backslashes: bool = True,
) -> DataFrame:
    """Statements that insert every row of ``df``: stream, statement, n_rows, n_bytes, text.

    Rows go to ``streams`` streams, by a hash of the ``order`` columns or by ``stream`` (whole
    numbers from 0), and within a stream by ``order``; equal rows give equal text, so reruns agree.
    A statement takes rows as long as its UTF-8 text, ``ending`` included, has ``limit`` bytes at
    most; a single row beyond that has a statement of its own. ``verb`` may be REPLACE, ``ending``
    an ON DUPLICATE clause. A table without rows has no statement.

    A stream is cut by many tasks. Rows are range-partitioned and sorted once, and written; where
    the statements of a partition begin hangs only on the size of the one open before it, so each
    partition says from its row sizes what it makes of any, and one row a partition is followed
    in order. Rows that belong to a statement of an earlier partition join it. Rows with equal
    ``order`` columns stay in one partition if their text begins alike, so order by what tells rows apart.
    """
    names = ", ".join(df.columns)
    before = f"{verb} INTO {table} ({names}) VALUES ".encode()
    after = f" {ending}".encode() if ending else b""
    own = len(before) + len(after)
    values = [sql_literal(F.col(f"`{f.name}`"), f.dataType, backslashes) for f in df.schema.fields]
    dealt = F.pmod(F.xxhash64(*order), F.lit(streams)) if stream is None else stream
    rows = df.select(
        dealt.cast("int").alias("stream"),
        F.struct(*order).alias("at"),
        F.concat(F.lit("("), F.concat_ws(", ", *values), F.lit(")")).cast("binary").alias("row"),
        F.monotonically_increasing_id().alias("_input"),
    )
    # Equal rows may be parted anywhere, which long ones are not known to be by their first bytes.
    parted = F.when(F.octet_length("row") <= _PREFIX, F.col("_input")).otherwise(F.lit(2**63 - 1))
    ranked = (
        rows.repartitionByRange("stream", "at", F.substring("row", 1, _PREFIX), parted)
        .sortWithinPartitions("stream", "at", "row")
        .select("stream", "row", F.monotonically_increasing_id().alias("_slot"))
    )
    kept = stored(ranked, "statements").withColumn("_part", F.shiftright("_slot", _PLACE_BITS))
    sizes = kept.select("_part", "_slot", "stream", F.octet_length("row").alias("_bytes"))
    summary = sizes.groupBy("_part").applyInArrow(lambda part, rows: _summary(part, rows, own, limit), _SUMMARY)
    parts = stored(summary, "statement-parts")
    followed = parts.drop("firsts").coalesce(1).sortWithinPartitions("_part")
    entries = followed.mapInArrow(partial(_entries, limit=limit), _ENTRY)
    lead = F.size(F.filter("firsts", lambda reach: reach <= F.col("_room"))) - 1
    entries = entries.join(parts.select("_part", "firsts"), "_part").select("_part", "_owner", "_begin", lead.alias("_lead"))
    place = F.col("_slot").bitwiseAND((1 << _PLACE_BITS) - 1)
    grouped = kept.join(F.broadcast(entries), "_part").select(
        F.when(place < F.col("_lead"), F.col("_owner")).otherwise(F.col("_part")).alias("_group"), "_begin", "_slot", "stream", "row"
    )
    sorted_rows = grouped.repartition("_group").sortWithinPartitions("_group", "_slot")
    cut = partial(_cut, before=before, after=after, limit=limit)
    return sorted_rows.select("_group", "_begin", "stream", "row").mapInArrow(cut, _COLUMNS)


def run_statements(statements: DataFrame, connect: Callable[[], object]) -> None:
    """Run statements against a database, one connection and one transaction a task.

    A stream's statements run in order in one task, so no more tasks than streams are connected.
    ``connect`` opens a DB-API connection inside the task. A task that is taken again has
    committed nothing before, unless its commit itself went unnoticed: REPLACE or an
    ON DUPLICATE clause make that harmless.
    """
    ordered = statements.repartition("stream").sortWithinPartitions("stream", "statement")

    def run(rows: Iterator) -> None:
        connection = connect()
        try:
            cursor = connection.cursor()
            for row in rows:
                cursor.execute(row.text)
            connection.commit()
        finally:
            connection.close()

    ordered.select("text").foreachPartition(run)
