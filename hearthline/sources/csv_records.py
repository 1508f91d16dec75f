"""Records of CSV files whose quoted fields hold line breaks, read in splits.

The rows are those of Python's ``csv`` module, which parses them in the tasks. A line is a
function from "entered inside quotes" to "left inside quotes"; every split is followed for
both ways it may be entered, the functions of a file's splits compose, and that picks one
way for each. Records then are parsed where their lines are read; only the lines of records
that cross the end of a split move. No rule depends on the length of a file or of a split.

A file packed by gzip cannot be split, so one task reads it anyway: it gets the packed bytes and
makes columns of them in one pass (``packed_columns``), by Arrow's parser where that reads the
text as ``csv`` does, else by ``csv``.
"""

from __future__ import annotations

import csv
import gzip
import io
import re
import sys
from collections.abc import Callable, Iterator
from functools import reduce
from urllib.parse import unquote
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.csv as arrow_csv
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored

# Tasks get these functions by value: executors need not have the library installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILE, BLOCK, ROW = "_file", "_block", "_row"
FIELDS, HEADER = "_fields", "_header"
_RECORDS = f"{FILE} string, {BLOCK} long, {ROW} long, {HEADER} boolean, {FIELDS} array<string>"
_WAYS = f"{FILE} string, {BLOCK} long, outside int, inside int, closes long, tail_outside long, tail_inside long"
# Tables with a row per split or file are broadcast up to so many rows; beyond, lines are joined to them by a shuffle.
MOST_BROADCAST = 1 << 20
_ESCAPE = "\ue000"  # stands before what a plain line break in a line is written as
_HELD = 4096  # records a task hands on at once
PACKED_BYTES = 1 << 27  # packed files up to this size are handed to their task whole; larger ones are read as lines
_CHUNK = 1 << 22  # bytes of unpacked text parsed at once
# Few packed files are taken by several tasks each, up to so many in all and one for so many packed bytes of the
# largest. Every one unpacks the whole file, which costs little beside what is done with its rows, and keeps its share.
PACKED_TASKS = 32
SHARE_BYTES = 1 << 22
_STRETCH = 2048  # rows in a row of one share
_BOM = b"\xef\xbb\xbf"


# A line whose fields are all closed, if it begins outside quotes. Possessive: a line has one reading.
_FIELD = r'(?:"[^"]*+"(?:"[^"]*+")*+(?:[^",][^,]*+)?+|[^",][^,]*+)?+'
_CLOSED_LINE = re.compile(f"{_FIELD}(?:,{_FIELD})*+")


def leaves_inside(line: str, inside: bool) -> bool:
    """Whether a line ends inside quotes, by the rules of Python's ``csv``: a quote opens a
    field only where the field begins, and any other one outside quotes is a plain character."""
    return _CLOSED_LINE.fullmatch(f'"{line}' if inside else line) is None


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Stretches of lines of one split: its key, file, block, and the further columns as lists."""
    for batch in batches:
        keys = np.asarray(batch.column(0))
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                columns = [c.slice(a, b - a).to_pylist() for c in batch.columns[3:]]
                yield keys[a], batch.column(1)[a].as_py(), batch.column(2)[a].as_py(), columns


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[tuple]]]:
    """File, block and lines (as tuples of the further columns) of each split in turn."""
    segments = _segments(batches)
    segment = next(segments, None)
    while segment is not None:
        key, file, block, _ = segment

        def own() -> Iterator[tuple]:
            nonlocal segment
            while segment is not None and segment[0] == key:  # noqa: B023
                yield from zip(*segment[3], strict=True)
                segment = next(segments, None)

        lines = own()
        yield file, block, lines
        for _ in lines:
            pass


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split with a quote: how it is left if entered outside or inside quotes, the
    row that closes what it is entered in, and the row where the record begins that it is left in."""
    found = []
    for file, block, lines in _by_split(batches):
        state, begin, closes = [False, True], [None, None], None
        for row, line in lines:
            left = [leaves_inside(line, state[0])]
            # A file begins outside quotes, so its first split has one way.
            left.append(left[0] if state[1] == state[0] or not block else leaves_inside(line, state[1]))
            for way in (0, 1):
                if left[way] and not state[way]:
                    begin[way] = row
                elif state[way] and not left[way]:
                    if way == 1 and closes is None:
                        closes = row
                    begin[way] = None
            state = left
        found.append((file, block, int(state[0]), int(state[1]), closes, *begin))
    names = [c.split()[0] for c in _WAYS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    columns = zip(*found, strict=True) if found else [()] * len(names)
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


class _Parser:
    """Python's ``csv`` over lines, where a line break within a line is a plain character."""

    def __init__(self, lines: Iterator[str]):
        self.escaped = False
        self.reader = csv.reader(self._escaped(lines))

    def _escaped(self, lines: Iterator[str]) -> Iterator[str]:
        for line in lines:
            if "\r" in line or "\n" in line or _ESCAPE in line:
                end = "\r" if line.endswith("\r") else ""
                line = line.removesuffix("\r").replace(_ESCAPE, _ESCAPE + "0")
                line = line.replace("\r", _ESCAPE + "1").replace("\n", _ESCAPE + "2") + end
                self.escaped = True
            yield line + "\n"

    def records(self) -> Iterator[tuple[int, list[str]]]:
        """Number of the first line and fields of every record that is not blank."""
        first = 0
        for record in self.reader:
            if record:
                if self.escaped:
                    for code, char in ("2", "\n"), ("1", "\r"), ("0", _ESCAPE):
                        record = [f.replace(_ESCAPE + code, char) for f in record]
                    self.escaped = False
                yield first, record
            first = self.reader.line_num


class _Records:
    """Records on their way out of a task."""

    def __init__(self):
        self.rows: list[tuple] = []

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        bounds, flat = [0], []
        for row in rows:
            flat += row[4]
            bounds.append(len(flat))
        columns = list(zip(*(r[:4] for r in rows), strict=True)) if rows else [()] * 4
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_()]
        fields = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.string()))
        arrays = [*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), fields]
        return pa.RecordBatch.from_arrays(arrays, names=[FILE, BLOCK, ROW, HEADER, FIELDS])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of lines (row, line, row of the header, CR LF) that lie whole within their split."""
    csv.field_size_limit(2**31 - 1)
    out = _Records()
    for file, block, lines in _by_split(batches):
        rows: list[int] = []
        heads: list[int | None] = []

        def taken() -> Iterator[str]:
            for row, line, head, crlf in lines:  # noqa: B023
                rows.append(row)  # noqa: B023
                if not heads:  # noqa: B023
                    heads.append(head)  # noqa: B023
                yield line.removesuffix("\r") if crlf else line

        for first, record in _Parser(taken()).records():
            out.rows.append((file, block, rows[first], rows[first] == heads[0], record))
            if len(out.rows) >= _HELD:
                yield out.batch()
    yield out.batch()


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One record of each row (file, split, row, header, lines)."""
    csv.field_size_limit(2**31 - 1)
    out = _Records()
    for batch in batches:
        for file, block, row, head, lines in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for _, record in _Parser(iter(lines)).records():
                out.rows.append((file, block, row, head, record))
                break
        yield out.batch()


def _text(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    return spark.read.options(**options).text(path).select(
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(BLOCK),
        F.monotonically_increasing_id().alias(ROW),
        F.col("value").alias("_line"),
    )


def _split_key() -> Column:
    return F.xxhash64(FILE, BLOCK).alias("_split")


def _blank() -> Column:
    return F.col("_line").isin("", "\r")


def _beside(lines: DataFrame, table: DataFrame, keys: list[str], many: int) -> DataFrame:
    """Lines with the ``many`` rows of a small table, in file order; they stay in place while it is small."""
    if many <= MOST_BROADCAST:
        return lines.join(F.broadcast(table), keys)
    return lines.join(table, keys).sortWithinPartitions(FILE, BLOCK, ROW)


def _splits(lines: DataFrame) -> DataFrame:
    """Per split: the rows up to ``_until`` go on with a record of the split ``_owner``, those
    from ``_since`` on belong to one that goes on in the next; the row of the file's header if
    it begins there, and whether that ends with CR LF."""
    # Row, if a CR stands before its last character, and if it ends with one, in one number.
    cr = F.instr("_line", "\r")
    head = F.col(ROW) * 4 + ((cr > 0) & (cr < F.length("_line"))).cast("long") * 2 + F.col("_line").endswith("\r").cast("long")
    every = lines.groupBy(FILE, BLOCK).agg(F.max(ROW).alias("last"), F.min(F.when(~_blank(), head)).alias("head"))
    quoted = lines.where(F.instr("_line", '"') > 0).select(_split_key(), FILE, BLOCK, ROW, "_line")
    found = every.join(quoted.mapInArrow(_ways, _WAYS), [FILE, BLOCK], "left")
    found = found.withColumns({"outside": F.coalesce("outside", F.lit(0)), "inside": F.coalesce("inside", F.lit(1))})

    order = Window.partitionBy(FILE).orderBy(BLOCK)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    outside, inside = F.col("outside"), F.col("inside")
    found = found.withColumn("flips", F.sum((outside > inside).cast("int")).over(so_far))
    fixed = F.when(outside == inside, F.struct(outside.alias("state"), F.col("flips").alias("flips")))
    found = found.withColumn("fixed", F.last(fixed, ignorenulls=True).over(earlier))
    flipped = F.coalesce(F.max("flips").over(earlier), F.lit(0)) - F.coalesce(F.col("fixed.flips"), F.lit(0))
    entered = (F.coalesce(F.col("fixed.state"), F.lit(0)) + flipped) % 2 == 1
    found = found.withColumn("entered", entered)
    left = F.when(F.col("entered"), inside).otherwise(outside) == 1
    found = found.withColumns(
        {
            "left": left,
            "until": F.when(F.col("entered"), F.coalesce("closes", "last")),
            "since": F.when(left, F.when(F.col("entered"), F.col("tail_inside")).otherwise(F.col("tail_outside"))),
        }
    )
    whole_file = Window.partitionBy(FILE)
    header = F.min(F.when(F.col("head").isNotNull(), F.struct(BLOCK, "head"))).over(whole_file)
    by_cr = F.coalesce(header["head"] % 4 >= 2, F.lit(False))
    unclosed = F.raise_error(F.concat(F.lit("a quote is never closed in "), F.col(FILE))).cast("long")
    return found.select(
        FILE,
        BLOCK,
        F.when(F.max_by("left", BLOCK).over(whole_file) & ~by_cr, unclosed).otherwise(F.col("until")).alias("_until"),
        F.col("since").alias("_since"),
        F.last(F.when(F.col("since").isNotNull(), F.col(BLOCK)), ignorenulls=True).over(earlier).alias("_owner"),
        F.when(header[BLOCK] == F.col(BLOCK), F.expr("head div 4")).alias("_head"),
        F.coalesce(header["head"] % 2 == 1, F.lit(False)).alias("_crlf"),
        by_cr.alias("_by_cr"),
    )


def _names(files: DataFrame) -> list[str]:
    """Names of files as paths to read; the driver holds a list of them anyway."""
    rows = files.select(FILE).distinct().toLocalIterator()
    return [re.sub(r"([\[\]{}*?\\,])", r"\\\1", unquote(row[FILE])) for row in rows]


def _read(spark: SparkSession, path: str | list[str], line_end: str, multiline: bool, drop_bad_bytes: bool) -> DataFrame:
    line = F.make_valid_utf8("_line")
    line = F.replace(line, F.lit("\ufffd"), F.lit("")) if drop_bad_bytes else line
    lines = _text(spark, path, lineSep=line_end).withColumn("_line", line)
    splits = stored(_splits(lines), "splits")
    is_open = F.col("_until").isNotNull() | F.col("_since").isNotNull()
    if not multiline:
        # Every line is a record, whatever quotes it leaves open.
        splits = splits.select(FILE, BLOCK, "_head", "_by_cr", F.lit(None).cast("long").alias("_until"))
        splits, is_open = splits.withColumn("_since", F.col("_until")).withColumn("_crlf", F.lit(False)), F.lit(False)
    many, by_cr, n_open = splits.agg(
        F.count(F.lit(1)), F.count_if("_by_cr"), F.count_if(is_open)
    ).first()
    if by_cr and line_end == "\n":
        # Files without an LF behind their header are read with CR instead.
        files = [(_names(splits.where(which)), end) for which, end in (("_by_cr", "\r"), ("not _by_cr", "\n"))]
        found = [_read(spark, own, end, multiline, drop_bad_bytes) for own, end in files if own]
        return found[0] if len(found) == 1 else found[0].unionByName(found[1])
    placed = _beside(lines, splits.drop("_by_cr"), [FILE, BLOCK], many)
    if not multiline:
        is_head = F.coalesce(F.col(ROW) == F.col("_head"), F.lit(False)).alias(HEADER)
        rows = placed.where(~_blank()).select(FILE, BLOCK, ROW, is_head, F.array("_line").alias("_lines"))
        return rows.mapInArrow(_alone, _RECORDS)
    crosses = F.coalesce(F.col(ROW) <= F.col("_until"), F.lit(False)) | F.coalesce(F.col(ROW) >= F.col("_since"), F.lit(False))
    whole = placed.where(~crosses).select(_split_key(), FILE, BLOCK, ROW, "_line", "_head", "_crlf")
    whole = whole.mapInArrow(_whole, _RECORDS)
    if not n_open:
        return whole
    text = F.when(F.col("_crlf"), F.regexp_replace("_line", "\r$", "")).otherwise(F.col("_line"))
    # Before its first row a split goes on with what an earlier one began.
    home = F.when(F.col(ROW) <= F.col("_until"), F.col("_owner")).otherwise(F.col(BLOCK)).alias("_home")
    is_head = F.coalesce(F.col(ROW) == F.col("_head"), F.lit(False)).alias(HEADER)
    parts = _beside(lines, splits.where(is_open).drop("_by_cr"), [FILE, BLOCK], n_open).where(crosses)
    parts = parts.select(FILE, home, BLOCK, ROW, text.alias("_line"), is_head).groupBy(FILE, "_home").agg(
        F.sort_array(F.collect_list(F.struct(BLOCK, ROW, "_line"))).alias("_parts"), F.max(HEADER).alias(HEADER)
    )
    crossing = parts.select(
        FILE,
        F.col("_home").alias(BLOCK),
        F.col("_parts")[0][ROW].alias(ROW),
        HEADER,
        F.transform("_parts", lambda p: p["_line"]).alias("_lines"),
    ).mapInArrow(_alone, _RECORDS)
    return whole.unionByName(crossing)


def csv_records(
    spark: SparkSession, path: str | list[str], multiline: bool = True, drop_bad_bytes: bool = False
) -> DataFrame:
    """One row per record that is not blank: file, split, number, if it is the header, and fields.

    Files may end their lines with LF, CR LF or CR, each its own way, as its header's line
    shows; before an LF a CR is part of the line end. A file of CR lines is one line to the first
    scan, whose task holds it (2 GB at most); then it is read in splits as others are. Inside quotes a file's own line end (that of its header) reads as LF,
    others stay. A record belongs to the split it begins in. A file that ends inside quotes is
    an error. Without ``multiline`` every line is a record. Bytes that are not UTF-8 read as
    U+FFFD, which ``drop_bad_bytes`` leaves out before the lines are parsed.
    """
    return _read(spark, path, "\n", multiline, drop_bad_bytes)


class _Irregular(Exception):
    """Text that Arrow's parser would read otherwise than Python's ``csv``."""


def _regular(text: io.BufferedIOBase, drop_bad_bytes: bool, last: bytes) -> Iterator[bytes]:
    """The text in pieces, its own line end as LF, and then ``last``.

    A CR that stands before no LF is a plain character to ``csv`` and a line end to Arrow, and
    U+FFFD has to go before lines are parsed: text with either is refused.
    """
    held, crlf = b"", None
    while True:
        more = text.read(_CHUNK)
        data = held + more
        if crlf is None:
            if data.startswith(_BOM):
                data = data.removeprefix(_BOM)
                if data[:1] in (b'"', b"\r", b"\n", b""):
                    raise _Irregular
            head, end, _ = data.lstrip(b"\r\n").partition(b"\n")
            if more and not end:
                raise _Irregular
            crlf = head.endswith(b"\r")
        # What may go on as CR LF or U+FFFD waits for the next piece.
        begun = next((b for b in (b"\xef\xbf", b"\xef", b"\r") if more and data.endswith(b)), b"")
        data, held = data[: len(data) - len(begun)], begun
        if drop_bad_bytes and b"\xef\xbf\xbd" in data:
            raise _Irregular
        if (n_cr := data.count(b"\r")) and n_cr != data.count(b"\r\n"):
            raise _Irregular
        yield data.replace(b"\r\n", b"\n") if crlf and n_cr else data
        if not more:
            break
    yield last


class _Pieces(io.RawIOBase):
    """An input stream of pieces."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.rest = pieces, memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, into: memoryview) -> int:
        while not self.rest:
            piece = next(self.pieces, None)
            if piece is None:
                return 0
            self.rest = memoryview(piece)
        n = min(len(into), len(self.rest))
        into[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def _same_header(file: str, fields: list[str | None], names: list[str]) -> None:
    if [(f or "").replace("\ufeff", "").lower() for f in fields] != [n.lower() for n in names]:
        raise ValueError(f"another header in {file}")


def _by_arrow(file: str, text: io.BufferedIOBase, names: list[str], drop_bad_bytes: bool) -> Iterator[pa.RecordBatch]:
    """Rows behind the header. A row of another length than the header's is an error of Arrow."""
    # A last row of its own: an open quote would swallow it.
    token = uuid4().hex
    columns = [f"_{i}" for i in range(len(names))]
    rows = arrow_csv.open_csv(
        _Pieces(_regular(text, drop_bad_bytes, f"\n{token}{',' * (len(names) - 1)}\n".encode())),
        arrow_csv.ReadOptions(use_threads=False, block_size=_CHUNK, column_names=columns),
        arrow_csv.ParseOptions(newlines_in_values=True),
        arrow_csv.ConvertOptions(column_types=dict.fromkeys(columns, pa.string())),
    )
    held, begun = None, False
    for batch in rows:
        if not batch.num_rows:
            continue
        if held is not None:
            yield held
        if not begun:
            header, begun = [c[0].as_py() for c in batch.columns], True
            if header[0] == token:
                return  # a file without a line
            _same_header(file, header, names)
            batch = batch.slice(1)
        held = batch
    if held is None or not held.num_rows or held.column(0)[-1].as_py() != token:
        raise ValueError(f"a quote is never closed in {file}")
    yield held.slice(0, held.num_rows - 1)


def _by_csv(
    file: str, opened: Callable[[], io.BufferedIOBase], names: list[str], drop_bad_bytes: bool
) -> Iterator[pa.RecordBatch]:
    """The same rows by Python's ``csv``, whatever the text is."""

    def lines(end: str) -> Iterator[str]:
        for line in io.TextIOWrapper(opened(), "utf-8", errors="replace", newline=end):
            line = line.removesuffix(end)
            yield line.replace("\ufffd", "") if drop_bad_bytes else line

    end = "\n"
    head = next((line for line in lines(end) if line not in ("", "\r")), "")
    if "\r" in head[:-1]:
        end = "\r"
    crlf = end == "\n" and head.endswith("\r")
    token = uuid4().hex

    def taken() -> Iterator[str]:
        for line in lines(end):
            yield line.removesuffix("\r") if crlf else line
        yield token

    def batch(rows: list[list[str]]) -> pa.RecordBatch:
        fields = zip(*((r + [None] * len(names))[: len(names)] for r in rows), strict=True) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(f, pa.string()) for f in fields], [f"_{i}" for i in range(len(names))])

    rows: list[list[str]] = []
    held, begun = None, False
    for _, record in _Parser(taken()).records():
        if held is not None and not begun:
            _same_header(file, held, names)
            begun = True
        elif held is not None:
            rows.append(held)
        held = record
        if len(rows) >= _HELD:
            yield batch(rows)
            rows = []
    if held != [token]:
        raise ValueError(f"a quote is never closed in {file}")
    yield batch(rows)


def _unpacked(names: list[str], position: bool, drop_bad_bytes: bool, share: int = 0, shares: int = 1) -> Callable:
    def own(rows: pa.RecordBatch, first: int) -> Iterator[tuple[int, pa.RecordBatch]]:
        """What this share has of rows that begin with number ``first``, by number alone: batches may be cut otherwise elsewhere."""
        if shares == 1:
            yield first, rows
            return
        a, end = first, first + rows.num_rows
        while a < end:
            b = min((a // _STRETCH + 1) * _STRETCH, end)
            if a // _STRETCH % shares == share:
                yield a, rows.slice(a - first, b - a)
            a = b

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(2**31 - 1)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):

                def opened() -> io.BufferedIOBase:
                    return gzip.GzipFile(fileobj=pa.BufferReader(content.as_buffer()))  # noqa: B023

                done = 0
                for found in either(path, opened):
                    for first, rows in own(found, done):
                        if position:
                            n = rows.num_rows
                            place = [pa.repeat(path, n), pa.repeat(pa.scalar(0, pa.int64()), n), pa.array(np.arange(first, first + n))]
                            rows = pa.RecordBatch.from_arrays([*rows.columns, *place], [*rows.schema.names, FILE, BLOCK, ROW])
                        yield rows
                    done += found.num_rows

    def either(path: str, opened: Callable[[], io.BufferedIOBase]) -> Iterator[pa.RecordBatch]:
        done = 0
        try:
            for rows in _by_arrow(path, opened(), names, drop_bad_bytes):
                yield rows
                done += rows.num_rows
            return
        except (_Irregular, pa.ArrowException):
            pass
        for rows in _by_csv(path, opened, names, drop_bad_bytes):
            known = min(done, rows.num_rows)
            done -= known
            yield rows.slice(known)

    return read


def packed_columns(
    spark: SparkSession, path: str | list[str], names: list[str], drop_bad_bytes: bool, position: bool
) -> tuple[DataFrame | None, str | list[str]]:
    """Rows of the files packed by gzip, with a column for each of ``names`` (by place) and on request
    their file, split and number; and the paths that are left. The rules are those of ``csv_records``."""
    files = spark.read.format("binaryFile").load(path)
    name = F.col("_metadata.file_path")
    listed = files.select(name.alias(FILE), "length", (name.endswith(".gz") & (F.col("length") <= PACKED_BYTES)).alias("_packed"))
    n_packed, n_other, largest = listed.agg(
        F.count_if("_packed"), F.count_if(~F.col("_packed")), F.max(F.when(F.col("_packed"), F.col("length")))
    ).first()
    if not n_packed:
        return None, path
    if n_other:
        files = spark.read.format("binaryFile").load(_names(listed.where("_packed")))
    schema = ", ".join([*(f"_{i} string" for i in range(len(names))), *([f"{FILE} string, {BLOCK} long, {ROW} long"] * position)])
    content = files.select(name.alias(FILE), "content")
    shares = max(1, min(-(-largest // SHARE_BYTES), -(-PACKED_TASKS // n_packed)))
    rows = [content.mapInArrow(_unpacked(names, position, drop_bad_bytes, k, shares), schema) for k in range(shares)]
    return reduce(DataFrame.union, rows), _names(listed.where("not _packed")) if n_other else []
