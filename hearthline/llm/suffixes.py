"""Repeated passages from an enhanced suffix array and its common-prefix interval tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.session import stored

from .words import Texts, chunks, long_windows, mixed

SPAN = 400  # bytes of the shortest repeat
GRAM = 32  # bytes of an anchor
PASSAGE_WORDS = 51  # words of the shortest passage that two documents are said to share
STRETCH_WORDS = 38  # words that stand for it
# Contexts that one task sorts together; larger groups are dealt out by window.
GROUP = 8192
BATCH_BYTES = 1 << 19  # texts sorted at once, if groups are smaller
_PLACE = 24  # bits of a place within a piece
RUN = ["doc", "starts", "n", "gram", "whole"]


# --- Suffix array of a group of short texts -------------------------------------------------


def suffix_array(data: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and common-prefix lengths of neighbours, exact below ``most``.

    Prefix doubling: ranks of the first 1, 2, 4, ... symbols; the ranks of all lengths
    are kept, and give the common prefix of two suffixes by binary descent.
    """
    n = len(data)
    _, rank = np.unique(data, return_inverse=True)
    levels, length = [rank.astype(np.int32)], 1
    while length < most:
        pair = levels[-1].astype(np.int64) * (n + 1)
        if length < n:
            pair[: n - length] += levels[-1][length:] + 1
        _, rank = np.unique(pair, return_inverse=True)
        levels.append(rank.astype(np.int32))
        length *= 2
    order = np.argsort(levels[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        fits = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[fits] = levels[k][a[fits]] == levels[k][b[fits]]
        step = same.astype(np.int64) << k
        common, a, b = common + step, a + step, b + step
    return order, common


def prefix_intervals(common: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """Nodes (first, last, length) of the interval tree whose prefix has ``least`` symbols."""
    long = np.flatnonzero(common >= least)
    stack: list[tuple[int, int]] = []
    before = -2
    for i, value in zip([*long.tolist(), len(common) + 1], [*common[long].tolist(), 0]):
        if i != before + 1:  # shorter prefixes lie between: all open nodes end there
            while stack:
                first, length = stack.pop()
                yield first, before + 1, length
        first = i
        while stack and stack[-1][1] > value:
            first, length = stack.pop()
            yield first, i, length
        if not stack or stack[-1][1] < value:
            stack.append((first, value))
        before = i


def repeat_groups(texts: list[bytes], least: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Maximal repeats of at least ``least`` bytes: length, and text and offset of every occurrence.

    A repeat is maximal if no longer one holds all its occurrences: to the right because
    it is a node of the interval tree, to the left because the bytes before its
    occurrences differ, or one of them begins its text.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    data = np.zeros(begins[-1], np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths + 1)
    inside = np.ones(len(data), bool)
    inside[begins[1:] - 1] = False
    data[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
    data[~inside] = 256 + np.arange(len(texts))  # ends of texts are unlike anything
    if not len(data):
        return []
    order, common = suffix_array(data, max(int(lengths.max()), 1) + 1)
    left = np.full(len(data), -1, np.int64)
    left[1:] = data[:-1]  # a text's first byte follows an end, unlike any other
    left = left[order]
    differs = np.concatenate([[0], np.cumsum(left[1:] != left[:-1])])
    found = []
    for first, last, length in prefix_intervals(common, least):
        if differs[last] > differs[first]:
            at = order[first : last + 1]
            found.append((length, owner[at], at - begins[owner[at]]))
    return found


# --- Anchors: which windows can be equal at all ---------------------------------------------


def anchors(texts: Texts) -> list[np.ndarray]:
    """Runs of windows that share their anchor.

    The anchor of a ``SPAN``-byte window is its ``GRAM``-byte string of the smallest hash,
    the leftmost of equals; equal windows have equal anchors. Returns text, first window
    start (in its text), number of starts, hash of the anchor, and two hashes of all bytes
    the run's windows cover.
    """
    data, bounds = texts.data, texts.bounds
    n, width = len(data), SPAN - GRAM + 1
    empty = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
    if n < SPAN:
        return empty
    grams = n - GRAM + 1
    starts = np.arange(grams)
    hashed = texts.hashes(starts, starts + GRAM)
    value = (hashed >> np.uint64(_PLACE) << np.uint64(_PLACE)) | starts.astype(np.uint64)
    # Sliding minimum: suffix minima of a block and prefix minima of the next one.
    blocks = -(-grams // width)
    padded = np.full(blocks * width, np.uint64(2**64 - 1))
    padded[:grams] = value
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - SPAN + 1
    least = np.minimum(back[:windows], ahead[width - 1 : width - 1 + windows])
    place = (least & np.uint64((1 << _PLACE) - 1)).astype(np.int64)

    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    valid = np.flatnonzero(owner[:windows] == owner[SPAN - 1 :])
    if not len(valid):
        return empty
    of, at = owner[valid], place[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (at[1:] != at[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(valid)))
    begin = valid[first]
    end = begin + count - 1 + SPAN
    return [of[first], begin - bounds[of[first]], count, hashed[at[first]], texts.hashes(begin, end)]


def pieces(texts: Texts, limit: int = 1 << 20) -> Iterator[tuple[int, Texts]]:
    """Texts cut into overlapping pieces, so that every window lies in exactly one; with its offset."""
    if len(texts.data) <= limit or len(texts) > 1:
        yield 0, texts
        return
    for begin in range(0, max(len(texts.data) - SPAN + 1, 1), limit):
        part = texts.data[begin : begin + limit + SPAN - 1]
        yield begin, Texts(part, np.array([0, len(part)]))


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, texts in chunks(batch.column(1)):
            for begin, part in pieces(texts):
                of, start, count, gram, whole = anchors(part)
                # A context that a text repeats, as periodic ones do many times, is one row.
                key = mixed(whole ^ mixed(gram + of.astype(np.uint64)))
                _, one, kind, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                starts = (start + begin)[np.argsort(kind, kind="stable")]
                ends = np.concatenate([[0], np.cumsum(times)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(of[one] + row)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(starts)),
                        pa.array(count[one]),
                        *(pa.array(h[one].view(np.int64)) for h in (gram, whole)),
                    ],
                    names=RUN,
                )


# --- Repeats within a group of contexts -----------------------------------------------------


def repeated_parts(texts: list[bytes]) -> list[tuple[int, int, int]]:
    """Text, begin and end of the stretches that windows found twice make up, by window hash.

    The rest can be in no repeat, and is not sorted.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    whole = Texts(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(lengths)]))
    many = np.maximum(lengths - SPAN + 1, 0)
    first = np.concatenate([[0], np.cumsum(many)])
    of = np.repeat(np.arange(len(texts)), many)
    at = np.arange(first[-1]) - first[of]
    begin = whole.bounds[of] + at
    _, kind, times = np.unique(whole.hashes(begin, begin + SPAN), return_inverse=True, return_counts=True)
    twice = np.flatnonzero(times[kind] > 1)
    if not len(twice):
        return []
    of, at = of[twice], at[twice]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (at[1:] > at[:-1] + 1)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(of)) - 1
    return list(zip(of[heads].tolist(), at[heads].tolist(), (at[tails] + SPAN).tolist()))


def covered(texts: list[bytes]) -> list[list[tuple[int, int]]]:
    """Byte ranges of each text that repeats among the texts cover."""
    ranges: list[list[tuple[int, int]]] = [[] for _ in texts]
    parts = repeated_parts(texts)
    for length, of, at in repeat_groups([texts[t][a:b] for t, a, b in parts], SPAN):
        for p, offset in zip(of.tolist(), at.tolist()):
            text, begin, _ = parts[p]
            ranges[text].append((begin + offset, begin + offset + length))
    return [merged(r) for r in ranges]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges without overlaps; touching ones are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered ranges of contexts that come sorted by their anchor; whole groups are sorted together."""
    held: list[tuple] = []
    size = 0

    def found() -> pa.RecordBatch:
        rows = [
            (doc, start + a, start + b)
            for (_, doc, start, _), ranges in zip(held, covered([h[3] for h in held]))
            for a, b in ranges
        ]
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["doc", "a", "b"]
        )

    for batch in batches:
        kind = batch.schema.field("doc").type
        for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "doc", "start", "context"))):
            if size >= BATCH_BYTES and row[0] != held[-1][0]:
                yield found()
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield found()


# --- Stretches of words ---------------------------------------------------------------------


def stretches(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of the stretches that stand for its passages, each once.

    Of the ``STRETCH_WORDS``-word stretches of every ``PASSAGE_WORDS``-word window the one
    of the smallest hash is taken, so texts that share a window share a stretch.
    """
    starts, ends = texts.words()
    many = len(starts) - PASSAGE_WORDS + 1
    if many < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    owner = texts.owner(starts)
    least = long_windows(texts.hashes(starts, ends), STRETCH_WORDS)
    width, done = PASSAGE_WORDS - STRETCH_WORDS + 1, 1
    while done < width:  # smallest of 1, 2, 4, ... neighbours, then of all
        step = min(done, width - done)
        least, done = np.minimum(least[:-step], least[step:]), done + step
    valid = np.flatnonzero(owner[:many] == owner[PASSAGE_WORDS - 1 :])
    of, least = owner[valid], least[valid]
    _, one = np.unique(mixed(least ^ mixed(of.astype(np.uint64))), return_index=True)
    return of[one], least[one]


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, texts in chunks(batch.column(1)):
            of, least = stretches(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of + row)), pa.array(least.view(np.int64))], names=["doc", "stretch"]
            )


# --- The operator ---------------------------------------------------------------------------


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts that a document was asked for."""
    for batch in batches:
        out: list[tuple] = []
        for doc, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(3))):
            out += [
                (w["gram"], doc, w["start"], w["crowded"], text[w["start"] : w["start"] + w["n"] + SPAN - 1])
                for w in wanted or ()
            ]
        columns = list(zip(*out)) or [()] * 5
        kinds = [pa.int64(), batch.schema.field(0).type, pa.int64(), pa.bool_(), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["gram", "doc", "start", "crowded", "context"]
        )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of a crowded group's contexts, with two hashes."""
    for batch in batches:
        for row, texts in chunks(batch.column("context")):
            many = np.maximum(np.diff(texts.bounds) - SPAN + 1, 0)
            of = np.repeat(np.arange(len(texts)), many)
            at = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            begin = texts.bounds[of] + at
            other = Texts(texts.data ^ np.uint8(0x5A), texts.bounds)
            start = batch.column("start").take(pa.array(of + row)).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc").take(pa.array(of + row)),
                    pa.array(start + at),
                    *(pa.array(t.hashes(begin, begin + SPAN).view(np.int64)) for t in (texts, other)),
                ],
                names=["doc", "a", "h", "g"],
            )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each document without its covered ranges."""
    for batch in batches:
        removed, spans, left = [], [], []
        for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            size = len(text)
            runs = merged([(a, min(a + r["size"], size)) for r in ranges for a in r["starts"] if a < size])
            edges = [0, *(e for run in runs for e in run), size]
            removed.append(sum(b - a for a, b in runs))
            spans.append(len(runs))
            left.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(left, pa.binary())],
            names=["doc", "n_removed", "n_spans", "kept"],
        )


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc`` names a document by its id, one without an id by its text; ``data`` holds the bytes."""
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    named = F.concat(F.lit("i"), F.col(id_col).cast("string"))
    return docs.select(
        F.col(id_col).alias("id"), F.coalesce(named, F.concat(F.lit("t"), F.sha2(data, 256))).alias("doc"), data.alias("data")
    )


def shared_stretches(own: DataFrame) -> DataFrame:
    """Per ``doc`` the number of its stretches that another row holds too (``n_shared``, above 0 only).

    A document that shares ``PASSAGE_WORDS`` words in a row with another has such a stretch;
    one that has none shares no passage of that length. Stretches are counted before they are
    shuffled, so one that many documents hold stays one row of each task.
    """
    picked = own.select("doc", "data").mapInArrow(_stretches, "doc string, stretch long")
    shared = picked.groupBy("stretch").agg(F.count(F.lit(1)).alias("met")).where("met > 1").drop("met")
    return picked.join(shared, "stretch", "left_semi").groupBy("doc").agg(F.count(F.lit(1)).alias("n_shared"))


def _passages(own: DataFrame) -> DataFrame:
    """``repeated_passages`` by ``doc``."""
    own, kind = own.select("doc", "data"), "string"
    runs = own.mapInArrow(_anchored, f"doc {kind}, starts array<long>, n long, gram long, whole long")
    runs = stored(runs, "anchored", compression="zstd")
    shared = (
        runs.groupBy("gram")
        .agg(F.sum(F.size("starts")).alias("met"), (F.min("whole") != F.max("whole")).alias("differ"))
        .where("met > 1")
        .drop("met")
    )
    runs = stored(runs.join(shared, "gram"), "runs", compression="zstd")
    contexts = runs.groupBy("gram", "whole", "n", "differ").agg(
        F.sum(F.size("starts")).alias("copies"),
        F.min(F.struct("doc", F.element_at("starts", 1).alias("start"))).alias("at"),
    )
    contexts = stored(contexts, "contexts", compression="zstd")
    asked = contexts.where("differ")
    crowds = asked.groupBy("gram").agg((F.count(F.lit(1)) > GROUP).alias("crowded"))
    wanted = asked.join(crowds, "gram").select(
        F.col("at.doc").alias("doc"), F.struct("gram", "at.start", "n", "crowded").alias("wanted")
    )
    touched = runs.select("doc").distinct().withColumn("wanted", F.lit(None).cast(wanted.schema["wanted"].dataType))
    per_doc = wanted.unionByName(touched).groupBy("doc").agg(F.collect_list("wanted").alias("wanted"))
    texts = stored(own.join(per_doc, "doc"), "touched", compression="zstd")

    fetched = texts.where(F.size("wanted") > 0).mapInArrow(
        _contexts, f"gram long, doc {kind}, start long, crowded boolean, context binary"
    )
    fetched = stored(fetched, "fetched", compression="zstd")
    grouped = fetched.where("not crowded").drop("crowded").repartition("gram").sortWithinPartitions("gram")
    sorted_out = grouped.mapInArrow(_grouped, f"doc {kind}, a long, b long")
    every = fetched.where("crowded").mapInArrow(_windows, f"doc {kind}, a long, h long, g long")
    twice = every.groupBy("h", "g").agg(F.count(F.lit(1)).alias("met")).where("met > 1").drop("met")
    size = F.lit(SPAN).cast("long")
    counted = every.join(twice, ["h", "g"], "left_semi").select("doc", F.array("a").alias("starts"), size.alias("size"))
    copied = runs.join(contexts.where("copies > 1").select("gram", "whole", "n"), ["gram", "whole", "n"], "left_semi")
    copied = copied.select("doc", "starts", (F.col("n") + SPAN - 1).alias("size"))
    found = sorted_out.select("doc", F.array("a").alias("starts"), (F.col("b") - F.col("a")).alias("size"))
    ranges = found.union(counted).union(copied).groupBy("doc")
    ranges = ranges.agg(F.collect_list(F.struct("starts", "size")).alias("ranges"))
    hit = texts.drop("wanted").join(ranges, "doc")
    return hit.mapInArrow(_cut, f"doc {kind}, n_removed long, n_spans long, kept binary")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents that hold repeats: id, n_removed, n_spans, and the bytes ``kept``.

    Every byte that a ``SPAN``-byte string covers which also starts elsewhere goes, in
    all places; strings are judged on the input.

    Equal windows share an anchor, so windows are grouped by it, each once. Runs whose
    whole context is met twice are repeats without further ado; pre-aggregated counts
    find them however many copies there are. Where contexts with one anchor differ, one
    of each is sorted into a suffix array, whose maximal repeat groups give the
    occurrences' ranges. Groups above ``GROUP`` contexts are not put in one task: their
    windows are counted by hash, which forms the tree's nodes of ``SPAN`` symbols.

    NULL and empty texts hold no repeat. Ids name documents: rows that repeat an id get
    the ranges of all of them. Rows without an id take part like others, named by their text.
    """
    kind = docs.schema[id_col].dataType
    found = _passages(_keyed(docs, id_col, text_col))
    named = F.when(F.col("doc").startswith("i"), F.substring("doc", 2, 2**31 - 1)).cast(kind)
    return found.select(named.alias(id_col), "n_removed", "n_spans", "kept")


def passage_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document: id, n_bytes, n_removed, n_spans, kept_sha256 of what is left, and
    n_shared_stretches (see ``shared_stretches``), 0 if no passage of over 50 words repeats across rows.
    """
    own = _keyed(docs, id_col, text_col)
    every = own.select(
        "id", "doc", F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("whole")
    )
    hit = _passages(own).withColumn("rest", F.sha2("kept", 256)).drop("kept").dropDuplicates(["doc"])
    zero = F.lit(0).cast("long")
    return every.join(hit, "doc", "left").join(shared_stretches(own), "doc", "left").select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("rest", "whole").alias("kept_sha256"),
        F.coalesce("n_shared", zero).alias("n_shared_stretches"),
    )
