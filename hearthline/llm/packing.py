"""Token ids packed into rows of fixed length, in binary."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed by the vocabulary: how text splits before merges, and the id it leaves free.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
LENGTH = 2048
# Text per packing group, about two million ids: what is left open in a group's last
# rows is a few rows in a thousand, and a task holds a few megabytes.
GROUP_BYTES = 4 << 20


class Capacities:
    """Open bins by the room they have left; a segment tree finds the tightest that fits."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.tree = bytearray(2 * self.leaves)  # whether some bin below has room of this size
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, number: int, room: int) -> None:
        self.bins[room].append(number)
        node = self.leaves + room
        while node and not self.tree[node]:
            self.tree[node] = 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Bin with the least room of at least ``size``, and its room."""
        node = self.leaves + size
        if not self.tree[node]:
            while node > 1 and (node & 1 or not self.tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.tree[2 * node] else 2 * node + 1
        room = node - self.leaves
        number = self.bins[room].pop()
        while node and not self.bins[room] and not (node < self.leaves and (self.tree[2 * node] or self.tree[2 * node + 1])):
            self.tree[node] = 0
            node >>= 1
        return number, room


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Items of each bin: longest items first, each into the fullest bin that holds it."""
    open_bins, bins = Capacities(length), []
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = open_bins.take(sizes[item])
        if found is None:
            found = (len(bins), length)
            bins.append([])
        number, room = found
        bins[number].append(item)
        if room > sizes[item]:
            open_bins.add(number, room - sizes[item])
    return bins


def _tokenized(ranks, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of at most ``length`` ids: id, part, ids as little-endian bytes."""
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.value.splitlines())}
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first in range(0, len(texts), 512):
                rows, parts, ids = [], [], []
                for row, text in enumerate(texts[first : first + 512], first):
                    line = np.array([*encoding.encode_ordinary(text or ""), END], "<u2").tobytes()
                    cuts = range(0, len(line), 2 * length)
                    rows += [row] * len(cuts)
                    parts += range(len(cuts))
                    ids += [line[c : c + 2 * length] for c in cuts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(parts, pa.int32()), pa.array(ids, pa.binary())],
                    names=["id", "part", "ids"],
                )

    return run


def _packed(length: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("id", "ascending"), ("part", "ascending"), ("ids", "ascending")]).combine_chunks()
        ids = group.column("ids").to_pylist()
        names, parts = group.column("id"), group.column("part").to_pylist()
        bins = best_fit_decreasing([len(i) // 2 for i in ids], length)
        pad = np.array([END], "<u2").tobytes()
        ramp = np.arange(length, dtype="<u2").tobytes()
        rows: list[tuple] = []
        for items in bins:
            line = b"".join(ids[i] for i in items)
            sizes = [len(ids[i]) // 2 for i in items]
            used = len(line) // 2
            places = b"".join(ramp[: 2 * s] for s in sizes) + ramp[: 2 * (length - used)]
            rows.append((used, line + pad * (length - used), places, np.cumsum([0, *sizes]).tolist(), [parts[i] for i in items]))
        columns = list(zip(*rows))
        ends = np.cumsum([0, *(len(b) for b in bins)])
        flat = names.combine_chunks().take(pa.array([i for b in bins for i in b], pa.int64()))
        return pa.table(
            {
                "pack_group": pa.array([group.column("pack_group")[0].as_py()] * len(bins), pa.int64()),
                "pack": pa.array(range(len(bins)), pa.int32()),
                "n_tokens": pa.array(columns[0], pa.int32()),
                "ids": pa.array(columns[1], pa.binary()),
                "positions": pa.array(columns[2], pa.binary()),
                "cu_seqlens": pa.array(columns[3], pa.list_(pa.int32())),
                "docs": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat),
                "parts": pa.array(columns[4], pa.list_(pa.int32())),
            }
        )

    return run


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, ranks: str = RANKS
) -> DataFrame:
    """Rows of a packed id matrix, ``length`` 16-bit ids each, with what tells its segments apart.

    ``ids`` and ``positions`` are little-endian bytes; positions start anew at every
    segment, ``cu_seqlens`` are the segments' cumulative lengths (from 0), ``docs`` and
    ``parts`` name the document and its part in each segment. A document ends with the
    free id; one above ``length`` ids is cut into parts that together are all its ids.
    The rest of a row is filled with the free id, a last stretch that no segment covers.

    Pieces are dealt by hash into groups of about ``GROUP_BYTES`` of text, and each group
    is packed best-fit-decreasing, so no task sees more than its group; parts of one long
    document, or of rows without an id, spread too. Write the result as Parquet: the
    matrix is then in files of the table format, committed whole.

    NULL and empty texts are a segment of the end alone. Rows that repeat an id are
    packed each. An empty table gives an empty one.
    """
    with open(ranks, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    kind = docs.schema[id_col].dataType.simpleString()
    size = docs.select(F.sum(F.octet_length(text_col))).first()[0] or 0
    groups = max(1, -(-size // GROUP_BYTES))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    pieces = own.mapInArrow(_tokenized(shared, length), f"id {kind}, part int, ids binary")
    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64("id", "part", "ids"), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInArrow(
        _packed(length),
        "pack_group long, pack int, n_tokens int, ids binary, positions binary, cu_seqlens array<int>, "
        f"docs array<{kind}>, parts array<int>",
    )
