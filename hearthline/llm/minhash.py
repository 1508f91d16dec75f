"""Near-duplicates by b-bit MinHash: bands propose pairs, packed low bits screen them, full sets confirm."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthline.session import stored

from .graph import components
from .words import LOWER, Texts, chunks, mixed, windows

ROWS = 256  # minima per set
BITS = 4  # low bits kept of each minimum
BANDS, BAND_ROWS = 32, 5
_RANDOM = np.random.default_rng(733)
_FLIP = _RANDOM.integers(0, 2**32, ROWS, np.uint32)
_TIMES = _RANDOM.integers(0, 2**31, ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
SHINGLE = 3
# A bucket is looked at in so many parts first, so that no task meets a hot one whole.
PARTS = 64
# Sets and shingles that a block of a cluster holds about; a task compares two blocks.
BLOCK_SETS, BLOCK_SHINGLES = 256, 150_000


def shingle_sets(texts: Texts, words: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as ascending 64-bit hashes, and where each text's begin.

    Lower-cased (A-Z) words; a text with fewer than ``words`` has its whole sequence as
    one shingle, a text without words has none.
    """
    texts = Texts(LOWER[texts.data], texts.bounds)
    starts, ends = texts.words()
    owner = texts.owner(starts)
    hashed = texts.hashes(starts, ends)
    found, place = windows(hashed, owner, words)
    found, of = [found], [owner[place]]
    n_words = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(n_words)])
    for short in range(1, words):
        own = np.flatnonzero(n_words == short)
        total = np.zeros(len(own), np.uint64)
        for j in range(short):
            total = mixed(total + hashed[first[own] + j])
        found.append(mixed(total + np.uint64(short)))
        of.append(own)
    found, of = np.concatenate(found), np.concatenate(of)
    order = np.lexsort((found, of))
    found, of = found[order], of[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    found, of = found[new], of[new]
    return found, np.searchsorted(of, np.arange(len(texts) + 1))


def minima(found: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """``ROWS`` minima of each set that is not empty (rows by set)."""
    low = (found >> np.uint64(32)).astype(np.uint32)
    at = begins[:-1][np.diff(begins) > 0]
    out = np.empty((len(at), ROWS), np.uint32)
    if len(at):
        for row in range(ROWS):
            out[:, row] = np.minimum.reduceat((low ^ _FLIP[row]) * _TIMES[row], at)
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    """64-bit key of each band of full minima (rows by set, columns by band)."""
    keys = np.empty((len(low), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(low), band, np.uint64)
        for row in range(band * BAND_ROWS, (band + 1) * BAND_ROWS):
            key = mixed(key + low[:, row])
        keys[:, band] = key
    return keys


def packed(low: np.ndarray) -> np.ndarray:
    """The low ``BITS`` bits of the minima as bytes (rows by set)."""
    bits = (low[:, :, None] >> np.arange(BITS, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.reshape(len(low), -1).astype(np.uint8), axis=1)


def agreeing(sketches: np.ndarray, one: int, others: slice) -> np.ndarray:
    """In how many minima's low bits a set agrees with others: bit counts over packed words."""
    differ = sketches[others] ^ sketches[one]
    step = 1
    while step < BITS:  # gather the differing bits of a minimum in its lowest one
        differ = differ | (differ >> np.uint64(step))
        step *= 2
    lowest = np.uint64(sum(1 << k for k in range(0, 64, BITS)))
    return ROWS - np.bitwise_count(differ & lowest).sum(axis=1, dtype=np.int64)


def estimated(agree: np.ndarray) -> np.ndarray:
    """Similarity from agreeing low bits, corrected for those that agree by chance."""
    chance = 2.0**-BITS
    return (agree / ROWS - chance) / (1 - chance)


def screen(similarity: float) -> float:
    """Estimate below which a pair is not confirmed: five standard errors under ``similarity``."""
    chance = 2.0**-BITS
    hit = chance + (1 - chance) * similarity
    return similarity - 5 * (hit * (1 - hit) / ROWS) ** 0.5 / (1 - chance)


def spanning_links(
    sketches: np.ndarray, sets: list[np.ndarray], blocks: np.ndarray, percent: int
) -> list[tuple[int, int]]:
    """Pairs of positions that connect what all confirmed pairs among the given sets connect.

    ``blocks`` tells the two sides apart where two blocks meet; pairs within a side are
    then left to the group in which the block meets itself. A pair that is connected
    already is not confirmed again.
    """
    sizes = np.array([len(s) for s in sets])
    elements = np.concatenate(sets)
    known, number = np.unique(elements, return_inverse=True)
    common = np.bincount(number) > 1
    column = np.cumsum(common) - 1
    kept = common[number]
    owner = np.repeat(np.arange(len(sets)), sizes)[kept]
    place = column[number[kept]]
    width = -(-max(int(common.sum()), 1) // 64)
    bits = np.zeros((len(sets), width), np.uint64)
    np.bitwise_or.at(bits, (owner, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))

    parent = np.arange(len(sets))
    floor, links, apart = screen(percent / 100), [], len(np.unique(blocks)) > 1
    for i in range(1, len(sets)):
        near = np.flatnonzero(estimated(agreeing(sketches, i, slice(0, i))) >= floor)
        small, large = np.minimum(sizes[near], sizes[i]), np.maximum(sizes[near], sizes[i])
        near = near[(small * 100 >= large * percent) & ((not apart) | (blocks[near] != blocks[i]))]
        near = near[parent[near] != parent[i]]
        if len(near):
            shared = np.bitwise_count(bits[near] & bits[i]).sum(axis=1, dtype=np.int64)
            union = sizes[near] + sizes[i] - shared
            for j in near[100 * shared >= percent * union]:
                if parent[j] != parent[i]:
                    links.append((i, int(j)))
                    parent[parent == parent[i]] = parent[j]
    return links


def _signed(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document: id, size and 128-bit hash of its set, and its band keys."""
        for batch in batches:
            for first, texts in chunks(batch.column(1)):
                found, begins = shingle_sets(texts, words)
                sizes = np.diff(begins)
                some = np.flatnonzero(sizes)
                sums = np.zeros((2, len(texts)), np.uint64)
                if len(some):
                    for k, seed in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
                        each = mixed(found ^ np.uint64(seed))
                        sums[k, some] = np.add.reduceat(each, begins[:-1][some])
                keys = band_keys(minima(found, begins)).astype(np.int64).ravel()
                ends = np.zeros(len(texts) + 1, np.int32)
                ends[1:] = np.cumsum(np.where(sizes > 0, BANDS, 0))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(texts)),
                        pa.array(sizes.astype(np.int64)),
                        *(pa.array(s.view(np.int64)) for s in sums),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(keys)),
                    ],
                    names=["id", "n_shingles", "hi", "lo", "bands"],
                )

    return run


def _sketched(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The other columns, then each text's set and packed low bits."""
        for batch in batches:
            for first, texts in chunks(batch.column(0)):
                found, begins = shingle_sets(texts, words)
                raw = pa.py_buffer(found.tobytes())
                ends = pa.py_buffer((begins * 8).astype(np.int32).tobytes())
                sets = pa.Array.from_buffers(pa.binary(), len(texts), [None, ends, raw])
                sketch = np.zeros((len(texts), ROWS * BITS // 8), np.uint8)
                sketch[np.diff(begins) > 0] = packed(minima(found, begins))
                others = [c.slice(first, len(texts)) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays(
                    [*others, sets, pa.array([row.tobytes() for row in sketch], pa.binary())],
                    names=[*batch.schema.names[1:], "shingles", "sketch"],
                )

    return run


def _linked(percent: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        sets = [np.frombuffer(b, np.uint64) for b in group.column("shingles").to_pylist()]
        sketches = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint64)
        blocks = group.column("block").to_numpy()
        pairs = spanning_links(sketches.reshape(len(sets), -1), sets, blocks, percent)
        at = np.array(pairs, np.int64).reshape(-1, 2)
        ids = group.column("node")
        return pa.table({"u": ids.take(pa.array(at[:, 0])), "v": ids.take(pa.array(at[:, 1]))})

    return run


def _bucket_links(bands: DataFrame) -> DataFrame:
    """Links that join the members of every bucket (key, cls), a star of stars.

    A member hangs below the smallest of its part of the bucket, and that one below the
    smallest of the bucket. The second window sees heads together and leaves the others
    where they were; no window holds more than a part or the heads of a bucket.
    """
    part = F.pmod(F.xxhash64("cls"), F.lit(PARTS))
    head = F.min("cls").over(Window.partitionBy("key", "part"))
    inner = bands.withColumn("part", part).withColumn("head", head)
    inner = inner.withColumn("level", F.when(F.col("cls") == F.col("head"), F.lit(-1)).otherwise(F.col("part")))
    top = F.min("cls").over(Window.partitionBy("key", "level"))
    above = F.when(F.col("level") == -1, F.col("top")).otherwise(F.col("head"))
    return inner.withColumn("top", top).select(F.col("cls").alias("u"), above.alias("v")).where("u <> v").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, words: int = 5
) -> DataFrame:
    """id, n_shingles, component_id and kept for every row of ``docs``.

    Two documents are linked if ``100 * |A & B| >= percent * |A | B|`` for their sets of
    distinct ``words``-word shingles; a component is what links reach, named by its
    smallest id, which is the one kept.

    Rows with the same set (128-bit hash) are one class. Classes that share a band of
    minima are joined up to clusters, without comparing pairs. Inside a cluster packed
    low bits estimate the similarity, corrected for chance, and full sets confirm what
    the estimate does not rule out by five standard errors. Clusters are compared
    block by block; a task gets two blocks and returns a spanning forest, never the
    pairs. With 32 bands of 5 rows a pair at 0.80 shares no bucket with a chance of
    3e-6 (at 0.85: 7e-9), and clusters join up many pairs that share none.

    NULL, empty and wordless texts have an empty set and are linked with nothing. A row
    without an id is reported with its set's size and its copies' component. Rows that
    repeat an id are one document.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = stored(
        own.mapInArrow(_signed(words), f"id {kind}, n_shingles long, hi long, lo long, bands array<long>"),
        "signatures",
    )
    per_set = ["hi", "lo", "n_shingles"]
    named = signed.where("n_shingles > 0 and id is not null")
    classes = stored(
        named.groupBy(*per_set).agg(F.min("id").alias("cls"), F.first("bands").alias("bands")), "classes"
    )
    clusters = components(_bucket_links(classes.select("cls", F.explode("bands").alias("key"))))

    sized = clusters.join(classes.select(F.col("cls").alias("node"), "n_shingles"), "node")
    many = F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("n_shingles") / BLOCK_SHINGLES)
    counts = sized.groupBy("component").agg(F.ceil(many).cast("int").alias("n_blocks"))
    blocked = clusters.join(counts, "component").withColumn(
        "block", F.pmod(F.xxhash64(F.lit(7), "node"), F.col("n_blocks")).cast("int")
    )
    members = own.join(blocked, F.col("id") == F.col("node")).select("text", "node", "component", "block", "n_blocks")
    sketched = members.mapInArrow(
        _sketched(words),
        f"node {kind}, component {kind}, block int, n_blocks int, shingles binary, sketch binary",
    )
    partner = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    met = sketched.withColumn("partner", partner).select(
        "component",
        F.least("block", "partner").alias("one"),
        F.greatest("block", "partner").alias("other"),
        "block", "node", "shingles", "sketch",
    )
    links = met.groupBy("component", "one", "other").applyInArrow(_linked(percent), f"u {kind}, v {kind}")
    linked = components(links)

    known = classes.join(linked.withColumnRenamed("node", "cls"), "cls", "left").select(
        *per_set, F.coalesce("component", "cls").alias("of_class")
    )
    found = signed.select("id", *per_set).join(known, per_set, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("of_class")).otherwise(F.col("id"))
    return found.select(
        F.col("id").alias(id_col),
        "n_shingles",
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
