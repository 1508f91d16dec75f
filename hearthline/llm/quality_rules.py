"""Quality rules: plain counts, and a hashed n-gram log-likelihood ratio to trusted text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Texts, chunks, mixed, per_text, windows

BUCKETS = 1 << 16
GRAM = 3  # bytes, case kept
PRIOR = 0.5  # added to every bucket's count
# Mean log ratio per n-gram below which a document is unlike the trusted ones. Clean text
# lies near 0 (a little off where trusted text has other shares of languages), junk below -1.
THRESHOLD = -0.5
# The trusted multinomial is fitted on at most so many labelled documents, those whose
# ids have the smallest MD5; the raw multinomial counts every document.
MAX_TRUSTED = 20_000
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))

COUNTS = "bucket int, raw long, trusted long"
MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_grams long, log_ratio double"
)


def gram_buckets(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and place of every n-gram inside a text."""
    data = texts.data
    many = len(data) - GRAM + 1
    if many <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.zeros(many, np.uint64)
    for j in range(GRAM):
        code = (code << np.uint64(8)) | data[j : j + many]
    inside = np.ones(many + GRAM, bool)
    ends = texts.bounds[1:]
    for back in range(1, GRAM):
        inside[ends[ends >= back] - back] = False  # empty texts at the front end before any place
    places = np.flatnonzero(inside[:many])
    return (mixed(code[places]) % np.uint64(BUCKETS)).astype(np.int64), places


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-gram counts of a task's texts, in all and in trusted ones."""
    raw, trusted = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        flags = np.asarray(batch.column("trusted").fill_null(False).to_numpy(zero_copy_only=False), bool)
        for first, texts in chunks(batch.column("text")):
            bucket, place = gram_buckets(texts)
            raw += np.bincount(bucket, minlength=BUCKETS)
            own = flags[first : first + len(texts)]
            if own.any():
                trusted += np.bincount(bucket[own[texts.owner(place)]], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays(
        [pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(trusted[some])],
        names=["bucket", "raw", "trusted"],
    )


def fit_weights(docs: DataFrame, trusted_ids: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Log ratio of trusted to raw probability for each hash bucket.

    One pass over all texts counts both multinomials; a task sends at most ``BUCKETS``
    rows. ``trusted_ids`` (one column) is cut to ``MAX_TRUSTED`` and hence broadcast.
    The driver gets ``BUCKETS`` rows. Without trusted text every weight is 0.
    """
    chosen = (
        trusted_ids.toDF("__trusted").dropna().distinct()
        .orderBy(F.md5(F.col("__trusted").cast("string"))).limit(MAX_TRUSTED)
    )
    marked = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("__trusted"), "left").select(
        F.col(text_col).alias("text"), F.col("__trusted").isNotNull().alias("trusted")
    )
    rows = (
        marked.mapInArrow(_counted, COUNTS)
        .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))
        .toPandas()
    )
    raw, trusted = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[rows["bucket"]], trusted[rows["bucket"]] = rows["raw"], rows["trusted"]
    if not trusted.sum():
        return np.zeros(BUCKETS)
    share = lambda c: np.log((c + PRIOR) / (c.sum() + PRIOR * BUCKETS))
    return share(trusted) - share(raw)


def measures(texts: Texts, weights: np.ndarray) -> list[np.ndarray]:
    """The columns of ``MEASURES`` for each text."""
    n, data = len(texts), texts.data
    starts, ends = texts.words()
    owner = texts.owner(starts)
    inside = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=inside[1:])
    characters = per_text(inside[ends] - inside[starts], owner, n)
    symbols = np.diff(np.concatenate([[0], np.cumsum(SYMBOLS[data])])[texts.bounds])

    from_, to = texts.runs(data != 0x0A)
    line_owner = texts.owner(from_)
    worded = np.searchsorted(starts, to) > np.searchsorted(starts, from_)
    from_, to, line_owner = from_[worded], to[worded], line_owner[worded]
    lines = mixed(texts.hashes(from_, to) + line_owner.astype(np.uint64))
    new = np.zeros(len(lines), bool)
    new[np.unique(lines, return_index=True)[1]] = True
    repeated_lines = per_text(~new, line_owner, n)

    found, place = windows(texts.hashes(starts, ends), owner, REPEAT_WINDOW)
    _, kind, times = np.unique(
        mixed(found + owner[place].astype(np.uint64)), return_inverse=True, return_counts=True
    )
    again = place[times[kind] > 1]
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + REPEAT_WINDOW, -1)
    repeated_words = per_text(np.cumsum(cover[:-1]) > 0, owner, n)

    bucket, where = gram_buckets(texts)
    gram_owner = texts.owner(where)
    grams = np.bincount(gram_owner, minlength=n)
    ratio = np.bincount(gram_owner, weights=weights[bucket], minlength=n) / np.maximum(grams, 1)
    return [np.bincount(owner, minlength=n), characters, symbols, repeated_lines, repeated_words, grams, ratio]


def assess(
    docs: DataFrame,
    trusted_ids: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Counts, ``log_ratio``, ``base_failed`` and ``kept`` beside the columns of ``docs``.

    ``log_ratio`` is the mean over a text's hashed byte n-grams of the log of their
    probability in trusted text over that in the whole corpus. A document is kept if the
    plain rules pass and the ratio is at least ``threshold``; every document is judged.

    NULL counts as empty: no words, ratio 0, ``base_failed``. Columns of ``docs`` that
    have the name of a result column give way to it.
    """
    weights = fit_weights(docs, trusted_ids, id_col, text_col)
    names = [f.split()[0] for f in MEASURES.split(", ")]
    verdicts = {"base_failed", "kept"}
    own = [c for c in docs.columns if c not in names and c not in verdicts]
    at = own.index(text_col)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [measures(texts, weights) for _, texts in chunks(batch.column(at))]
            if parts:
                columns = [pa.array(np.concatenate(c)) for c in zip(*parts)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*own, *names])

    schema = docs.select(own).schema
    for field in MEASURES.split(", "):
        schema = schema.add(*field.split())
    scored = docs.select(own).mapInArrow(measured, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return scored.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("log_ratio") >= threshold)
    )
