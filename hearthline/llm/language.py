"""Language ID: the nearest of several centroids per language, over TF-IDF n-gram vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import Texts, chunks, mixed

DIM = 4096  # hash buckets of n-grams
GRAMS = (1, 2, 3)  # bytes of the lower-cased text
CLUSTERS = 4  # centroids per language
ROUNDS = 12
# Centroids are fitted on at most so many rows per language, those whose ids have the
# smallest MD5; document frequencies count every training row.
MAX_FITTED = 1000
FIT_PARTS = 1024
# A text farther from its centroid than so many times the centroid's own radius is rejected.
SLACK = 1.5
UNKNOWN = "und"
_ROWS = 512  # dense vectors held at once
# ASCII other than letters reads as a space.
_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[[c for c in range(128) if not chr(c).isalpha()]] = 32


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()))


def worded(texts: Texts) -> Texts:
    """Letters, with one space for whatever lies between them."""
    data = _LETTERS[texts.data]
    kept = np.ones(len(data), bool)
    kept[1:] = (data[1:] != 32) | (data[:-1] != 32)
    return Texts(data[kept], np.concatenate([[0], np.cumsum(kept)])[texts.bounds])


def gram_counts(texts: Texts) -> np.ndarray:
    """Counts of hashed n-grams, rows by text."""
    texts = worded(texts)
    data, n = texts.data, len(texts)
    counts = np.zeros(n * DIM, np.int64)
    code = np.zeros(len(data), np.uint64)
    owner = np.repeat(np.arange(n), np.diff(texts.bounds))
    for size in range(1, max(GRAMS) + 1):
        many = len(data) - size + 1
        if many <= 0:
            break
        code = (code[:many] << np.uint64(8)) | data[size - 1 :]
        if size in GRAMS:
            inside = owner[:many] == owner[size - 1 :]
            bucket = mixed(code + (np.uint64(size) << np.uint64(56))) % np.uint64(DIM)
            place = owner[:many] * DIM + bucket.astype(np.int64)
            counts += np.bincount(place[inside], minlength=n * DIM)
    return counts.reshape(n, DIM)


def vectors(texts: Texts, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors; an empty text has the zero vector."""
    weighted = (np.log1p(gram_counts(texts)) * idf).astype(np.float32)
    norms = np.linalg.norm(weighted, axis=1, keepdims=True)
    return weighted / np.maximum(norms, 1e-12)


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, rows = np.zeros(DIM, np.int64), 0
    for batch in batches:
        for _, texts in chunks(lowered(batch.column(0)), rows=_ROWS):
            seen += (gram_counts(texts) > 0).sum(axis=0)
            rows += len(texts)
    # Bucket DIM carries the number of texts.
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(DIM + 1, dtype=np.int32)), pa.array(np.append(seen, rows))], names=["bucket", "n"]
    )


def clustered(points: np.ndarray, k: int = CLUSTERS) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids of a spherical k-means with farthest-first starts, and their radii."""
    mean = points.mean(axis=0)
    chosen = [points[np.argmax(points @ mean)]]
    while len(chosen) < min(k, len(points)):
        nearest = (points @ np.array(chosen).T).max(axis=1)
        chosen.append(points[np.argmin(nearest)])
    centroids = np.array(chosen)
    for _ in range(ROUNDS):
        of = np.argmax(points @ centroids.T, axis=1)
        sums = np.stack([points[of == c].sum(axis=0) if (of == c).any() else centroids[c] for c in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    likeness = points @ centroids.T
    of = np.argmax(likeness, axis=1)
    far = 1 - likeness[np.arange(len(points)), of]
    return centroids, np.array([far[of == c].max(initial=0.0) for c in range(len(centroids))])


def _fitted(idf: np.ndarray):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        points = np.concatenate([vectors(t, idf) for _, t in chunks(lowered(group.column("text").combine_chunks()), rows=_ROWS)])
        centroids, radii = clustered(points)
        lang = group.column("lang")[0].as_py()
        return pa.table(
            {
                "lang": pa.array([lang] * len(radii), pa.string()),
                "centroid": pa.array([c.astype(np.float32).tobytes() for c in centroids], pa.binary()),
                "radius": pa.array(radii.astype(float)),
            }
        )

    return run


def fit(training: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"):
    """Model from labelled rows: idf, languages, centroids and radii as numpy arrays.

    Document frequencies come from one pass over all training texts. The driver gets
    one number per bucket, and ``CLUSTERS`` centroids per language.
    """
    rows = training.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    found = rows.select(text_col).mapInArrow(_document_frequencies, "bucket int, n long")
    total = np.zeros(DIM + 1)
    for row in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[row["bucket"]] = row["n"]
    idf = np.log((1 + total[DIM]) / (1 + total[:DIM])) + 1

    order = F.md5(F.col(id_col).cast("string"))
    named = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), order.alias("order"))
    parts = named.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(FIT_PARTS)))
    for keys in (["lang", "part"], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("order", "id"))
        parts = parts.withColumn("place", place).where(F.col("place") <= MAX_FITTED)
    chosen = F.broadcast(parts.select(F.col("id").alias("__id"), F.col("lang").alias("__lang")).distinct())
    sample = rows.select(id_col, F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).join(
        chosen, (F.col(id_col) == F.col("__id")) & (F.col("lang") == F.col("__lang"))
    )
    models = (
        sample.select("lang", "text")
        .groupBy("lang")
        .applyInArrow(_fitted(idf), "lang string, centroid binary, radius double")
        .orderBy("lang", "radius", "centroid")
        .collect()
    )
    centroids = np.array([np.frombuffer(m["centroid"], np.float32) for m in models]).reshape(-1, DIM)
    return idf, [m["lang"] for m in models], centroids, np.array([m["radius"] for m in models])


def _predicted(model):
    idf, langs, centroids, radii = model
    names = np.array([*langs, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = lowered(batch.column(batch.num_columns - 1))
            letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            best, score = np.full(len(text), len(langs)), np.zeros(len(text))
            for first, texts in chunks(text, rows=_ROWS) if langs else ():
                likeness = np.clip(vectors(texts, idf) @ centroids.T, 0, 1)
                own = slice(first, first + len(texts))
                best[own] = np.argmax(likeness, axis=1)
                score[own] = likeness.max(axis=1)
            best, score = np.where(letters, best, len(langs)), np.where(letters, score, 0.0)
            far = 1 - score > SLACK * np.append(radii, 2.0)[best]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names[best], pa.string()), pa.array(score), pa.array(far)],
                names=[*batch.schema.names[:-1], "lang_pred", "score", "rejected"],
            )

    return run


def identify(docs: DataFrame, model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` with lang_pred, score (cosine) and rejected.

    The text alone decides. ``lang_pred`` names the language of the nearest centroid, or
    ``und`` with score 0 for a NULL text, one without a letter, or without any model.
    ``rejected`` marks a text beyond ``SLACK`` radii of its centroid. All of a text counts.
    """
    kept = [c for c in (keep or docs.columns) if c not in ("lang_pred", "score", "rejected")]
    schema = docs.select(kept).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return docs.select(*kept, F.col(text_col).alias("__text")).mapInArrow(_predicted(model), schema)


def fold(id_col: str, folds: int) -> Column:
    """Remainder of the CRC-32 of an id's text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds
