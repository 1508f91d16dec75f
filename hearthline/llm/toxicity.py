"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence is toxic with the logistic of the weights of its words; a document is if any of
its sentences is (noisy-or). Weights are learned from document labels alone, and the trained
model then says which sentences offend.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from hearthline.session import scratch, stored

from .words import LOWER, Tally, Texts, chunks, mixed

PREFIXES = (3, 4, 5, 6)  # bytes of the beginnings of words that are features beside whole words
# The model is fitted on at most MAX_FITTED rows of each label, those whose ids have the smallest
# MD5. Features are those that so many of its texts hold, and whose share of toxic ones differs
# from the usual by so many deviations; the model keeps the MAX_FEATURES that differ most.
LEAST_DOCS, LEAST_SIGMAS = 4, 6.0
MAX_FEATURES = 20_000
MAX_FITTED = 6000
FIT_PARTS = 1024
STEPS, RATE, RIDGE = 400, 0.1, 2e-6
PREDICTED = 0.3
OFFENDING = 0.5  # sentences at or above this score offend
SENTENCES = ArrayType(
    StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("score", DoubleType())])
)
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[c for c in range(256) if c >= 128 or chr(c).isalpha()]] = True


@dataclass(frozen=True)
class Model:
    """Weights of the sorted ``features`` (hashes), and of a sentence without any."""

    features: np.ndarray
    weights: np.ndarray
    bias: float


def sentences(texts: Texts) -> tuple[np.ndarray, ...]:
    """Sentence and hash of each feature; text, start and end (in bytes) of each sentence.

    A sentence ends with one of ``.!?`` or a line; stretches without a letter are none.
    """
    starts, ends = texts.runs(_LETTER[texts.data])
    owner = texts.owner(starts)
    stops = np.concatenate([[0], np.cumsum(_ENDS[texts.data])])[starts]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (stops[1:] != stops[:-1])
    sentence = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(starts)) - 1 if len(first) else first
    lowered = Texts(LOWER[texts.data], texts.bounds)
    cuts = [ends, *(np.minimum(starts + n, ends) for n in PREFIXES)]
    whole = [np.ones(len(starts), bool), *(ends - starts > n for n in PREFIXES)]
    kind = np.repeat(np.arange(len(cuts)), [w.sum() for w in whole])
    begin = np.concatenate([starts[w] for w in whole])
    hashed = lowered.hashes(begin, np.concatenate([c[w] for c, w in zip(cuts, whole, strict=True)]))
    hashed = mixed(hashed + (kind > 0).astype(np.uint64))  # a beginning is not the word of the same letters
    return np.concatenate([sentence[w] for w in whole]), hashed, owner[first], starts[first], ends[last]


def telling(texts_of: pa.Array, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Hashes of the features that tell toxic texts from others, ascending."""
    tally = Tally(2)
    for first, texts in chunks(texts_of):
        sentence, hashed, owner, _, _ = sentences(texts)
        order = np.lexsort((hashed, owner[sentence]))
        text, hashed = owner[sentence][order], hashed[order]
        fresh = np.append(True, (text[1:] != text[:-1]) | (hashed[1:] != hashed[:-1]))[: len(text)]
        row = first + text[fresh]
        tally.add(hashed[fresh], np.ones(len(row), np.int64), label[row].astype(np.int64))
    keys, (docs, toxic) = tally.sums()
    # In units of toxic rows, with the others as many as they stand for.
    bad = label == 1
    other = weight[~bad].mean() / weight[bad].mean()
    share = bad.sum() / (bad.sum() + other * (~bad).sum())
    stands = toxic + other * (docs - toxic)
    off = np.abs(toxic - share * stands) / np.sqrt(stands * share * (1 - share))
    able = np.flatnonzero((docs >= LEAST_DOCS) & (off >= LEAST_SIGMAS))
    most = able[np.argsort(-off[able], kind="stable")[:MAX_FEATURES]]
    return np.sort(keys[most])


def _features(texts: Texts, chosen: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (sentence, place in ``chosen``) pairs, the text of each sentence, and its span."""
    sentence, hashed, owner, starts, ends = sentences(texts)
    place = np.searchsorted(chosen, hashed)
    known = place < len(chosen)
    known[known] = chosen[place[known]] == hashed[known]
    width = max(len(chosen), 1)
    pair = np.unique(sentence[known] * width + place[known])
    return pair // width, pair % width, owner, starts, ends


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def noisy_or(p: np.ndarray, owner: np.ndarray, n: int, many: np.ndarray | float = 1.0) -> np.ndarray:
    """Probability by text that any of its sentences is toxic; sentence i stands for ``many[i]``."""
    return -np.expm1(np.bincount(owner, weights=many * np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n))


def trained(sentence, place, owner, many, label, weight, width: int) -> tuple[np.ndarray, float]:
    """Weights and bias that make the labels of the texts likeliest, by Adam on the whole sample.

    Sentence i lies in text ``owner[i]`` and stands for ``many[i]`` equal ones.
    """
    parameters = np.zeros(width + 1)
    parameters[width] = -5.0
    mean, square = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(sentence, weights=parameters[place], minlength=len(owner)) + parameters[width]
        p = _logistic(z)
        whole = np.clip(noisy_or(p, owner, len(label), many), 1e-9, 1)
        pull = many * p * (weight * (label - whole) / whole)[owner]
        slope = np.append(np.bincount(place, weights=pull[sentence], minlength=width), pull.sum())
        slope = slope / weight.sum() - RIDGE * np.append(parameters[:width], 0)
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        parameters += RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return parameters[:width], float(parameters[width])


def _fitted(group: pa.Table) -> pa.Table:
    """One row: features, weights and bias learned from the rows of the sample."""
    group = group.combine_chunks()
    column = group.column("text").combine_chunks()
    label = np.asarray(group.column("label").combine_chunks().cast(pa.float64()))
    weight = np.asarray(group.column("weight").combine_chunks())
    chosen = telling(column, label, weight)
    parts, before = [], 0
    for first, texts in chunks(column):
        sentence, place, owner, starts, _ = _features(texts, chosen)
        told = np.unique(sentence)
        # The sentences of a text that tell nothing are one, with their number.
        silent = np.bincount(owner, minlength=len(texts)) - np.bincount(owner[told], minlength=len(texts))
        rest = np.flatnonzero(silent)
        parts.append(
            (
                np.searchsorted(told, sentence) + before,
                place,
                np.concatenate([owner[told], rest]) + first,
                np.concatenate([np.ones(len(told)), silent[rest]]),
            )
        )
        before += len(told) + len(rest)
    sentence, place, owner, many = (np.concatenate(x) for x in zip(*parts, strict=True))
    weights, bias = trained(sentence, place, owner, many, label, weight, len(chosen))
    return pa.table(
        {"features": pa.array([chosen.tobytes()], pa.binary()), "weights": pa.array([weights.tobytes()], pa.binary()), "bias": pa.array([bias])}
    )


def _smallest(rows: DataFrame, order: list[str]) -> DataFrame:
    """At most ``MAX_FITTED`` rows of each label, the first by ``order``; no window part grows with the rows.

    Rows are cut down within parts first, dealt so that repeats of one row lie in many.
    """
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    rows = rows.withColumn("part", F.pmod(F.xxhash64("tie"), F.lit(FIT_PARTS)))
    for keys in (["label", "part"], ["label"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, "tie"))
        rows = rows.withColumn("place", place).where(F.col("place") <= MAX_FITTED)
    return rows.drop("tie", "part", "place")


def fit(
    training: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> Model:
    """A model from the texts of ``training`` and the labels (0 or 1) of their ids.

    The sample is chosen by id, before any text is read: at most ``MAX_FITTED`` ids of each
    label are broadcast, and only their texts are brought together, in one task. Its rows weigh
    as much as the labels they stand for. Other and missing labels, rows without an id and NULL
    texts are left out; of several labels of an id the largest counts; of repeated ids again at
    most ``MAX_FITTED`` rows are taken. Without rows of both labels every sentence has the
    share of toxic rows for a score.
    """
    texts = training.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.where("label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    known = known.join(texts.select("id").distinct(), "id").withColumn("order", F.md5(F.col("id").cast("string")))
    with scratch(training.sparkSession):
        return _model(stored(known, "labelled"), texts)


def _model(known: DataFrame, texts: DataFrame) -> Model:
    many, bad = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < bad < many:
        share = min(max(bad / many if many else 0.0, 1e-6), 1 - 1e-6)
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(share / (1 - share))))
    stands = [(many - bad) / min(many - bad, MAX_FITTED), bad / min(bad, MAX_FITTED)]
    weight = F.when(F.col("label") == 1, F.lit(stands[1])).otherwise(F.lit(stands[0]))
    ids = _smallest(known, ["order", "id"]).select("id", "label", "order", weight.alias("weight"))
    sample = _smallest(texts.join(F.broadcast(ids), "id"), ["order", "id"])
    sample = sample.select("label", "weight", "text", F.lit(0).alias("all"))
    model = sample.groupBy("all").applyInArrow(_fitted, "features binary, weights binary, bias double").first()
    return Model(np.frombuffer(model.features, np.uint64), np.frombuffer(model.weights), model.bias)


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch.column(batch.num_columns - 1)):
                sentence, place, owner, starts, ends = _features(texts, model.features)
                z = np.bincount(sentence, weights=model.weights[place], minlength=len(starts)) + model.bias
                p = _logistic(z)
                score = noisy_or(p, owner, len(texts))
                count = np.bincount(owner, minlength=len(texts))
                # A text without a sentence counts as one without a telling word.
                score = np.where(count == 0, _logistic(np.array([model.bias])), score)
                bad = p >= OFFENDING
                spans = pa.StructArray.from_arrays(
                    [
                        pa.array(starts[bad] - texts.bounds[owner[bad]], pa.int64()),
                        pa.array(ends[bad] - texts.bounds[owner[bad]], pa.int64()),
                        pa.array(p[bad]),
                    ],
                    ["start", "end", "score"],
                )
                bounds = np.searchsorted(owner[bad], np.arange(len(texts) + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(c.slice(first, len(texts)) for c in batch.columns[:-1]),
                        pa.array(np.clip(score, 0, 1)),
                        pa.array((score >= PREDICTED).astype(np.int32)),
                        pa.array(count, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), spans),
                    ],
                    names=[*batch.schema.names[:-1], "score", "predicted", "n_sentences", "offending"],
                )

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` with score, predicted, n_sentences and offending.

    The text alone decides, all of it. ``offending`` lists the sentences that score
    ``OFFENDING`` or more, as byte spans of the text in UTF-8. NULL and empty texts, and
    those without a letter, have no sentence and the score of one without a telling word.
    Rows stay as many as they are; kept columns that clash with the result's are left out.
    """
    names = ("score", "predicted", "n_sentences", "offending")
    kept = [c for c in (keep or docs.columns) if c not in names]
    schema = docs.select(kept).schema.add("score", "double").add("predicted", "integer")
    schema = schema.add("n_sentences", "long").add("offending", SENTENCES)
    return docs.select(*kept, F.col(text_col).alias("__text")).mapInArrow(_scored(model), schema)


def fold(id_col: str, folds: int) -> Column:
    """Remainder of the CRC-32 of an id's text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds
