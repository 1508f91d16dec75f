"""LM scores by deleted interpolation of bigrams and unigrams over context-frequency buckets."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.session import stored

from .words import LOWER, Texts, chunks, mixed

# Text per block: a block asks once for the counts of its distinct n-grams. Above
# WIDE_BYTES of text blocks grow with the root of the whole, so that their rows to the
# ranges, of which there are more as well, do not become many and short; up to MOST_BYTES.
BLOCK_BYTES = 8 << 20
WIDE_BYTES = 64 << 30
MOST_BYTES = 128 << 20
# Text per range of n-gram hashes: the number of ranges follows the input, and what a
# range holds does not: some RANGE_BYTES / 8 n-grams, each once for every block.
RANGE_BYTES = 8 << 20
BATCH_KEYS = 1 << 20
PRIOR = 0.5
_START, _END = np.uint64(0x1D8E4E27C47D124F), np.uint64(0xEB44ACCAB455D165)
_NEXT = np.uint64(0x9E3779B97F4A7C15)
CLASSES = 32  # context-frequency buckets: powers of two
_BINS, _STEP = 2560, 32  # likelihood ratios from 2^-40 to 2^40, in 1/32 of a doubling

ROLES = {"train": 1, "held": 2, "test": 0}


class Grams:
    """Tokens of a block's texts as places in its sorted distinct unigrams and bigrams."""

    def __init__(self, column: pa.Array):
        parts, self.n_tokens = [], np.zeros(len(column), np.int64)
        for first, texts in chunks(column):
            texts = Texts(LOWER[texts.data], texts.bounds)
            starts, ends = texts.words()
            n_words = np.bincount(texts.owner(starts), minlength=len(texts))
            # Every text is its words between a start and an end.
            line = np.full(len(starts) + 2 * len(texts), _END, np.uint64)
            heads = np.cumsum(n_words + 2) - (n_words + 2)
            line[heads] = _START
            word = np.ones(len(line), bool)
            word[heads] = word[heads + n_words + 1] = False
            line[word] = texts.hashes(starts, ends)
            parts.append(line)
            self.n_tokens[first : first + len(texts)] = n_words + 1
        line = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        head = np.zeros(len(line), bool)
        head[np.cumsum(self.n_tokens + 1) - (self.n_tokens + 1)] = True
        token = np.flatnonzero(~head)
        self.words, place = np.unique(line, return_inverse=True)
        self.pairs, self.pair = np.unique(mixed(line[token - 1] * _NEXT + line[token]), return_inverse=True)
        self.word, self.context, self.starts = place[token], place[token - 1], place[head]
        self.owner = np.repeat(np.arange(len(column)), self.n_tokens)


def dealt(size: int, held: int) -> tuple[int, int, int]:
    """Blocks of other and of held-out text and ranges (a power of two) for so many bytes."""
    block = min(max(BLOCK_BYTES, int(BLOCK_BYTES * math.sqrt(size / WIDE_BYTES))), MOST_BYTES)
    ranges = 1 << max(1, (-(-size // RANGE_BYTES) - 1).bit_length())
    return max(1, -(-(size - held) // block)), max(1, -(-held // block)), ranges


def _ranged(keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges that hold some of the ascending ``keys``, with their first key and end."""
    of = keys >> np.uint64(64 - ranges.bit_length() + 1)
    heads = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)])
    return of[heads].astype(np.int64), heads, np.append(heads[1:], len(keys))[: len(heads)]


def _planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte, all lowest bytes first: high bytes are zeros that compress away."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _values(planes: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(planes, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def _small(counts: np.ndarray) -> bytes:
    """Counts, most of them 0 or 1, in a fraction of a byte each."""
    return zlib.compress(_planes(counts.astype(np.uint32)), 1)


def _counts(blob: bytes) -> np.ndarray:
    return _values(zlib.decompress(blob), np.uint32)


def _asked(ranges: int):
    def run(group: pa.Table) -> pa.Table:
        """A block's distinct n-grams by range, each with its counts in training and in held-out text."""
        group = group.combine_chunks()
        grams = Grams(group.column("text").combine_chunks())
        role = group.column("role").to_numpy()
        train = role[grams.owner] > 0
        held = role[grams.owner] == ROLES["held"]
        rows: dict[str, list] = {"range": [], "block": [], "keys": [], "train": [], "held": []}
        block = group.column("block")[0].as_py()
        for kind, (keys, place) in enumerate(((grams.words, grams.word), (grams.pairs, grams.pair))):
            counts = [np.bincount(place[m], minlength=len(keys)) for m in (train, held)]
            if kind == 0:  # how often a text starts is the frequency of that context, and no token
                for c, own in zip(counts, (role > 0, role == ROLES["held"])):
                    c += np.bincount(grams.starts[own], minlength=len(keys))
            for r, a, b in zip(*(v.tolist() for v in _ranged(keys, ranges))):
                rows["range"].append(kind * ranges + r)
                rows["block"].append(block)
                rows["keys"].append(_planes(np.diff(keys[a:b], prepend=np.uint64(0))))
                for name, c in zip(("train", "held"), counts):
                    rows[name].append(_small(c[a:b]))
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(v, k) for v, k in zip(rows.values(), kinds)], names=list(rows))

    return run


def _answered(ranges: int):
    def answer(held: list[tuple]) -> pa.RecordBatch:
        keys = [np.cumsum(_values(row[2], np.uint64), dtype=np.uint64) for row in held]
        given = [np.concatenate([_counts(row[at]) for row in held]) for at in (3, 4)]
        # Unigrams and bigrams are hashed alike but may not meet: their ranges differ.
        kind = np.repeat([row[0] >= ranges for row in held], [len(k) for k in keys])
        every = np.concatenate(keys)
        whole = [0, 0, 0]  # distinct and all training tokens, held-out tokens
        sums = np.zeros((2, len(every)), np.int64)
        for which in (False, True):
            own = np.flatnonzero(kind == which)
            distinct, place = np.unique(every[own], return_inverse=True)
            totals = [
                np.bincount(place, weights=given[s][own], minlength=len(distinct)).astype(np.int64) for s in (0, 1)
            ]
            sums[:, own] = [total[place] for total in totals]
            if not which:
                train, test = (total[distinct != _START] for total in totals)
                whole = [int((train > 0).sum()), int(train.sum()), int(test.sum())]
        ends = np.cumsum([len(k) for k in keys]).tolist()
        spans = list(zip([0, *ends], ends))
        out = [[_small(c[a:b]) for a, b in spans] for c in sums]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([row[0] for row in held] + [-1], pa.int64()),
                pa.array([row[1] for row in held] + [-1], pa.int64()),
                *(pa.array([*c, b""], pa.binary()) for c in out),
                *(pa.array([0] * len(held) + [n], pa.int64()) for n in whole),
            ],
            names=[f.split()[0] for f in ANSWER.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The same rows with counts summed over all blocks; rows come sorted by range.

        A row of block -1 holds what the ranges add to the corpus totals.
        """
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("range", "block", "keys", "train", "held"))):
                if size >= BATCH_KEYS and row[0] != held[-1][0]:
                    yield answer(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2]) // 8
        if held:
            yield answer(held)

    return run


ANSWER = "range long, block long, train binary, held binary, vocabulary long, tokens long, held_tokens long"


def frequency_class(count: np.ndarray) -> np.ndarray:
    """Bucket of a context by its frequency: 0 for unseen ones, then powers of two."""
    return np.minimum(np.ceil(np.log2(count + 1.0)), CLASSES - 1).astype(np.uint8)


class Block(Grams):
    """A block's texts with the counts that its n-grams have in all training text."""

    def __init__(self, texts: pa.Table, answers: pa.Table):
        super().__init__(texts.column("text").combine_chunks())
        answers = answers.sort_by("range")
        self.train, self.held = (
            np.concatenate([_counts(b) for b in answers.column(c).to_pylist()]).astype(np.int64)
            for c in ("train", "held")
        )
        if len(self.train) != len(self.words) + len(self.pairs):
            raise ValueError("a block's n-grams and their counts differ")

    def ratios(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per token its context's bucket, and the bigram estimate over the unigram count."""
        n = len(self.words)
        context = c[:n][self.context]
        estimate = c[n:][self.pair] / np.maximum(context, 1)
        return frequency_class(context), estimate / (c[:n][self.word] + PRIOR)


def _binned(scale: float):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        """Tokens of a held-out block by bucket and likelihood ratio, by counts that leave held-out text out."""
        grams = Block(texts.combine_chunks(), answers)
        of, ratio = grams.ratios(grams.train - grams.held)
        ratio = ratio * scale
        size = CLASSES * (_BINS + 1)
        place = np.clip(np.floor((np.log2(np.maximum(ratio, 1e-30)) + 40) * _STEP) + 1, 1, _BINS)
        at = of.astype(np.int64) * (_BINS + 1) + np.where(ratio > 0, place, 0).astype(np.int64)
        n = np.bincount(at, minlength=size)
        total = np.bincount(at, weights=ratio, minlength=size)
        some = np.flatnonzero(n)
        return pa.table(
            [pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(total[some])], names=["bin", "n", "total"]
        )

    return run


def expectation_maximisation(of: np.ndarray, n: np.ndarray, ratio: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Weight of the bigram estimate in each bucket, from held-out counts of likelihood ratios.

    With ratio r of the two estimates, a token is the bigram's doing with the chance
    ``w*r / (w*r + 1-w)``; its mean over a bucket is the next weight. Unseen contexts and
    buckets without held-out tokens have weight 0 and that of the next lower bucket.
    """
    weights = np.zeros(CLASSES)
    for c in range(1, CLASSES):
        own = of == c
        if not n[own].sum():
            weights[c] = weights[c - 1] if c > 1 else 0.5
            continue
        w = 0.5
        for _ in range(rounds):
            w = float((n[own] * (w * ratio[own] / (w * ratio[own] + 1 - w))).sum() / n[own].sum())
            w = min(max(w, 1e-6), 1 - 1e-6)
        weights[c] = w
    return weights


def _scored(weights: np.ndarray, scale: float):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        texts = texts.combine_chunks()
        grams, many = Block(texts, answers), len(texts)
        token = grams.train[: len(grams.words)][grams.word]
        known, base, mixed_in = (
            np.bincount(grams.owner, weights=each, minlength=many)
            for each in (token > 0, np.log10(token + PRIOR), _mixture(*grams.ratios(grams.train), weights, scale))
        )
        base -= grams.n_tokens * math.log10(scale)
        role = texts.column("role").to_numpy()
        arrays = [role == ROLES["test"], grams.n_tokens, known.astype(np.int64), base, base + mixed_in]
        return pa.table(
            [texts.column("id").combine_chunks(), *(pa.array(v) for v in arrays)],
            names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"],
        )

    return run


def _mixture(of: np.ndarray, ratio: np.ndarray, weights: np.ndarray, scale: float) -> np.ndarray:
    """log10 of what mixing in the bigram estimate makes of the unigram's."""
    return np.log10(1 - weights[of] + weights[of] * ratio * scale)


def score_texts(docs: DataFrame, role: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    ``role`` says what a document is for: 0 only to be scored, 1 training, 2 training of
    which the mixture weights are learned. Tokens are lower-cased words and an end; the
    probability of a token is ``w * c(v, t) / c(v) + (1 - w) * (c(t) + 0.5) / (N + 0.5 * (V + 1))``
    after the token v, with counts over training documents and a weight w for each bucket
    of c(v). Weights come from expectation-maximisation on the documents of role 2, with
    counts that leave these out. ``base_score`` is the unigram part alone, in log10.

    Texts are dealt into blocks, held-out texts into their own. A block asks for the
    counts of its distinct n-grams, one row per range of hashes; ranges sum over blocks and
    answer; block and answers meet again, those of held-out text first, to learn the
    weights, then all. No n-gram is looked up by a task that holds them all, a frequent one
    is one number per block, the number of ranges follows the text (``dealt``), and the
    corpus moves twice at most. Only the weights' statistics (buckets by ratio bins) reach
    the driver.

    NULL and empty texts are a single end. Rows that repeat an id are scored each. A
    corpus without training text knows no token. An empty table gives an empty one.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), role.cast("int").alias("role"))
    learns = F.col("role") == ROLES["held"]
    length = F.octet_length("text")
    sizes = own.agg(F.sum(length).alias("size"), F.sum(F.when(learns, length)).alias("held")).first()
    many, many_held, ranges = dealt(sizes["size"] or 0, sizes["held"] or 0)
    hashed = F.xxhash64("id", "text")
    block = F.when(learns, F.pmod(hashed, F.lit(many_held)) + many).otherwise(F.pmod(hashed, F.lit(many)))
    own = own.withColumn("block", block)
    asked = own.groupBy("block").applyInArrow(
        _asked(ranges), "range long, block long, keys binary, train binary, held binary"
    )
    answers = asked.repartition("range").sortWithinPartitions("range").mapInArrow(_answered(ranges), ANSWER)
    answers = stored(answers, "answers", compression="zstd")
    known = answers.where("block = -1").agg(
        *(F.coalesce(F.sum(c), F.lit(0)) for c in ("vocabulary", "tokens", "held_tokens"))
    ).first()
    distinct, train_tokens, held_tokens = known
    scale = train_tokens + PRIOR * (distinct + 1)
    answers = answers.where("block >= 0").select("range", "block", "train", "held")

    held = own.where(learns).groupBy("block").cogroup(answers.where(F.col("block") >= many).groupBy("block"))
    bins = held.applyInArrow(_binned(scale - held_tokens), "bin int, n long, total double")
    bins = bins.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("bin").collect()
    at, n, total = (np.array([b[c] for b in bins], float) for c in ("bin", "n", "total"))
    weights = expectation_maximisation((at // (_BINS + 1)).astype(int), n, total / np.maximum(n, 1))

    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    met = own.groupBy("block").cogroup(answers.groupBy("block"))
    scored = met.applyInArrow(_scored(weights, scale), schema)
    return scored.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known",
        F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
