"""SentencePiece encoding and decoding with N-best segmentations.

The model file gives pieces and ids; nothing is trained. Vocabularies of merges carry
merge order in place of log probabilities; there a piece's score follows Zipf's law by
its place in the vocabulary.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"  # fixed by the format: stands for a space
N_BEST = 3
CACHED = 600_000  # words whose best segmentation a task remembers
_ZIPF = 2.7
# A byte piece costs so much more than the rarest normal piece: fallback is the last resort.
_BYTE_PENALTY = 10.0

Path = tuple[float, tuple[int, ...]]


class Vocabulary:
    """Pieces of a model with scores, ids of byte pieces, and each id's bytes."""

    def __init__(self, model: bytes, stored_scores: bool = False):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces: dict[str, tuple[float, int]] = {}
        self.byte_ids, self.bytes_of = [0] * 256, [b""] * sp.get_piece_size()
        normal = [
            i for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))
        ]
        total = math.log(sum(1 / (r + _ZIPF) for r in range(len(normal))))
        for rank, i in enumerate(normal):
            score = sp.get_score(i) if stored_scores else -math.log(rank + _ZIPF) - total
            self.pieces[sp.id_to_piece(i)] = (score, i)
            self.bytes_of[i] = sp.id_to_piece(i).replace(SPACE, " ").encode()
        self.byte_score = min(s for s, _ in self.pieces.values()) - _BYTE_PENALTY
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:5], 16)
                self.byte_ids[value], self.bytes_of[i] = i, bytes([value])
        # All ids' bytes on end, and where each one's begin and how many they are.
        self.spelling = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.sizes = np.array(list(map(len, self.bytes_of)))
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.longest = max(map(len, self.pieces))
        # Pieces character by character: by character what goes on, then score and ids of a
        # piece that ends there, if one does.
        self.tree: dict = {}
        for piece, (score, i) in self.pieces.items():
            node: list = [self.tree]
            for character in piece:
                node = node[0].setdefault(character, [{}, None, None])
            node[1:] = score, (i,)
        # A lattice falls into independent parts wherever no piece holds the two characters
        # that meet: between a word and the next space, and around a line break if no piece
        # goes past it. Inside words ``learn`` looks up the pairs.
        self.pairs = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        spaced = any(b == SPACE != a for a, b in self.pairs)
        broken = any("\n" in pair for pair in self.pairs)
        end = "" if broken else "\n"
        self.word = re.compile("(?s).+" if spaced else f"{SPACE}*[^{SPACE}{end}]+|{SPACE}+|{end or SPACE}")

    def edges(self, word: str, literal: frozenset[int] = frozenset()) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """Lattice: for each place the edges (start, score, ids) that end there.

        Characters without a piece, and those at ``literal`` places, are spelled in bytes.
        """
        ending: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(len(word) + 1)]
        get = self.pieces.get
        for end in range(1, len(word) + 1):
            here = ending[end]
            for start in range(max(0, end - self.longest), end):
                found = get(word[start:end])
                if found and not (literal and any(start <= x < end for x in literal)):
                    here.append((start, found[0], (found[1],)))
            if end - 1 in literal or word[end - 1] not in self.pieces:
                spelled = tuple(self.byte_ids[b] for b in word[end - 1].encode("utf-8", "replace"))
                here.append((end - 1, self.byte_score * len(spelled), spelled))
        return ending


def forward(ending: list[list[tuple[int, float, tuple[int, ...]]]]) -> list[float]:
    """Viterbi scores: of the best path from the start to each place."""
    best = [0.0]
    for edges in ending[1:]:
        best.append(max((best[start] + score for start, score, _ in edges), default=-math.inf))
    return best


def best_two(vocabulary: Vocabulary, word: str) -> tuple[list[int], float, float]:
    """Ids and score of the best segmentation, and what the second best loses.

    One forward pass that carries two scores per place; of equal edges the one from the
    smallest start counts, as in ``n_best``.
    """
    n, none = len(word), -math.inf
    best, second, back = [0.0] + [none] * n, [none] * (n + 1), [(0, ())] * (n + 1)
    for start in range(n):
        first, other = best[start], second[start]
        goes_on, end = vocabulary.tree, start
        for character in word[start:]:
            end += 1
            node = goes_on.get(character)
            if node is None:
                if end > start + 1:
                    break
                node = ({}, None, None)
            goes_on, cost, own = node
            if cost is None:
                if end > start + 1:
                    continue
                own = tuple([vocabulary.byte_ids[b] for b in character.encode("utf-8", "replace")])
                cost = vocabulary.byte_score * len(own)
            score = first + cost
            so_far = best[end]
            if score > so_far:
                rest = other + cost
                second[end] = rest if rest > so_far else so_far
                best[end], back[end] = score, (start, own)
            elif score > second[end]:
                second[end] = score
            if not goes_on:
                break
    ids: list[int] = []
    place = n
    while place:
        place, own = back[place]
        ids[:0] = own
    return ids, best[n], best[n] - second[n]


def n_best(ending: list[list[tuple[int, float, tuple[int, ...]]]], n: int) -> list[Path]:
    """The ``n`` best segmentations, best first, by A* from the end of the lattice.

    The forward score of a place is exactly what the rest of a path can still reach, so
    paths leave the queue in the order of their scores. Of equal ones (to six digits)
    the one nearer to the start goes on first, so that ties do not widen the search.
    """
    best = forward(ending)
    order = itertools.count()
    # (-score of the whole path, place, order, score from here to the end, (ids, rest of the path))
    queue: list[tuple] = [(-best[-1], len(ending) - 1, 0, 0.0, None)]
    found: list[Path] = []
    while queue and len(found) < n:
        _, place, _, done, path = heapq.heappop(queue)
        if place == 0:
            ids: list[int] = []
            while path:
                own, path = path
                ids += own
            found.append((done, tuple(ids)))
            continue
        for start, score, own in ending[place]:
            if best[start] > -math.inf:
                whole = done + score
                heapq.heappush(queue, (-round(whole + best[start], 6), start, next(order), whole, (own, path)))
    return found


def words_of(text: str, word: re.Pattern) -> list[tuple[str, frozenset[int]]]:
    """Independent stretches of a text's lattice, and the places of literal ``SPACE`` in them."""
    if not text:
        return []
    marked = SPACE + text.replace(" ", SPACE)
    places = {m.start() + 1 for m in re.finditer(SPACE, text)}
    spans = [m.span() for m in word.finditer(marked)]
    return [(marked[a:b], frozenset(p - a for p in range(a, b) if p in places)) for a, b in spans]


class Encoder:
    """Best segmentations of words, remembered, and N-best ones of texts."""

    def __init__(self, vocabulary: Vocabulary, n: int = N_BEST):
        self.vocabulary, self.n = vocabulary, n
        self.forget()

    def forget(self) -> None:
        self.place: dict = {}  # of a word in the lists: ids as int32 bytes, score, loss of the second best
        self.ids: list[bytes] = []
        self.scores, self.losses = array("d"), array("d")
        self.others: dict = {}

    def learn(self, word) -> int:
        """Place of a new word; a word with literal marks is a pair of text and places."""
        parts = self.parts(word) if isinstance(word, str) else []
        if len(parts) > 1:
            places = [self.learn(p) if (at := self.place.get(p)) is None else at for p in parts]
            self.ids.append(b"".join([self.ids[p] for p in places]))
            self.scores.append(math.fsum([self.scores[p] for p in places]))
            self.losses.append(min([self.losses[p] for p in places]))
            place = self.place[word] = len(self.ids) - 1
            return place
        if parts:
            ids, score, loss = best_two(self.vocabulary, word)
        else:
            paths = n_best(self.vocabulary.edges(*word), 2)
            score, ids = paths[0]
            loss = score - paths[1][0] if len(paths) > 1 else math.inf
        self.ids.append(array("i", ids).tobytes())
        self.scores.append(score)
        self.losses.append(loss)
        place = self.place[word] = len(self.ids) - 1
        return place

    def parts(self, word: str) -> list[str]:
        """The word cut where no piece can lie across."""
        pairs, out, first = self.vocabulary.pairs, [], 0
        for k in range(1, len(word)):
            if word[k - 1 : k + 1] not in pairs:
                out.append(word[first:k])
                first = k
        out.append(word[first:])
        return out

    def options(self, word, place: int) -> list[Path]:
        """The ``n`` best segmentations of a word, the one in use first."""
        if place not in self.others:
            used = tuple(np.frombuffer(self.ids[place], np.int32).tolist())
            edges = self.vocabulary.edges(*((word,) if isinstance(word, str) else word))
            rest = [p for p in n_best(edges, self.n) if p[1] != used]
            self.others[place] = [(self.scores[place], used), *rest][: self.n]
        return self.others[place]

    def text(self, text: str) -> tuple[bytes, list[float], list[list[tuple[int, tuple[int, ...]]]], bool]:
        """What ``segment`` gives, and whether the ids decode to the text."""
        ids, scores, others = self.segment(text)
        ends = np.array([0, len(ids) // 4])
        return ids, scores, others, round_trips(np.frombuffer(ids, np.int32), ends, [text], self.vocabulary)[0]

    def segment(self, text: str) -> tuple[bytes, list[float], list[list[tuple[int, tuple[int, ...]]]]]:
        """Ids of the best segmentation; scores of the N best; the words the others change.

        Words are independent, so another segmentation of the text is other ones of some
        words. The ``n - 1`` words that lose least suffice: changing a further one loses
        at least as much as ``n - 1`` single changes do.
        """
        if not text:
            return b"", [], []
        if len(self.place) > CACHED:
            self.forget()
        if SPACE not in text:
            words = self.vocabulary.word.findall(SPACE + text.replace(" ", SPACE))
        else:
            words = [w if w[1] else w[0] for w in words_of(text, self.vocabulary.word)]
        get, learn = self.place.get, self.learn
        places = [learn(w) if (p := get(w)) is None else p for w in words]
        ids = b"".join([self.ids[p] for p in places])
        score = math.fsum([self.scores[p] for p in places])
        losses = np.array([self.losses[p] for p in places])
        few = min(self.n - 1, len(losses))
        near = losses <= np.partition(losses, few - 1)[few - 1] if few else losses < 0
        picked = np.flatnonzero(near & (losses < math.inf)).tolist()
        picked = sorted(sorted(picked, key=losses.__getitem__)[:few])
        options = [self.options(words[i], places[i]) for i in picked]
        ways = []
        for way in itertools.product(*(range(len(o)) for o in options)):
            lost = math.fsum(o[0][0] - o[k][0] for o, k in zip(options, way))
            ways.append((lost, [(i, o[k][1]) for i, o, k in zip(picked, options, way) if k]))
        ways.sort(key=lambda w: (w[0], len(w[1]), w[1]))
        ways = ways[: self.n]
        return ids, [score - lost for lost, _ in ways], [changed for _, changed in ways[1:]]


def spelled(ids: np.ndarray, ends: np.ndarray, vocabulary: Vocabulary) -> tuple[bytes, np.ndarray]:
    """The bytes of all ids, and where those of each row end; row k has the ids ``ends[k]`` to ``ends[k + 1]``."""
    sizes = vocabulary.sizes[ids]
    after = np.cumsum(sizes)
    total = int(after[-1]) if len(after) else 0
    place = np.repeat(vocabulary.begins[ids] - after + sizes, sizes) + np.arange(total)
    return vocabulary.spelling[place].tobytes(), np.concatenate([[0], after])[ends]


def round_trips(ids: np.ndarray, ends: np.ndarray, texts: list[str], vocabulary: Vocabulary) -> list[bool]:
    """Whether the ids of each row decode to its text, with the space that precedes every text."""
    data, bounds = spelled(ids, ends, vocabulary)
    bounds = bounds.tolist()
    return [
        data[a:b] == (" " + t if t else "").encode("utf-8", "replace")
        for a, b, t in zip(bounds[:-1], bounds[1:], texts, strict=True)
    ]


def decoded(ids: np.ndarray, bytes_of: list[bytes]) -> bytes:
    """The text that ids spell, without the space that precedes every text."""
    return b"".join([bytes_of[i] for i in ids.tolist()])[1:]


ENCODED = (
    "n_pieces int, ids array<int>, scores array<double>, "
    "others array<array<struct<word:int,ids:array<int>>>>, round_trip boolean"
)


def encode(
    docs: DataFrame, keep: list[str], text_col: str = "text", n: int = N_BEST, model: str = MODEL
) -> DataFrame:
    """``keep`` columns of ``docs`` with the ``n`` best segmentations of each whole text.

    ``ids`` is the best one and ``scores[k]`` the k-th best score; ``others[k - 1]`` lists
    the words (by number) that segmentation k changes, with their ids. ``round_trip``
    tells that the ids of the row as written, decoded, give its text. A space before the text and spaces read as the
    model's space mark; a literal mark and characters without a piece are spelled in
    bytes, so that decoding is exact.

    NULL and empty texts have no pieces and no scores. A text without spaces is one word
    of any length. Columns of ``docs`` named like a result column give way to it. The
    model (half a megabyte) is read once and broadcast.
    """
    spark = docs.sparkSession
    with open(model, "rb") as file:
        shared = spark.sparkContext.broadcast(file.read())
    names = [f.split(" ")[0] for f in ("n_pieces", "ids", "scores", "others", "round_trip")]
    kept = [c for c in keep if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value)
        encoder = Encoder(vocabulary, n)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            step = max(1, len(texts) // (1 + sum(map(len, texts)) // (4 << 20)))
            for first in range(0, len(texts), step):
                some = texts[first : first + step]
                rows = [encoder.segment(t) for t in some]
                sizes = np.array([len(r[0]) // 4 for r in rows], np.int32)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                every = np.frombuffer(b"".join(r[0] for r in rows), np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(every))
                exact = round_trips(ids.values.to_numpy(), ids.offsets.to_numpy(), some, vocabulary)
                others = [[[{"word": w, "ids": list(i)} for w, i in way] for way in r[2]] for r in rows]
                kind = pa.list_(pa.list_(pa.struct([("word", pa.int32()), ("ids", pa.list_(pa.int32()))])))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(c.slice(first, step) for c in batch.columns[:-1]),
                        pa.array(sizes),
                        ids,
                        pa.array([r[1] for r in rows], pa.list_(pa.float64())),
                        pa.array(others, kind),
                        pa.array(exact, pa.bool_()),
                    ],
                    names=[*kept, *names],
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    return docs.select(*kept, F.col(text_col).alias("__text")).mapInArrow(run, ", ".join(filter(None, [schema, ENCODED])))


def decode(encoded: DataFrame, keep: list[str], ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """``keep`` columns with the ``text`` that the ids spell; NULL ids give NULL."""
    with open(model, "rb") as file:
        shared = encoded.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = Vocabulary(shared.value).bytes_of
        for batch in batches:
            ids = batch.column(batch.num_columns - 1).to_pylist()
            text = [None if i is None else decoded(np.array(i, int), bytes_of).decode("utf-8", "replace") for i in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(text, pa.string())], names=[*keep, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*keep).schema)
    return encoded.select(*keep, F.col(ids_col).alias("__ids")).mapInArrow(run, f"{schema}, text string")
