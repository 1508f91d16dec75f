"""Periodic runs of words, found on a grammar of the texts.

The word ids of many texts are compressed together by Re-Pair: the pairs that occur most
often become nonterminals, round after round, until none occurs twice. What is left of each
text is joined by a balanced tree. Every run of a text crosses the middle of exactly one
lowest node that holds it whole, so it is enough to look, once for each nonterminal, for the
runs across the place where its two parts meet. What is found is carried to all places that
derive the nonterminal, and pieces are merged into maximal runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .words import SPACE, Texts, chunks, powers, windows

LEAST_WORDS = 24  # a run holds so many words at least,
LEAST_PERIODS = 3  # and so many periods
_BASE = 0xD6E8FEB86659FD93
RUNS = ArrayType(StructType([StructField(n, LongType()) for n in ("start", "length", "period")]))

Shown = Callable[[object, int], "np.ndarray | None"]


class _Windows:
    """Where windows of ``width`` words occur again in their text."""

    def __init__(self, hashed: np.ndarray, owner: np.ndarray, width: int):
        self.width, self.n = width, len(hashed)
        code, places = windows(hashed, owner, width)
        _, code = np.unique(code + owner[places].astype(np.uint64) * np.uint64(_BASE), return_inverse=True)
        order = np.argsort(code, kind="stable")
        code, places = code[order], places[order]
        same = code[1:] == code[:-1]
        self.after = np.full(self.n + 1, self.n * 2, np.int64)
        self.before = np.full(self.n + 1, -1, np.int64)
        self.after[places[:-1][same]] = places[1:][same]
        self.before[places[1:][same]] = places[:-1][same]
        again = np.zeros(len(places), bool)
        again[:-1] |= same
        again[1:] |= same
        self.group = np.full(self.n + 1, -1, np.int64)
        self.group[places[again]] = code[again]
        self.places, self.keys = places[again], code[again] * self.n + places[again]

    def between(self, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each window ``at``, the places from ``low`` to ``high`` where it occurs: index into ``at``, place."""
        group = self.group[at] * self.n
        first = np.searchsorted(self.keys, group + low)
        many = np.maximum(np.searchsorted(self.keys, group + high, "right") - first, 0)
        many[self.group[at] < 0] = 0
        of = np.repeat(np.arange(len(at)), many)
        within = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        return of, self.places[first[of] + within]


class _Crossing:
    """Runs of a text that cross a given place, by longest common extensions."""

    def __init__(self, hashed: np.ndarray, owner: np.ndarray, least: int, times: int):
        self.least, self.times = least, times
        self.again = _Windows(hashed, owner, least // 3)
        self.powers = powers(_BASE, len(hashed))
        self.sums = np.zeros(len(hashed) + 1, np.uint64)
        np.cumsum(hashed * self.powers[: len(hashed)], out=self.sums[1:])
        self.found: list[np.ndarray] = []

    def _same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ``size`` words at ``a`` are those at ``b``, by hash; b > a."""
        left = (self.sums[a + size] - self.sums[a]) * self.powers[b - a]
        return left == self.sums[b + size] - self.sums[b]

    def _extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words agree from ``a`` and ``b`` onward, or before them, ``most`` at most."""
        known, step = np.zeros(len(a), np.int64), 1
        while step <= most.max(initial=0):
            step *= 2
        while step := step // 2:
            size = known + step
            open_ = np.flatnonzero(size <= most)
            size = size[open_]
            shift = size if back else 0
            ok = self._same(a[open_] - shift, b[open_] - shift, size)
            known[open_[ok]] += step
        return known

    def look(self, start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """Runs inside [start, end) across ``middle``: index, start, end, period.

        A run of enough words repeats the window that begins, or the one that ends, at the
        middle, at a distance of its period and inside itself. So only places where such a
        window occurs again between start and end are looked at.
        """
        w, again = self.again.width, self.again
        long = end - start >= self.least
        ahead = long & (middle + w <= end)
        ahead &= (again.after[middle] + w <= end) | (again.before[middle] >= start)
        behind = long & (middle - w >= start)
        behind[behind] = again.before[middle[behind] - w] >= start[behind]
        parts = []
        for chosen, shift, last in ((ahead, 0, end - w), (behind, w, middle - w - 1)):
            node = np.flatnonzero(chosen)
            at = middle[node] - shift
            of, place = again.between(at, start[node], last[node])
            parts.append((node[of], np.minimum(at[of], place), np.maximum(at[of], place)))
        node, low, high = (np.concatenate(x) for x in zip(*parts, strict=True))
        period = high - low
        useful = (period > 0) & (period * self.times <= (end - start)[node])
        node, low, high, period = (x[useful] for x in (node, low, high, period))
        after = self._extension(low, high, end[node] - high, False)
        before = self._extension(low, high, low - start[node], True)
        size = before + period + after
        useful = size >= np.maximum(self.least, self.times * period)
        node, low, size, period = node[useful], (low - before)[useful], size[useful], period[useful]
        return node, low, low + size, period

    def add(self, starts: np.ndarray, ends: np.ndarray, periods: np.ndarray) -> None:
        if len(starts):
            self.found.append(np.stack([starts, ends, periods]))

    def merged(self) -> np.ndarray:
        """Maximal runs with their smallest periods, by start and period."""
        if not self.found:
            return np.zeros((3, 0), np.int64)
        s, e, q = np.concatenate(self.found, axis=1)
        # A piece lies within the whole run of the same period, which its lowest node gives.
        order = np.lexsort((-e, s, q))
        s, e, q = s[order], e[order], q[order]
        reach = np.maximum.accumulate(e + q * (self.again.n + 1))
        kept = np.ones(len(s), bool)
        kept[1:] = (q[1:] != q[:-1]) | (e[1:] + q[1:] * (self.again.n + 1) > reach[:-1])
        s, e, q = s[kept], e[kept], q[kept]
        # Multiples of the smallest period give the same words.
        order = np.lexsort((q, e, s))
        s, e, q = s[order], e[order], q[order]
        kept = np.ones(len(s), bool)
        kept[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
        s, e, q = s[kept], e[kept], q[kept]
        order = np.lexsort((q, s))
        return np.stack([s[order], e[order], q[order]])


def _counted(symbol: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the pairs in ``hot``: rank by frequency, number of the pair, and frequency.

    Of overlapping equal pairs every second one counts.
    """
    code = symbol[hot] * (symbol.max() + 1) + symbol[hot + 1]
    goes_on = np.zeros(len(hot), bool)
    goes_on[1:] = (hot[1:] == hot[:-1] + 1) & (code[1:] == code[:-1])
    first = np.maximum.accumulate(np.where(goes_on, 0, np.arange(len(hot))))
    odd = (np.arange(len(hot)) - first) % 2 == 1
    _, pair = np.unique(code, return_inverse=True)
    many = np.bincount(pair[~odd], minlength=pair.max(initial=-1) + 1)
    rank = np.empty(len(many), np.int64)
    rank[np.argsort(many, kind="stable")] = np.arange(1, len(many) + 1)
    return np.where(odd, 0, rank[pair]), pair, many[pair]


def grammar_runs(hashed: np.ndarray, owner: np.ndarray, least: int, times: int) -> np.ndarray:
    """Runs of the words of many texts: starts, ends and periods, by start and period.

    ``hashed`` holds a hash for each word and ``owner`` the text it belongs to.
    """
    if times < 3 or least < 3:
        raise ValueError("runs have three words and three periods at least")
    crossing = _Crossing(hashed, owner, least, times)
    if not len(crossing.again.places):
        return crossing.merged()  # no window occurs again in its text
    _, symbol = np.unique(hashed, return_inverse=True)
    symbol = symbol.astype(np.int64)
    start, length, of = np.arange(len(symbol)), np.ones(len(symbol), np.int64), owner
    hot = np.flatnonzero(of[1:] == of[:-1])
    while len(hot):
        rank, pair, many = _counted(symbol, hot)
        hot, rank, pair = hot[many > 1], rank[many > 1], pair[many > 1]
        at = np.zeros(len(symbol) + 1, np.int64)
        at[hot] = rank
        # Pairs that are more frequent than those they overlap are replaced, all of a round at once.
        best = (rank > 0) & (rank >= at[hot - 1]) & (rank >= at[hot + 1])
        uses = np.bincount(pair[best], minlength=pair.max(initial=-1) + 1)
        best &= uses[pair] > 1
        if not best.any():
            break
        place, made = hot[best], pair[best]
        node, first, number = np.unique(made, return_index=True, return_inverse=True)
        span = length[place] + length[place + 1]
        lead = place[first]
        found, s, e, q = crossing.look(start[lead], start[lead] + length[lead], start[lead] + span[first])
        if len(found):
            # To all places that derive the nonterminal.
            order = np.argsort(number, kind="stable")
            begins = np.searchsorted(number[order], np.arange(len(node) + 1))
            copies = (begins[1:] - begins[:-1])[found]
            row = np.repeat(np.arange(len(found)), copies)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
            moved = start[place[order[begins[found[row]] + nth]]] - start[lead][found[row]]
            crossing.add(s[row] + moved, e[row] + moved, q[row])
        symbol[place], length[place] = symbol.max() + 1 + number, span
        kept = np.ones(len(symbol), bool)
        kept[place + 1] = False
        was_hot = np.zeros(len(symbol), bool)
        was_hot[hot] = True
        was_hot[place] = True
        was_hot[place[place > 0] - 1] = True
        # The pair before a replaced one may begin at a place that is gone.
        gone = place[place > 1]
        was_hot[gone[~kept[gone - 1]] - 2] = True
        symbol, start, length, of, was_hot = (x[kept] for x in (symbol, start, length, of, was_hot))
        hot = np.flatnonzero(was_hot[:-1] & (of[1:] == of[:-1]))
    while len(start):
        fresh = np.ones(len(start), bool)
        fresh[1:] = of[1:] != of[:-1]
        within = np.arange(len(start)) - np.maximum.accumulate(np.where(fresh, np.arange(len(start)), 0))
        left = np.flatnonzero((within[1:] % 2 == 1) & (of[1:] == of[:-1]))
        if not len(left):
            break
        span = length[left] + length[left + 1]
        crossing.add(*crossing.look(start[left], start[left] + length[left], start[left] + span)[1:])
        length[left] = span
        kept = np.ones(len(start), bool)
        kept[left + 1] = False
        start, length, of = start[kept], length[kept], of[kept]
    return crossing.merged()


def _spaced(texts: Texts) -> Texts:
    """Words joined by one space."""
    space = SPACE[texts.data]
    kept = ~space
    kept[1:] |= ~space[:-1]
    inner = texts.bounds[(texts.bounds > 0) & (texts.bounds < len(kept))]
    kept[inner] = ~space[inner]  # no space at the front
    data = np.where(space, 32, texts.data).astype(np.uint8)[kept]
    bounds = np.concatenate([[0], np.cumsum(kept)])[texts.bounds]
    return Texts(data, bounds)


def _collapsed(texts: Texts, starts, ends, firsts, changed: dict[int, np.ndarray]) -> list[bytes]:
    """The kept words of each text; ``changed`` holds them for texts that are not all kept as they are."""
    spaced = _spaced(texts)
    data, raw = spaced.data.tobytes(), texts.data.tobytes()
    out = []
    for k in range(len(texts)):
        if k in changed:
            words = changed[k]
            out.append(b" ".join([raw[a:b] for a, b in zip(starts[words], ends[words], strict=True)]))
        else:
            out.append(data[spaced.bounds[k] : spaced.bounds[k + 1]].removesuffix(b" "))
    return out


def _runs(ids: pa.Array, texts: Texts, first: int, shown: Shown | None, least: int, times: int):
    """For each text: number of words, runs (start, length, period) and kept words."""
    starts, ends = texts.words()
    hashed = texts.hashes(starts, ends)
    counts = np.diff(np.searchsorted(starts, texts.bounds))
    firsts = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(len(texts)), counts)
    changed: dict[int, np.ndarray] = {}
    if shown is not None:
        for k in np.flatnonzero(counts):
            if (places := shown(ids[first + int(k)].as_py(), int(counts[k]))) is not None:
                changed[int(k)] = firsts[k] + places
                hashed[firsts[k] : firsts[k + 1]] = hashed[changed[int(k)]]
    s, e, q = grammar_runs(hashed, owner, least, times)
    of = owner[s]
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    for k in np.unique(of):
        a, b, f = bounds[k], bounds[k + 1], firsts[k]
        inside = np.zeros(counts[k] + 1, np.int64)
        np.add.at(inside, s[a:b] + q[a:b] - f, 1)
        np.add.at(inside, e[a:b] - f, -1)
        words = changed.get(int(k), np.arange(firsts[k], firsts[k + 1]))
        changed[int(k)] = words[np.cumsum(inside)[:-1] == 0]
    return counts, bounds, s - firsts[of], e - s, q, _collapsed(texts, starts, ends, firsts, changed)


def _found(shown: Shown | None, least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(batch.num_columns - 1)
            for first, texts in chunks(column):
                counts, bounds, start, length, period, words = _runs(ids, texts, first, shown, least, times)
                runs = pa.StructArray.from_arrays(
                    [pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        *(c.slice(first, len(texts)) for c in batch.columns[:-1]),
                        pa.array(counts, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs),
                        pa.array(words, pa.binary()).cast(pa.string()),
                    ],
                    names=[*batch.schema.names[:-1], "n_words", "runs", "collapsed"],
                )

    return run


def find_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: list[str] | None = None,
    shown: Shown | None = None,
    least: int = LEAST_WORDS,
    times: int = LEAST_PERIODS,
) -> DataFrame:
    """The id and the ``keep`` columns, with n_words, runs and collapsed.

    A run is a stretch of ``least`` words and ``times`` periods or more in which words one
    period apart are the same, which no neighbouring word continues; the period is the
    smallest. ``runs`` go by start, then period; starts count words from 0. ``collapsed``
    joins by one space the words that no run holds behind its first period. ``shown`` may
    name, for an id and a number of words, the word to show at each place.

    One row per input row: NULL and empty texts have no words, no runs and an empty
    ``collapsed``; equal rows have equal results. Whole texts count. Columns that clash with
    the result's are left out of ``keep``. No row moves; memory follows the longest text.
    """
    names = ("n_words", "runs", "collapsed")
    kept = [id_col, *(c for c in keep or [] if c not in (*names, id_col))]
    schema = docs.select(kept).schema.add("n_words", "long").add("runs", RUNS).add("collapsed", "string")
    rows = docs.select(*kept, F.col(text_col).alias("__text"))
    return rows.mapInArrow(_found(shown, least, times), schema)
