"""Collocations: frequent phrases found by sampling, after Toivonen.

A sample of the texts proposes phrases. One pass over all texts then counts, exactly, the
proposed ones and their negative border: the phrases that were not proposed although all
their parts were. Where a phrase of the border turns out to be frequent, longer ones may have
been missed; it joins the proposed ones, and a further pass counts what that opens, until no
border phrase fails. So the result is the same for every sample.

What is proposed is known to the tasks as a table of bits of fixed size (two per phrase).
A bit that is set by chance only lets more phrases be counted. Counting goes by hash; the
phrases that reach the threshold are then counted by their text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.session import scratch, stored

from .words import LOWER, Tally, Texts, chunks, mixed

LEAST = 10  # a phrase is frequent if it occurs so often in a language,
LONGEST = 3  # and has so many words at most
SHARE = 8  # one of so many rows is in the sample,
PROPOSED = 2  # and a phrase found so often there is proposed
INSIDE = 50  # percent of a phrase's occurrences inside a longer one that drop it
TOP = 2000
BITS = 26  # the table of proposed phrases has 2 ** BITS bits
HELD = 1 << 21  # distinct phrases a task holds before it hands them on
NO_LANGUAGE = "und"
_BASE = np.uint64(0x9FB21C651E98DF25)
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True


class Phrases:
    """The phrases of some texts: for each length their keys and the places of their first words.

    A key is a hash of language and words whose last two bits hold the length.
    """

    def __init__(self, texts: Texts, language: np.ndarray):
        self.data = LOWER[texts.data]
        lowered = Texts(self.data, texts.bounds)
        self.starts, self.ends = lowered.runs(~_GAP[self.data])
        self.owner = texts.owner(self.starts)
        hashed = lowered.hashes(self.starts, self.ends)
        breaks = np.concatenate([[0], np.cumsum(_BREAK[self.data])])[self.starts]
        self.keys, self.places = {}, {}
        total = np.zeros(len(hashed), np.uint64)
        for n in range(1, LONGEST + 1):
            many = max(len(hashed) - n + 1, 0)
            total = total[:many] * _BASE + hashed[n - 1 :][:many]
            joined = (self.owner[:many] == self.owner[n - 1 :][:many]) & (breaks[:many] == breaks[n - 1 :][:many])
            place = np.flatnonzero(joined)
            key = mixed(total[place] * _BASE + language[self.owner[place]])
            self.places[n] = place
            self.keys[n] = (key & ~np.uint64(3)) | np.uint64(n)

    def word(self, place: int) -> bytes:
        return self.data[self.starts[place] : self.ends[place]].tobytes()

    def parts(self, n: int, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the chosen phrases of ``n`` words without their last, and without their first word."""
        at = np.zeros(len(self.starts) + 1, np.uint64)
        at[self.places[n - 1]] = self.keys[n - 1]
        place = self.places[n][chosen]
        return at[place], at[place + 1]

    def eligible(self, bits: np.ndarray) -> Iterator[np.ndarray]:
        """By length: which phrases have only proposed parts."""
        before = None
        for n in range(1, LONGEST + 1):
            if n == 1:
                yield np.ones(len(self.places[1]), bool)
            else:
                parts = np.zeros(len(self.starts) + 1, bool)
                parts[before] = True
                yield parts[self.places[n]] & parts[self.places[n] + 1]
            before = self.places[n][held(self.keys[n], bits)]


def _slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each key in the table of bits."""
    spread = mixed(keys)
    mask = np.uint64((1 << BITS) - 1)
    return (spread & mask).astype(np.int64), ((spread >> np.uint64(BITS)) & mask).astype(np.int64)


def held(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    found = np.ones(len(keys), bool)
    for slot in _slots(keys):
        found &= (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
    return found


def _language(name: str) -> int:
    return int.from_bytes(hashlib.md5(name.encode()).digest()[:8], "little")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Phrases, np.ndarray, list[str]]]:
    """Phrases of pieces of the batches (language, text), with the languages of their texts."""
    known: dict[str, int] = {}
    for batch in batches:
        names = batch.column(0).dictionary_encode()
        found = names.dictionary.to_pylist()
        codes = np.asarray(names.indices)
        number = np.array([known.setdefault(x, _language(x)) for x in found], np.uint64)
        for first, texts in chunks(batch.column(1)):
            own = codes[first : first + len(texts)]
            yield Phrases(texts, number[own]), own, found


def _handed_on(tally: Tally) -> Iterator[pa.RecordBatch]:
    keys, (counts,) = tally.sums()
    for a in range(0, len(keys), 1 << 16):
        own = slice(a, a + (1 << 16))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[own].view(np.int64)), pa.array(counts[own])], names=["key", "n"]
        )


def _counted(bits: np.ndarray | None, before: np.ndarray | None):
    """Counts of the phrases whose parts ``bits`` hold (all phrases without it), but those
    that an earlier pass counted, with ``before``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(1)
        for phrases, _, _ in _each(batches):
            chosen = phrases.eligible(bits) if bits is not None else (slice(None),) * LONGEST
            past = phrases.eligible(before) if before is not None else (None,) * LONGEST
            for n, now, then in zip(phrases.keys, chosen, past, strict=True):
                keys = phrases.keys[n][now if then is None else now & ~then]
                keys, counts = np.unique(keys, return_counts=True)
                tally.add(keys, counts)
            if tally.size > HELD:
                yield from _handed_on(tally)
                tally = Tally(1)
        yield from _handed_on(tally)

    return run


_PARTS = "key long, head long, tail long, n long, lang string, word string"


def _taken_apart(bits: np.ndarray):
    """Counts of the phrases that ``bits`` hold, with the keys of their parts; of words, with
    language and text; and, with neither, of all the words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_back: list[tuple[np.ndarray, ...]] = []
        words: dict[int, list] = {}
        totals: dict[str, int] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            if held_back:
                columns = [np.concatenate(x) for x in zip(*held_back, strict=True)]
                order = np.argsort(columns[0], kind="stable")
                key, head, tail, n = (c[order] for c in columns)
                fresh = np.append(True, (key[1:] != key[:-1]) | (head[1:] != head[:-1]) | (tail[1:] != tail[:-1]))
                first = np.flatnonzero(fresh[: len(key)])
                n = np.add.reduceat(n, first) if len(first) else n
                nothing = pa.nulls(len(first), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c[first].view(np.int64)) for c in (key, head, tail)), pa.array(n), nothing, nothing],
                    names=["key", "head", "tail", "n", "lang", "word"],
                )
            rows = [(k, n, lang, word) for k, (n, lang, word) in words.items()]
            rows += [(0, n, lang, None) for lang, n in totals.items()]
            key, n, lang, word = zip(*rows, strict=True) if rows else ((), (), (), ())
            zeros = pa.array(np.zeros(len(rows), np.int64))
            key = pa.array(np.array(key, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [key, zeros, zeros, pa.array(n, pa.int64()), pa.array(lang, pa.string()), pa.array(word, pa.binary()).cast(pa.string())],
                names=["key", "head", "tail", "n", "lang", "word"],
            )
            held_back.clear()
            words.clear()
            totals.clear()

        size = 0
        for phrases, own, names in _each(batches):
            for code, n in enumerate(np.bincount(own[phrases.owner], minlength=len(names)).tolist()):
                totals[names[code]] = totals.get(names[code], 0) + n
            for n, keys in phrases.keys.items():
                chosen = np.flatnonzero(held(keys, bits))
                found, first, counts = np.unique(keys[chosen], return_index=True, return_counts=True)
                if n > 1:
                    held_back.append((found, *phrases.parts(n, chosen[first]), counts))
                    size += len(found)
                    continue
                for key, count, at in zip(found.tolist(), counts.tolist(), chosen[first].tolist(), strict=True):
                    if key in words:
                        words[key][0] += count
                    else:
                        place = int(phrases.places[1][at])
                        words[key] = [count, names[own[phrases.owner[place]]], phrases.word(place)]
            if size > HELD:
                yield from flushed()
                size = 0
        yield from flushed()

    return run


def _bits(keys: DataFrame) -> np.ndarray:
    """The table of bits of distributed keys; what reaches the driver is at most the whole table."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = np.concatenate(_slots(np.asarray(batch.column(0)).view(np.uint64)))
            bit = np.left_shift(np.int64(1), slots & 63)
            yield pa.RecordBatch.from_arrays([pa.array(slots >> 6), pa.array(bit)], names=["slot", "bit"])

    found = keys.select("key").mapInArrow(places, "slot long, bit long").groupBy("slot").agg(F.bit_or("bit").alias("bit"))
    table = found.toArrow()
    bits = np.zeros(1 << (BITS - 6), np.int64)
    bits[np.asarray(table["slot"])] = np.asarray(table["bit"])
    return bits.view(np.uint8)


def _missing(keys: DataFrame, bits) -> DataFrame:
    """Keys that the table does not hold and that longer phrases could hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.asarray(batch.column(0)).view(np.uint64)
            lacking = ~held(key, bits.value) & ((key & np.uint64(3)) < LONGEST)
            yield pa.RecordBatch.from_arrays([pa.array(key[lacking].view(np.int64))], names=["key"])

    return keys.select("key").mapInArrow(run, "key long")


def _sums(counts: DataFrame, *keys: str) -> DataFrame:
    """Sums by key. The tasks have added up their own rows, so these are dealt as they are."""
    return counts.repartition(*keys).groupBy(*keys).agg(F.sum("n").alias("n"))


def phrase_table(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """Phrases of up to ``LONGEST`` words that occur ``LEAST`` times or more in a language.

    key, head and tail (keys of the phrase without its last and without its first word), n
    (its count); words have their language and text instead; the row with key 0 counts all
    words of a language. Counts are exact and do not depend on the sample. The passes'
    tables are removed; the result is a written table. Each task adds up its own rows first,
    so repeated texts and hot languages move one row per phrase and block.
    """
    spark = docs.sparkSession
    broadcast = spark.sparkContext.broadcast
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE)).alias("lang")
    rows = docs.select(F.col(id_col).alias("id"), lang, F.col(text_col).alias("text")).where("length(text) > 0")
    texts = rows.select("lang", "text")

    def counted(source: DataFrame, bits, before, least: int, label: str) -> DataFrame:
        def run(batches):
            now, then = (None if b is None else b.value for b in (bits, before))
            return _counted(now, then)(batches)

        sums = _sums(source.mapInArrow(run, "key long, n long"), "key")
        return stored(sums.where(F.col("n") >= least).select("key"), label)

    with scratch(spark):
        # Equal rows and missing ids are dealt by their text too.
        chosen = F.pmod(F.xxhash64("id", F.md5("text")), F.lit(SHARE)) == 0
        sample = rows.where(chosen).select("lang", "text")
        table = _bits(counted(sample, None, None, PROPOSED, "proposed"))
        before, bits = None, broadcast(table)
        frequent = []
        while True:
            frequent.append(counted(texts, bits, before, LEAST, "frequent"))
            failed = stored(_missing(frequent[-1], bits), "failed")
            if failed.isEmpty():
                break
            table = table | _bits(failed)
            before, bits = bits, broadcast(table)
        found = frequent[0]
        for more in frequent[1:]:
            found = found.unionByName(more)
        wanted = broadcast(_bits(found))
        apart = texts.mapInArrow(lambda batches: _taken_apart(wanted.value)(batches), _PARTS)
        # Parts beside the key tell phrases apart whose hashes agree.
        sums = _sums(apart, "key", "head", "tail", "lang", "word")
        return stored(sums.where((F.col("key") == 0) | (F.col("n") >= LEAST)), "phrases", temporary=False)


def _words_and_pairs(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words and pairs of words with their texts and counts."""
    words = table.where("word is not null").select("key", "lang", "word", "n")
    pairs = table.where("key & 3 = 2").select("key", F.col("head").alias("one"), F.col("tail").alias("two"), F.col("n").alias("a"))
    one = words.select(F.col("key").alias("one"), "lang", F.col("word").alias("w1"), F.col("n").alias("l"))
    two = words.select(F.col("key").alias("two"), F.col("word").alias("w2"), F.col("n").alias("r"))
    return words, pairs.join(one, "one").join(two, "two").drop("one", "two")


def _triples(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """Phrases of three words with both pairs they hold."""
    triples = table.where("key & 3 = 3").select("head", "tail", F.col("n").alias("a"))
    head = pairs.select(F.col("key").alias("head"), "lang", "w1", F.col("l").alias("l1"), F.col("a").alias("l2"))
    behind = (F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("r1"), F.col("r").alias("r2"))
    tail = pairs.select(F.col("key").alias("tail"), *behind)
    return triples.join(head, "head").join(tail, "tail")


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """lang, phrase, words and f of every frequent phrase, single words included."""
    table = phrase_table(docs, text_col, lang_col, id_col)
    words, pairs = _words_and_pairs(table)
    triples = _triples(table, pairs)
    one = words.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), F.col("n").alias("f"))
    two = pairs.select("lang", F.concat_ws(" ", "w1", "w2"), F.lit(2), "a")
    return one.union(two).union(triples.select("lang", F.concat_ws(" ", "w1", "w2", "w3"), F.lit(3), "a"))


def _score(a: str, left: str, right: str) -> Column:
    a, left, right = (f"cast({c} as decimal(38,0))" for c in (a, left, right))
    return F.expr(f"({a} * {a} * 1000000) div ({left} * {right})")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", top: int = TOP) -> DataFrame:
    """The ``top`` phrases of two or more words of each language: lang, rank, phrase, a, l, r, n, score.

    A-Z are lowered; texts are cut at ``[.,;:!?]`` and line ends into pieces, and those at
    spaces and tabs into words; phrases lie within a piece. ``a`` counts a phrase, ``l`` and
    ``r`` the parts of its lowest-scoring cut, ``score`` is a * a / (l * r) in millionths,
    rounded down, and ``n`` counts the language's words. Phrases of which ``INSIDE`` percent
    or more lie inside one longer frequent phrase are dropped. Ties go by ``a``, then phrase.

    NULL and empty texts hold no phrase, a NULL language is ``und``, repeated rows count as
    often as they occur, further columns are ignored; without texts there is no row.
    """
    table = phrase_table(docs, text_col, lang_col, id_col)
    totals = table.where("key = 0").select("lang", "n")
    _, pairs = _words_and_pairs(table)
    triples = _triples(table, pairs)

    # A pair lies in a longer phrase by way of a triple.
    inner = triples.select(F.explode(F.array_distinct(F.array("head", "tail"))).alias("key"), F.col("a").alias("within"))
    inner = inner.groupBy("key").agg(F.max("within").alias("within"))
    alone = pairs.join(inner, "key", "left").where(
        F.col("within").isNull() | (F.col("within") * 100 < F.col("a") * INSIDE)
    )
    cut = [F.struct(_score("a", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in (1, 2)]
    three = triples.withColumn("cut", F.least(*cut)).select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "cut.l", "cut.r", "cut.score"
    )
    two = alone.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", _score("a", "l", "r").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = two.unionByName(three).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")
    )
