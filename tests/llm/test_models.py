"""Quality rules, language ID and LM scores against brute force and held-out rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.llm import interpolation, language, quality_rules
from hearthline.llm.words import mixed

DOCS = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (900, None), (901, ""), (902, " \n\t"), (903, "x"), (904, "a b c d e f g h " * 30), (905, "same line\n" * 40),
    (906, "é#*$%&|<>é " * 10), (907, "w" * 200_000), (908, "one two three four five six seven eight nine ten " * 3000),
    (909, "# \n#\n \n#\n# "), (910, "a\r\na\r\nb"),
]


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            again.update(range(i, i + 8))
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)), len(again),
    )


def corpus(seed, many=150):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 7)))
    rows = []
    for i in range(many):
        words = [word() for _ in range(rng.randint(5, 120))]
        if i % 6 == 0:
            words = [w + rng.choice(["$$$", "%%%", "###"]) for w in words]
        rows.append((i, rng.choice([" ", "\n"]).join(words)))
    return rows


def test_quality_rules(spark):
    rows = corpus(1) + ODD
    docs = spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit("x")).withColumn("lang", F.lit(None).cast("string"))
    good = spark.createDataFrame([(i,) for i in range(0, 150) if i % 6 and i % 2], "doc_id long")
    got = {r.doc_id: r for r in quality_rules.assess(docs, good).collect()}
    assert len(got) == len(rows)

    size, prior = quality_rules.BUCKETS, quality_rules.PRIOR
    known = {}

    def buckets(text):
        b, n = (text or "").encode(), quality_rules.GRAM
        grams = [b[k : k + n] for k in range(len(b) - n + 1)]
        for g in set(grams) - set(known):
            known[g] = int(mixed(np.array([int.from_bytes(g, "big")], np.uint64))[0]) % size
        return [known[g] for g in grams]

    raw, trusted = Counter(), Counter()
    for i, t in rows:
        grams = buckets(t)
        raw.update(grams)
        if i < 150 and i % 6 and i % 2:
            trusted.update(grams)
    sums = {id(c): sum(c.values()) for c in (raw, trusted)}
    share = lambda c, g: (c[g] + prior) / (sums[id(c)] + prior * size)
    weight = {g: math.log(share(trusted, g) / share(raw, g)) for g in raw}
    for i, t in rows:
        r = got[i]
        counts = plain_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
        grams = buckets(t)
        expected = sum(weight[g] for g in grams) / max(len(grams), 1)
        assert math.isclose(r.log_ratio, expected, rel_tol=1e-6, abs_tol=1e-9)
        assert r.kept == (not r.base_failed and r.log_ratio >= quality_rules.THRESHOLD)
    assert all(got[i].kept for i in range(150) if i % 6 and not got[i].base_failed)
    assert not any(got[i].kept for i in range(0, 150, 6))


def test_quality_rules_of_odd_tables(spark):
    labels = spark.createDataFrame([], "doc_id long")
    assert quality_rules.assess(spark.createDataFrame([], DOCS), labels).count() == 0
    some = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, None)], DOCS)
    rows = quality_rules.assess(some, spark.createDataFrame([(1,), (1,), (None,)], "doc_id long")).collect()
    assert sorted(r.n_words for r in rows) == [0, 3, 3] and not any(r.kept for r in rows)
    assert {r.log_ratio for r in quality_rules.assess(some, labels).collect()} == {0.0}


def test_language_id_on_held_out_rows(spark):
    rng = random.Random(2)
    letters = {"aa": "abcdefg", "bb": "mnopqrs", "cc": "абвгдеж", "dd": "uvwxyzé"}
    rows = []
    for i in range(600):
        lang = rng.choice(["aa"] * 4 + ["bb", "cc", "dd"])
        text = " ".join("".join(rng.choice(letters[lang]) for _ in range(4)) for _ in range(rng.randint(2, 60)))
        rows.append((i, text.upper() if i % 9 == 0 else text, lang if i % 10 else None))
    odd = [(700, None, "aa"), (701, "", "bb"), (702, "123 !?", "aa"), (703, "x" * 300_000, None), (704, "ééé", "zz")]
    docs = spark.createDataFrame(rows + odd, DOCS + ", lang string").withColumn("score", F.lit("s"))
    docs = docs.withColumn("held_out", language.fold("doc_id", 3) == 1)
    model = language.fit(docs.where(~F.col("held_out")))
    got = {r.doc_id: r for r in language.identify(docs, model, keep=["doc_id", "held_out", "score"]).collect()}
    assert len(got) == len(rows) + len(odd)
    for i, text, lang in rows:
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        true = next(name for name, a in letters.items() if text.lower()[0] in a)
        assert r.lang_pred == true and 0 < r.score <= 1
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (700, 701, 702))
    # Other columns do not matter, nor does who else is asked.
    swapped = docs.where("doc_id < 50").withColumn("lang", F.lit("zz"))
    again = language.identify(swapped, model, keep=["doc_id"]).collect()
    assert all((r.lang_pred, r.score) == (got[r.doc_id].lang_pred, got[r.doc_id].score) for r in again)


def test_language_id_rejects_far_texts_and_takes_odd_tables(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("".join(rng.choice("abcd") for _ in range(3)) for _ in range(20)), "aa") for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS + ", lang string")
    model = language.fit(docs)
    asked = spark.createDataFrame([(1, rows[0][1]), (2, "zyx wvu zzz")], DOCS)
    assert {r.doc_id: r.rejected for r in language.identify(asked, model).collect()} == {1: False, 2: True}
    assert language.identify(asked.limit(0), model).count() == 0
    empty = language.fit(docs.limit(0))
    assert {(r.lang_pred, r.score) for r in language.identify(asked, empty).collect()} == {("und", 0.0)}


def test_clusters_are_found():
    rng = np.random.default_rng(3)
    heads = np.eye(3, 20) + 0.01
    points = np.repeat(heads, 30, axis=0) + rng.random((90, 20)) * 0.05
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    centroids, radii = language.clustered(points, 3)
    assert sorted(np.argmax(centroids, axis=1)) == [0, 1, 2] and (radii < 0.1).all()


def scores_by_brute_force(rows, roles):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [[*WORD.findall((t or "").translate(table)), None] for _, t in rows]
    uni, pair, context = Counter(), Counter(), Counter()
    less = (Counter(), Counter(), Counter())
    for words, role in zip(tokens, roles):
        before = [True, *words[:-1]]
        for wanted, (u, p, c) in (((1, 2), (uni, pair, context)), ((2,), less)):
            if role in wanted:
                u.update(words), p.update(zip(before, words)), c.update(before)
    n = sum(uni.values())
    scale = n + 0.5 * (len(uni) + 1)
    of, ratio = [], []
    frequency = lambda c: min(math.ceil(math.log2(c + 1)), interpolation.CLASSES - 1)
    for words, role in zip(tokens, roles):
        if role == 2:
            for a, b in zip([True, *words[:-1]], words):
                c = context[a] - less[2][a]
                of.append(frequency(c))
                bigram = (pair[a, b] - less[1][a, b]) / c if c else 0
                ratio.append(bigram / (uni[b] - less[0][b] + 0.5) * (scale - sum(less[0].values())))
    bins = {}  # the operator learns from ratios by bins of 1/32 of a doubling
    for c, r in zip(of, ratio):
        place = math.floor((math.log2(r) + 40) * 32) if r > 0 else None
        bins.setdefault((c, place), []).append(r)
    counts, means = [len(v) for v in bins.values()], [sum(v) / len(v) for v in bins.values()]
    weights = interpolation.expectation_maximisation(
        np.array([c for c, _ in bins], int), np.array(counts, float), np.array(means)
    )
    out = []
    for words in tokens:
        score = base = 0.0
        for a, b in zip([True, *words[:-1]], words):
            low = (uni[b] + 0.5) / scale
            w = weights[frequency(context[a])]
            base += math.log10(low)
            score += math.log10(w * (pair[a, b] / context[a] if context[a] else 0) + (1 - w) * low)
        out.append((len(words), sum(uni[w] > 0 for w in words), n, base, score))
    return out


def chained(seed, many=200):
    rng = random.Random(seed)
    follows = {w: [f"w{rng.randrange(40)}" for _ in range(3)] for w in (f"w{k}" for k in range(40))}
    rows = []
    for i in range(many):
        words = [f"w{rng.randrange(40)}"]
        for _ in range(rng.randint(0, 60)):
            words.append(rng.choice(follows.get(words[-1], ["w0"])) if rng.random() < 0.8 else f"W{rng.randrange(90)}")
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("block", [1 << 23, 2000])
def test_lm_scores(spark, block, monkeypatch):
    monkeypatch.setattr(interpolation, "BLOCK_BYTES", block)
    monkeypatch.setattr(interpolation, "RANGE_BYTES", block // 2)
    monkeypatch.setattr(interpolation, "BATCH_KEYS", 500)
    rows = chained(4) + [(900, None), (901, ""), (902, " "), (903, "new words"), (3, "w1 w2"), (904, "w1 " * 30_000)]
    roles = [0 if i % 5 == 1 else 2 if i % 5 == 2 else 1 for i, _ in rows]
    docs = spark.createDataFrame(rows, DOCS).withColumn("block", F.lit(1))
    part = F.col("doc_id") % 5
    got = interpolation.score_texts(docs, F.when(part == 1, 0).when(part == 2, 2).otherwise(1))
    key = lambda r: (r[0], r[1])
    found = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got.collect()), key=key)
    expected = sorted(((i, *e) for (i, _), e in zip(rows, scores_by_brute_force(rows, roles))), key=key)
    for f, e in zip(found, expected, strict=True):
        assert f[:4] == e[:4] and math.isclose(f[4], e[4], rel_tol=1e-9) and math.isclose(f[5], e[5], rel_tol=1e-6)
    held = [(f[4], f[5]) for f in found if f[0] % 5 == 1 and f[0] < 200]
    assert sum(s for _, s in held) > 1.05 * sum(b for b, _ in held)  # less negative on unseen texts


def test_ranges_grow_with_the_text():
    for size in (0, 1, 10**6, 10**9, 10**12, 10**14):
        blocks, held, ranges = interpolation.dealt(size, size // 20)
        assert ranges & (ranges - 1) == 0 and size / ranges <= interpolation.RANGE_BYTES
        assert blocks >= 1 and held >= 1 and size / (blocks + held) <= interpolation.MOST_BYTES
    keys = np.sort(np.random.default_rng(2).integers(0, 2**64, 1000, np.uint64))
    for ranges in (2, 64, 1 << 20):
        of, heads, ends = interpolation._ranged(keys, ranges)
        assert [k for r, a, b in zip(of, heads, ends) for k in keys[a:b]] == keys.tolist()
        assert all((int(k) * ranges) >> 64 == r for r, a, b in zip(of, heads, ends) for k in keys[a:b])
    assert [len(v) for v in interpolation._ranged(keys[:0], 2)] == [0, 0, 0]


def test_lm_scores_of_odd_tables(spark):
    assert interpolation.score_texts(spark.createDataFrame([], DOCS), F.lit(1)).count() == 0
    rows = interpolation.score_texts(spark.createDataFrame([(1, "a b"), (None, None)], DOCS), F.lit(0)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.held_out) for r in rows) == [(1, 0, 0, True), (3, 0, 0, True)]


def test_weights_follow_the_held_out_counts():
    # Half of the tokens come from a bigram ten times as likely, half it does not know.
    weights = interpolation.expectation_maximisation(np.array([3, 3]), np.array([500, 500]), np.array([10.0, 0.0]))
    best = max(np.linspace(0.001, 0.999, 999), key=lambda w: 500 * math.log(1 - w + 10 * w) + 500 * math.log(1 - w))
    assert abs(weights[3] - best) < 0.002 and weights[0] == 0 and weights[1] == 0.5 and weights[31] == weights[3]


@pytest.mark.parametrize("texts", [["", "abcde", "", "", "xyz", "a", "bc"], ["", "", "abc"], ["a", "bcd"], ["ab", "", "cdef", ""]])
def test_ngrams_of_a_batch_that_begins_with_empty_texts(texts):
    from hearthline.llm.words import Texts

    data = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum(list(map(len, data)))])
    whole = Texts(np.frombuffer(b"".join(data), np.uint8), bounds)
    bucket, place = quality_rules.gram_buckets(whole)
    expected = [int(a) + k for t, a in zip(data, bounds) for k in range(len(t) - quality_rules.GRAM + 1)]
    assert place.tolist() == expected
    alone = [quality_rules.gram_buckets(Texts(np.frombuffer(t, np.uint8), np.array([0, len(t)])))[0] for t in data]
    assert bucket.tolist() == np.concatenate(alone).tolist()
