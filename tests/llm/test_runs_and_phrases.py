"""Periodic runs, toxicity and collocations against brute force and held-out rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.llm import periodic, phrases, queries, toxicity
from hearthline.session import child_names, shared_root

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (900, None), (901, ""), (902, " \n\t"), (903, "x"), (None, "a b " * 40), (905, "same line\n" * 40), (905, "same line\n" * 40),
    (907, "w" * 200_000), (908, "one two three four five six seven eight nine ten " * 3000), (909, "é ü " * 30 + "end"),
]


def plain_runs(words, least=24, times=3):
    """Every maximal run by its definition, period by period."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((i, j - i, q) for (i, j), q in found.items())


def periodic_words(rng):
    words = []
    while len(words) < rng.randint(0, 300):
        letters = rng.choice([1, 2, 5, 1000])
        root = [str(rng.randint(0, letters)) for _ in range(rng.randint(1, 50))]
        words += root if rng.random() < 0.4 else root * rng.randint(1, 8) + root[: rng.randint(0, len(root))]
    return words


def test_grammar_finds_every_run():
    rng = random.Random(1)
    code = np.random.default_rng(1).integers(0, 2**63, 2000).astype(np.uint64)
    total = 0
    for _ in range(150):
        texts = [periodic_words(rng) for _ in range(rng.randint(1, 6))]
        flat = np.array([int(w) for t in texts for w in t], int)
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        starts, ends, periods = periodic.grammar_runs(code[flat], owner, 24, 3)
        first = np.cumsum([0, *map(len, texts)])
        for k, text in enumerate(texts):
            own = (starts >= first[k]) & (starts < first[k + 1])
            got = zip(starts[own] - first[k], (ends - starts)[own], periods[own], strict=True)
            assert [tuple(map(int, x)) for x in got] == plain_runs(text)
        total += len(starts)
    assert total > 200
    with pytest.raises(ValueError):
        periodic.grammar_runs(code, np.zeros(2000, int), 24, 2)


def test_op11_columns(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice([" ", "\n"]).join(periodic_words(rng))) for i in range(150)] + ODD
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("clash"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    result = queries.op11_periodic_runs(spark, str(tmp_path))
    got = Counter(tuple(r) for r in result.collect())
    expected = Counter()
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        number = zlib.crc32(str(doc_id).encode())
        g, n = number // 10, len(words)
        if doc_id is not None and number % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words) if len(words) < 5000 else [(0, 30000, 10)]
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
        texts = "".join(f"{s},{size},{q}\n" for s, size, q in runs), " ".join(
            w for i, w in enumerate(words) if i not in dropped
        )
        milli = 1000 * best[1] // best[2] if runs else None
        expected[(doc_id, len(runs), *best, milli, *(hashlib.sha256(t.encode()).hexdigest() for t in texts))] += 1
    assert got == expected


def test_runs_keep_columns_and_take_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b " * 20, "k")], "doc_id long, text string, n_words string")
    row = periodic.find_runs(docs, keep=["n_words", "doc_id"]).first()
    assert (row.n_words, row.collapsed, row.runs[0].asDict()) == (40, "a b", {"start": 0, "length": 40, "period": 2})
    assert periodic.find_runs(docs.where("false")).collect() == []


def plain_phrases(rows, top):
    counts, words = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            counts.update((lang, tuple(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    found = {}
    for (lang, p), a in counts.items():
        if len(p) < 2 or a < 10:
            continue
        cuts = [(1_000_000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        if len(p) == 2 and any(
            100 * b >= 50 * a for (m, q), b in counts.items() if b >= 10 and m == lang and len(q) == 3 and p in (q[:2], q[1:])
        ):
            continue
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return {
        (lang, rank, p.decode(), -a, left, right, words[lang], -score)
        for lang, best in found.items()
        for rank, (score, a, p, left, right) in enumerate(sorted(best)[:top], 1)
    }


def phrase_rows(seed):
    rng = random.Random(seed)
    vocabulary = [rng.choice(["The", "of", "é", "on", "x-y", "ÜB"]) + str(rng.randint(0, 12)) for _ in range(40)]
    rows = []
    for i in range(250):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        if i % 3 == 0:
            words += ["New", "York", "City"] * rng.randint(0, 2) + ["Hong  Kong"]
        rows.append((i, rng.choice(["en", "de", None, "und"]), "".join(w + rng.choice([" ", "\t", ", ", ".", "\r\n"]) for w in words)))
    return rows + [(None, "en", "again and again " * 30)] * 2 + [(1, "fr", None), (1, "fr", ""), (2, "fr", " , ")]


@pytest.mark.parametrize("share, proposed", [(8, 2), (2, 3), (1000, 1), (2, 1000)])
def test_phrases_do_not_depend_on_the_sample(spark, monkeypatch, share, proposed):
    """Also where the sample is empty or proposes nothing, so that the border fails at every length."""
    monkeypatch.setattr(phrases, "SHARE", share)
    monkeypatch.setattr(phrases, "PROPOSED", proposed)
    rows = phrase_rows(share)
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("phrase", F.lit("clash"))
    before = set(child_names(spark, shared_root(spark)))
    got = phrases.collocations(docs.repartition(5)).collect()
    assert {tuple(r) for r in got} == plain_phrases([r[1:] for r in rows], 2000)
    left = {n.rsplit("-", 1)[0] for n in set(child_names(spark, shared_root(spark))) - before}
    assert left == {"phrases"}  # the passes' tables are gone


def test_few_phrases_and_none(spark):
    rows = phrase_rows(5)
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert {tuple(r) for r in phrases.collocations(docs, top=3).collect()} == plain_phrases([r[1:] for r in rows], 3)
    assert phrases.collocations(docs.where("false")).collect() == []
    listed = {(r.lang, r.phrase): r.f for r in phrases.frequent_phrases(docs).where("words = 2").collect()}
    assert all(listed[lang, p] == a for lang, _, p, a, *_ in plain_phrases([r[1:] for r in rows], 50) if p.count(" ") == 1)


def test_products_beyond_64_bits(spark, monkeypatch):
    table = spark.createDataFrame(
        [(6, 5, 9, 4 * 10**9, None, None), (5, 0, 0, 5 * 10**9, "en", "a"), (9, 0, 0, 6 * 10**9, "en", "b"), (0, 0, 0, 10**12, "en", None)],
        "key long, head long, tail long, n long, lang string, word string",
    )
    monkeypatch.setattr(phrases, "phrase_table", lambda *_: table)
    row = phrases.collocations(table).first()
    assert row.score == 16 * 10**18 * 10**6 // (30 * 10**18)


INSULTS = ["dolt", "nitwit", "krudd"]


def labelled(seed, many=900):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioustrln") for _ in range(rng.randint(2, 6)))
    rows = []
    for i in range(many):
        lines = [" ".join(word() for _ in range(rng.randint(3, 12))) for _ in range(rng.randint(1, 12))]
        bad = i % 7 == 0
        if bad:
            insult = rng.choice(INSULTS)
            insult = insult + word() if insult == "krudd" else insult.title()
            lines[rng.randrange(len(lines))] += f" {insult} " + word()
        rows.append((i, ". ".join(lines), int(bad)))
    return rows


def test_toxic_sentences_are_found_from_document_labels(spark):
    rows = labelled(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").withColumn("score", F.lit("clash"))
    split = docs.withColumn("held_out", toxicity.fold("doc_id", 4) == 2)
    model = toxicity.fit(split.where("not held_out"), docs)
    scored = toxicity.score(split, model, keep=["doc_id", "text", "toxic", "held_out", "score"])
    held = [r for r in scored.collect() if r.held_out]
    assert len(held) > 150
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.97
    for r in held:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        texts = [r.text.encode()[s.start : s.end].decode().lower() for s in r.offending]
        assert len(texts) <= r.n_sentences
        if r.toxic and r.predicted:
            assert any(w in t for t in texts or [r.text.lower()] for w in INSULTS)
        elif not r.predicted:
            assert texts == []


def test_noisy_or_gradient_raises_the_likelihood():
    sentence, place = np.array([0, 1, 3]), np.array([0, 1, 0])
    owner, many = np.array([0, 0, 1, 2]), np.array([1.0, 1.0, 5.0, 1.0])
    label, weight = np.array([1.0, 0.0, 1.0]), np.ones(3)
    weights, bias = toxicity.trained(sentence, place, owner, many, label, weight, 2)
    z = np.bincount(sentence, weights=weights[place], minlength=4) + bias
    p = 1 / (1 + np.exp(-z))
    whole = [1 - (1 - p[0]) * (1 - p[1]), 1 - (1 - p[2]) ** 5, p[3]]
    assert np.allclose(toxicity.noisy_or(p, owner, 3, many), whole)
    assert whole[0] > 0.9 and whole[1] < 0.1 and whole[2] > 0.9


def test_odd_texts_and_labels(spark):
    rows = labelled(4, 200)
    odd = [(i, t, l) for (i, t), l in zip(ODD, [0, 1, None, 0, 1, 0, 0, 5, 0, 0], strict=True)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, docs)
    got = toxicity.score(docs, model, keep=["doc_id"]).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    silent = [r for r in got if r.doc_id in (900, 901, 902)]
    assert len({r.score for r in silent}) == 1 and all(r.n_sentences == 0 and r.offending == [] for r in silent)
    again = {r.score for r in got if r.doc_id == 905}
    assert len(again) == 1
    # One label only, or none: the share of toxic rows.
    alone = toxicity.score(docs, toxicity.fit(docs.where("toxic = 0"), docs.where("toxic = 0")), keep=["doc_id"])
    assert alone.where("predicted = 1").count() == 0
    assert toxicity.score(docs.where("false"), toxicity.fit(docs.where("false"), docs)).collect() == []


def test_repeated_rows_do_not_meet_in_one_window_part(spark):
    rows = labelled(6, 300) + [(1000, "same text krudda", 1)] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(8)
    model = toxicity.fit(docs, docs)
    docs = spark.createDataFrame([(1, "same text krudda"), (2, "other words")], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert got == {1: 1, 2: 0}
