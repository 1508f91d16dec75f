"""Near-duplicates and repeated passages against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from hearthline.llm import graph, minhash, suffixes

DOCS = "doc_id long, text string"


def shingles(text, n):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [w for w in (text or "").translate(table).replace("\t", " ").replace("\n", " ").split(" ") if w]
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def by_brute_force(rows, percent, n):
    sets = {i: shingles(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def near_copies(seed, many=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeXYZé") for _ in range(4))
    bases = [[word() for _ in range(rng.choice([2, 6, 40, 150]))] for _ in range(8)]
    rows = []
    for i in range(many):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            words[rng.randrange(len(words))] = word()
        rows.append((i, rng.choice([" ", "\n", "\t"]).join(words)))
    return rows


@pytest.mark.parametrize(("percent", "n"), [(85, 3), (80, 5)])
def test_near_duplicates(spark, percent, n, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_SETS", 8)  # clusters of several blocks
    rows = near_copies(percent)
    rows += [(500, ""), (501, None), (502, " \n"), (503, "one"), (504, "ONE"), (505, "one two"), (506, "one  two")]
    rows += [(600, "long " + "tail " * 50_000), (601, "long " + "tail " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, body string").selectExpr("doc_id", "body as text", "1 as bands")
    got = minhash.near_duplicates(docs, percent=percent, words=n)
    expected = by_brute_force(rows, percent, n)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == expected


def test_near_duplicates_of_odd_tables(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (None, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(
        map(repr, [(3, 2, 2, False), (3, 2, 2, False), (2, 2, 2, True), (None, 2, 2, False), (None, 0, None, True)])
    )


def test_estimates_are_close_to_the_similarity():
    rng = np.random.default_rng(1)
    for shared in (0, 300, 700, 900):
        base = rng.integers(0, 2**63, 2000 - shared, np.uint64)
        one, other = np.sort(base[:1000]), np.sort(np.concatenate([base[:shared], base[1000:]]))
        found = np.concatenate([one, other])
        low = minhash.minima(found, np.array([0, 1000, 1000 + len(other)]))
        sketches = minhash.packed(low).view(np.uint64)
        agree = minhash.agreeing(sketches, 0, slice(1, 2))
        assert agree[0] == int(((low[0] ^ low[1]) % (1 << minhash.BITS) == 0).sum())
        true = shared / (2000 - shared)
        assert abs(minhash.estimated(agree)[0] - true) < 0.15


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(50)] + [(200, i) for i in range(201, 260)]
    edges += [(rng.randrange(300, 420), rng.randrange(300, 420)) for _ in range(90)] + [(7, 7)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for u, v in edges:
        x, y = sorted((root(u), root(v)))
        parent[y] = x
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: root(i) for u, v in edges for i in (u, v) if u != v}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def left_of(rows, span):
    seen = Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        seen.update(b[k : k + span] for k in range(len(b) - span + 1))
    out = {}
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - span + 1):
            if seen[b[k : k + span]] > 1:
                gone[k : k + span] = b"\1" * span
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        rest = bytes(c for c, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out


def passages(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    shared = [text(n) for n in (399, 400, 401, 700, 1500)]
    rows = []
    for i in range(80):
        parts = [text(rng.choice([0, 5, 300, 900]))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            parts += [rng.choice(shared), text(rng.choice([0, 1, 200]))]
        rows.append((i, "".join(parts)))
    rows += [(100, "ab" * 700), (101, "z" * 1000), (102, ""), (103, None), (104, rows[0][1]), (105, "q" * 399)]
    rows += [(106, text(30_000) + shared[3])]
    return rows


@pytest.mark.parametrize("crowd", [8192, 3])
def test_repeated_passages(spark, crowd, monkeypatch):
    monkeypatch.setattr(suffixes, "GROUP", crowd)  # 3: most groups are counted by window
    rows = passages(crowd)
    docs = spark.createDataFrame(rows, DOCS).selectExpr("doc_id", "text", "1 as doc", "2 as ranges")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.passage_report(docs).collect()}
    assert got == left_of(rows, 400)


def test_passages_of_odd_tables(spark):
    assert suffixes.passage_report(spark.createDataFrame([], DOCS)).count() == 0
    text = "".join(chr(97 + i * i % 23) for i in range(900))
    got = suffixes.passage_report(spark.createDataFrame([(None, text), (1, text), (None, None)], DOCS)).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in got) == [(0, 0), (900, 900), (900, 900)]
    passage, front, back = text[:600], "x" * 350, "".join(chr(97 + i % 25) for i in range(0, 2100, 7))
    rows = [(None, front + passage), (7, passage + back), (None, back + "-")]
    got = suffixes.passage_report(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in got) == [(301, 0), (900, 600), (950, 600)]
    named = suffixes.repeated_passages(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id or 0, bytes(r.kept).decode()) for r in named) == [(0, front), (7, back)]


def test_shared_stretches_find_passages_of_over_fifty_words(spark):
    rng = random.Random(9)
    text = lambda n: [rng.choice("abcdefgh") + str(rng.randrange(1000)) for _ in range(n)]
    shared = [text(n) for n in (30, 37, 45, 51, 51, 60, 130)]
    rows = [(1000, None), (1001, ""), (1002, "a " * 500), (1003, "one two")]
    for i in range(150):
        words = text(rng.choice([0, 20, 90]))
        for _ in range(rng.choice([0, 1, 1, 2])):
            words += rng.choice(shared) + text(rng.choice([0, 10]))
        rows.append((i if i % 9 else None, rng.choice(["", "\n"]) + rng.choice([" ", "\t "]).join(words) + f" é{i}"))

    def holders(n):
        held = {k: set(zip(*(t.split()[j:] for j in range(n)))) for k, (_, t) in enumerate(rows) if t}
        met = Counter(s for stretches in held.values() for s in stretches)
        return [sum(met[s] > 1 for s in held.get(k, ())) for k in range(len(rows))]

    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], DOCS + ", n_shared long")
    own = {r.doc: r.n_shared for r in suffixes.shared_stretches(suffixes._keyed(docs, "doc_id", "text")).collect()}
    keys = [f"t{hashlib.sha256((t or '').encode()).hexdigest()}" if i is None else f"i{i}" for i, t in rows]
    for key, passages_met, stretches_met in zip(keys, holders(51), holders(38)):
        found = own.get(key, 0)
        assert found <= stretches_met and (found > 0 or not passages_met)
    assert len(own) > 20 and not own.keys() - set(keys)


def test_long_texts_are_cut_into_pieces_without_losing_windows(monkeypatch):
    rng = np.random.default_rng(4)
    data = rng.integers(97, 123, 5000, np.uint8)
    whole = suffixes.Texts(data, np.array([0, 5000]))
    starts = []
    for begin, part in suffixes.pieces(whole, limit=1000):
        _, start, count, _, _ = suffixes.anchors(part)
        starts += [begin + s + k for s, n in zip(start, count) for k in range(n)]
    assert sorted(starts) == list(range(5000 - suffixes.SPAN + 1))


def test_maximal_repeats_with_all_occurrences():
    texts = [b"xabcabcabc", b"yabcz", b"abc", b"qq"]
    found = {}
    for length, of, at in suffixes.repeat_groups(texts, 2):
        words = {texts[t][a : a + length] for t, a in zip(of, at)}
        assert len(words) == 1
        found[words.pop()] = sorted(zip(of.tolist(), at.tolist()))
    every = Counter(t[i:j] for t in texts for i in range(len(t)) for j in range(i + 2, len(t) + 1))

    def maximal(word):
        where = [(k, i) for k, t in enumerate(texts) for i in range(len(t)) if t.startswith(word, i)]
        left = {(k, texts[k][i - 1] if i else None, i if not i else 0) for k, i in where}
        before = {texts[k][i - 1] if i else ("start", k) for k, i in where}
        after = {texts[k][i + len(word)] if i + len(word) < len(texts[k]) else ("end", k) for k, i in where}
        return left and len(before) > 1 and len(after) > 1

    assert set(found) == {w for w, n in every.items() if n > 1 and maximal(w)}
    assert found[b"abc"] == [(0, 1), (0, 4), (0, 7), (1, 1), (2, 0)]
