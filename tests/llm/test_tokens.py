"""Piece encoding, packing and the pipeline: brute force, round trips and registration."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from hearthline.llm import packing, pieces, queries
from hearthline.session import stored

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
needs_model = pytest.mark.skipif(not Path(pieces.MODEL).exists(), reason="needs the vocabulary files")


def every_path(ending):
    paths = [[(0.0, ())]]
    for edges in ending[1:]:
        paths.append([(s + score, p + ids) for start, score, ids in edges for s, p in paths[start]])
    return sorted(paths[-1], key=lambda p: -p[0])


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(Path(pieces.MODEL).read_bytes())


@needs_model
def test_n_best_of_words(vocabulary):
    for word in ("▁hello", "▁them", "▁▁a", "é☃x", "aaaaaa", "▁tion", "☃thé☃☃re"):
        ending = vocabulary.edges(word)
        expected = every_path(ending)
        for n in (1, 4, 50):
            got = pieces.n_best(ending, n)
            assert [round(s, 9) for s, _ in got] == [round(s, 9) for s, _ in expected[:n]]
            assert len({p for _, p in got}) == len(got) == min(n, len(expected))
        ids, score, loss = pieces.best_two(vocabulary, word)
        assert np.isclose(score, expected[0][0]) and np.isclose(loss, [expected[0][0] - s for s, _ in [*expected, (-np.inf, ())][1:2]][0])
        assert tuple(ids) in {p for s, p in expected if np.isclose(s, score)}


@needs_model
def test_n_best_of_texts(vocabulary):
    rng = random.Random(1)
    for n in (1, 2, 3, 5):
        encoder = pieces.Encoder(vocabulary, n)
        for _ in range(15):
            text = " ".join("".join(rng.choice("therani,.\n") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 3)))
            ids, scores, others, exact = encoder.text(text)
            assert exact
            expected = every_path(vocabulary.edges("▁" + text.replace(" ", "▁")))[:n]
            assert np.allclose(scores, [s for s, _ in expected])
            assert len(others) == len(scores) - 1
            words = [list(np.frombuffer(encoder.ids[encoder.place[w]], np.int32)) for w, _ in pieces.words_of(text, vocabulary.word)]
            best = np.frombuffer(ids, np.int32).tolist()
            assert [i for w in words for i in w] == best
            for way in others:
                other = list(words)
                for place, changed in way:
                    other[place] = list(changed)
                line = [i for w in other for i in w]
                assert pieces.decoded(np.array(line), vocabulary.bytes_of).decode() == text and line != best


@needs_model
def test_encoding_round_trips(spark):
    texts = [None, "", " ", "plain words", "  two  spaces ", "▁literal ▁ marks▁", "é☃\U0001f600\t\n\r\x00", "x" * 20_000, "tail " * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("ids", F.lit("clash"))
    got = pieces.encode(docs.union(docs.limit(3)), ["doc_id", "ids"])
    rows = got.collect()
    assert len(rows) == len(texts) + 3 and all(r.round_trip for r in rows)
    assert {r.n_pieces for r in rows if not texts[r.doc_id]} == {0}
    back = {r.doc_id: r.text for r in pieces.decode(got, ["doc_id"]).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert pieces.encode(docs.limit(0), ["doc_id"]).count() == 0


@needs_model
def test_round_trip_decodes_the_ids_that_are_written(vocabulary):
    encoder = pieces.Encoder(vocabulary)
    texts = ["one two", "", "▁ two  three", "é☃\x00", "one two"]
    rows = [np.frombuffer(encoder.segment(t)[0], np.int32) for t in texts]
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    ids = np.concatenate(rows)
    assert pieces.round_trips(ids, ends, texts, vocabulary) == [True] * 5
    wrong = ids.copy()
    wrong[ends[2]] += 1
    assert pieces.round_trips(wrong, ends, texts, vocabulary) == [True, True, False, True, True]
    moved = ends.copy()
    moved[3] += 1
    assert pieces.round_trips(ids, moved, texts, vocabulary) == [True, True, False, False, True]
    # Only the space that precedes a text may be left out, and only it.
    assert pieces.round_trips(ids[1:], ends[:2].clip(max=len(rows[0]) - 1), texts[:1], vocabulary) == [False]


@needs_model
def test_a_join_that_loses_a_word_is_seen(monkeypatch):
    whole = pieces.Encoder.segment
    monkeypatch.setattr(pieces.Encoder, "segment", lambda self, t: (whole(self, t)[0][:-4], *whole(self, t)[1:]))
    encoder = pieces.Encoder(pieces.Vocabulary(Path(pieces.MODEL).read_bytes()))
    assert not encoder.text("some words")[3]


def naive_fill(sizes, length):
    bins = []
    for size in sorted(sizes, reverse=True):
        rooms = [length - sum(b) for b in bins]
        fits = [r for r in rooms if r >= size]
        if fits:
            bins[rooms.index(min(fits))].append(size)
        else:
            bins.append([size])
    return sorted(map(sum, bins))


def test_best_fit_decreasing():
    rng = random.Random(7)
    for _ in range(400):
        length = rng.choice([1, 7, 8, 32, 100])
        sizes = [rng.randint(1, length) for _ in range(rng.randint(0, 50))]
        bins = packing.best_fit_decreasing(sizes, length)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert sorted(sum(sizes[i] for i in b) for b in bins) == naive_fill(sizes, length)


@pytest.mark.skipif(not Path(packing.RANKS).exists(), reason="needs the vocabulary files")
def test_packing_is_lossless(spark, monkeypatch):
    import base64

    import tiktoken

    monkeypatch.setattr(packing, "GROUP_BYTES", 20_000)
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["some", "words", "über", "\n"]) for _ in range(rng.randint(0, 150))) for _ in range(60)]
    texts += [None, "", "long " * 9000]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("part", F.lit("clash"))
    rows = packing.pack(docs, length=64).collect()
    again = packing.pack(docs, length=64).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    parts, padding = {}, 0
    for r in rows:
        ids, places = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(places) == 64 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        padding += 64 - r.n_tokens
        assert (ids[r.n_tokens :] == packing.END).all()
        for doc, part, a, b in zip(r.docs, r.parts, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            assert places[a:b].tolist() == list(range(b - a))
            assert parts.setdefault((doc, part), ids[a:b].tolist()) is not None
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(packing.RANKS).read_bytes().splitlines())}
    encoding = tiktoken.Encoding("t", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, text in enumerate(texts):
        line = [x for k in sorted(k for d, k in parts if d == i) for x in parts[i, k]]
        assert line.pop() == packing.END and encoding.decode(line) == (text or "")
    assert padding < 0.1 * 64 * len(rows)
    assert packing.pack(docs.limit(0)).count() == 0
    repeated = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], DOCS)
    assert sum(len(r.docs) for r in packing.pack(repeated).collect()) == 3


def test_registered_names():
    own = [n for n in contract.queries() if n.startswith("op") and n[2].isdigit()]
    assert {n[2:].split("_")[0] for n in own} == {str(k) for k in range(1, 11)} and "pipeline" in contract.queries()
    assert set(queries.ORACLE) <= set(queries.QUERIES) and set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="needs the driver tables")
@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_queries_agree_with_sql(spark, name):
    from workload.compare import duck

    mine = queries.QUERIES[name](spark, SF_DIR)
    names = sorted(mine.columns)
    relation = duck(SF_DIR).sql(queries.ORACLE[name])
    assert sorted(relation.columns) == names
    order = [relation.columns.index(n) for n in names]
    rows = sorted(repr(tuple(r[n] for n in names)) for r in mine.collect())
    assert rows == sorted(repr(tuple(r[i] for i in order)) for r in relation.fetchall())


@needs_model
@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="needs the driver tables")
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, docs, SF_DIR), f"test-{name}")
        assert after.columns == docs.columns
        kept.append((docs.collect(), after.collect()))
        docs = after
    (every, good), (_, distinct), (_, unlike), (_, taken) = kept
    gone = {r.doc_id for r in every} - {r.doc_id for r in good}
    words = {r.doc_id: len((r.text or "").split()) for r in every}
    clean = {i for i, q in labels.items() if q == 1 and words.get(i, 0) >= 20}
    assert not gone & clean and {i for i, q in labels.items() if q == 0 and i in words} <= gone
    assert len(distinct) == len({r.text for r in good})
    firsts = {}
    for r in good:
        firsts[r.text] = min(r.doc_id, firsts.get(r.text, r.doc_id))
    assert {r.doc_id for r in distinct} == set(firsts.values())
    from test_duplicates import by_brute_force

    groups = by_brute_force([(r.doc_id, r.text) for r in distinct], 80, 5)
    assert {r.doc_id for r in unlike} == {i for i, g in groups.items() if g[2]}
    assert {r.doc_id for r in taken} <= {r.doc_id for r in unlike}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    assert sorted(r.doc_id for r in last) == sorted(r.doc_id for r in taken) and all(r.round_trip for r in last)


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
