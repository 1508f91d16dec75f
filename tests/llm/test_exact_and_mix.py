"""Exact duplicates, the source mix and chat formatting against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hearthline.llm import chat, exact_dedup, mixing

DOCS = "doc_id long, text string, source string"


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def weak(text):
    """A hash on which many texts collide."""
    return F.substring(F.md5(text), 1, 1)


ROWS = [
    (5, "same", "a"), (3, "same", "b"), (9, "same", None), (4, None, "a"), (7, "", "a"), (1, "Same", "a"),
    (2, "x" * 300_000, "a"), (8, "x" * 300_000, "b"), (None, "lonely", "a"), (None, "same", "a"), (5, "same", "a"),
]


@pytest.mark.parametrize("hashed", [exact_dedup.content_hash, weak])
@pytest.mark.parametrize("keep", ["min", "max"])
def test_duplicate_report(spark, hashed, keep):
    more = [(100 + i, f"text {i % 20}", "s") for i in range(60)]
    got = exact_dedup.duplicate_report(spark.createDataFrame(ROWS + more, DOCS), keep=keep, hashed=hashed).collect()
    groups = defaultdict(list)
    for i, t, _ in ROWS + more:
        groups[t or ""].append(i)
    pick = max if keep == "max" else min
    expected = []
    for i, t, _ in ROWS + more:
        ids = [x for x in groups[t or ""] if x is not None]
        best = pick(ids) if ids else None
        digest = hashlib.sha256((t or "").encode()).hexdigest()
        expected.append((i, best, len(groups[t or ""]), i == best, digest))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))


@pytest.mark.parametrize("hashed", [exact_dedup.content_hash, weak])
def test_deduplicate_keeps_smallest_id_and_all_columns(spark, hashed):
    rows = [(*r, "c0", 1) for r in ROWS]
    docs = spark.createDataFrame(rows, DOCS + ", c0 string, id int")
    got = exact_dedup.deduplicate(docs, hashed=hashed)
    assert got.columns == docs.columns
    kept = {(r.doc_id, r.text) for r in got.collect()}
    assert kept == {(3, "same"), (4, None), (1, "Same"), (2, "x" * 300_000), (None, "lonely")}


def test_exact_dedup_of_nothing_and_plan(spark):
    none = spark.createDataFrame([], DOCS)
    assert exact_dedup.deduplicate(none).count() == 0 and exact_dedup.duplicate_report(none).count() == 0
    plan = physical(exact_dedup.duplicate_report(none))
    assert "Python" not in plan and "Arrow" not in plan


def reshared(sizes):
    """Targets by resharing excess until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, targets, free = 1.5 * sum(sizes.values()), {}, set(sizes)
    while free:
        left, weights = total - sum(targets.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / weights > 2 * sizes[s]]
        if not over:
            targets |= {s: left * weight[s] / weights for s in free}
            break
        for s in over:
            targets[s] = 2.0 * sizes[s]
            free.discard(s)
    return targets


def mixed_documents(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        source = rng.choice(["hot"] * 6 + ["b", "c", "Z", "é", None])
        words = rng.choice([0, 1, 3, 10, 40, 200]) * rng.randint(1, 3)
        rows.append((i, " \t".join(["w"] * words) if words or i % 2 else None, source))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_meets_its_targets(spark, seed):
    rows = mixed_documents(seed)
    docs = spark.createDataFrame(rows, DOCS)
    sizes, largest = Counter(), Counter()
    for _, text, source in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] += n
        largest[source] = max(largest[source], n)
    targets = reshared(sizes)
    assert math.isclose(sum(targets.values()), 1.5 * sum(sizes.values()))
    taken = Counter()
    source_of = {i: s for i, _, s in rows}
    plan = mixing.mix_plan(docs).withColumn("taken", F.col("size") * F.col("copies"))
    for r in plan.collect():
        source = source_of[r.doc_id]
        assert r.source_size == sizes[source] and math.isclose(r.target, targets[source], abs_tol=1e-6)
        assert 0 <= r.copies <= 2
        taken[source] += r.taken
    for source, target in targets.items():
        assert abs(taken[source] - target) <= largest[source]


def test_positions_follow_the_schedules(spark):
    docs = spark.createDataFrame([(i, "w " * 20, "abc"[i % 3]) for i in range(900)], DOCS)
    rows = mixing.mix(docs).collect()
    positions = [r.position for r in rows]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1
    for k, source in enumerate("abc"):
        own = sorted(r.position for r in rows if r.source == source)
        corners = mixing.SCHEDULES[k]

        def weight(t, corners=corners):
            for (a, u), (b, v) in zip(corners, corners[1:]):
                if t <= b:
                    return u + (v - u) * (t - a) / (b - a)

        grid = [(i + 0.5) / 2000 for i in range(2000)]
        total = sum(map(weight, grid))
        for cut in (0.25, 0.5, 0.75, 0.9):
            share = sum(weight(t) for t in grid if t <= cut) / total
            assert abs(sum(p <= cut for p in own) / len(own) - share) < 0.02


def test_training_order_query_returns_every_copy_with_its_position(spark, tmp_path):
    from hearthline.llm import queries

    rows = mixed_documents(4)
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    by_document = queries.QUERIES["op6_source_mix"](spark, str(tmp_path)).collect()
    taken = {r.doc_id: r.taken for r in by_document}
    turns = [(r.first_position is None, r.first_position or 0.0, r.doc_id) for r in by_document]
    assert turns == sorted(turns) and len(turns) == len(rows)
    got = queries.QUERIES["op6_training_order"](spark, str(tmp_path)).collect()
    copies, sizes, source_of = Counter(), Counter(), {i: s for i, _, s in rows}
    for r in got:
        copies[r.doc_id] += r["size"]
    for i, text, source in rows:
        sizes[i] = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    assert all(copies[i] == taken[i] for i in taken)
    ends = {r.doc_id: (r.first_position, r.last_position) for r in by_document}
    for i, (first, last) in ends.items():
        own = [r.position for r in sorted(got, key=lambda r: r.epoch) if r.doc_id == i]
        assert (own[0], own[-1]) == (first, last) if own else (first, last) == (None, None)
    assert [(r.position, r.doc_id) for r in got] == sorted((r.position, r.doc_id) for r in got)
    names = sorted(set(source_of.values()), key=lambda s: (s is None, s))
    for r in got:
        own = [i for i, s in source_of.items() if s == r.source]
        key = lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)
        middle = r.epoch * r.source_size + sum(sizes[i] for i in own if key(i) < key(r.doc_id)) + r["size"] / 2
        corners = mixing.SCHEDULES[names.index(r.source) % 3]
        used = whole = 0.0  # what the schedule has demanded up to the position, and in all
        for (a, u), (b, v) in zip(corners, corners[1:]):
            whole += (b - a) * (u + v) / 2
            x = min(max(r.position - a, 0.0), b - a)
            used += u * x + (v - u) / (b - a) * x * x / 2
        assert math.isclose(used / whole, min(middle / r.target, 1.0), abs_tol=1e-6)


def test_mix_is_native_repeats_itself_and_takes_odd_tables(spark):
    rows = [(1, "a b", "s", 7, 1.5), (1, "a b c", "s", 7, 1.5), (None, None, None, None, None), (2, "", "s", 0, 0.0)]
    docs = spark.createDataFrame(rows, DOCS + ", size int, target double").withColumn("__part", F.lit("x"))
    once, again = (sorted(map(repr, mixing.mix(docs).collect())) for _ in range(2))
    assert once == again and len(once) >= 2
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    zero = mixing.mix_plan(spark.createDataFrame([(1, None, "a"), (2, " ", None)], DOCS)).collect()
    assert {(r.target, r.copies * r["size"]) for r in zero} == {(0.0, 0)}
    plan = physical(mixing.mix(docs))
    assert "Python" not in plan and "Arrow" not in plan


def kept_by_brute_force(turns):
    logged = defaultdict(set)
    for conv, turn, role, text in turns:
        logged[conv].add((turn, role, text))
    low = lambda v: (v is not None, v if v is not None else 0)
    lows = lambda v: (v is not None, v or "")
    said = {
        c: [(r, t) for _, r, t in sorted(rows, key=lambda x: (low(x[0]), lows(x[1]), lows(x[2])))]
        for c, rows in logged.items()
    }
    kept = {}
    for c, mine in said.items():
        extended = any(len(o) > len(mine) and o[: len(mine)] == mine for o in said.values())
        twins = [d for d, o in said.items() if o == mine]
        first = min((d for d in twins if d is not None), default=None)
        if not extended and c == first:
            kept[c] = mine
    return kept


def test_chat_collapses_snapshots(spark):
    rng = random.Random(5)
    turns = []
    for c in range(60):
        base = rng.randint(0, 5)
        for t in range(rng.randint(1, 8)):
            turns.append((c, t, "user" if t % 2 == 0 else "assistant", f"{base}-{t}" if rng.random() < 0.95 else f"{c}!"))
    turns += [(200, t, "user", f"long {t}") for t in range(700)] + [(201, t, "user", f"long {t}") for t in range(600)]
    turns += [(300, None, "user", None), (300, 1, None, "x"), (301, None, "user", None), (None, 0, "user", "hello")]
    turns += turns[:30]  # repeated rows
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("seg", F.lit(1))
    got = chat.format_chats(frame)
    rows = got.collect()
    expected = kept_by_brute_force(turns)
    assert {r.conv_id for r in rows} == set(expected)
    texts = defaultdict(str)
    for r in sorted(rows, key=lambda r: r.segment):
        texts[r.conv_id] += r.text
        assert r.n_turns == len(expected[r.conv_id])
    for c, said in expected.items():
        assert texts[c] == "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in said)
    assert sorted(r.segment for r in rows if r.conv_id == 200) == [0, 1, 2]
    assert chat.format_chats(frame.limit(0)).count() == 0
    plan = physical(got)
    assert "Python" not in plan and "Arrow" not in plan


def test_chat_segments_are_bounded_whatever_the_turn_numbers_are(spark):
    turns = [(None, t % 2, "user", f"logged {t:04d}") for t in range(1500)]  # a shared conversation
    turns += [(7, None, "user", f"no number {t:04d}") for t in range(900)] + [(7, 3, "user", "end"), (7, 300, None, None)]
    turns += [(8, None, "user", f"no number {t:04d}") for t in range(700)]  # begins 7
    turns += [(9, t, "user", f"gaps {t}") for t in range(0, 2000, 100)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(7)
    rows = chat.format_chats(frame).collect()
    expected = kept_by_brute_force(turns)
    assert None in expected and set(expected) == {None, 7, 9} == {r.conv_id for r in rows}
    for conv, said in expected.items():
        own = sorted((r for r in rows if r.conv_id == conv), key=lambda r: r.segment)
        assert [r.segment for r in own] == list(range(len(own)))
        held = [r.text.count("<|im_start|>") for r in own]
        assert max(held) <= chat.SEGMENT_TURNS
        assert [r.first_turn for r in own] == [1 + sum(held[:k]) for k in range(len(own))]
        assert {r.n_turns for r in own} == {len(said)}
        assert "".join(r.text for r in own) == "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in said)
    # By number where numbers are distinct, as in the SQL.
    assert sum(r.conv_id == 9 for r in rows) == len({t // 256 for t in range(0, 2000, 100)})
