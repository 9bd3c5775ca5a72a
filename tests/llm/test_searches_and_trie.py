"""Exact search, hard negatives and the prefix trie against brute force on small fixtures with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import ball_search, hard_negatives, prefix_trie
from paperloom.llm.integer_vectors import smallest_copies

SCHEMA = "vec_id long, embedding array<double>, label int, id long, v string, cell int, score double"


def vector_rows():
    r = random.Random(7)
    rows = [(i, [r.gauss(0, 0.4) for _ in range(5)], r.randrange(4)) for i in range(300)]
    common = [0.5, -0.25, 0.125, 0.75, -1.0]
    rows += [(i, common, i % 3) for i in range(300, 420)]  # a common vector: ties by id
    rows += [(420, [0.0] * 5, 1), (421, [0.0] * 5, 2), (422, None, 1), (423, [1.0, None, 0.0, 0.0, 0.0], 1), (424, [math.nan] * 5, 1), (425, [math.inf, 0.0, 0.0, 0.0, 0.0], 1)]
    rows += [(426, [1.0, 2.0], 1), (427, [], 0), (None, common, 1), (428, common, None), (440, [0.3] * 5, 2), (440, [0.3] * 5, 2), (460, [0.9] * 5, 3), (460, [-0.9] * 5, 3)]
    rows += [(-20, [0.1, 0.2, 0.3, 0.4, 0.5], 0)]
    return rows


def taking_part(rows, factor, labelled):
    """Integer vectors by id, as the docstring defines them."""
    out = {}
    for i, v, label in rows:
        if i is None or v is None or len(v) != 5 or any(x is None or not math.isfinite(x) for x in v) or (labelled and label is None):
            continue
        row = (label if labelled else 0, [math.floor(x * factor) for x in v])
        out[i] = min(out.get(i, row), row)
    return out


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, 7, "clash", 3, 0.5) for i, v, label in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(("k", "shard_rows", "leaf", "block"), [(10, 8192, 128, 8192), (3, 40, 4, 5), (1, 7, 1, 1000), (500, 100, 16, 8192)])
def test_ball_search(spark, k, shard_rows, leaf, block):
    rows = vector_rows()
    got = ball_search.search(table(spark, rows), F.col("vec_id") % 20 == 0, k=k, factor=16, shard_rows=shard_rows, leaf=leaf, block=block, sample=60)
    v = taking_part(rows, 16, False)
    want = []
    for q in v:
        if q % 20 == 0:
            best = sorted(((-dot(v[q][1], x), i) for i, (_, x) in v.items() if i != q))[:k]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_ball_tree_bounds_hold():
    rng = np.random.Generator(np.random.PCG64(3))
    x, q = np.floor(rng.normal(size=(500, 6)) * 50), np.floor(rng.normal(size=(40, 6)) * 50)
    nodes = ball_search.ball_tree(x, 16)
    limit = ball_search.bounds(q, np.stack([n[2] for n in nodes]), np.array([n[3] for n in nodes]))
    for n, (up, rows, _, _, _) in enumerate(nodes):
        assert (limit[:, n] >= (q @ x[rows].T).max(axis=1)).all()
        assert up < n and (up < 0 or set(rows) <= set(nodes[up][1]))
    assert sorted(i for n in nodes if n[4] for i in n[1]) == list(range(500))


def test_scores_beyond_doubles_and_longs(spark):
    rows = [(0, [1e12, 1.0, 3.0, 0.0, 0.0], 0), (1, [1e12, 1.0, 5.0, 0.0, 0.0], 0), (2, [1e12, 1.0, 7.0, 0.0, 0.0], 0), (3, [-1e12, 0.0, 0.0, 0.0, 0.0], 1), (4, [1e-3, 4.0, 4.0, 0.0, 0.0], 1)]
    small = [(i, [x / 1e7 if abs(x) > 1e9 else x for x in v], label) for i, v, label in rows]
    for part in (rows, small):
        got = ball_search.search(table(spark, part), F.col("vec_id") == 0, k=4, factor=1024).collect()
        v = taking_part(part, 1024, False)
        score = {i: max(-(2**63), min(2**63 - 1, dot(v[0][1], x))) for i, (_, x) in v.items() if i}
        assert [(r.vec_id, r.score) for r in got] == sorted(score.items(), key=lambda s: (-s[1], s[0]))


def brute_negatives(rows, anchor, relabel, factor=256, n_pos=5, n_neg=10):
    v = taking_part([(i, x, None if label is None else relabel(i or 0, label)) for i, x, label in rows], factor, True)
    want = []
    for a, (label, x) in v.items():
        if a % anchor:
            continue
        scored = sorted((-dot(x, y), i, other == label) for i, (other, y) in v.items() if i != a)
        for p, i, _ in [s for s in scored if s[2]][:n_pos]:
            good = [(j, -s) for s, j, same in scored if not same and 30 * -p <= 100 * -s <= 90 * -p][:n_neg]
            want += [(a, i, n + 1, j, -p, s) for n, (j, s) in enumerate(good)]
    return sorted(want)


@pytest.mark.parametrize(("factor", "shard_rows", "block"), [(256, 8192, 8192), (16, 30, 3), (3, 100, 8192)])
def test_hard_negatives(spark, factor, shard_rows, block):
    rows = vector_rows()
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.mine(table(spark, rows), F.col("vec_id") % 20 == 0, label, factor=factor, shard_rows=shard_rows, block=block)
    want = brute_negatives(rows, 20, lambda i, label: (label + 1) % 10 if i % 7 == 0 else label, factor)
    assert len(want) > 100
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("huge", [1.0, 1e9, 1e15])
def test_sliced_products(huge):
    rng = np.random.Generator(np.random.PCG64(5))
    a, x = np.floor(rng.normal(size=(6, 4)) * 9), np.floor(rng.normal(size=(50, 4)) * 9)
    x[0, 0] = huge
    bits = int(max(x.max(), -x.min() - 1)).bit_length()
    seen = []

    def judge(r, low, high):
        seen.append((r, low, high))
        return np.ones(len(r), bool)

    r, c, got = hard_negatives.sliced_products(a, x, np.ones((6, 50), bool), bits, judge)
    exact = [[int(s) for s in row] for row in (a.astype(np.int64).astype(object) @ x.astype(np.int64).astype(object).T)]
    assert [exact[i][j] for i, j in zip(r, c)] == got.tolist()
    assert len(seen) == bits + 1
    for r, low, high in seen:  # intervals hold the product
        assert all(lo <= exact[i][j] <= hi for (i, j), lo, hi in zip(((i, j) for i in range(6) for j in range(50)), low, high))
    assert (np.asarray(seen[-1][1] == seen[-1][2], bool)).all()


def test_smallest_copies():
    ids, key = np.array([5, 3, 9, 1, 7]), np.array([2.0, 2.0, 1.0, 2.0, 2.0])
    assert smallest_copies(ids, 2, key).tolist() == [1, 2, 3]
    assert smallest_copies(ids[:0], 2, key[:0]).tolist() == []


def test_empty_vector_tables(spark):
    none = table(spark, vector_rows()).filter("vec_id < -100")
    assert ball_search.search(none, F.col("vec_id") == 0).collect() == []
    assert hard_negatives.mine(none, F.col("vec_id") == 0, F.col("label")).collect() == []
    unasked = table(spark, vector_rows())
    assert ball_search.search(unasked, F.col("vec_id") == 999).collect() == []
    assert hard_negatives.mine(unasked, F.col("vec_id") == 999, F.col("label")).collect() == []


def conversation_rows():
    r = random.Random(3)
    rows = []
    for c in [*range(60), 100, 101, 119, 125, -1, -3, -20, -25, 5000, 5001]:
        for t in range(r.randrange(1, 7)):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(["a b", "c", "", None, "d e f"])))
    rows += [(200 + i, t, "user", "the same talk") for i in range(30) for t in range(4)]  # a large group of equal conversations
    rows += [(300, t, "user", f"long {t}") for t in range(130)] + [(301, t, "user", f"long {t}") for t in range(129)] + [(301, 129, "user", "word " * 3000)]
    rows += [(302, None, "user", "null turn"), (302, 0, "b", "tie"), (302, 0, "a", "tie"), (302, 0, "a", "tie"), (302, 0, "a", "other tie"), (None, 0, "user", "no id"), (303, None, None, None)]
    return rows


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0, role or "", hashlib.md5((text or "").encode()).hexdigest()), (role or "", text or "")))
    own = {c: [turn for _, turn in sorted(ts)] for c, ts in own.items()}
    talks = {}
    for c, turns in own.items():
        h, donor = zlib.crc32(str(c).encode()) % 4, c - int(math.fmod(c, 20))
        talks[c] = own.get(donor, [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in talks.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []
    for node, who in members.items():
        below, waiting = [], [node]
        while waiting:
            below.append(waiting.pop())
            waiting += children[below[-1]]
        saved = sum((len(members[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) for n in below if n)
        listed = ",".join(map(str, sorted(ends[node])))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children[node]), sum(not children[n] for n in below), saved, hashlib.sha256(listed.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("held", "fan", "piece"), [(100_000, 32, 12), (10, 2, 1), (1, 3, 0)])
def test_prefix_trie(spark, monkeypatch, held, fan, piece):
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    rows = conversation_rows()
    df = spark.createDataFrame([(*r, "clash", b"x", 1) for r in rows], "conv_id long, turn long, role string, text string, node string, digest binary, head int").repartition(5)
    conv = F.col("conv")
    got = prefix_trie.trie(df, donor=conv - conv % 20, head=F.crc32(conv.cast("string").cast("binary")) % 4, most_head=3, held=held, fan=fan)
    assert sorted(map(tuple, got.collect()), key=lambda r: (r[:2])) == sorted(brute_trie(rows), key=lambda r: r[:2])


def test_prefix_trie_of_one_turnless_conversation_and_of_none(spark):
    schema = "conv_id long, turn long, role string, text string"
    conv = F.col("conv")
    how = {"donor": conv + 1, "head": F.lit(2), "most_head": 2}
    one = prefix_trie.trie(spark.createDataFrame([(4, 0, "user", "a")], schema), **how).collect()
    assert [tuple(r) for r in one] == [(4, 0, None, 1, 0, 1, 0, hashlib.sha256(b"4").hexdigest())]
    assert prefix_trie.trie(spark.createDataFrame([], schema), **how).collect() == []
