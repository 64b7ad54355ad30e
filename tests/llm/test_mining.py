"""Importance resampling and hard negatives: brute force, edge cases."""

import math
import random
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardwatch.llm import importance as I, negatives as N
from cardwatch.llm.importance import importance, resample
from cardwatch.llm.negatives import hard_negatives

DOCS = "doc_id long, text string"


def expected(docs, target, buckets=50, min_words=3, percent=40):
    words = lambda t: [w.decode() for w in I.words_of(t)]
    at = lambda w: zlib.crc32(w.encode()) % buckets
    s = Counter(at(w) for _, t in docs for w in words(t))
    t = Counter(at(w) for x in target for w in words(x))
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t)))
    out = []
    for key, text in docs:
        own = words(text)
        weight = sum(gain(at(w)) for w in own) // len(own) if own else 0
        h = int(sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    fit = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, row in enumerate(fit[: len(fit) * percent // 100]):
        row.append(k + 1)
    return sorted(tuple(r + [None] * (5 - len(r))) for r in out)


SMALL = dict(buckets=50, min_words=3, percent=40)
ROW = ("doc_id", "n_features", "weight", "score", "rank")


def test_importance_against_brute_force(spark):
    pick = random.Random(5)
    vocabulary = ["alpha", "Beta", "γάμμα", "delta9", "été", "x", "日本", "low-end"]
    docs = [(k, " ".join(pick.choices(vocabulary, k=pick.randrange(40)))) for k in range(80)]
    docs += [(200, None), (201, ""), (202, "?!"), (203, "alpha " * 40_000), (204, "été " * 3)]
    target = [" ".join(pick.choices(vocabulary[:3], k=30)) for _ in range(5)] + [None, ""]
    frame = spark.createDataFrame(docs, DOCS).repartition(3)
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance(frame, aims, **SMALL).select(*ROW).collect()
    assert sorted(map(tuple, got)) == expected(docs, target)
    drawn = resample(frame.withColumn("rank", F.lit("own")), aims, **SMALL)
    assert drawn.columns == ["doc_id", "text", "rank"]
    assert {r.doc_id for r in drawn.collect()} == {r.doc_id for r in got if r.rank}


def test_importance_runs_of_words(spark):
    docs = spark.createDataFrame([(1, "a b a b")], DOCS)
    row = importance(docs, docs, runs=(1, 2), **SMALL).first()
    assert (row.n_words, row.n_features) == (4, 7)


def test_importance_edges(spark):
    empty = spark.createDataFrame([], DOCS)
    assert importance(empty, empty).collect() == []
    assert resample(empty, empty).collect() == []
    twice = spark.createDataFrame([(None, "a b c d")] * 2 + [(7, "a b c d")] * 3, DOCS)
    rows = importance(twice, empty.select("text"), **SMALL).collect()
    assert len(rows) == 5
    assert sorted(r.rank for r in rows if r.rank) == [1, 2]
    assert resample(twice, empty, **SMALL).count() == 2


def test_planes_hold_counts():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 9, (4, 130)) * rng.integers(0, 2, (4, 130))
    gains = rng.integers(-70_000, 70_000, 130)
    width = I.plane_bytes(130)
    owner, bucket = np.nonzero(counts)
    raw, first = I.to_planes(owner, bucket, counts[owner, bucket], 4, width)
    own = [raw[a * width : b * width] for a, b in zip(first[:-1], first[1:], strict=True)]
    assert I.Gains(gains).sums(own).tolist() == (counts @ gains).tolist()
    assert I.Gains(gains).sums([b"", own[2]]).tolist() == [0, int(counts[2] @ gains)]
    assert I.Gains(gains * 0).sums(own).tolist() == [0] * 4


def mined(rows, anchors, k=5, m=5, percent=(80, 100)):
    """Each row: (id, vector of whole numbers, label)."""
    out = []
    for a, v, label in (r for r in rows if r[0] in anchors):
        dot = lambda w: sum(x * y for x, y in zip(v, w, strict=False))
        mates = sorted((-dot(w), i) for i, w, l in rows if l == label and i != a)[:k]
        others = sorted((-dot(w), i) for i, w, l in rows if l != label)
        for s, p in mates:
            near = [(t, i) for t, i in others if percent[0] * -s <= 100 * -t <= percent[1] * -s][:m]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i) in enumerate(near)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int"


def run(spark, rows, anchors, **options):
    frame = spark.createDataFrame([(i, v, l) for i, v, l in rows], VECTORS).repartition(3)
    return sorted(map(tuple, hard_negatives(frame, F.col("vec_id").isin(*anchors), **options).collect()))


@pytest.mark.parametrize("tree,chunk", [(256, 16_000_000), (4, 900)])
def test_hard_negatives_against_brute_force(spark, monkeypatch, tree, chunk):
    monkeypatch.setattr(N, "TREE", tree)
    monkeypatch.setattr(N, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(N, "SLICE", 50)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 8)) * 4
    rows = []
    for k in range(220):
        x = centres[k % 6] + rng.normal(size=8)
        rows.append((k, (np.round(x * 8) / 8).tolist(), int(k % 4)))
    rows += [(500 + k, rows[k][1], rows[k][2]) for k in range(30)]
    anchors = [r[0] for r in rows if r[0] % 7 == 0]
    whole = [(i, [math.floor(x * 256) for x in v], l) for i, v, l in rows]
    assert run(spark, rows, anchors) == mined(whole, anchors)
    if tree == 4:
        options = dict(n_positives=2, n_negatives=3, percent=(50, 150))
        assert run(spark, rows, anchors, **options) == mined(whole, anchors, 2, 3, (50, 150))


def test_hard_negatives_edges(spark):
    good = [(100, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.5], 2), (3, [0.9], 2), (4, [], 3)]
    bad = [(5, None, 1), (6, [1.0, None], 2), (7, [float("nan"), 1.0], 2), (8, [1.0, 1.0], None), (None, [1.0], 2)]
    rows = run(spark, good + bad, [100])
    assert rows == [(100, 1, 1, 2, 65536, 256 * 230), (100, 1, 2, 3, 65536, 256 * 230)]
    assert run(spark, [], [100]) == []
    assert run(spark, good[1:], [100]) == []
    assert run(spark, [(100, [-1.0], 1), (1, [1.0], 1), (2, [0.5], 2)], [100]) == []
    twice = spark.createDataFrame([good[0], good[1], good[1], good[2], good[2]], VECTORS)
    found = hard_negatives(twice.withColumn("rank", F.lit(1)), F.col("vec_id") == 100).collect()
    assert len(found) == 4


def test_hard_negatives_of_large_components(spark):
    rows = [(0, [4e6, 4e6], 1), (1, [4e6, 3.9e6], 1), (2, [3.9e6, 3.8e6], 2), (3, [1.0, 1.0], 2)]
    whole = [(i, [math.floor(x * 256) for x in v], l) for i, v, l in rows]
    assert run(spark, rows, [0]) == mined(whole, [0])


def test_bounds_leave_work_out():
    rng = np.random.default_rng(4)
    near = (np.repeat(rng.normal(size=(8, 16)) * 200, 40, axis=0) + rng.normal(size=(320, 16))).astype("<i4")
    order, parent, edge = N.spanning_tree(near[::4])
    assert sorted(order) == list(range(80)) and (edge[1:] > 0).all()
    place = {int(o): k for k, o in enumerate(order)}
    raw = [near[::4][o].tobytes() for o in order]
    tree = N.Tree(list(order), 0, raw, [place[int(p)] for p in parent], list(edge))
    block = N.Slice(np.arange(320), np.zeros(320), near)
    scores = near[::4][order].astype(int) @ near.T.astype(int)
    tops = np.sort(scores, axis=1)[:, -5]
    seen = 0
    for at, idx, score in tree.scores(block, lambda at, low, high: high >= tops[at]):
        seen += len(idx)
        assert (scores[at, idx] == score).all()
        assert set(np.flatnonzero(scores[at] >= tops[at])) <= set(idx)
    assert seen < 0.4 * scores.size
