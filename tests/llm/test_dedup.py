"""Windows of words, byte strings and fingerprints against brute force."""

from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cardwatch.llm import simhash, suffixes
from cardwatch.llm.minimisers import Run, sliding_least
from cardwatch.llm.simhash import covering_masks, drop_near_duplicates, links, near_duplicates
from cardwatch.llm.substrings import dedup_substrings
from cardwatch.llm.suffixes import dedup_suffixes, difference_cover_array
from tests.llm.samples import table, texts


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))


@pytest.mark.parametrize("seed", [1, 2])
def test_later_windows_go(spark, seed):
    rows, seen, expected = texts(seed), set(), []
    for key, text in in_order(rows):
        words, gone = (text or "").encode().split(), set()
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone.update(range(i, i + 20))
            seen.add(window)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
        expected.append((key, len(words), len(gone), kept))
    found = dedup_substrings(table(spark, rows)).collect()
    got = [(r[0], r[1], sum(e - s for s, e in r[2]), r[3]) for r in found]
    assert Counter(got) == Counter(expected)


@pytest.mark.parametrize("length", [5, 400])
def test_large_groups_are_parted_by_a_second_minimiser(length):
    """Runs with one common string, each with surroundings of its own or shared in part."""
    rng = np.random.default_rng(5)
    common = bytes(rng.integers(97, 123, 40).astype(np.uint8))
    sides = [bytes(rng.integers(97, 123, 2 * length).astype(np.uint8)) for _ in range(6)]
    runs = [
        Run(a + common + b, 7, len(a + common + b) - length + 1, [(k, 0)])
        for k, (a, b) in enumerate((a, b) for a in sides for b in sides)
    ]
    windows = suffixes.Windows(length, min(length - 1, 32), suffixes.split_bytes)
    cells = [
        {(k, u) for k, a, n in marks for u in range(a, a + n)}
        for marks in (suffixes._parted(runs, windows), suffixes._repeated(runs, length))
    ]
    assert cells[0] == cells[1] != set()


@pytest.mark.parametrize("length", [5, 400])
def test_repeated_bytes_go(spark, length):
    rows = texts(3)
    datas = [(k, (t or "").encode()) for k, t in rows]
    counts = Counter(d[i : i + length] for _, d in datas for i in range(len(d) - length + 1))
    expected = []
    for key, d in datas:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) > 0).sum())
        expected.append((key, len(d), spans, bytes(b for b, g in zip(d, gone, strict=True) if not g)))
    found = dedup_suffixes(table(spark, rows), length=length, gram=min(length - 1, 32)).collect()
    assert Counter((r[0], r[1], len(r[2]), bytes(r[3])) for r in found) == Counter(expected)


def test_one_row_per_document_of_an_empty_table(spark):
    none = table(spark, []).limit(0)
    for f in (dedup_substrings, dedup_suffixes, near_duplicates, drop_near_duplicates):
        assert f(none).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=50))
def test_difference_cover_order(symbols):
    order = difference_cover_array(np.array(symbols)).tolist()
    assert order == sorted(range(len(symbols)), key=lambda i: symbols[i:])


@pytest.mark.parametrize("width", [1, 2, 3, 16, 33])
def test_sliding_least(width):
    keys = np.random.default_rng(0).integers(0, 9, 100).astype(np.uint64)
    expected = [keys[i : i + width].min() for i in range(101 - width)]
    assert sliding_least(keys, width).tolist() == expected


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    spans = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_every_near_pair_shares_a_table():
    rng = np.random.default_rng(1)
    for level in range(3):
        masks = np.array(covering_masks(3, level), np.int64)
        assert len(masks) == 15
        assert all(bin(int(m) & (2**64 - 1)).count("1") == 32 for m in masks)
        for _ in range(300):
            change = sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False))
            assert any(int(m) & (2**64 - 1) & change == 0 for m in masks)


@pytest.mark.parametrize("bucket", [2, 200])
def test_links_are_all_near_pairs(spark, bucket):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)
    prints = {0}
    for _ in range(400):
        bits = rng.choice(12, rng.integers(0, 5), replace=False)
        prints.add(int(base[rng.integers(4)]) ^ sum(1 << int(5 * b) for b in bits))
    signed = sorted(p - 2**64 if p >= 2**63 else p for p in prints)
    expected = {
        (a, b)
        for i, a in enumerate(signed)
        for b in signed[i + 1 :]
        if ((a ^ b) & (2**64 - 1)).bit_count() <= 3
    }
    frame = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    assert {tuple(r) for r in links(frame, bucket=bucket).collect()} == expected
    assert len(expected) > 100


def test_components_have_the_smallest_id(spark):
    rows = texts(4)
    prints = [fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    low = {g: min((rows[i][0] for i, h in enumerate(group) if h == g and rows[i][0] is not None), default=None) for g in set(group)}
    expected = Counter((k, f"{p:016x}", low[g]) for (k, _), p, g in zip(rows, prints, group, strict=True))
    assert Counter(tuple(r) for r in near_duplicates(table(spark, rows)).collect()) == expected
    kept = drop_near_duplicates(table(spark, rows))
    assert kept.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert kept.count() == len(set(group))


def test_long_chain_is_one_component(spark):
    chain = [0]
    for k in range(40):
        chain.append(chain[-1] ^ (0b111 << k))
    frame = spark.createDataFrame([(p,) for p in chain], "fingerprint long")
    found = simhash.components(links(frame)).agg(F.countDistinct("component"), F.count("*")).first()
    assert found[0] == 1 and found[1] == len(set(chain))
