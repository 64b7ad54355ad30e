"""Token ids, packing, length tables, and the pipeline of all stages."""

import random
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cardwatch.llm import decontam, pii, quality, registry
from cardwatch.llm.cutting_stock import best_limited_pattern, best_pattern, cut, solve_master
from cardwatch.llm.packing import pack
from cardwatch.llm.token_counts import token_counts
from cardwatch.llm.tokens import TokenizerFiles, encoder
from tests.check import differences, duck
from tests.conftest import SF001
from tests.llm.samples import table, texts
from tests.llm.test_jaccard import kept_by_brute_force

WHOLE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))

ODD = [
    "", " ", "a  b", "a \n b", "\n\n a", "x<|endoftext|>y z", "a   b", "it's don't  ", " lead", "tail ",
    None, "é\n\nb c", "1 22 333", "  two", "a" * 3000, "\ta\t b", "a  b 　", "\x1c a", "😀 😀",
]


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_vocabularys():
    many = [*ODD, *(t for _, t in texts(7))]
    ids, counts = encoder(TokenizerFiles()).encode(many)
    parts = np.split(ids, np.cumsum(counts)[:-1])
    assert [p.tolist() for p in parts] == [ids_of(t) for t in many]


def check_pieces(rows, pieces, capacity):
    """Every id in one piece, every sequence gapless; returns the share of padding."""
    by_sequence, by_document = {}, {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
        by_document.setdefault(p.doc_id, []).append((p.start, p.ids, p.length, p.doc_tokens))
    padding = total = 0
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert 0 < at <= capacity
        total += at
        padding += capacity - at if at & (at - 1) else 0
    for key, text in rows:
        ids, at = [*ids_of(text), 0], 0
        for start, own, length, n in sorted(by_document[key]):
            assert (start, n, len(own)) == (at, len(ids), 4 * length)
            assert np.frombuffer(own, "<u4").tolist() == ids[at : at + length]
            at += length
        assert at == len(ids)
    return padding / max(total, 1)


def test_packing_round_trip(spark):
    rows = [(k, t) for k, (_, t) in enumerate([*texts(8), *((0, t) for t in ODD)])]
    pieces = pack(table(spark, rows), capacity=128).collect()
    assert check_pieces(rows, pieces, 128) < 0.01


def test_packing_bears_repeated_and_null_ids(spark):
    rows = texts(9)
    pieces = pack(table(spark, rows)).collect()
    assert sum(p.length for p in pieces) == sum(len(ids_of(t)) + 1 for _, t in rows)
    assert len({(p.sequence_id, p.offset) for p in pieces}) == len(pieces)
    assert pack(table(spark, []).limit(0)).collect() == []


def test_patterns_meet_demand_with_little_waste():
    rng = random.Random(3)
    demand = Counter(rng.randint(1, 99) for _ in range(20_000))
    patterns = cut(dict(demand), 100, 0.002, 1_500)
    used = Counter()
    for p in patterns:
        assert sum(n * k for n, k in zip(p.lengths, p.counts, strict=True)) <= 100
        for n, k in zip(p.lengths, p.counts, strict=True):
            used[n] += k * p.times
    assert used == demand
    needed = sum(n * k for n, k in demand.items()) / 100
    assert sum(p.times for p in patterns) < 1.02 * needed + 100


def test_knapsack_is_optimal():
    rng = np.random.default_rng(4)
    for _ in range(20):
        value = rng.random(6) * np.arange(1, 7)
        best = [0.0] * 24
        for room in range(1, 24):
            best[room] = max([best[room - 1], *(best[room - n] + value[n - 1] for n in range(1, 7) if n <= room)])
        worth, counts = best_pattern(value, 23)
        assert worth == pytest.approx(best[23])
        assert sum(value[n - 1] * k for n, k in counts.items()) == pytest.approx(worth)


def test_limited_knapsack_is_optimal():
    rng = np.random.default_rng(5)
    for _ in range(20):
        value, limits = rng.random(5) * np.arange(1, 6), rng.integers(0, 4, 5)
        best = [0.0] * 21
        for n, (v, limit) in enumerate(zip(value, limits, strict=True), 1):
            best = [
                max(best[room - n * k] + v * k for k in range(limit + 1) if n * k <= room)
                for room in range(21)
            ]
        worth, counts = best_limited_pattern(value, 20, limits)
        assert worth == pytest.approx(best[20])
        assert all(k <= limits[n - 1] for n, k in counts.items())
        assert sum(n * k for n, k in counts.items()) <= 20


def test_column_generation_carries_the_packing():
    """On real lengths the program meets its dual bound before its last round, and patterns
    within the slack make up most sequences that are not one full piece."""
    found = duckdb.sql(f"SELECT text FROM '{SF001}/../sf0.01/documents.parquet'").fetchall()
    _, counts = encoder(TokenizerFiles()).encode([t for (t,) in found])
    demand = Counter(((counts + 1) % 1024).tolist())
    del demand[0]
    needed = sum(n * k for n, k in demand.items()) / 1024
    tolerance = max(1.5, 0.001 * needed)
    solved = solve_master(demand, 1024, tolerance, 1_500)
    assert solved.rounds < 1_500
    assert needed <= solved.bound <= solved.total <= solved.bound + tolerance
    patterns = cut(demand, 1024, 0.001, 1_500)
    tight = [p for p in patterns if sum(n * k for n, k in zip(p.lengths, p.counts, strict=True)) >= 1018]
    assert sum(p.times for p in tight) > 0.75 * sum(p.times for p in patterns)
    assert sum(p.times for p in patterns) < 1.01 * needed + 2


def test_length_table(spark):
    rows = texts(10)
    lengths = [len(ids_of(t)) for _, t in rows]
    got = {r.n_tokens: r for r in token_counts(table(spark, rows)).collect()}
    assert set(got) == set(lengths)
    for n, r in got.items():
        longer = [x for x in lengths if x > n]
        assert (r.n_docs, r.docs_longer, r.tokens_longer) == (lengths.count(n), len(longer), sum(longer))
        assert r.docs_within == len(lengths) - len(longer)
        assert (r.total_tokens, r.truncated_tokens) == (sum(lengths), sum(min(x, n) for x in lengths))
        assert r.share_within == pytest.approx(r.docs_within / len(lengths))
    assert token_counts(table(spark, []).limit(0)).collect() == []


def test_pipeline_matches_its_stages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    judged = quality.judge(docs.select("doc_id", "text")).filter("kept").select("doc_id").collect()
    left = {r.doc_id for r in judged}
    good = docs.filter(docs.doc_id.isin(list(left))).select("doc_id", "text").collect()
    left = set(kept_by_brute_force([tuple(r) for r in good]))
    bench = [tuple(r) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    windows = set()
    for _, text in bench:
        words = decontam.words_of(text)
        windows.update(tuple(words[i : i + 10]) for i in range(max(1, len(words) - 9)))
    rows = []
    for key, text in docs.select("doc_id", "text").collect():
        words = decontam.words_of(text)
        hit = any(tuple(words[i : i + 10]) in windows for i in range(len(words) - 9))
        if key in left and not hit:
            rows.append((key, pii.redact_text(text)))
    pieces = corpus_pipeline.run(spark, SF001).collect()
    assert {p.doc_id for p in pieces} == {k for k, _ in rows}
    assert check_pieces(rows, pieces, 1024) < 0.01
    assert 0.5 < len(rows) / docs.count() < 0.95


def test_stages_return_the_columns_of_documents(spark):
    docs = table(spark, texts(11))
    for _, function in corpus_pipeline.STAGES[:-1]:
        docs = function(spark, docs, SF001)
        assert docs.columns == table(spark, []).columns
    empty = table(spark, []).limit(0)
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, empty, SF001).collect() == []


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_rows_match_sql(spark, name):
    sql = registry.oracle_sql()[name]
    assert differences(spark, duck(SF001), registry.queries()[name], sql, SF001) is None


def test_all_operators_are_registered():
    assert [n.split("_")[0] for n in registry.queries()] == [f"op{k}" for k in range(1, 14)]
