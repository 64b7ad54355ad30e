"""The near-duplicate stage against brute-force Jaccard similarity."""

import random

import numpy as np
import pytest

import corpus_pipeline
from cardwatch.llm import components, jaccard, shared, simhash
from tests.conftest import SF001
from tests.llm.samples import prose, table, texts


def shingles(text, size=5):
    words = (text or "").encode().lower().split()
    k = min(size, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, text, edits):
    words = text.split()
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"w{rng.randrange(10**9)}"
    return " ".join(words)


def kept_by_brute_force(rows):
    """Ids of the smallest of each component; ids are unique."""
    sets = {k: shingles(t) for k, t in rows}
    group = {k: k for k in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and group[i] != group[j] and similarity(sets[i], sets[j]) >= 0.8:
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    return sorted(set(group.values()))


def test_stage_drops_what_brute_force_drops(spark):
    rng = random.Random(21)
    rows = []
    for _ in range(12):
        # One original and copies with one to six words changed, around 0.8.
        text = " ".join(f"t{rng.randrange(10**6)}" for _ in range(150))
        rows += [text, *(edited(rng, text, n) for n in range(1, 7))]
    # A large group of near copies of each other, so that buckets are full.
    text = " ".join(f"t{rng.randrange(10**6)}" for _ in range(200))
    rows += [edited(rng, text, rng.randint(1, 6)) for _ in range(150)]
    rows += [prose(rng, rng.randint(1, 60)) for _ in range(20)] + [None, "", " \n", "a b", "A  b"]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    got = corpus_pipeline.near_duplicates(spark, table(spark, rows), SF001)
    assert sorted(r.doc_id for r in got.collect()) == kept_by_brute_force(rows)


def pairs_tested(monkeypatch, function):
    """The function's result and how many pairs of texts it has compared."""
    compared, verify = [], jaccard._verified

    def counted(pairs, *more):
        compared.append(pairs.count())
        return verify(pairs, *more)

    monkeypatch.setattr(jaccard, "_verified", counted)
    return function(), sum(compared)


def test_a_common_passage_makes_few_pairs(spark, monkeypatch):
    rng = random.Random(23)
    passage = " ".join(f"p{k}" for k in range(150))
    rows = [(k, f"{passage} {' '.join(f'w{rng.randrange(10**9)}' for _ in range(50))}") for k in range(600)]
    kept, compared = pairs_tested(monkeypatch, lambda: jaccard.drop_similar(table(spark, rows)).count())
    assert kept == 600
    assert compared < 20 * len(rows)


def test_loose_copies_make_few_pairs(spark, monkeypatch):
    # Copies with up to nine changes: most pairs are below 0.8, all buckets are shared.
    rng = random.Random(24)
    text = " ".join(f"t{rng.randrange(10**6)}" for _ in range(150))
    rows = [(k, edited(rng, text, rng.randint(0, 9))) for k in range(400)]
    rows += [(400 + k, " ".join(t.split()[rng.randrange(20) :])) for k, (_, t) in enumerate(rows[:200])]
    got, compared = pairs_tested(
        monkeypatch, lambda: [r.doc_id for r in jaccard.drop_similar(table(spark, rows)).collect()]
    )
    assert sorted(got) == kept_by_brute_force(rows)
    assert compared < 60 * len(rows)


@pytest.mark.parametrize("listed", [1, 10**6])
def test_all_texts_compared_share_a_band(spark, monkeypatch, listed):
    # Two loose groups, whose buckets stay open; text k of either has the same rare words,
    # but no band in common.
    rng, rows = random.Random(25), []
    own = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(40)) for _ in range(15)]
    for _ in range(2):
        passage = " ".join(f"t{rng.randrange(10**6)}" for _ in range(150))
        rows += [f"{passage} {words}" for words in own]
    rows += [edited(rng, rows[0], rng.randint(1, 6)) for _ in range(15)]
    rows = list(enumerate(rows))
    compared, verify = [], jaccard._verified

    def seen(pairs, *more):
        compared.extend((r.u, r.v) for r in pairs.collect())
        return verify(pairs, *more)

    monkeypatch.setattr(jaccard, "_verified", seen)
    monkeypatch.setattr(jaccard, "LISTED", listed, raising=False)
    got = sorted(r.doc_id for r in jaccard.drop_similar(table(spark, rows)).collect())
    bands = {k: set(jaccard.describe(t, 5)["bands"]) for k, t in rows}
    assert [p for p in compared if not bands[p[0]] & bands[p[1]]] == []
    assert got == kept_by_brute_force(rows)


def test_bands_and_sketches_find_pairs_at_the_threshold():
    rng, close, met = random.Random(22), 0, 0
    while close < 300:
        text = " ".join(f"t{rng.randrange(10**6)}" for _ in range(rng.randint(20, 200)))
        other = edited(rng, text, rng.randint(1, 5))
        if not 0.8 <= similarity(shingles(text), shingles(other)) < 0.87:
            continue
        a, b = jaccard.describe(text, 5), jaccard.describe(other, 5)
        apart = sum(((a[s] ^ b[s]) & (2**64 - 1)).bit_count() for s in ("s0", "s1", "s2"))
        close += 1
        met += bool(set(a["bands"]) & set(b["bands"])) and apart <= jaccard.SKETCH_BITS
    assert met == close


def test_repeated_and_null_ids_keep_one_row_each_component(spark):
    rows = texts(4)
    kept = jaccard.drop_similar(table(spark, rows))
    assert kept.columns == table(spark, []).columns
    assert kept.count() == len(kept_by_brute_force([(k, t) for k, (_, t) in enumerate(rows)]))


@pytest.mark.parametrize("listed", [1, 16])
def test_no_side_passes_through_the_driver(spark, monkeypatch, listed):
    plans, write = [], shared.stage

    def planned(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    for module in (jaccard, components):
        monkeypatch.setattr(module, "stage", planned)
    monkeypatch.setattr(jaccard, "LISTED", listed)
    rng = random.Random(26)
    text = " ".join(f"t{rng.randrange(10**6)}" for _ in range(150))
    rows = [(k, edited(rng, text, rng.randint(0, 9))) for k in range(60)]
    got = jaccard.drop_similar(table(spark, rows))
    plans.append(("result", got._jdf.queryExecution().executedPlan().toString()))
    assert sorted(r.doc_id for r in got.collect()) == kept_by_brute_force(rows)
    assert {"open-bands", "candidates", "similar", "large-star", "small-star", "linked"} <= {n for n, _ in plans}
    assert [n for n, plan in plans if "Broadcast" in plan] == []


#: Texts of nine words; the first eight alone have four of five shingles, but no band in common.
MISSED = [
    "t877753 t181631 t89947 t729689 t261012 t4126 t182018 t241140 t183013",
    "t391506 t302022 t159688 t381184 t47993 t979038 t261520 t304964 t547619",
    "t342628 t129535 t61546 t753906 t311836 t812100 t470496 t668907 t646507",
]


@pytest.mark.parametrize("paired", [1, 64])
def test_similar_texts_without_a_common_band_are_linked(spark, monkeypatch, paired):
    monkeypatch.setattr(jaccard, "PAIRED", paired)
    rows = [(2 * k, text) for k, text in enumerate(MISSED)]
    rows += [(2 * k + 1, text.rsplit(" ", 1)[0]) for k, text in enumerate(MISSED)]
    bands = {k: set(jaccard.describe(t, 5)["bands"]) for k, t in rows}
    assert not any(bands[2 * k] & bands[2 * k + 1] for k in range(len(MISSED)))
    got = jaccard.drop_similar(table(spark, rows))
    assert sorted(r.doc_id for r in got.collect()) == kept_by_brute_force(rows) == [0, 2, 4]


def test_links_far_below_the_bands_similarity_are_found(spark):
    rng, rows = random.Random(27), []
    for _ in range(40):
        text = " ".join(f"t{rng.randrange(10**6)}" for _ in range(60))
        rows += [text, edited(rng, text, rng.randint(4, 9))]
    close = [similarity(shingles(a), shingles(b)) >= 0.3 for a, b in zip(rows[::2], rows[1::2], strict=True)]
    assert 10 < sum(close) < 40
    got = jaccard.drop_similar(table(spark, list(enumerate(rows))), similarity=0.3)
    assert got.count() == len(rows) - sum(close)


def test_prefixes_of_similar_sets_meet_where_enough_is_left():
    rng, close = random.Random(28), 0
    while close < 300:
        text = " ".join(f"t{rng.randrange(10 ** rng.randint(2, 6))}" for _ in range(rng.randint(5, 120)))
        other = edited(rng, text, rng.randint(0, 3)) if rng.random() < 0.5 else text.rsplit(" ", rng.randint(1, 3))[0]
        if similarity(shingles(text), shingles(other)) < 0.8:
            continue
        close += 1
        own = simhash.shingle_hashes(text, 5)
        some = np.unique(rng.sample(own.tolist(), rng.randint(0, len(own)))).astype(np.uint64)
        a, b = (jaccard.describe(t, 5, 0.8, some) for t in (text, other))
        i, j = next((i, b["prefix"].index(h)) for i, h in enumerate(a["prefix"]) if h in b["prefix"])
        assert min(a["size"] - i, b["size"] - j) >= 0.8 / 1.8 * (a["size"] + b["size"]) - 1e-6
        apart = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a["parities"], b["parities"], strict=True))
        assert apart <= 0.2 / 1.8 * (a["size"] + b["size"]) + 1e-6
