"""Large texts that share little are told apart before any set is moved, and no link is lost by it."""

import random

import numpy as np
import pytest

from tests.llm.test_llm_operators import components, shingle_sets
from treeloom.llm import jaccard_join

VOCABULARY = [f"w{i}" for i in range(400)]


def words(rnd, n):
    return [rnd.choice(VOCABULARY) for _ in range(n)]


def test_sketches_tell_large_texts_apart(spark):
    rnd = random.Random(11)
    base = words(rnd, 4150)
    near = [w if rnd.random() > 0.01 else "edit" for w in base]
    # 1 and 4 are unrelated to all; the sketch of 3, of fewer than 4,097 shingles, is half as fine as that of 0.
    texts = [base, words(rnd, 4150), near, base[:3900], words(rnd, 3900)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    drawn = jaccard_join.sketches(docs, 4).join(jaccard_join.describe_sets(docs, 4).select("doc_id", "size"), "doc_id")
    assert {r.doc_id: len(r.sketch) // 4 for r in drawn.collect()} == {0: 1024, 1: 1024, 2: 1024, 3: 512, 4: 512}
    pairs = spark.createDataFrame([(a, b) for a in range(5) for b in range(a + 1, 5)], "a long, b long")
    assert {(r.a, r.b) for r in jaccard_join._promising(pairs, drawn, 85, 100).collect()} == {(0, 2), (0, 3), (2, 3)}


def test_bucket_pairs_leave_out_hubs_and_equal_components(spark):
    rows = [(7, 1, 1, 1), (7, 2, 1, 2), (7, 3, 1, 3), (7, 4, 1, 3), (8, 3, 3, 3), (8, 9, 3, 9), (9, 2, 2, 2), (9, 3, 2, 3), (9, 4, 2, 3)]
    got = jaccard_join._bucket_pairs(spark.createDataFrame(rows, "segment long, doc_id long, hub long, component long")).collect()
    assert sorted((r.a, r.b) for r in got) == [(2, 3), (2, 4)]


@pytest.mark.parametrize("bucket_pairs", [0, 5, 1000])
def test_buckets_by_pairs_or_blocks_against_all_pairs(spark, monkeypatch, bucket_pairs):
    monkeypatch.setattr(jaccard_join, "BUCKET_PAIRS", bucket_pairs)
    rnd, rows = random.Random(5), []
    for size in (40, 300, 530, 1050, 2100):  # the last ones lie about the edges of finer sketches
        base = words(rnd, size)
        for i in range(12):
            text, at = list(base), rnd.randrange(size)
            for _ in range(rnd.randint(0, size // 30)):
                text[rnd.randrange(size)] = rnd.choice(VOCABULARY)
            if i % 3 == 0:
                text = text[: size - rnd.randint(0, size // 8)]
            if i % 4 == 0:
                text[at : at + 10] = words(rnd, rnd.randint(0, 20))
            rows.append((len(rows), " ".join(text)))
    want = components(shingle_sets(rows, 4), 85, 100)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert 5 < len(set(want.values())) < len(rows)
    assert {r.doc_id: r.component_id for r in got} == want


def shared_segments(sets):
    """(segments that more than one set sends, segments in all) of arrays of distinct keys."""
    sizes = np.array([len(s) for s in sets])
    _, segment = jaccard_join._segment_keys(np.repeat(np.arange(len(sets)), sizes), np.concatenate([np.sort(s) for s in sets]), sizes, 85, 100)
    found, count = np.unique(segment, return_counts=True)
    return int((count > 1).sum()), len(segment)


def fresh(rng, n, lumpy=False):
    keys = rng.integers(0, 2**64, n, dtype=np.uint64)
    return np.unique((keys >> np.uint64(40)) + rng.choice(keys[:3], n) if lumpy and n else keys)


def test_unrelated_texts_with_common_lines_share_few_segments():
    rng = np.random.default_rng(1)
    for size in (150, 300, 1000):
        common = fresh(rng, size // 10)
        sets = [np.unique(np.concatenate([common, fresh(rng, size - len(common) + int(rng.integers(0, 30)))])) for _ in range(200)]
        shared, sent = shared_segments(sets)
        assert shared <= 2 * 200 / 100
        # One for each difference and one more, in the own class and at most one beside.
        assert sent <= 2 * sum(15 * len(s) // 85 + 1 for s in sets)


@pytest.mark.parametrize("lumpy", [False, True])
def test_sets_at_the_edge_of_a_link_share_a_segment(lumpy):
    rng, edges = np.random.default_rng(2), 0
    for _ in range(400):
        n = int(rng.integers(1, 4000) if rng.random() < 0.5 else rng.integers(1, 60))
        base = rng.permutation(fresh(rng, n, lumpy))
        gone = int(rng.integers(0, 15 * n // 100 + 1))
        # As many new keys as the threshold allows.
        new = max(0, 100 * (n - gone) // 85 - n)
        other = np.unique(np.concatenate([base[gone:], fresh(rng, new, lumpy)]))
        both = len(np.intersect1d(base, other))
        if both and 100 * both >= 85 * (len(base) + len(other) - both):
            edges += 1
            assert shared_segments([base, other])[0]
    assert edges > 200
