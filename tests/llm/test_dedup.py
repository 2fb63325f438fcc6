from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from brute import near, repeats, shingles
from conftest import pairs

from dagframe.llm import near_dedup, suffix_dedup
from dagframe.llm.common import Scratch
from dagframe.llm.components import components
from dagframe.llm.near_dedup import banding, drop_near_duplicates, linked, near_duplicates, pack, similarity
from dagframe.llm.suffix_dedup import remove_repeats


def rows(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_repeats_on_edges(edges, nothing):
    got = rows(remove_repeats(edges), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == Counter(repeats(pairs(edges)))
    assert remove_repeats(nothing).count() == 0


def test_repeats_in_stretches(edges, monkeypatch):
    """Long texts are worked on in stretches; where these end doesn't show."""
    monkeypatch.setattr(suffix_dedup, "STARTS", 333)
    docs = [(int(k if k is not None else 999), t) for k, t in pairs(edges)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in docs], pa.int64()), pa.array([t for _, t in docs], pa.string())], ["doc", "text"])
    made = list(suffix_dedup._anchors(200)(iter([batch])))
    covered = Counter()
    for b in made:
        for d, place in zip(b.column("doc").to_pylist(), b.column("place").to_pylist()):
            covered[d] += ((place >> 8) & 255) + 1
    want = Counter()
    for k, t in docs:
        want[k] += max(0, len((t or "").encode()) - 199)
    assert covered == +want


def test_repeats_at_lengths(edges):
    for length in (136, 216):
        got = rows(remove_repeats(edges, length=length), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert got == Counter(repeats(pairs(edges), length))
    with pytest.raises(ValueError):
        remove_repeats(edges, length=100)


def test_repeats_on_documents(small):
    got = rows(remove_repeats(small), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == Counter(repeats(pairs(small)))


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(small, edges, nothing, size, percent):
    for df in (small, edges):
        want = Counter((k, n, c if n else k) for k, n, c in near(pairs(df), size, percent))
        assert rows(near_duplicates(df, shingle=size, percent=percent), "doc_id", "n_shingles", "component_id") == want
    assert near_duplicates(nothing).count() == 0


def test_near_duplicates_in_blocks(small, monkeypatch):
    """Groups over the block size are compared in pairs of blocks, with the same result."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 2)
    want = Counter((k, c if n else k) for k, n, c in near(pairs(small), 3, 85))
    assert rows(near_duplicates(small, shingle=3, percent=85), "doc_id", "component_id") == want


def test_buckets_in_blocks(small, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_SIGNS", 2)
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 3)
    want = Counter((k, c if n else k) for k, n, c in near(pairs(small), 5, 80))
    assert rows(near_duplicates(small), "doc_id", "component_id") == want


@pytest.mark.parametrize("repeated", [2, 0])
def test_chains_of_texts_that_are_mostly_alike(spark, monkeypatch, repeated):
    """Each text changes a few words of the one before: neighbours are linked, distant ones meet in buckets and are not, and a second family is close but apart."""
    import random

    monkeypatch.setattr(near_dedup, "REPEATED", repeated)
    rng = random.Random(7)
    texts = []
    for _ in range(2):
        words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        for k in range(60):
            for _ in range(2 if k % 12 else 9):
                words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    docs = [(i, t) for i, t in enumerate(texts)] + [(500 + i, texts[i // 2]) for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for size, percent in ((3, 85), (5, 80)):
        want = Counter(near(docs, size, percent))
        assert rows(near_duplicates(df, shingle=size, percent=percent), "doc_id", "n_shingles", "component_id") == want
        assert len({c for _, _, c in want}) > 4


@pytest.mark.parametrize("percent", [80, 85])
def test_pairs_at_the_threshold_meet(percent):
    """Planted pairs just above the threshold: none without a common band, none ruled out by its signature."""
    rng = np.random.default_rng(8)
    per_band, bands = banding(percent)
    n = per_band * bands
    factors = near_dedup._factors(n)
    for size in (7, 40, 300):
        for _ in range(400):
            both = -(-percent * 2 * size // (100 + percent))
            core = rng.integers(0, 2**63, 2 * size - both, dtype=np.uint64)
            minima = np.stack([near_dedup._minima(x, factors) for x in (core[:size], core[size - both :])])
            assert (minima[0].reshape(bands, per_band) == minima[1].reshape(bands, per_band)).all(1).any()
            signs = pack(minima)
            assert similarity(signs[0], signs[1:], n)[0] >= near_dedup.least_estimate(percent, n)


def test_near_duplicates_among_texts_of_megabytes(spark):
    words = [f"w{k}" for k in range(150000)]
    near_copy = words[:70000] + ["other"] + words[70001:]
    docs = [(1, " ".join(words)), (2, " ".join(near_copy)), (None, "x" * 1_500_000), (4, " ".join(words[:100000])), (None, " ".join(words)), (None, " ".join(words))]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(2)).collect())
    assert got == Counter({(1, 149996, 1): 1, (2, 149996, 1): 1, (None, 149996, 1): 2, (None, 1, None): 1, (4, 99996, 4): 1})


def test_drop_keeps_one_of_each(edges):
    from pyspark.sql import functions as F

    edges = edges.withColumn("_NEAR_uid", F.lit(1))
    kept = drop_near_duplicates(edges, shingle=3, percent=85)
    assert kept.columns == edges.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(0) == 1 and ids.count(3) == 2 and not {1, 2, 100} & set(ids)  # two texts have id 3
    assert sum(i is None for i in ids) == 2  # one with a text of its own and one without text


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    minima = 252
    a = rng.integers(0, 2**32, minima, dtype=np.uint32)
    for share in (0.0, 0.5, 0.9, 1.0):
        b = np.where(rng.random(minima) < share, a, rng.integers(0, 2**32, minima, dtype=np.uint32))
        signs = pack(np.stack([a, b]))
        true = (a == b).mean()
        assert abs(similarity(signs[0], signs[1:], minima)[0] - true) < 0.15


def test_banding_meets_its_bound():
    for percent in (80, 85, 90):
        r, b = banding(percent)
        assert r * b <= 288 and (1 - (percent / 100) ** r) ** b <= 1e-6


def test_linked_agrees_with_all_pairs():
    rng = np.random.default_rng(2)
    core = np.unique(rng.integers(0, 2**63, 150, dtype=np.uint64))
    sets = [np.unique(np.where(rng.random(len(core)) < rng.choice([0.02, 0.08, 0.15]), rng.integers(0, 2**63, len(core), dtype=np.uint64), core)) for _ in range(60)]
    factors = near_dedup._factors(252)
    signs = pack(np.stack([near_dedup._minima(s, factors) for s in sets]))
    labels = linked(sets, signs, np.ones(60, int), 252, 85)
    as_sets = [set(s.tolist()) for s in sets]
    want = list(range(60))
    for i in range(60):
        for j in range(i):
            if 100 * len(as_sets[i] & as_sets[j]) >= 85 * len(as_sets[i] | as_sets[j]) and want[i] != want[j]:
                old, new = max(want[i], want[j]), min(want[i], want[j])
                want = [new if w == old else w for w in want]
    assert labels.tolist() == want


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100} | {200 + i: 100 for i in range(30)}


def test_shingles_of_few_words():
    assert shingles("One TWO", 3) == {("one", "two")} and shingles(" \n", 3) == set()
