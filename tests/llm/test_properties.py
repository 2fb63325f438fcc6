"""Helpers that run inside tasks, on generated inputs."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from brute import LOWER, WORD, shingles
from hypothesis import assume, given, settings
from hypothesis import strategies as st

from dagframe.llm import bytesets, language_model, packing, secrets, suffix_dedup

texts = st.lists(st.one_of(st.none(), st.text(alphabet="aAbBé \t\n\x0b日", max_size=40)), min_size=1, max_size=6)


@settings(max_examples=60, deadline=None)
@given(texts, st.integers(1, 40))
def test_words_are_those_of_the_pattern(rows, most):
    strings = bytesets.as_strings(pa.array(rows, pa.string()))
    got = []
    for first, end, data, offsets in bytesets.slices(strings, most):
        starts, ends, row = bytesets.words(data, offsets)
        hashes = bytesets.word_hashes(data, starts, ends)
        found = [[] for _ in range(end - first)]
        for a, b, r, h in zip(starts, ends, row, hashes, strict=True):
            found[r].append((bytes(data[a:b]).decode().translate(LOWER), int(h)))
        got += found
    want = [WORD.findall((t or "").translate(LOWER)) for t in rows]
    assert [[w for w, _ in r] for r in got] == want
    names = {}
    for w, h in (x for r in got for x in r):
        assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


@settings(max_examples=60, deadline=None)
@given(texts, st.integers(1, 4))
def test_shingle_sets_have_the_sizes_of_plain_ones(rows, size):
    sets = list(bytesets.shingle_sets(bytesets.as_strings(pa.array(rows, pa.string())), size))
    plain = [shingles(t, size) for t in rows]
    assert [len(s) for s in sets] == [len(p) for p in plain]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert len(np.intersect1d(a, b)) == len(plain[i] & plain[j])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 4000), min_size=1, max_size=6), st.lists(st.integers(0, 9), min_size=6, max_size=6), st.integers(1, 700))
def test_schedules_give_every_token_once(totals, weights, tokens):
    weights = weights[: len(totals)]
    assume(tokens >= len(totals) and all(not w or tokens * w >= sum(weights) for w in weights))
    s = packing.Schedule(totals, weights, tokens)
    left = sum(totals)
    for t in range(s.windows):
        sizes = [s.before(q, t + 1) - s.before(q, t) for q in range(len(totals))]
        assert min(sizes) >= 0 and sum(sizes) == min(tokens, left)
        assert [s.offset(q, t) for q in range(len(totals))] == np.concatenate([[0], np.cumsum(sizes)[:-1]]).tolist()
        left -= sum(sizes)
    assert left == 0 and [s.before(q, s.windows) for q in range(len(totals))] == totals
    for q, n in enumerate(totals):
        if n:
            t = s.window_of(q, n - 1)
            assert s.before(q, t) <= n - 1 < s.before(q, t + 1)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=1, max_size=8), st.integers(8, 500))
def test_small_queues_go_together(totals, tokens):
    named = {f"q{i}": n for i, n in enumerate(totals)}
    lane = packing.lanes(named, tokens)
    sizes = {}
    for q, x in lane.items():
        sizes[x] = sizes.get(x, 0) + named[q]
    assert set(lane) == set(named) and len({x for q, x in lane.items() if q != x}) <= 1
    assert all(tokens * n >= sum(totals) for n in sizes.values())
    s = packing.Schedule(list(sizes.values()), list(sizes.values()), tokens)
    for q, n in enumerate(sizes.values()):
        given = [s.before(q, t) for t in range(min(s.windows, 300) + 1)]
        assert all(a <= b for a, b in zip(given, given[1:]))
        assert all(abs(g - t * tokens * n / sum(totals)) < 1 for t, g in enumerate(given[:-1]))


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=50), st.integers(1, 9), st.integers(0, 5), st.lists(st.integers(0, 2**53), max_size=9))
def test_packed_keys_come_back_in_their_ranges(keys, fan, level, counts):
    keys = np.array(sorted(keys), np.uint64)
    assert language_model.unsqueezed(language_model.squeezed(keys)).tolist() == keys.tolist()
    where = language_model.range_of(keys, level, fan)
    assert (np.diff(where) >= 0).all() and ((where >= 0) & (where < 1 << fan * (level + 1))).all()
    assert (language_model.range_of(keys, level + 1, fan) >> fan == where).all()
    assert language_model.counts_unpacked(language_model.counts_packed(np.array(counts, np.int64))).tolist() == counts


def test_counts_beyond_32_bits_add_up():
    keys = np.array([5, 9, 2**62], np.uint64)
    blocks = [language_model._packed(k, 0, 1, [(keys, np.array([3 * 10**9, 1, 0])), (keys[:2], np.array([2**40, 7]))]) for k in range(2)]
    got = language_model._answered(pa.concat_tables(blocks))
    assert [language_model.counts_unpacked(x).tolist() for x in got.column("words").to_pylist()] == [[6 * 10**9, 2, 0]] * 2
    assert [language_model.counts_unpacked(x).tolist() for x in got.column("pairs").to_pylist()] == [[2**41, 14]] * 2
    assert got.column("n").to_pylist() == [6 * 10**9 + 2, 0] and got.column("v").to_pylist() == [2, 0]


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=200, max_size=900).map(lambda b: bytes(x % 3 for x in b)))
def test_every_window_has_one_anchor(data):
    array = np.frombuffer(data, np.uint8)
    for _, first, last, anchor, held in suffix_dedup._runs(array, 200):
        assert first[0] == 0 and last[-1] == len(data) - 200 and (first[1:] == last[:-1] + 1).all()
        grams = held[suffix_dedup.GRAM]
        for f, e, a in zip(first, last, anchor, strict=True):
            for p in (f, e):
                window = grams[p : p + 137]
                assert a == p + int(np.argmin(window))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="secrt=: 'pawodAKI01f9_é", max_size=120))
def test_spans_are_those_of_the_patterns(text):
    found = secrets.spans(text, secrets.KINDS, secrets.default_vocabulary())
    base = [(m.start(), 0, m.end()) for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    assert [s for s in found if s[1] < 3] == sorted(base)
    batch = secrets._batch_spans(pa.array([text, ""]), secrets.default_vocabulary())
    assert batch == [found, []]
