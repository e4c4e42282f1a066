"""Exact, SimHash, word-window and byte-string duplicates against plain restatements."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus
from meshledger.llm import common, exact_dedup, simhash, substring_dedup, suffix_repeats
from meshledger.llm.components import components


@pytest.mark.parametrize("share", [0.002, 0.02, 0.9])
def test_exact(spark, share):
    found = corpus.rows() + [(1000 + k, "the same  text") for k in range(30)]
    groups = {}
    for i, t in found:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    want = []
    for i, t in found:
        plain = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        ids = [x for x in groups[plain] if x is not None]
        keep = min(ids) if ids else None
        want.append((i, keep, len(groups[plain]), i == keep, hashlib.sha256(plain.encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.exact_dedup(corpus.frame(spark, found), share=share).collect()]
    assert corpus.ordered(got) == corpus.ordered(want)


def test_exact_frequent_digests_are_verified(spark):
    found = [(k, f"text {k}") for k in range(200)] + [(1000 + k, "hot") for k in range(100)]
    heavy = exact_dedup.frequent(exact_dedup.digests(corpus.frame(spark, found)), 0.1).collect()
    assert [(r.keep_id, r.group_size) for r in heavy] == [(1000, 100)]


def simhash_of(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[j:j + 3]) for j in range(max(1, len(words) - 2))] if words else []
    count = np.zeros(64, int)
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        count += [(h >> b) & 1 for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * count[b] > len(shingles))


def smallest_reachable(fps, ranks):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(ranks):
        least[root(i)] = min(least.get(root(i), corpus.NO_ID), r)
    return [least[root(i)] for i in range(len(fps))]


def test_simhash(spark):
    found = corpus.rows()
    fps = [simhash_of(t or "") for _, t in found]
    least = smallest_reachable(fps, [corpus.rank(i) for i, _ in found])
    want = [(i, f - (1 << 64) if f >> 63 else f, None if c == corpus.NO_ID else c) for (i, _), f, c in zip(found, fps, least)]
    got = simhash.near_duplicates(corpus.frame(spark, found)).select("id", "fp", "component").collect()
    assert corpus.ordered(map(tuple, got)) == corpus.ordered(want)


@pytest.mark.parametrize("crowd", [0, 3, 64])
def test_links_by_pairs_and_by_stars(spark, crowd):
    rng = np.random.default_rng(3)
    fps = {0}
    for centre in rng.integers(0, 1 << 63, 12).tolist():
        for _ in range(12):
            x = centre
            for b in rng.integers(0, 64, rng.integers(0, 4)).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f, k) for k, f in enumerate(signed)], "fp long, rank long")
    found = components(simhash.links(nodes.select("fp"), crowd=crowd), nodes).collect()
    assert {r.fp: r.component for r in found} == dict(zip(signed, smallest_reachable(fps, range(len(fps)))))


def test_pivot_distances_bound_the_distance(spark):
    rng = np.random.default_rng(4)
    fps = rng.integers(-(1 << 63), 1 << 63, 20).tolist()
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    refs = simhash.references(frame)
    assert len(refs) == simhash.REFERENCES and set(refs) < set(fps)
    table = {r.fp: r.d for r in simhash.distance_table(frame, refs).collect()}
    for a in fps:
        # the first pivots are the first reference itself and the same with the bits of one group inverted
        unlike = a ^ refs[0]
        inside = [(unlike & m).bit_count() for m in simhash.masks()]
        assert table[a][0] == sum(inside)
        assert [(table[a][0] + m.bit_count() - d) // 2 for d, m in zip(table[a][1:], simhash.masks())] == inside
        for b in fps:
            assert max(abs(x - y) for x, y in zip(table[a], table[b])) <= ((a ^ b) & ((1 << 64) - 1)).bit_count()


def test_components_of_a_path(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    nodes = spark.createDataFrame([(k, -k) for k in range(41)] + [(100, 7), (101, 5), (200, 9)], "fp long, rank long")
    got = {r.fp: r.component for r in components(path, nodes).collect()}
    assert got == {**{k: -40 for k in range(41)}, 100: 5, 101: 5, 200: 9}


def test_keep_one_of_each_group_of_linked_texts(spark):
    """Null ids and an id repeated over unlinked texts are no links: one of every group stays."""
    rng = np.random.default_rng(6)
    a, b, c, d, e = (" ".join(f"w{k}" for k in rng.integers(0, 10 ** 6, 30)) for _ in range(5))
    assert all((simhash_of(x) ^ simhash_of(y)).bit_count() > 2 for x in (a, b, c, d, e) for y in (a, b, c, d, e) if x != y)
    found = [(None, a), (None, b), (None, b.upper()), (7, c), (7, d), (9, d), (8, e), (None, e)]
    got = [(r.doc_id, r.text.lower()) for r in simhash.keep_one(spark, corpus.frame(spark, found), "").collect()]
    assert corpus.ordered(got) == corpus.ordered([(None, a), (None, b), (7, c), (7, d), (8, e)])


def test_word_windows(spark):
    found = corpus.rows()
    want = [(i, len(own), int(gone.sum()), " ".join(w.decode() for w, g in zip(own, gone) if not g))
            for (i, _), (own, gone) in zip(found, corpus.repeated_units(found, lambda t: t.encode().split(), 13))]
    got = [tuple(r) for r in substring_dedup.substring_dedup(corpus.frame(spark, found)).collect()]
    assert corpus.ordered(got) == corpus.ordered(want)


@pytest.mark.parametrize("hot", [suffix_repeats.HOT, 0])
def test_byte_strings(spark, hot):
    found = corpus.rows()
    want = []
    for (i, _), (own, gone) in zip(found, corpus.repeated_units(found, str.encode, 50)):
        runs = int(np.count_nonzero(np.diff(np.r_[0, gone.astype(np.int8)]) == 1))
        want.append((i, len(own), int(gone.sum()), runs, np.frombuffer(own, np.uint8)[~gone].tobytes()))
    kept = suffix_repeats.suffix_dedup(corpus.frame(spark, found), hot=hot)
    got = [(*r[:4], bytes(r[4])) for r in kept.collect()]
    assert corpus.ordered(got) == corpus.ordered(want)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=14).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=8))
def test_suffix_array_and_maximal_repeats(pieces):
    data = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum([len(p) for p in pieces])
    end = np.repeat(ends, [len(p) for p in pieces])
    start = np.arange(len(data))
    order, shared = suffix_repeats.suffix_array(data, start, end)
    suffixes = [data[s:e].tobytes() for s, e in zip(start, end)]
    assert [suffixes[i] for i in order] == sorted(suffixes)
    for k in range(1, len(order)):
        a, b = suffixes[order[k - 1]], suffixes[order[k]]
        assert shared[k] == next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    before = np.array([int(data[s - 1]) if s and s not in ends else -1 - s for s in start])[order]
    got = {}
    for first, last, length in suffix_repeats.maximal_repeats(shared, before, 2):
        for f, l, n in zip(first, last, length):
            got[suffixes[order[f]][:n]] = sorted(order[f:l + 1].tolist())
    want = {}
    for size in range(2, 15):
        places = {}
        for s in range(len(data)):
            if len(suffixes[s]) >= size:
                places.setdefault(suffixes[s][:size], []).append(s)
        for string, at in places.items():
            left = {int(data[s - 1]) if s and s not in ends else -1 - s for s in at}
            right = {suffixes[s][size] if len(suffixes[s]) > size else ("end", s) for s in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                want[string] = at
    assert got == want


@pytest.mark.parametrize("run", [
    exact_dedup.exact_dedup, simhash.near_duplicates, substring_dedup.substring_dedup, suffix_repeats.suffix_dedup])
def test_empty_tables_and_tables_of_nulls(spark, run):
    assert run(corpus.frame(spark, [])).count() == 0
    assert run(corpus.frame(spark, [(None, None), (None, None), (1, None)])).count() == 3


def test_only_windows_with_an_equal_in_another_piece_are_sorted(monkeypatch):
    """Equal pieces are one, and windows that occur once need no place in the suffix array; the spans stay whole."""
    rng = np.random.default_rng(5)
    letters = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes()
    shared, copied = letters(70), letters(60)
    pieces = [copied] * 200 + [letters(80) for _ in range(100)] + [letters(20) + shared + b"x", shared + letters(30)]
    rank = np.r_[rng.permutation(200), 300 + np.arange(100), 7, 8]
    windows = np.array([len(p) - suffix_repeats.WINDOW + 1 for p in pieces])
    sizes, sort = [], suffix_repeats.suffix_array
    monkeypatch.setattr(suffix_repeats, "suffix_array", lambda data, start, end: sizes.append(len(start)) or sort(data, start, end))
    data = np.frombuffer(b"".join(pieces), np.uint8)
    found = suffix_repeats.repeat_spans(data, np.cumsum([len(p) for p in pieces]), windows, rank)
    marked = {(p, at) for p, off, n in zip(*(x.tolist() for x in found)) for at in range(off, off + n)}
    places: dict[bytes, list] = {}
    for p, text in enumerate(pieces):
        for at in range(windows[p]):
            places.setdefault(text[at:at + suffix_repeats.WINDOW], []).append((p, at))
    assert marked == {x for own in places.values() for x in own if rank[x[0]] > min(rank[p] for p, _ in own)}
    assert sum(sizes) < windows.sum() // 4


def test_gram_runs_do_not_depend_on_segments(monkeypatch):
    """Runs of windows with one smallest gram against the smallest of each window, over segment and text ends."""
    rng = np.random.default_rng(6)
    found = [rng.integers(97, 99, n).astype(np.uint8).tobytes() for n in (0, 49, 50, 51, 400, 0, 75, 1000, 3)]
    data, offsets = np.frombuffer(b"".join(found), np.uint8), np.r_[0, np.cumsum([len(t) for t in found])]
    least = []
    grams = common.span_hashes(data, at := np.arange(len(data) - suffix_repeats.GRAM + 1), at + suffix_repeats.GRAM, 31) >> np.uint64(24)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        for first in range(a, b - suffix_repeats.WINDOW + 1):
            own = grams[first:first + suffix_repeats.WINDOW - suffix_repeats.GRAM + 1]
            least.append((first, first + int(own.argmin())))
    for segment in (1 << 15, 97):
        monkeypatch.setattr(suffix_repeats, "SEGMENT", segment)
        first, count, place, _ = suffix_repeats.smallest_grams(data, offsets)
        assert [(a + k, p) for a, n, p in zip(first.tolist(), count.tolist(), place.tolist()) for k in range(n)] == least
        assert len(set(place.tolist())) == len(place)
