"""Whitening and hard negatives against numpy and plain loops."""

import math

import numpy as np
import pytest

from meshledger.llm import hard_negatives, polar, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, id string, x string, label_ string, windows string, score string, rank string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, c, *["z"] * 7) for i, v, c in rows], SCHEMA).repartition(3)


def table(seed=1, n=600, d=6):
    """Clusters, a vector that a third of the rows hold, repeated rows, ties, and everything that takes no part."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, d))
    rows = [(int(i), [float(t) for t in centres[rng.integers(9)] + 0.2 * rng.normal(size=d)], int(rng.integers(5))) for i in range(n)]
    hot = rows[3][1]
    rows += [(n + k, hot, k % 3) for k in range(n // 2)] + rows[:5] + [rows[100]] + [(200, rows[7][1], 1), (None, rows[8][1], 2), (-100, rows[9][1], 0)]
    bad = float("nan"), float("inf"), -float("inf"), None
    return rows + [(5000, None, 1), (5001, hot, None), (5002, [], 1), (5003, hot[:2], 1)] + [(5100 + k, [*hot[:-1], b], 1) for k, b in enumerate(bad)]


def usable(v, d=6):
    return v is not None and len(v) == d and all(t is not None and math.isfinite(t) for t in v)


def test_eigenvectors():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 17, 64):
        q = np.linalg.qr(rng.standard_normal((n, n)))[0]
        for values in (rng.random(n) + 1, 10.0 ** -rng.integers(0, 12, n), np.full(n, 3.0), np.r_[np.zeros(n // 2), rng.random(n - n // 2)], -rng.random(n), np.zeros(n)):
            a = (q * values) @ q.T
            a = (a + a.T) / 2
            e, v = polar.eigen(a)
            scale = np.abs(values).max() or 1.0
            assert np.abs(e - np.sort(values)[::-1]).max() < 1e-13 * scale
            assert np.abs(v.T @ v - np.eye(n)).max() < 1e-13 and np.abs(a @ v - v * e).max() < 1e-13 * scale
    with pytest.raises(ArithmeticError):
        polar.eigen(np.full((3, 3), np.nan))


@pytest.mark.parametrize("d", [6, 40])
def test_whitening_by_eigh(spark, d):
    rows = table(d=d)
    live = [(i, tuple(math.floor(64 * t) + 1_000_000 for t in np.array(v, np.float32).astype(float))) for i, v, _ in rows if usable(v, d)]
    fit = np.array(sorted({x for _, x in live}))
    n, s = len(fit), fit.sum(axis=0)
    y = fit - s / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    got = whitening.whiten(frame(spark, rows)).collect()
    k = min(16, d)
    assert len(got) == len(live) * k and {r.n for r in got} == {n} and {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    signs = {}
    by_row = {}
    for r in got:
        by_row.setdefault((r.id, r.deviation), []).append(r)
        assert abs(r.explained - e[r.component - 1] / e.sum()) < 1e-10
    for i, x in live:
        dev = sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s))
        own = by_row[i, dev]
        for c in range(k):
            want = (np.array(x) - s / n) @ v[:, c] / math.sqrt(e[c])
            near = [r.whitened for r in own if r.component == c + 1]
            if abs(want) > 1e-3:
                sign = signs.setdefault(c, 1 if abs(near[0] - want) < abs(near[0] + want) else -1)
                assert all(abs(w - sign * want) < 1e-7 for w in near)


def test_whitening_of_little(spark):
    empty = frame(spark, table()).limit(0)
    assert whitening.whiten(empty).count() == 0
    assert whitening.whiten(frame(spark, [(1, None, 1), (2, [float("nan")], 1)])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)])).count() == 0  # no variance
    line = whitening.whiten(frame(spark, [(k, [float(k), 1.0, -float(k)], 1) for k in range(5)])).collect()
    assert {r.component for r in line} == {1} and len(line) == 5 and abs(line[0].explained - 1) < 1e-12
    far = whitening.whiten(frame(spark, [(1, [0.0, 0.0], 1), (2, [3e7, 0.0], 1), (3, [3e7, 1.0], 1)])).collect()
    assert {r.id for r in far if r.deviation is None} == {1}  # (3 * 0 - 2 * 64 * 3e7) ** 2 does not fit a long


def brute(rows, d=6):
    live = sorted({(i, (c + 1) % 10 if i % 7 == 0 else c, tuple(math.floor(256 * t) for t in np.array(v, np.float32).astype(float)))
                   for i, v, c in rows if usable(v, d) and c is not None and i is not None})
    out = []
    for a in live:
        if a[0] % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(a[2], r[2])), r[0], r[1]) for r in live if r != a)
        for p in [t for t in scored if t[2] == a[1]][:5]:
            fits = [t for t in scored if t[2] != a[1] and -80 * p[0] <= -100 * t[0] <= -100 * p[0]][:5]
            out += [(a[0], p[1], k + 1, t[1], -p[0], -t[0]) for k, t in enumerate(fits)]
    return out


@pytest.mark.parametrize("shard_rows, sample", [(100_000, 20_000), (150, 20_000), (90, 40)])
def test_negatives_by_brute_force(spark, shard_rows, sample):
    rows = table()
    got = [tuple(r) for r in hard_negatives.mine(frame(spark, rows), shard_rows=shard_rows, sample=sample).collect()]
    assert sorted(got) == sorted(brute(rows)) and len(got) > 50


def test_negatives_of_little(spark):
    assert hard_negatives.mine(frame(spark, table()).limit(0)).count() == 0
    assert hard_negatives.mine(frame(spark, [(0, [1.0], 1)])).count() == 0
    rows = [(0, [1.0], 1), (1, [0.5], 1), (2, [0.5], 2), (3, [0.45], 2), (4, [0.3], 2), (5, [-1.0], 1)]
    assert [tuple(r) for r in hard_negatives.mine(frame(spark, rows)).collect()] == brute(rows, 1)


def test_cells_come_by_falling_bound_and_all():
    rng = np.random.default_rng(2)
    x = rng.integers(-300, 300, (3000, 8))
    books = hard_negatives.fit_codebook(x[:, :4].astype(float), 12), hard_negatives.fit_codebook(x[:, 4:].astype(float), 12)
    shard = hard_negatives.Shard(np.arange(3000), np.zeros(3000, int), x, books)
    q = x[5].astype(float)
    cells = list(shard.cells(q))
    assert sum(z - a for *_, a, z in cells) == 3000
    assert all(a[0] >= b[0] for a, b in zip(cells, cells[1:]))
    for upper, lower, a, z in cells:
        score = shard.x[a:z] @ q
        assert lower <= score.min() and score.max() <= upper
    # the best row is found long before the last cell
    visited = [c for c in cells if c[0] >= (x @ x[5]).max()]
    assert len(visited) < len(cells) / 2
