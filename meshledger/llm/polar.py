"""Eigenvectors of a symmetric matrix by spectral divide and conquer over polar decompositions.

The polar factor U of A - s I has the eigenvalue 1 where A has one above s, and -1 below, so
(U + I) / 2 projects on the upper invariant subspace. Bases of it and of its complement cut A into two
smaller matrices, and so on down to single eigenvalues. U comes from the QR-based dynamically weighted
Halley iteration (Nakatsukasa and Higham, 2013). Matrices here are d x d for vectors of d entries.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The symmetric orthogonal polar factor of a symmetric matrix without zero eigenvalues."""
    n = len(a)
    x = a / np.linalg.norm(a)
    # a lower bound of the least singular value; too low a guess costs a few steps, not precision
    try:
        low = max(1.0 / np.linalg.norm(np.linalg.inv(x)), EPS) * 0.9
    except np.linalg.LinAlgError:
        low = EPS * 0.9
    for _ in range(60):
        d = np.cbrt(4 * (1 - low**2) / low**4) if low < 1 else 0.0
        root = np.sqrt(1 + d)
        wa = root + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low**2) / (low**2 * root)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
            after = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:n] @ q[n:].T
        else:
            after = wb / wc * x + (wa - wb / wc) * np.linalg.solve(np.eye(n) + wc * x.T @ x, x.T).T
        after = (after + after.T) / 2
        low = min(1.0, low * (wa + wb * low**2) / (1 + wc * low**2))
        moved = np.linalg.norm(after - x)
        x = after
        if moved <= np.cbrt(EPS) * 1e-1 and 1 - low <= 10 * EPS:
            break
    return x


def _split(a: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first k columns span an invariant subspace of ``a``, and k."""
    n, diagonal = len(a), np.diag(a)
    middle, spread = diagonal.mean(), np.linalg.norm(a - diagonal.mean() * np.eye(n))
    # the mean lies strictly between the extreme eigenvalues; it is moved if it hits one
    for shift in (0.0, 0.05, -0.05, 0.15, -0.15, 0.3, -0.3):
        moved = a - (middle + shift * spread / n) * np.eye(n)
        u = polar_factor(moved)
        k = int(round((np.trace(u) + n) / 2))
        if np.linalg.norm(u @ u - np.eye(n)) > 1e-8 * n or not 0 < k < n:
            continue
        projector = (u + np.eye(n)) / 2
        basis = np.linalg.qr(projector @ rng.standard_normal((n, k)))[0]
        q = np.linalg.qr(projector @ basis, mode="complete")[0]
        if np.linalg.norm(q[:, k:].T @ a @ q[:, :k]) <= 1e3 * EPS * max(np.linalg.norm(a), spread):
            return q, k
    return None


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns; the largest entry of each is positive."""
    if not np.isfinite(a).all():
        raise ArithmeticError("the matrix holds values that are not finite")
    n = len(a)
    scale, rng = np.linalg.norm(a), np.random.default_rng(1)
    values, vectors, open_ = [], [], [(np.eye(n), (a + a.T) / 2)] if n else []
    while open_:
        basis, part = open_.pop()
        k = len(part)
        rest = np.linalg.norm(part - np.diag(np.diag(part)))
        cut = None if k == 1 or rest <= EPS * scale else _split(part, rng)
        if cut is None and k > 1 and rest > 1e3 * EPS * k * scale:
            raise ArithmeticError("no shift splits the matrix")
        if cut is None:
            values.append(np.diag(part))
            vectors.append(basis)
            continue
        q, size = cut
        for columns in (q[:, size:], q[:, :size]):
            inner = columns.T @ part @ columns
            open_.append((basis @ columns, (inner + inner.T) / 2))
    if not n:
        return np.zeros(0), np.zeros((0, 0))
    # columns of all parts together are orthonormal up to rounding, which one more step halves away
    v = np.hstack(vectors)
    v = v @ (1.5 * np.eye(n) - 0.5 * v.T @ v)
    e = np.einsum("ij,ij->j", v, a @ v)
    order = np.argsort(-e, kind="stable")
    v = v[:, order]
    return e[order], v * np.where(v[np.abs(v).argmax(axis=0), np.arange(n)] < 0, -1.0, 1.0)
