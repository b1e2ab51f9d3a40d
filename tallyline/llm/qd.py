"""Singular values and right singular vectors of a small square matrix, by qd methods.

Householder reflections from both sides bring the matrix to upper bidiagonal form B
(diagonal a, superdiagonal b). The dqds iteration on the squares q = a^2, e = b^2 finds
all singular values of B to high relative accuracy, as it only adds, multiplies and
divides positive numbers, but for the shifts. With B'B = L D L', the factorisations
of L D L' - x from the top (stationary qd) and from the bottom (progressive qd) meet
at the place where their twist g is smallest; the vector they give there solves
(B'B - x) z = g e_k, and x + g / |z|^2 is a better eigenvalue. Where the superdiagonal
is zero to rounding, B falls apart into blocks whose vectors are solved apart: equal
eigenvalues then come from different blocks. Vectors of eigenvalues of one block that
lie close together are made orthogonal to each other.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: Eigenvalues nearer to each other than this share have their vectors orthogonalised.
CLOSE = 1e-3


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(v, r): (I - 2 v v') x = r e_1 with |v| = 1, or v = 0 where x is r e_1 already."""
    rest = np.abs(x[1:]).max(initial=0.0)
    if rest == 0.0:
        return np.zeros_like(x), float(x[0])
    scale = max(abs(x[0]), rest)
    v = x / scale
    size = float(np.sqrt(v @ v))
    r = -size if v[0] >= 0 else size
    v[0] -= r
    return v / np.sqrt(v @ v), r * scale


def bidiagonalise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, v): the bidiagonal form B of a square matrix = U B v', v orthogonal."""
    m = np.array(matrix, dtype=float)
    d = len(m)
    a, b, v = np.zeros(d), np.zeros(max(0, d - 1)), np.eye(d)
    for i in range(d):
        left, a[i] = _reflector(m[i:, i].copy())
        m[i:, i:] -= 2 * np.outer(left, left @ m[i:, i:])
        if i + 1 < d:
            right, b[i] = _reflector(m[i, i + 1:].copy())
            m[i:, i + 1:] -= 2 * np.outer(m[i:, i + 1:] @ right, right)
            v[:, i + 1:] -= 2 * np.outer(v[:, i + 1:] @ right, right)
    return a, b, v


def _qd_step(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float]:
    """One dqds step: the qd array of B'B - shift, and its smallest d (below 0: shift too large)."""
    n = len(q)
    q2, e2 = np.empty(n), np.empty(n - 1)
    d = least = q[0] - shift
    for i in range(n - 1):
        q2[i] = d + e[i]
        if d < 0 or q2[i] <= 0:
            return q2, e2, -1.0
        t = q[i + 1] / q2[i]
        e2[i] = e[i] * t
        d = d * t - shift
        least = min(least, d)
    q2[n - 1] = d
    return q2, e2, least


def qd_values(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Squared singular values of the bidiagonal matrix with squared diagonal ``q``
    and squared superdiagonal ``e``, falling."""
    found: list[float] = []
    todo = [(np.array(q, dtype=float), np.array(e, dtype=float), 0.0)]
    while todo:
        q, e, total = todo.pop()
        least = None
        while True:
            n = len(q)
            if n <= 1:
                found += [x + total for x in q]
                break
            # a coupling that moves no value beyond rounding parts the array
            weak = np.flatnonzero(e <= (EPS * EPS) * (total + np.minimum(q[:-1], q[1:])))
            zero = np.flatnonzero(q[:-1] == 0.0)
            if len(weak):
                cut = int(weak[-1]) + 1
                todo.append((q[:cut], e[:cut - 1], total))
                q, e, least = q[cut:], e[cut:], None
                continue
            if 1.5 * q[0] < q[-1] and least is None:
                q, e = q[::-1].copy(), e[::-1].copy()  # the small end goes last
            if len(zero) or q[-1] == 0.0 or least is None:
                shift = 0.0
            else:
                # the last d bounds the smallest value from above; most of it is a safe guess
                shift = max(0.0, min(least, q[-1] * (1 - min(1.0, 2 * np.sqrt(e[-1] / q[-1])))) * 0.98)
                shift = max(shift, 0.25 * least) if n > 2 else shift
            for attempt in range(4):
                if attempt == 3:
                    shift = 0.0
                q2, e2, small = _qd_step(q, e, shift)
                if small >= 0.0 or shift == 0.0:
                    break
                shift *= 0.25
            q, e, total, least = np.maximum(q2, 0.0), e2, total + shift, max(small, 0.0)
    return np.sort(np.maximum(found, 0.0))[::-1]


def _twisted(d: np.ndarray, low: np.ndarray, x: float, tiny: float):
    """Both factorisations of L D L' - x: (g at every place, lower factors, upper factors)."""
    n = len(d)
    down, up, s, p = np.zeros(n - 1), np.zeros(n - 1), np.empty(n), np.empty(n)
    s[0] = -x
    for i in range(n - 1):
        pivot = s[i] + d[i]
        pivot = pivot if abs(pivot) > tiny else tiny
        down[i] = d[i] * low[i] / pivot
        s[i + 1] = down[i] * low[i] * s[i] - x
    p[n - 1] = d[n - 1] - x
    for i in range(n - 2, -1, -1):
        pivot = d[i] * low[i] ** 2 + p[i + 1]
        pivot = pivot if abs(pivot) > tiny else tiny
        t = d[i] / pivot
        up[i] = low[i] * t
        p[i] = p[i + 1] * t - x
    return s + p + x, down, up


def _solve(down: np.ndarray, up: np.ndarray, k: int) -> np.ndarray:
    """The unit vector that the factorisations twisted at ``k`` give."""
    n = len(down) + 1
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -up[i] * z[i]
    top = np.abs(z).max()
    z /= top if np.isfinite(top) and top > 0 else 1.0
    return z / np.sqrt(z @ z)


def twisted_vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of B'B for its eigenvalues ``values`` (falling);
    no entry of ``b`` is zero."""
    n = len(a)
    size = max(float(np.abs(a).max()), float(np.abs(b).max(initial=0.0))) or 1.0
    a = np.where(np.abs(a) > EPS * size, a, EPS * size)  # L needs pivots; moves B by rounding only
    d, low, tiny = a * a, b / a[:-1], EPS * EPS * size * size
    vectors, refined = np.zeros((n, len(values))), np.array(values, dtype=float)
    for j, x in enumerate(values):
        near = [i for i in range(j) if abs(refined[i] - x) <= CLOSE * max(x, tiny)]
        basis = vectors[:, near]
        for _ in range(4):
            g, down, up = _twisted(d, low, x, tiny)
            k = int(np.argmin(np.abs(g)))
            z = _solve(down, up, k)
            step = g[k] * z[k] ** 2
            if near or abs(step) <= EPS * abs(x) or abs(step) > CLOSE * abs(x):
                break
            x += step
        if near:
            best = 0.0
            for k in np.argsort(np.abs(g), kind="stable").tolist():
                new = _solve(down, up, k)
                new = new - basis @ (basis.T @ new)
                rest = float(np.sqrt(new @ new))
                if rest > best:
                    best, z = rest, new
                if rest > 0.1:
                    break
            z = z - basis @ (basis.T @ z)
            z /= np.sqrt(z @ z)
        vectors[:, j], refined[j] = z, x
    return refined, vectors


def bidiagonal_vectors(a: np.ndarray, b: np.ndarray, count: int | None = None):
    """(all eigenvalues of B'B, the first ``count`` refined, their vectors as columns), falling."""
    n = len(a)
    size = max(float(np.abs(a).max(initial=0.0)), float(np.abs(b).max(initial=0.0)))
    cuts = [0, *(np.flatnonzero(np.abs(b) <= 2 * EPS * size) + 1).tolist(), n]
    blocks = [slice(i, j) for i, j in zip(cuts, cuts[1:])]
    own = [qd_values(a[at] ** 2, b[at.start:at.stop - 1] ** 2) for at in blocks]
    block_of = np.repeat(np.arange(len(blocks)), [len(x) for x in own])
    values = np.concatenate(own)
    order = np.argsort(-values, kind="stable")
    first = order[:count]
    refined, vectors = np.zeros(len(first)), np.zeros((n, len(first)))
    for i, at in enumerate(blocks):
        place = np.flatnonzero(block_of[first] == i)
        if len(place):
            refined[place], vectors[at, place] = twisted_vectors(
                a[at], b[at.start:at.stop - 1], values[first[place]])
    return values[order], refined, vectors


def right_singular(matrix: np.ndarray, count: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all squared singular values, the first ``count`` refined, their right vectors as columns)."""
    a, b, v = bidiagonalise(matrix)
    values, first, z = bidiagonal_vectors(a, b, count)
    return values, first, v @ z
