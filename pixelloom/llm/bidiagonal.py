"""Singular values and right singular vectors of an upper triangular matrix by way of a bidiagonal one.

Householder reflections bring R to bidiagonal form B. The values come from qd arrays (q, e), the squares of B's entries, by
differential qd steps with shifts: the sum of the reciprocals 1 / d of a step without a shift is the trace of the inverse,
so its own reciprocal is a shift that never passes the smallest value (Newton's step on the characteristic polynomial).
Vectors come from twisted factorisations of B'B - value, those of close values are kept orthogonal by inverse steps.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, superdiagonal, right reflectors) of r = U B V'; reflector k acts on the places from k + 1 on."""
    a, right = np.array(r, float), []
    n = a.shape[1]
    a = np.vstack([a, np.zeros((max(0, n - a.shape[0]), n))])[: max(n, a.shape[0])]

    def reflector(x):
        v = x.copy()
        size = np.linalg.norm(x)
        if size == 0:
            return v
        v[0] += np.copysign(size, x[0])
        return v / np.linalg.norm(v)

    for k in range(n):
        v = reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < n - 1:
            v = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
            right.append(v)
    return np.diag(a)[:n].copy(), np.diag(a, 1)[: n - 1].copy(), right


def back(right: list[np.ndarray], z: np.ndarray) -> np.ndarray:
    """V z for a vector z in B's coordinates."""
    x = z.copy()
    for k in range(len(right) - 1, -1, -1):
        x[k + 1 :] -= 2 * right[k] * (right[k] @ x[k + 1 :])
    return x


def _step(q: list[float], e: list[float], shift: float):
    """One differential step: (q, e, reciprocals' sum or None); None for all if the shift is too large."""
    d, n = q[0] - shift, len(q)
    qs, es, total = [0.0] * n, [0.0] * (n - 1), 0.0
    for i in range(n - 1):
        if d < 0:
            return None
        total += 1 / d if d > 0 else np.inf
        qs[i] = d + e[i]
        t = q[i + 1] / qs[i] if qs[i] > 0 else 0.0 if q[i + 1] == 0 else np.inf
        if t == np.inf:
            return None
        es[i] = e[i] * t
        d = d * t - shift
    if d < 0:
        return None
    qs[-1] = d
    return qs, es, total + (1 / d if d > 0 else np.inf)


def squared_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the bidiagonal matrix, falling; each to high relative accuracy."""
    top = max(np.abs(diagonal).max(initial=0), np.abs(above).max(initial=0))
    if top == 0:
        return np.zeros(len(diagonal))
    q, e = [float(x) for x in np.square(diagonal / top)], [float(x) for x in np.square(above / top)]
    found, todo = [], [(q, e, 0.0)]
    small = 16 * EPS * EPS
    while todo:
        q, e, base = todo.pop()
        while len(q) > 1:
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= small * (base + q[i + 1]) or e[i] <= small * (base + q[i]) * 1e-3), None)
            if cut is not None:
                todo.append((q[: cut + 1], e[:cut], base))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if q[0] < 0.5 * q[-1]:  # the small values belong to the end
                q, e = q[::-1], e[::-1]
            plain = _step(q, e, 0.0)
            if plain is None:  # a zero between zeros: what is left of a value there is below all rounding
                q[q.index(min(q))] = 1e-300
                continue
            shift = (1 / plain[2]) * (1 - 4 * EPS * len(q)) if np.isfinite(plain[2]) else 0.0
            after = _step(q, e, shift) if shift > 0 else plain
            if after is None:
                after, shift = plain, 0.0
            q, e, base = after[0], after[1], base + shift
        found.append(base + q[0])
    return np.sort(np.array(found))[::-1] * top * top


def _twisted(diagonal, above, value):
    """(stationary multipliers, progressive multipliers, twists) of B'B - value."""
    n = len(diagonal)
    tiny = EPS * EPS * max(value, 1e-290)
    diagonal = np.where(np.abs(diagonal) < EPS * EPS, EPS * EPS, diagonal)
    d = np.square(diagonal)
    low = diagonal
    low = above / low[:-1] if n > 1 else np.zeros(0)
    s, p, up, down = np.empty(n), np.empty(n), np.empty(max(0, n - 1)), np.empty(max(0, n - 1))
    s[0] = -value
    for i in range(n - 1):
        plus = s[i] + d[i]
        plus = plus if plus != 0 else tiny
        up[i] = d[i] * low[i] / plus
        s[i + 1] = up[i] * low[i] * s[i] - value
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        minus = d[i] * low[i] * low[i] + p[i + 1]
        minus = minus if minus != 0 else tiny
        t = d[i] / minus
        down[i] = low[i] * t
        p[i] = p[i + 1] * t - value
    return up, down, s + p + value


def _from_twist(up, down, k):
    n = len(up) + 1
    z = np.zeros(n)
    z[k] = 1
    for i in range(k - 1, -1, -1):
        z[i] = -up[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -down[i] * z[i]
    return z / np.linalg.norm(z)


def _solved(diagonal, above, value, b):
    """(B'B - value)^-1 b, up to a factor, by Gaussian elimination with row exchanges."""
    n = len(diagonal)
    main = np.square(diagonal) + np.concatenate(([0], np.square(above))) - value
    side = diagonal[:-1] * above
    rows = [[main[i], side[i] if i < n - 1 else 0.0, 0.0, b[i]] for i in range(n)]
    tiny = EPS * max(abs(value), 1e-290)
    for i in range(n - 1):
        low = [side[i], rows[i + 1][0], rows[i + 1][1], rows[i + 1][3]]
        if abs(low[0]) > abs(rows[i][0]):
            rows[i], low = low, rows[i]
        pivot = rows[i][0] if rows[i][0] != 0 else tiny
        rows[i][0] = pivot
        t = low[0] / pivot
        rows[i + 1] = [low[1] - t * rows[i][1], low[2] - t * rows[i][2], 0.0, low[3] - t * rows[i][3]]
    x = np.zeros(n + 2)
    for i in range(n - 1, -1, -1):
        pivot = rows[i][0] if rows[i][0] != 0 else tiny
        x[i] = (rows[i][3] - rows[i][1] * x[i + 1] - rows[i][2] * x[i + 2]) / pivot
        if abs(x[i]) > 1e150:
            x /= 1e150
            for row in rows[:i]:
                row[3] /= 1e150
    return x[:n] / np.linalg.norm(x[:n])


def directions(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """Unit vectors of B'B for the k largest of the values, a row each; of values that are zero to rounding any that fit."""
    found: list[np.ndarray] = []
    rng = np.random.default_rng(1)
    old = np.seterr(over="ignore", invalid="ignore")
    for i in range(min(k, len(values))):
        if values[i] <= np.square(8 * EPS * len(diagonal)) * values[0]:  # nothing but rounding: any orthonormal direction
            z = rng.standard_normal(len(diagonal))
            for _ in range(2):
                z -= sum(((f @ z) * f for f in found), np.zeros(len(z)))
                z /= np.linalg.norm(z)
            found.append(z)
            continue
        close = [found[j] for j in range(i) if values[j] - values[i] <= 1e-3 * values[0]]
        up, down, twist = _twisted(diagonal, above, values[i])
        fine = np.isfinite(twist).all() and np.isfinite(up).all() and np.isfinite(down).all()
        z = _from_twist(up, down, int(np.argmin(np.abs(twist)))) if fine else np.full(len(diagonal), np.nan)
        for _ in range(0 if np.isfinite(z).all() else 3):  # beyond a double's range: inverse steps from any vector
            z = _solved(diagonal, above, values[i], rng.standard_normal(len(diagonal)) if not np.isfinite(z).all() else z)
        if close:
            near = np.array(close)
            for _ in range(4):
                rest = z - near.T @ (near @ z)
                if np.linalg.norm(rest) < 0.1:  # the same vector again, as of values that are equal
                    rest = rng.standard_normal(len(z))
                    rest -= near.T @ (near @ rest)
                z = _solved(diagonal, above, values[i], rest / np.linalg.norm(rest))
            z -= near.T @ (near @ z)
            z /= np.linalg.norm(z)
        found.append(z)
    np.seterr(**old)
    return np.array(found).reshape(len(found), len(diagonal))


def right_vectors(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(squares of all singular values of r, falling; the right singular vectors of the k largest, a row each)."""
    size = np.abs(r).max(initial=0) or 1.0
    diagonal, above, right = bidiagonal(r / size)
    values = squared_values(diagonal, above)
    vectors = np.array([back(right, z) for z in directions(diagonal, above, values, k)]).reshape(-1, r.shape[1])
    if len(vectors):
        at = np.argmax(np.abs(vectors), axis=1)
        vectors *= np.sign(vectors[np.arange(len(vectors)), at])[:, None]
    return values * size * size, vectors
