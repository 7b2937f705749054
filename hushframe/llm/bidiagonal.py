"""Singular values and right vectors of a small square matrix: Householder bidiagonal form, dqds, twisted factorisations."""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)
#: Eigenvalues nearer than this, in proportion, have their vectors made orthogonal to one another.
NEAR = 1e-5


def block_qr(r: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """The triangular factor of ``r`` with ``rows`` below it, at most square."""
    return np.linalg.qr(rows if r is None else np.vstack([r, rows]), mode="r")


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal ``a``, superdiagonal ``b`` and orthogonal ``v`` with ``matrix = u @ B @ v.T``."""
    m = np.array(matrix, float)
    n = m.shape[1]
    v = np.eye(n)
    for k in range(n):
        h = _reflector(m[k:, k])
        if h is not None:
            m[k:, k:] -= 2 * np.outer(h, h @ m[k:, k:])
        if k < n - 2:
            h = _reflector(m[k, k + 1 :])
            if h is not None:
                m[k:, k + 1 :] -= 2 * np.outer(m[k:, k + 1 :] @ h, h)
                v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ h, h)
    return np.diagonal(m).copy(), np.diagonal(m, 1).copy(), v


def _reflector(x: np.ndarray) -> np.ndarray | None:
    """The unit vector whose reflection takes ``x`` to a multiple of the first axis."""
    size = np.linalg.norm(x)
    if not size:
        return None
    h = x / size
    h[0] += 1.0 if h[0] >= 0 else -1.0
    return h / np.linalg.norm(h)


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the bidiagonal (a, b), falling: quotient-difference sweeps with shifts.

    A shift is the reciprocal of the trace of the inverse, which never passes the smallest value left; where rounding
    makes a sweep fail all the same it is repeated with less.
    """
    found: list[float] = []
    parts = [((a * a).tolist(), (b * b).tolist(), 0.0)]
    while parts:
        q, e, shift = parts.pop()
        if e and 1.5 * q[0] < q[-1]:
            q.reverse()
            e.reverse()
        while e:
            cut = next((k for k in range(len(e) - 1, -1, -1) if e[k] <= (4 * EPS) ** 2 * (shift + min(q[k], q[k + 1])) or e[k] < 1e-300), None)
            if cut is not None:
                parts.append((q[: cut + 1], e[:cut], shift))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            s, made = _bound(q, e), None
            while made is None:
                made = _sweep(q, e, s)
                s_used, s = s, s / 4 if s > 1e-8 * q[-1] else 0.0
            q, e = made
            shift += s_used
        found.append(q[0] + shift)
    return np.sort(np.array(found))[::-1]


def _bound(q: list[float], e: list[float]) -> float:
    """One over the trace of the inverse, from the terms of a sweep without shift."""
    d = q[0]
    total = 0.0
    for k in range(len(e)):
        if d <= 0:
            return 0.0
        total += 1 / d
        d *= q[k + 1] / (d + e[k])
    return 1 / (total + 1 / d) if d > 0 else 0.0


def _sweep(q: list[float], e: list[float], s: float) -> tuple[list[float], list[float]] | None:
    """The arrays of the matrix less the shift, or nothing if the shift is too large."""
    d, new_q, new_e = q[0] - s, [], []
    for k in range(len(e)):
        if d < 0:
            return None
        top = d + e[k]
        ratio = q[k + 1] / top
        new_q.append(top)
        new_e.append(e[k] * ratio)
        d = d * ratio - s
    if d < 0:
        return None
    return [*new_q, d], new_e


def twisted(a: np.ndarray, b: np.ndarray, value: float, others: list[np.ndarray]) -> np.ndarray:
    """The unit vector of ``B.T @ B`` for ``value``, from the twisted factorisation with the smallest middle term.

    ``others`` are vectors of values too near to this one to be told apart by it: the result is orthogonal to them.
    """
    n = len(a)
    tiny = EPS * max(value, 1e-290)
    d, l, low, up = a * a, b / a[:-1], np.zeros(n), np.zeros(n)
    s, p = np.zeros(n), np.zeros(n)
    s[0] = -value
    for k in range(n - 1):
        top = d[k] + s[k]
        low[k] = d[k] * l[k] / (top if top else tiny)
        s[k + 1] = low[k] * l[k] * s[k] - value
    p[-1] = d[-1] - value
    for k in range(n - 2, -1, -1):
        below = d[k] * l[k] ** 2 + p[k + 1]
        t = d[k] / (below if below else tiny)
        up[k] = l[k] * t
        p[k] = p[k + 1] * t - value
    middle = np.abs(s + p + value)
    middle[~np.isfinite(middle)] = np.inf
    best = None
    for at in np.argsort(middle, kind="stable")[: 1 + len(others) * 4]:
        z = np.zeros(n)
        z[at] = 1.0
        for k in range(at - 1, -1, -1):
            z[k] = -low[k] * z[k + 1]
        for k in range(at, n - 1):
            z[k + 1] = -up[k] * z[k]
        z = _unit(z)
        rest = _apart(z, others)
        if best is None or np.linalg.norm(rest) > 1.5 * np.linalg.norm(best):
            best = rest
        if np.linalg.norm(best) > 0.3:
            break
    return _unit(_apart(_unit(best), others))


def _unit(z: np.ndarray) -> np.ndarray:
    z = np.nan_to_num(z, posinf=1e150, neginf=-1e150)
    return z / (np.linalg.norm(z / (np.abs(z).max() or 1.0)) * (np.abs(z).max() or 1.0))


def _apart(z: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for o in others:
            z = z - (o @ z) * o
    return z


def decompose(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest squares of singular values, falling, and their right vectors as columns."""
    scale = np.abs(matrix).max(initial=0)
    if not scale:
        return np.zeros(0), np.zeros((matrix.shape[1], 0))
    a, b, v = bidiagonal(matrix / scale)
    size = max(np.abs(a).max(), np.abs(b).max(initial=0))
    a[np.abs(a) < EPS * EPS * size] = EPS * EPS * size
    found = []
    edges = [0, *(np.flatnonzero(np.abs(b) <= EPS * np.minimum(np.abs(a[:-1]), np.abs(a[1:]))) + 1).tolist(), len(a)]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        found += [(value, lo, hi) for value in dqds(a[lo:hi], b[lo : hi - 1]).tolist()]
    found = sorted(found, key=lambda f: -f[0])[:most]
    made: list[tuple[float, int, np.ndarray]] = []
    for value, lo, hi in found:
        # Vectors of other parts of the matrix are orthogonal by where they are not zero.
        near = [z[lo:hi] for other, part, z in made if part == lo and other - value <= NEAR * other]
        z = np.zeros(len(a))
        z[lo:hi] = twisted(a[lo:hi], b[lo : hi - 1], value, near)
        made.append((value, lo, z))
    return np.array([f[0] for f in found]) * scale**2, v @ np.array([z for _, _, z in made]).T
