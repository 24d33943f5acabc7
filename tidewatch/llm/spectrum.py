"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

The inertia of ``A - s I``, read off the pivots of its LDL^T factors, is the number of eigenvalues
above ``s``.  Bisection on these counts isolates the i-th largest eigenvalue, Rayleigh quotient
iteration from the middle of its interval gives value and vector, and two more counts certify that it
is the i-th.  The matrix is small (the square of a vector's length); about d^3 operations a count.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
PIVOT = (1 + 17 ** 0.5) / 8  # Bunch-Parlett: bounds the growth of the factors


def count_above(a: np.ndarray, shift: float) -> int:
    """Eigenvalues of symmetric ``a`` above ``shift``: positive pivots of LDL^T with full pivoting."""
    m = a - shift * np.eye(len(a))
    above = 0
    while len(m):
        diagonal = np.abs(np.diag(m))
        r = int(diagonal.argmax())
        off = np.abs(m)
        np.fill_diagonal(off, 0)
        p, q = divmod(int(off.argmax()), len(m))
        if diagonal[r] >= PIVOT * off[p, q]:
            if diagonal[r] == 0:
                break
            above += m[r, r] > 0
            pivot = [r]
        else:  # an indefinite pair: one eigenvalue on either side
            above += 1
            pivot = [p, q]
        rest = np.setdiff1d(np.arange(len(m)), pivot)
        cross = m[np.ix_(rest, pivot)]
        m = m[np.ix_(rest, rest)] - cross @ np.linalg.solve(m[np.ix_(pivot, pivot)], cross.T)
        m = (m + m.T) / 2
    return above


class Slicer:
    """Counts of one matrix, each taken once."""

    def __init__(self, a: np.ndarray):
        self.a = (a + a.T) / 2
        self.scale = float(np.abs(self.a).sum(axis=1).max(initial=0.0))  # no eigenvalue is larger
        self.counts: dict[float, int] = {}

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = count_above(self.a, shift)
        return self.counts[shift]

    def isolate(self, i: int, low: float, high: float) -> tuple[float, float]:
        """A narrower part of (low, high] that still holds the i-th largest eigenvalue."""
        middle = (low + high) / 2
        return (middle, high) if self.above(middle) >= i else (low, middle)

    def eigenpair(self, i: int, found: np.ndarray) -> tuple[float, np.ndarray]:
        """The i-th largest eigenvalue and a unit vector orthogonal to the columns of ``found``."""
        low, high = -1.01 * self.scale, 1.01 * self.scale
        known = sorted(self.counts.items())
        low = max([s for s, c in known if c >= i], default=low)
        high = min([s for s, c in known if c < i], default=high)
        least = 4 * EPS * self.scale * len(self.a)
        while True:
            alone = self.above(low) - self.above(high) == 1
            narrow = high - low <= least
            if alone or narrow:
                value, vector = self.refine((low + high) / 2, found)
                # equal eigenvalues (narrow) have no vector of their own: any orthonormal ones will do;
                # an iteration that left its interval goes on from a narrower one
                if self.certified(i, value):
                    return value, vector
                if narrow:
                    raise ArithmeticError(f"no convergence to eigenvalue {i} in ({low}, {high}]")
            low, high = self.isolate(i, low, high)

    def refine(self, shift: float, found: np.ndarray, steps: int = 30) -> tuple[float, np.ndarray]:
        """Inverse iteration at ``shift``, then Rayleigh quotient iteration while the residual falls."""
        d = len(self.a)

        def clear(x):
            for _ in range(2):
                x = x - found @ (found.T @ x)
            return x / np.linalg.norm(x)

        def solve(s, x):
            for nudge in (0, 1, 64, 4096):
                try:
                    y = np.linalg.solve(self.a - (s + nudge * EPS * self.scale) * np.eye(d), x)
                except np.linalg.LinAlgError:
                    continue
                if np.isfinite(y).all() and np.abs(y).max() > 0:
                    return y / np.abs(y).max()
            return x
        x = clear(np.random.default_rng(len(found.T)).standard_normal(d))
        for _ in range(3):
            x = clear(solve(shift, x))
        best = None
        for _ in range(steps):
            value = float(x @ self.a @ x)
            residual = float(np.linalg.norm(self.a @ x - value * x))
            if best is not None and residual >= best[0]:
                break
            best = residual, value, x
            if residual <= EPS * self.scale:
                break
            x = clear(solve(value, x))
        return best[1], best[2]

    def certified(self, i: int, value: float, tolerance: float = 1e-11) -> bool:
        """Whether counts on both sides of ``value`` say that it is the i-th eigenvalue."""
        near = tolerance * self.scale
        return self.above(value + near) < i <= self.above(value - near)


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit vectors as columns."""
    d = len(a)
    k = min(k, d)
    if not d or not np.abs(a).max():
        return np.zeros(k), np.eye(d)[:, :k]
    slicer = Slicer(a)
    values, vectors = [], np.zeros((d, 0))
    for i in range(1, k + 1):
        value, vector = slicer.eigenpair(i, vectors)
        values.append(value)
        vectors = np.column_stack([vectors, vector])
    return np.array(values), vectors
