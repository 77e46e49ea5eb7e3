"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

A factorisation V - s I = L D Lᵀ with blocks of one or two rows has, by Sylvester's law of inertia, as
many positive eigenvalues of D as V has eigenvalues above s. Counting at shifts isolates the i-th
largest eigenvalue in an interval of its own; Rayleigh quotient iteration from there converges
cubically, and two counts just below and above the result certify its number. Eigenvalues too close to
be parted in double precision form a cluster, whose vectors are made orthogonal to one another.
"""

from __future__ import annotations

import numpy as np

_ALPHA = (1 + 17**0.5) / 8


def count_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix are above ``shift``: the positive part of its LDLᵀ inertia.

    Bunch-Parlett pivoting: the largest entry decides between a pivot of one and of two rows.
    """
    a = matrix - shift * np.eye(len(matrix))
    positive = 0
    while len(a):
        diagonal = np.abs(np.diag(a))
        r = int(diagonal.argmax())
        off = np.abs(a)
        np.fill_diagonal(off, 0.0)
        i, j = divmod(int(off.argmax()), len(a)) if len(a) > 1 else (0, 0)
        if diagonal[r] == 0 and off[i, j] == 0:
            return positive  # what is left is zero
        if diagonal[r] >= _ALPHA * off[i, j]:
            pivot, rest = [r], np.delete(np.arange(len(a)), r)
            positive += a[r, r] > 0
        else:
            pivot, rest = [i, j], np.delete(np.arange(len(a)), [i, j])
            positive += 1  # its determinant is negative: one eigenvalue of each sign
        block, below = a[np.ix_(pivot, pivot)], a[np.ix_(rest, pivot)]
        a = a[np.ix_(rest, rest)] - below @ np.linalg.solve(block, below.T)
        a = (a + a.T) / 2
    return int(positive)


def _bounds(matrix: np.ndarray) -> tuple[float, float]:
    """Gershgorin: every eigenvalue lies between these."""
    radius = np.abs(matrix).sum(axis=1) - np.abs(np.diag(matrix))
    return float((np.diag(matrix) - radius).min()), float((np.diag(matrix) + radius).max())


def _refined(matrix: np.ndarray, low: float, high: float, found: list[np.ndarray], rng: np.random.Generator) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration from the middle of the interval, orthogonal to the vectors found."""
    eye = np.eye(len(matrix))
    basis = np.array(found) if found else np.zeros((0, len(matrix)))
    v, shift = rng.standard_normal(len(matrix)), (low + high) / 2
    scale = max(abs(low), abs(high), np.abs(matrix).max(), np.finfo(float).tiny)
    settled = False
    for step in range(60):
        v = v - basis.T @ (basis @ v)
        v /= np.linalg.norm(v)
        if step > 1:  # two steps of inverse iteration first
            value = float(v @ matrix @ v)
            if low <= value <= high:
                shift = value
            residual = np.linalg.norm(matrix @ v - value * v)
            if settled:
                break
            settled = residual <= 1e-14 * scale * len(matrix) ** 0.5  # one more step, then it is there
        try:
            v = np.linalg.solve(matrix - shift * eye, v)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue
            v = np.linalg.solve(matrix - (shift + 1e-15 * scale) * eye, v)
        v /= np.abs(v).max()
    v = v - basis.T @ (basis @ v)
    v /= np.linalg.norm(v)
    return float(v @ matrix @ v), v


def leading(matrix: np.ndarray, most: int, least_share: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as rows) of a positive semidefinite matrix, largest first.

    At most ``most``, and none that is not above ``least_share`` of the trace: what is left there is
    rounding. Raises ArithmeticError if the counts do not confirm a number.
    """
    d = len(matrix)
    trace = float(np.trace(matrix)) if d else 0.0
    if not trace > 0:
        return np.zeros(0), np.zeros((0, d))
    matrix = np.asarray(matrix, dtype=float)
    floor = least_share * trace
    bottom, top = _bounds(matrix)
    known = {min(bottom, 0.0) - floor: d, top + floor: 0}  # shift -> eigenvalues above it
    number = min(most, count_above(matrix, floor))
    known[floor] = count_above(matrix, floor)
    rng = np.random.default_rng(12)
    values: list[float] = []
    vectors: list[np.ndarray] = []
    tight = 4 * np.finfo(float).eps * max(abs(top), trace)
    for i in range(1, number + 1):
        while True:
            low = max(s for s, n in known.items() if n >= i)
            high = min(s for s, n in known.items() if n < i)
            alone = known[low] == i and known[high] == i - 1
            # a narrow interval makes the iteration start next to the one eigenvalue in it
            if (alone and high - low <= 1e-3 * max(abs(high), floor)) or high - low <= tight:
                break
            middle = (low + high) / 2
            known[middle] = count_above(matrix, middle)
        value, vector = _refined(matrix, low, high, vectors, rng)
        slack = max(high - low, tight) if not alone else tight * 64
        if not (low - slack <= value <= high + slack and count_above(matrix, value - slack) >= i > count_above(matrix, value + slack)):
            raise ArithmeticError(f"eigenvalue {i} is not where its count puts it")
        values.append(value)
        vectors.append(vector)
    order = np.argsort([-v for v in values], kind="stable")
    return np.array(values)[order], np.array(vectors)[order].reshape(-1, d)
