"""Small linear solves from moments: LASSO by coordinate descent, Ridge by normal equations."""

from __future__ import annotations

import numpy as np


def split(m: np.ndarray, d: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From sums of outer products of (1, z, y): n, means of z and y, their population scales, centred Gram and cross products (divided by n)."""
    n = m[0, 0]
    mu = m[0, 1:] / n
    cov = m[1:, 1:] / n - np.outer(mu, mu)
    scale = np.sqrt(np.maximum(np.diag(cov), 0))
    # What rounding leaves of a constant column counts as constant: scale 1, as the column is 0 then.
    raw = np.sqrt(np.maximum(np.diag(m)[1:] / n, 0))
    scale = np.where(scale <= 1e-9 * np.maximum(raw, 1e-300), 1.0, scale)
    return n, mu[:d], mu[d:], scale[:d], scale[d:], cov[:d, :d], cov[:d, d:]


def lasso(gram: np.ndarray, cross: np.ndarray, alpha: float, tol: float = 1e-12, most: int = 20_000) -> np.ndarray:
    """Minimises w'Gw / 2 - c'w + alpha |w|_1 for each column c of cross."""
    out = np.zeros_like(cross)
    diag = np.diag(gram).copy()
    live = np.flatnonzero(diag > 0)
    for t in range(cross.shape[1]):
        w, rest = out[:, t], cross[:, t].copy()
        for _ in range(most):
            moved = 0.0
            for j in live:
                rho = rest[j] + diag[j] * w[j]
                new = np.sign(rho) * max(abs(rho) - alpha, 0.0) / diag[j]
                if new != w[j]:
                    step = new - w[j]
                    rest -= gram[:, j] * step
                    moved = max(moved, abs(step))
                    w[j] = new
            if moved <= tol:
                break
    return out


def ridge(gram: np.ndarray, cross: np.ndarray, alpha: float, n: float) -> np.ndarray:
    """Minimises |y - Xw|^2 + alpha |w|^2, gram and cross divided by n."""
    return np.linalg.solve(gram + alpha / n * np.eye(len(gram)), cross)
