"""Linear support vector machines trained on the driver over bounded samples."""

from __future__ import annotations

import numpy as np


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = 30, seed: int = 7) -> np.ndarray:
    """Weights, the last one the bias, of a squared-hinge SVM (dual coordinate descent); ``y`` is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    diagonal = 1 / (2 * cost)
    norms = (x * x).sum(1) + diagonal
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(x)):
            gradient = y[i] * (w @ x[i]) - 1 + diagonal * alpha[i]
            new = max(alpha[i] - gradient / norms[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def newton_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, steps: int = 50) -> np.ndarray:
    """As ``linear_svm``, by Newton steps on the primal: for few features, exact."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    active = np.ones(len(x), dtype=bool)
    for _ in range(steps):
        inside = x[active]
        w = np.linalg.solve(np.eye(x.shape[1]) + 2 * cost * inside.T @ inside, 2 * cost * inside.T @ y[active])
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    return w


def logistic_scale(margin: np.ndarray, positive: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of Platt's sigmoid for these weighted margins."""
    n1, n0 = weight[positive].sum(), weight[~positive].sum()
    target = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    design = np.column_stack([margin, np.ones_like(margin)])
    theta = np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (weight * (p - target)) + 1e-3 * theta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
    return float(theta[0]), float(theta[1])


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
