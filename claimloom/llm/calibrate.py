"""Logistic calibration of scores (Platt), fitted by Newton steps on held-out labelled samples."""

from __future__ import annotations

import numpy as np


class Logistic:
    """P(label 1) from features, which are standardised first. Features beyond those of the samples count as the outermost of them."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-2):
        self.mean, self.scale, self.low, self.high = x.mean(0), x.std(0) + 1e-9, x.min(0), x.max(0)
        z = self._design(x)
        self.weight = np.zeros(z.shape[1])
        for _ in range(60):
            p = self._link(z)
            gradient = z.T @ (p - y) + ridge * self.weight
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(self.weight)), gradient)
            self.weight -= step
            if np.abs(step).max() < 1e-9:
                break

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.c_[(np.clip(x, self.low, self.high) - self.mean) / self.scale, np.ones(len(x))]

    def _link(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z @ self.weight, -40, 40)))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._link(self._design(x))
