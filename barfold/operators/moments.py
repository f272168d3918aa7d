"""Mergeable second moments of samples, and ridge regression read off them.

A record of samples holds their number, their mean and the products of their
deviations from it. Two records merge exactly as if their samples had been
together, whatever the distance of their means, so records of stretches of a
series add up to those of any window that is made of stretches.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np


@dataclass
class Moments:
    """``n`` samples: ``mean (d)`` and ``dev (d, d)``, or ``dev (d)`` of the diagonal alone."""

    n: float
    mean: np.ndarray
    dev: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray, *, diagonal: bool = False) -> Moments:
        n, d = values.shape
        if not n:
            return cls(0.0, np.zeros(d), np.zeros(d) if diagonal else np.zeros((d, d)))
        mean = values.mean(axis=0)
        off = values - mean
        return cls(float(n), mean, (off * off).sum(axis=0) if diagonal else off.T @ off)

    def _between(self, other: Moments) -> np.ndarray:
        step = other.mean - self.mean
        return step * step if self.dev.ndim == 1 else np.outer(step, step)

    def plus(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return other if not self.n else self
        n = self.n + other.n
        mean = self.mean + (other.mean - self.mean) * (other.n / n)
        return Moments(n, mean, self.dev + other.dev + self._between(other) * (self.n * other.n / n))

    def minus(self, part: Moments) -> Moments:
        """The samples of this record without those of a record that is part of it.

        Exact but for rounding, which grows with the share of deviations taken away.
        """
        n = self.n - part.n
        if not part.n:
            return self
        if n <= 0:
            return Moments(0.0, np.zeros_like(self.mean), np.zeros_like(self.dev))
        mean = self.mean + (self.mean - part.mean) * (part.n / n)
        rest = Moments(n, mean, self.dev)
        return Moments(n, mean, self.dev - part.dev - rest._between(part) * (n * part.n / self.n))


@dataclass
class Ridge:
    """Ridge regression of targets on inputs, out of joint moments of ``(inputs, targets)``.

    The Gram matrix is decomposed once; every penalty is then a rescaling of its
    eigenvalues. Moments and scales may be stacks, of one fit each along the first axis.
    """

    x_mean: np.ndarray
    y_mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    turned: np.ndarray

    @classmethod
    def of(cls, joint: Moments, inputs: int, x_scale: np.ndarray, y_scale: np.ndarray) -> Ridge:
        gram, cross = _scaled(joint, inputs, x_scale, y_scale)
        return cls.decomposed(gram, cross, joint.mean[..., :inputs] / x_scale, joint.mean[..., inputs:] / y_scale)

    @classmethod
    def decomposed(cls, gram, cross, x_mean, y_mean) -> Ridge:
        values, vectors = np.linalg.eigh(gram)
        return cls(x_mean, y_mean, np.maximum(values, 0.0), vectors, vectors.swapaxes(-1, -2) @ cross)

    def rescaled(self, alpha: float) -> np.ndarray:
        """Weights in the frame of the eigenvectors."""
        total = self.values + alpha
        most = np.maximum(total.max(axis=-1, initial=0.0, keepdims=True), np.finfo(float).tiny)
        usable = total > np.finfo(float).eps * total.shape[-1] * most
        inverse = np.divide(1.0, total, out=np.zeros_like(total), where=usable)
        return inverse[..., None] * self.turned

    def weights(self, alpha: float) -> np.ndarray:
        """Least squares with the penalty ``alpha``; of many solutions the smallest."""
        return self.vectors @ self.rescaled(alpha)

    def predict(self, x: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return self.y_mean + ((x - self.x_mean)[..., None, :] @ weights)[..., 0, :]


def _scaled(joint: Moments, inputs: int, x_scale: np.ndarray, y_scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products of inputs with inputs and with targets, in scaled units."""
    rows = joint.dev[..., :inputs, :] / x_scale[..., :, None]
    return rows[..., :inputs] / x_scale[..., None, :], rows[..., inputs:] / y_scale[..., None, :]


def mean_squared_error(ridge: Ridge, weights: np.ndarray, joint: Moments, inputs: int, x_scale: np.ndarray, y_scale: np.ndarray) -> np.ndarray:
    """Of predictions on the samples of a record, over samples and targets, in scaled units; of stacks one each."""
    sxx, sxy = _scaled(joint, inputs, x_scale, y_scale)
    syy = np.diagonal(joint.dev, axis1=-2, axis2=-1)[..., inputs:] / (y_scale * y_scale)
    spread = syy + (weights * (sxx @ weights - 2 * sxy)).sum(axis=-2)
    off = joint.mean[..., inputs:] / y_scale - ridge.predict(joint.mean[..., :inputs] / x_scale, weights)
    return np.mean(np.maximum(spread, 0.0) / np.asarray(joint.n)[..., None] + off * off, axis=-1)


def ridge_losses(x: np.ndarray, y: np.ndarray, x_val: np.ndarray, y_val: np.ndarray, alphas: Sequence[float]) -> list[float]:
    """Mean squared validation error of each penalty, from one decomposition of the training samples."""
    x_mean, y_mean = x.mean(axis=0), y.mean(axis=0)
    ridge = Ridge.decomposed((x - x_mean).T @ (x - x_mean), (x - x_mean).T @ (y - y_mean), x_mean, y_mean)
    # In the turned frame an input is met once, whatever the number of penalties.
    seen = (x_val - x_mean) @ ridge.vectors
    return [float(np.mean((y_mean + seen @ ridge.rescaled(a) - y_val) ** 2)) for a in alphas]
