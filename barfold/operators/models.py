"""The forecaster protocol and two closed-form forecasters.

A forecaster is a small Python object shipped to the tasks that fit it. Any
class with these methods works, a wrapped neural network included.
"""

from __future__ import annotations

import copy
from collections.abc import Sequence

import numpy as np

TABULAR, SEQUENCE = "tabular", "sequence"


class Forecaster:
    """Base class; ``data_format`` says what ``fit`` and ``predict`` receive.

    tabular: ``X (n, features)``, ``Y (n, horizon)``; predicts ``(n, horizon)``.
    sequence: ``X (n, lookback, features)``, ``Y (n, horizon, labels)``;
    predicts ``(n, horizon, labels)``.
    """

    data_format = TABULAR
    input_columns: tuple[str, ...] = ()

    def fit(self, X: np.ndarray, Y: np.ndarray) -> None:
        raise NotImplementedError

    def predict(self, X: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def reset(self) -> Forecaster:
        """An unfitted copy with the same parameters."""
        return type(self)(**self.get_params())

    def get_params(self) -> dict:
        return {}

    def tuned(self, params: dict) -> Forecaster:
        """An unfitted copy with some parameters changed."""
        fresh = self.reset()
        return fresh.set_params(**params) if params else fresh

    def set_params(self, **params) -> Forecaster:
        """Set known parameters; unknown names are ignored."""
        for name, value in params.items():
            if hasattr(self, name):
                setattr(self, name, value)
        return self


def solve_ridge(X: np.ndarray, Y: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercept of least squares with an L2 penalty on the weights."""
    x_mean, y_mean = X.mean(axis=0), Y.mean(axis=0)
    Xc, Yc = X - x_mean, Y - y_mean
    gram = Xc.T @ Xc
    gram[np.diag_indices_from(gram)] += alpha
    try:
        weights = np.linalg.solve(gram, Xc.T @ Yc)
    except np.linalg.LinAlgError:
        weights = np.linalg.lstsq(gram, Xc.T @ Yc, rcond=None)[0]
    return weights, y_mean - x_mean @ weights


class RidgeDMS(Forecaster):
    """Ridge regression of all steps at once on the feature vector."""

    data_format = TABULAR

    def __init__(self, alpha: float = 1.0, input_columns: Sequence[str] = ()):
        self.alpha, self.input_columns = float(alpha), tuple(input_columns)

    def fit(self, X, Y):
        self.weights, self.intercept = solve_ridge(X, Y, self.alpha)

    def predict(self, X):
        return X @ self.weights + self.intercept

    def get_params(self):
        return {"alpha": self.alpha, "input_columns": self.input_columns}


class RidgeSequence(Forecaster):
    """Linear map of a whole look-back window to all steps, by ridge regression."""

    data_format = SEQUENCE

    def __init__(self, alpha: float = 1.0, input_columns: Sequence[str] = ()):
        self.alpha, self.input_columns = float(alpha), tuple(input_columns)

    def fit(self, X, Y):
        self.shape = Y.shape[1:]
        flat_x, flat_y = X.reshape(len(X), -1), Y.reshape(len(Y), -1)
        self.weights, self.intercept = solve_ridge(flat_x, flat_y, self.alpha)

    def predict(self, X):
        flat = X.reshape(len(X), -1) @ self.weights + self.intercept
        return flat.reshape(len(X), *self.shape)

    def get_params(self):
        return {"alpha": self.alpha, "input_columns": self.input_columns}


class EstimatorForecaster(Forecaster):
    """Any object with ``fit(X, y)`` and ``predict(X)``: one copy per step.

    A classifier (an object with ``predict_proba``, or ``classifier=True``)
    predicts the probability of its second class when it has two, all
    probabilities otherwise, and plain predictions without ``predict_proba``.
    """

    data_format = TABULAR

    def __init__(self, estimator, input_columns: Sequence[str] = (), classifier: bool | None = None):
        self.estimator, self.input_columns = estimator, tuple(input_columns)
        self.classifier = hasattr(estimator, "predict_proba") if classifier is None else classifier
        self.fitted: list = []

    def fit(self, X, Y):
        columns = [Y] if Y.ndim == 1 else [Y[:, j] for j in range(Y.shape[1])]
        self.fitted = []
        for y in columns:
            one = copy.deepcopy(self.estimator)
            one.fit(X, y)
            self.fitted.append(one)

    def _one(self, estimator, X):
        if not self.classifier or not hasattr(estimator, "predict_proba"):
            return np.asarray(estimator.predict(X))
        probs = np.asarray(estimator.predict_proba(X))
        return probs[:, 1] if probs.shape[1] == 2 else probs

    def predict(self, X):
        outs = [self._one(e, X) for e in self.fitted]
        return outs[0] if len(outs) == 1 else np.stack(outs, axis=1)

    def reset(self):
        return EstimatorForecaster(
            copy.deepcopy(self.estimator), self.input_columns, self.classifier
        )

    def get_params(self):
        return self.estimator.get_params() if hasattr(self.estimator, "get_params") else {}

    def set_params(self, **params):
        self.estimator.set_params(**params)
        return self
