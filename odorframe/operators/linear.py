"""Linear classifiers as sums over rows: logistic regression and support vector machines.

Rows are blocks (X, y); coefficients are one row per class, the intercept last. Everything that
depends on the rows is a sum over them, so blocks may lie anywhere. All objectives are divided by
C * n: the mean loss plus a penalty of strength 1 / (C * n).

- logistic: log loss of all classes at once, of one coefficient row for two classes; the intercept
  is not penalised; squared penalty or none.
- svc: one class against the rest, hinge or squared hinge; the intercept is penalised like the
  rest. The hinge has no gradient at its corner, so it is rounded off there in stages, each starting
  from the last one's result; the gap between its value and that of the dual problem tells how far
  from the optimum the result can be at most.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from odorframe.operators import descent

TOLERANCE = 1e-6
# Widths of the rounded corner of the hinge, from coarse to fine.
CORNERS = (1.0, 0.1, 0.01, 1e-3, 1e-4)


@dataclass(frozen=True)
class Setting:
    """One objective: which loss and penalty, how strong, over how many rows."""

    loss: str
    penalty: str | None
    c: float
    max_iter: int

    @classmethod
    def of(cls, model: str, params: dict[str, str | None]) -> Setting:
        penalty = params["penalty"] if "penalty" in params else "l2"
        loss = "logistic" if model == "LogisticRegression" else params.get("loss") or "squared_hinge"
        if (loss, penalty) not in (("logistic", "l2"), ("logistic", None), ("hinge", "l2"), ("squared_hinge", "l2"), ("squared_hinge", "l1")):
            raise ValueError(f"no fit for loss {loss} with penalty {penalty}")
        c = float(params.get("C") or 1.0)
        if not c > 0:
            raise ValueError("C must be positive")
        return cls(loss, penalty, c, int(params.get("max_iter") or (100 if loss == "logistic" else 1000)))

    @property
    def stages(self) -> int:
        return len(CORNERS) if self.loss == "hinge" else 1


def rows_of_weights(setting: Setting, classes: int) -> int:
    return 1 if setting.loss == "logistic" and classes == 2 else classes


def sums(setting: Setting, stage: int, w: np.ndarray, x: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """([loss, loss without rounding, weights of rows in the dual], gradient) added up over the rows."""
    w = w.reshape(rows_of_weights(setting, classes), -1)
    m = x @ w[:, :-1].T + w[:, -1]
    if setting.loss == "logistic":
        if classes == 2:
            m = np.concatenate([np.zeros_like(m), m], axis=1)
        top = m.max(axis=1, keepdims=True)
        e = np.exp(m - top)
        total = e.sum(axis=1, keepdims=True)
        loss = float((np.log(total[:, 0]) + top[:, 0] - m[np.arange(len(y)), y]).sum())
        back = e / total
        back[np.arange(len(y)), y] -= 1
        back = back[:, 1:] if classes == 2 else back
        told = np.array([loss, loss, 0.0])
    else:
        sign = np.where(y[:, None] == np.arange(classes), 1.0, -1.0)
        z = np.maximum(1 - sign * m, 0.0)
        if setting.loss == "squared_hinge":
            loss, back = float((z * z).sum()), -2 * sign * z
            told = np.array([loss, loss, 0.0])
        else:
            width = CORNERS[stage]
            inside = np.minimum(z / width, 1.0)
            loss = float(np.where(z < width, z * z / (2 * width), z - width / 2).sum())
            back = -sign * inside
            told = np.array([loss, float(z.sum()), float(inside.sum())])
    grad = np.concatenate([back.T @ x, back.sum(axis=0)[:, None]], axis=1)
    return told, grad.ravel()


def _penalties(setting: Setting, n: int, classes: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared, absolute) penalty by coefficient."""
    strength = np.full((rows_of_weights(setting, classes), size // rows_of_weights(setting, classes)), 1.0 / (setting.c * n))
    if setting.loss == "logistic":
        strength[:, -1] = 0.0
    none = np.zeros(size)
    return (strength.ravel(), none) if setting.penalty == "l2" else (none, strength.ravel() if setting.penalty == "l1" else none)


def begin(setting: Setting, dim: int, classes: int) -> dict:
    return {**descent.start(np.zeros(rows_of_weights(setting, classes) * (dim + 1))), "stage": 0, "spent": 0}


def advance(setting: Setting, s: dict, told: np.ndarray, grad: np.ndarray, n: int, classes: int, tolerance: float = TOLERANCE) -> dict:
    """The fit's state once the sums over all rows at ``s["trial"]`` are known."""
    trial = s["trial"]
    l2, l1 = _penalties(setting, n, classes, len(trial))
    value = l2 @ (trial * trial) / 2
    s = descent.advance(s, told[0] / n + float(value), grad / n + l2 * trial, l1, tolerance, setting.max_iter)
    if setting.loss == "hinge" and s["x"] is trial:
        # Value and dual of the hinge itself, per row: they meet at the optimum.
        s["gap"] = float(told[1] / n + value - told[2] / n + (grad @ grad) * setting.c / (2 * n))
    if s["done"] and s["stage"] + 1 < setting.stages:
        s = {**descent.start(s["x"]), "stage": s["stage"] + 1, "spent": s["spent"] + s["iterations"], "gap": s["gap"]}
    return s


def optimality(setting: Setting, s: dict) -> float:
    """Largest entry of the (pseudo-)gradient; for the hinge the duality gap per row."""
    return s["gap"] if setting.loss == "hinge" else float(np.abs(s["pg"]).max(initial=0.0))


def coefficients(setting: Setting, s: dict, classes: int) -> np.ndarray:
    """One row per class; of two classes in a logistic fit the first has zeros."""
    w = s["x"].reshape(rows_of_weights(setting, classes), -1)
    return np.concatenate([np.zeros_like(w), w]) if len(w) < classes else w


def decide(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The class of the largest margin, ties to the first."""
    return np.argmax(x @ weights[:, :-1].T + weights[:, -1], axis=1)
