"""Recurrent sequence classifier: one tanh layer, the last state's class scores, Adam on mini-batches.

A step needs the gradient summed over the rows of one batch, so it is a sum over rows like any other
fit. The batch of a row in an epoch is drawn by key: batches hold ``batch_size`` rows on average, and
are the same wherever the rows lie. As one step follows another, an epoch over several blocks is a
sort of its rows by batch and one pass over them, a window of batches at a time.
"""

from __future__ import annotations

import numpy as np

from odorframe.operators.forest import keyed, uniform

# Decay of Adam's two averages and its guard against division by zero.
MOMENT, SQUARE, GUARD = 0.9, 0.999, 1e-8
SEED = 42


def _shapes(s: dict) -> list[tuple[int, ...]]:
    h, c, k = s["hidden"], s["channels"], s["classes"]
    return [(h, c), (h, h), (h,), (k, h), (k,)]


def _parts(s: dict, flat: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for shape in _shapes(s):
        size = int(np.prod(shape))
        out.append(flat[at : at + size].reshape(shape))
        at += size
    return out


def begin(params: dict, facts: dict) -> dict:
    channels = int(params.get("channels") or 1)
    if facts["dim"] % channels:
        raise ValueError("a row's length is no multiple of its channels")
    s = {
        "classes": facts["classes"], "channels": channels, "hidden": int(params.get("hidden_size") or 64), "epochs": int(params.get("epochs") or 10),
        "rate": float(params.get("lr") or 0.001), "batches": max(1, -(-facts["n"] // int(params.get("batch_size") or 32))),
        "epoch": 0, "batch": 0, "steps": 0, "iterations": 0, "done": False,
    }
    size = sum(int(np.prod(shape)) for shape in _shapes(s))
    bound = 1.0 / np.sqrt(s["hidden"])
    w = (2 * uniform(keyed(np.arange(size), SEED)) - 1) * bound
    return {**s, "w": w, "moment": np.zeros(size), "square": np.zeros(size), "done": s["epochs"] < 1}


def _steps(s: dict, x: np.ndarray) -> np.ndarray:
    """Rows as (time, row, channel): a row lists its channels one after the other."""
    return x.reshape(len(x), s["channels"], -1).transpose(2, 0, 1)


def _states(s: dict, x: np.ndarray) -> list[np.ndarray]:
    wx, wh, b, _, _ = _parts(s, s["w"])
    states = [np.zeros((x.shape[1], s["hidden"]))]
    for step in x:
        states.append(np.tanh(step @ wx.T + states[-1] @ wh.T + b))
    return states


def loss_gradient(s: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Log loss and its gradient, summed over the rows."""
    _, wh, _, wo, bo = _parts(s, s["w"])
    steps = _steps(s, x)
    states = _states(s, steps)
    m = states[-1] @ wo.T + bo
    m = m - m.max(axis=1, keepdims=True)
    e = np.exp(m)
    p = e / e.sum(axis=1, keepdims=True)
    rows = np.arange(len(y))
    loss = float(-np.log(np.maximum(p[rows, y], 1e-300)).sum())
    p[rows, y] -= 1
    gx, gh, gb = (np.zeros(shape) for shape in _shapes(s)[:3])
    back = p @ wo
    for t in range(len(steps) - 1, -1, -1):
        d = back * (1 - states[t + 1] ** 2)
        gx += d.T @ steps[t]
        gh += d.T @ states[t]
        gb += d.sum(axis=0)
        back = d @ wh
    return loss, np.concatenate([g.ravel() for g in (gx, gh, gb, p.T @ states[-1], p.sum(axis=0))])


def batch_of(s: dict, keys: np.ndarray) -> np.ndarray:
    """The batch of each row in the present epoch."""
    return (uniform(keyed(keys, s["epoch"] + 1)) * s["batches"]).astype(np.int64)


def partial(s: dict, x: np.ndarray, y: np.ndarray, keys: np.ndarray) -> list[np.ndarray]:
    """The batch's rows and gradient, as far as they are among these rows."""
    mine = batch_of(s, keys) == s["batch"]
    if not mine.any():
        return [np.zeros(1), np.zeros(len(s["w"]))]
    return [np.array([float(mine.sum())]), loss_gradient(s, x[mine], y[mine])[1]]


def advance(s: dict, parts: list[list[np.ndarray]]) -> dict:
    count = sum(float(p[0][0]) for p in parts)
    s = {**s, "iterations": s["iterations"] + 1}
    if count:
        g = np.sum([p[1] for p in parts], axis=0) / count
        t = s["steps"] + 1
        moment = MOMENT * s["moment"] + (1 - MOMENT) * g
        square = SQUARE * s["square"] + (1 - SQUARE) * g * g
        step = moment / (1 - MOMENT**t) / (np.sqrt(square / (1 - SQUARE**t)) + GUARD)
        s = {**s, "steps": t, "moment": moment, "square": square, "w": s["w"] - s["rate"] * step}
    batch = s["batch"] + 1
    if batch < s["batches"]:
        return {**s, "batch": batch}
    return {**s, "batch": 0, "epoch": s["epoch"] + 1, "done": s["epoch"] + 1 >= s["epochs"]}


def take(s: dict, of: np.ndarray, x: np.ndarray, y: np.ndarray) -> dict:
    """The steps of some batches of an epoch, all rows of which are given, and of empty ones before them."""
    order = np.argsort(of, kind="stable")
    of, x, y = of[order], x[order], y[order]
    start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else []
    for a, b in zip(start, [*start[1:], len(of)]):
        while s["batch"] < of[a]:
            s = advance(s, [])
        s = advance(s, [[np.array([float(b - a)]), loss_gradient(s, x[a:b], y[a:b])[1]]])
    return s


def end(s: dict, epoch: int) -> dict:
    """The state once the epoch is over: empty batches at its end are steps too."""
    while s["epoch"] == epoch and not s["done"]:
        s = advance(s, [])
    return s


def model(s: dict) -> dict:
    return {name: s[name] for name in ("classes", "channels", "hidden", "w")}


def decide(m: dict, x: np.ndarray) -> np.ndarray:
    _, _, _, wo, bo = _parts(m, m["w"])
    return np.argmax(_states(m, _steps(m, x))[-1] @ wo.T + bo, axis=1)
