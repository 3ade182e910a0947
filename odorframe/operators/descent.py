"""Minimisation by sums over rows: each call takes the value and gradient at the point it asked for.

Limited-memory quasi-Newton steps with backtracking; with an absolute penalty the steps stay in one
orthant and follow the pseudo-gradient. The state is a plain dictionary, so one evaluation may be a
loop turn in a task or a Spark job over all blocks of all runs: the steps are the same.
"""

from __future__ import annotations

import numpy as np

# Pairs of steps remembered, share of the promised decrease, halvings of a step.
MEMORY = 10
DECREASE = 1e-4
LEAST_STEP = 1e-18


def start(x: np.ndarray) -> dict:
    return {"x": x, "trial": x, "f": None, "g": None, "steps": [], "turns": [], "iterations": 0, "size": 1.0, "done": False}


def pseudo_gradient(x: np.ndarray, g: np.ndarray, l1: np.ndarray) -> np.ndarray:
    """The steepest descent's opposite of f + l1 * |x|; plainly g where l1 is 0."""
    right, left = g + l1, g - l1
    at_zero = np.where(right < 0, right, np.where(left > 0, left, 0.0))
    return np.where(x > 0, right, np.where(x < 0, left, at_zero))


def _direction(s: dict, pg: np.ndarray) -> np.ndarray:
    q, back = -pg, []
    for step, turn in zip(reversed(s["steps"]), reversed(s["turns"])):
        a = step @ q / (step @ turn)
        back.append(a)
        q = q - a * turn
    if s["steps"]:
        q = q * (s["steps"][-1] @ s["turns"][-1]) / (s["turns"][-1] @ s["turns"][-1])
    for step, turn, a in zip(s["steps"], s["turns"], reversed(back)):
        q = q + (a - turn @ q / (step @ turn)) * step
    return q


def advance(s: dict, f: float, g: np.ndarray, l1: np.ndarray, tolerance: float, max_iter: int) -> dict:
    """The state after f and g at ``s["trial"]`` are known; ``trial`` is the next point unless ``done``."""
    trial = s["trial"]
    f = f + float(l1 @ np.abs(trial))
    if s["f"] is not None:
        promised = DECREASE * float(s["pg"] @ (trial - s["x"]))
        if not (np.isfinite(f) and f <= s["f"] + promised):
            return _try(s, s["size"] / 2, l1)
        step, turn = trial - s["x"], g - s["g"]
        steps, turns = s["steps"], s["turns"]
        if step @ turn > 1e-12 * float(turn @ turn):
            steps, turns = [*steps, step][-MEMORY:], [*turns, turn][-MEMORY:]
        s = {**s, "steps": steps, "turns": turns, "iterations": s["iterations"] + 1, "flat": s["f"] - f <= 1e-14 * max(1.0, abs(f))}
    elif not np.isfinite(f):
        raise ValueError("the loss is not a number")
    pg = pseudo_gradient(trial, g, l1)
    s = {**s, "x": trial, "f": f, "g": g, "pg": pg}
    if np.abs(pg).max(initial=0.0) <= tolerance or s["iterations"] >= max_iter or s.get("flat"):
        return {**s, "done": True}
    d = _direction(s, pg)
    d = np.where((l1 > 0) & (d * pg >= 0), 0.0, d)
    if not d @ pg < 0:
        s, d = {**s, "steps": [], "turns": []}, -pg
    size = 1.0 if s["steps"] else min(1.0, 1.0 / np.abs(pg).sum())
    return _try({**s, "d": d}, size, l1)


def _try(s: dict, size: float, l1: np.ndarray) -> dict:
    if size < LEAST_STEP:
        return {**s, "trial": s["x"], "done": True}
    x = s["x"]
    orthant = np.where(x != 0, np.sign(x), -np.sign(s["pg"]))
    trial = x + size * s["d"]
    return {**s, "size": size, "trial": np.where((l1 > 0) & (trial * orthant < 0), 0.0, trial)}
