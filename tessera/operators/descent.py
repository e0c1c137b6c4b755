"""Logistic regression over matrix blocks: gradient descents, averaged descent, and Newton steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.blocks import Block, Blocks, pack

#: The prime and the multiplier of the hash that draws a round's sample.
PRIME, FACTOR = 2_147_483_647, 69_621


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _sampled(key: np.ndarray, k: int, fraction: float) -> np.ndarray:
    """Rows of round k: those whose key, times the round's multiplier modulo a prime, is among the lowest share."""
    return key % PRIME * (1 + k * FACTOR % (PRIME - 1)) % PRIME < fraction * PRIME


def _gradient(blocks: list[Block], w: np.ndarray, k: int, fraction: float | None) -> np.ndarray:
    """Summed gradient (intercept last) and number of rows."""
    out = np.zeros(len(w) + 1)
    for x, y, key in blocks:
        if fraction is not None:
            some = _sampled(key, k, fraction)
            x, y = x[some], y[some]
        e = sigmoid(x @ w[:-1] + w[-1]) - y
        out += [*(e @ x), e.sum(), len(y)]
    return out


def _own_steps(blocks: list[Block], w: np.ndarray, rate: float, steps: int, size: int = 64) -> np.ndarray:
    """Weights after ``steps`` passes of mini-batches over a task's blocks, times its rows, and the rows."""
    w, n = w.copy(), sum(len(y) for _, y, _ in blocks)
    for _ in range(steps):
        for x, y, _ in blocks:
            for lo in range(0, len(y), size):
                part, e = x[lo : lo + size], sigmoid(x[lo : lo + size] @ w[:-1] + w[-1]) - y[lo : lo + size]
                w[:-1] -= rate / len(e) * (e @ part)
                w[-1] -= rate / len(e) * e.sum()
    return np.append(w * n, n)


def descend(
    df: DataFrame, columns: list[str], method: str = "batch", rate: float = 0.05, rounds: int = 150, label: str = "label", fraction: float = 0.01, key: Column | None = None,
    exchange: int = 10,
) -> np.ndarray:
    """Logistic regression weights (intercept last).

    batch: mean gradient; summed: summed gradient; steepest: a step of unit length; stochastic: the mean over a
    sample of about ``fraction`` of the rows, drawn anew each round by a hash of ``key`` and the round; averaged:
    each task passes over its own blocks by mini-batches, and after every ``exchange`` passes weights are averaged
    by the tasks' rows, all in one barrier stage. A round whose sample is empty takes no step. Rows are packed once.
    """
    if method not in ("batch", "summed", "steepest", "stochastic", "averaged"):
        raise ValueError(f"unknown method {method!r}")
    packed = pack(df, F.array(*[F.col(c) for c in columns]), F.col(label), key)
    try:
        return descend_blocks(packed, method, rate, rounds, fraction, exchange)
    finally:
        packed.discard()


def descend_blocks(packed: Blocks, method: str, rate: float, rounds: int, fraction: float = 0.01, exchange: int = 10, tasks: int | None = None) -> np.ndarray:
    """``descend`` over rows that are packed already."""
    start = np.zeros(packed.width + 1)
    if method == "averaged":
        passes = lambda k: min(exchange, rounds - k * exchange)
        return packed.in_one_stage(lambda blocks, w, k: _own_steps(blocks, w, rate, passes(k)), lambda total, w, k: total[:-1] / total[-1], start, -(-rounds // exchange), tasks)
    share = fraction if method == "stochastic" else None

    def step(total: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
        g, n = total[:-1], total[-1]
        if n == 0:
            return w
        if method == "steepest":
            g = g / max(float(np.linalg.norm(g)), 1e-12)
        elif method != "summed":
            g = g / n
        return w - rate * g

    return packed.iterate(lambda blocks, w, k: _gradient(blocks, w, k, share), step, start, rounds)


def newton(packed: Blocks, ridge: float = 0.0, most_rounds: int = 30, tolerance: float = 1e-9) -> np.ndarray:
    """Logistic regression weights (intercept last) by Newton steps: normal equations weighted by each row's p (1 - p).

    The loss is the mean one plus ``ridge`` / 2 times the squared weights (without the intercept). A step that
    raises the loss is halved; rounds end when no part of the mean gradient is above ``tolerance``. Where
    classes can be separated, weights grow until the loss is below ``tolerance`` or rounds are over.
    """
    m = packed.width + 1

    def part(blocks: list[Block], state: np.ndarray, k: int) -> np.ndarray:
        w = state[:m]
        loss, g, h, n = 0.0, np.zeros(m), np.zeros((m, m)), 0
        for x, y, _ in blocks:
            x = np.column_stack([x, np.ones(len(y))])
            z = x @ w
            p = sigmoid(z)
            loss += float((np.logaddexp(0, z) - y * z).sum())
            g += (p - y) @ x
            h += (x * (p * (1 - p))[:, None]).T @ x
            n += len(y)
        return np.concatenate([[loss, n], g, h.ravel()])

    # state: weights, the last step, the loss before it
    def step(total: np.ndarray, state: np.ndarray, k: int) -> np.ndarray | None:
        w, last, before = state[:m], state[m : 2 * m], state[-1]
        n, keep = total[1], np.append(np.ones(m - 1), 0.0)
        loss = total[0] / n + ridge / 2 * float((keep * w * w).sum())
        if loss > before + 1e-12:
            return np.concatenate([w - last / 2, last / 2, [before]])
        g = total[2 : 2 + m] / n + ridge * keep * w
        if np.abs(g).max() <= tolerance or loss <= tolerance:
            return None
        h = total[2 + m :].reshape(m, m) / n + np.diag(ridge * keep)
        move = -np.linalg.lstsq(h + 1e-12 * np.trace(h) / m * np.eye(m), g, rcond=None)[0]
        return np.concatenate([w + move, move, [loss]])

    return packed.iterate(part, step, np.concatenate([np.zeros(2 * m), [np.inf]]), most_rounds)[:m]
