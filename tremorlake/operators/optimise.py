"""A descent with bounds whose values, slopes and curvatures come from Spark: one plan evaluates the trial points of all
starts."""

from __future__ import annotations

from collections.abc import Callable, Generator

import numpy as np

#: Value, slopes, and an estimate of the curvatures (such as the information matrix of a likelihood) at a point.
Found = tuple[float, np.ndarray, np.ndarray]
#: Least fall of the value that counts, relative to it, and largest step in any coordinate.
TOLERANCE, LONGEST = 1e-8, 1.5


def _descent(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> Generator[np.ndarray, Found, None]:
    """Asks for what is known at one point after another: scoring steps on the coordinates that are free to move, halted
    at the bounds, each shortened until the value falls. A step that fell well short is damped more the next time."""
    value, slope, curve = yield x
    damping = 1e-3
    while np.isfinite(value):
        free = ~((x <= low) & (slope > 0) | (x >= high) & (slope < 0))
        if not free.any():
            return
        part = curve[np.ix_(free, free)]
        scale = np.maximum(np.diag(part), 1e-9 * max(1.0, np.diag(curve).max()))
        step = np.zeros(len(x))
        step[free] = -np.linalg.solve(part + damping * np.diag(scale), slope[free])
        step *= min(1.0, LONGEST / max(np.abs(step).max(), 1e-300))
        y = np.clip(x + step, low, high)
        expected = -(slope @ (y - x))
        if expected < TOLERANCE * max(1.0, abs(value)):
            return
        found = yield y
        if np.isfinite(found[0]) and found[0] <= value - 1e-4 * expected:
            fell = value - found[0]
            damping = max(1e-6, damping / 5) if fell > 0.4 * expected else min(1e3, damping * 2)
            x, (value, slope, curve) = y, found
            if fell < TOLERANCE * max(1.0, abs(value)):
                return
        else:
            damping *= 10
            if damping > 1e8:
                return


def minimised(values: Callable[[list[np.ndarray]], list[Found]], starts: list[np.ndarray], low: np.ndarray, high: np.ndarray, passes: int) -> tuple[list[tuple[float, np.ndarray]], int]:
    """The lowest value and its point of each start, and how many times ``values`` was asked, ``passes`` at most."""
    runs = [_descent(np.clip(x, low, high), low, high) for x in starts]
    asked = {k: next(run) for k, run in enumerate(runs)}
    best: list[tuple[float, np.ndarray]] = [(np.inf, x) for x in starts]
    done = 0
    while asked and done < passes:
        done += 1
        for (k, x), found in zip(list(asked.items()), values(list(asked.values())), strict=True):
            if found[0] < best[k][0]:
                best[k] = (found[0], x)
            try:
                asked[k] = runs[k].send(found)
            except StopIteration:
                del asked[k]
    return best, done
