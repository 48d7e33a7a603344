"""L-BFGS on the driver for a function whose value and gradient are one pass over the rows.

Steps, line search (strong Wolfe conditions) and end are those of MLlib's optimiser, so a fit goes the way that MLlib's goes.
"""

from collections.abc import Callable

import numpy as np

Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]
MEMORY, VALUES = 10, 20  # steps remembered; values among which the newest must still differ
TRIES = 10
ENOUGH, FLAT = 1e-4, 0.9  # Wolfe: least share of the promised fall, and of the slope that may be left


class _Failed(ArithmeticError):
    pass


def minimise(objective: Objective, start: np.ndarray, max_iter: int = 100, tol: float = 1e-6) -> np.ndarray:
    x = np.array(start, float)
    if not max_iter:
        return x
    value, slope = objective(x)
    first, seen, steps, failed, step = value, [np.inf], [], False, 0
    while step < max_iter:
        if len(seen) > 1 and abs(value - max(seen)) <= tol * first:
            break
        if np.linalg.norm(slope) <= max(tol * value, 1e-8):
            break
        try:
            way = _direction(slope, steps)
            size, new, found, new_slope = _search(objective, x, value, slope, way, 1.0 if step else 1 / np.linalg.norm(way))
            if size * np.linalg.norm(slope) < 1e-10:
                raise _Failed
        except _Failed:
            if failed:
                break
            failed, steps = True, []
            continue
        steps = [(new - x, new_slope - slope), *steps][:MEMORY]
        x, value, slope, failed, step = new, found, new_slope, False, step + 1
        seen = [*seen, value][-VALUES:]
    return x


def _direction(slope: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The slope times the inverse curvature that the newest steps tell, downwards."""
    way, shares, scale = slope.copy(), [], 1.0
    if steps:
        moved, bent = steps[0]
        scale = moved @ bent / (bent @ bent) if bent @ bent else np.nan
        if not scale >= 0:
            raise _Failed
    for moved, bent in steps:
        with np.errstate(divide="ignore", invalid="ignore"):
            share = (moved @ way) / (moved @ bent)
        if np.isnan(share):
            raise _Failed
        shares.append(share)
        way -= share * bent
    way *= scale
    for (moved, bent), share in zip(steps[::-1], shares[::-1]):
        way += (share - (bent @ way) / (moved @ bent)) * moved
    return -way


def _search(objective: Objective, x, value, slope, way, size):
    """(size, place, value, slope) of a step along ``way`` that satisfies the strong Wolfe conditions."""
    fall = slope @ way
    if not fall <= 0:
        raise _Failed

    def at(t):
        place = x + way * t
        found, there = objective(place)
        return t, found, there @ way, place, there

    def short(c):
        return c[1] > value + ENOUGH * c[0] * fall

    def done(c):
        return abs(c[2]) <= FLAT * abs(fall)

    def zoom(low, high):
        for _ in range(TRIES):
            c = at(_between(*sorted((low, high), key=lambda p: p[0])))
            if short(c) or c[1] >= low[1]:
                high = c
            elif done(c):
                return c
            else:
                if c[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        raise _Failed

    def walk():
        low, t = (0.0, value, fall), size
        for i in range(TRIES):
            c = at(t)
            if not np.isfinite(c[1]):
                t /= 2
                continue
            if short(c) or (i and c[1] >= low[1]):
                return zoom(low, c)
            if done(c):
                return c
            if c[2] >= 0:
                return zoom(c, low)
            low, t = c, t * 1.5
        raise _Failed

    t, found, _, place, there = walk()
    return t, place, found, there


def _between(left, right) -> float:
    """Where the cubic through both ends has its least value, a tenth of their distance off either end."""
    width = right[0] - left[0]
    with np.errstate(all="ignore"):
        d1 = left[2] + right[2] - 3 * (left[1] - right[1]) / (left[0] - right[0])
        d2 = np.sqrt(d1 * d1 - left[2] * right[2])
        t = right[0] - width * (right[2] + d2 - d1) / (right[2] - left[2] + 2 * d2)
    if np.isnan(t):
        raise _Failed
    return min(max(t, left[0] + 0.1 * width), left[0] + 0.9 * width)
