"""Proposals of settings from earlier trials, by Parzen density estimates.

The better share of the trials and the rest each give a density per parameter: a mixture of bells around the values tried, and a flat
part.  Candidates are drawn from the density of the better trials; the one whose ratio of both densities is greatest is proposed.  Numbers are
handled at their position in the range (of the logarithm, for "log" ranges), choices by smoothed counts.
"""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from typing import Any

from tabspark.operators.search import Choice, Range

SHARE = 0.15  # of the trials that count as good
CANDIDATES = 24
LEAST_WIDTH = 0.03


def position(r: Range, value: float) -> float:
    """Where a value lies in its range, 0 to 1."""
    low, high, v = (math.log(x) for x in (r.start, r.end, value)) if r.step == "log" else (r.start, r.end, value)
    return (v - low) / (high - low) if high > low else 0.5


def value_at(r: Range, u: float) -> Any:
    """The value of the range's own grid at a position."""
    class Fixed:
        random = staticmethod(lambda: min(max(u, 0.0), 1 - 1e-12))
    return r.draw(Fixed())


def _widths(points: Sequence[float]) -> list[float]:
    """A bell is as wide as the gap to its farther neighbour."""
    order = sorted(range(len(points)), key=lambda i: points[i])
    out = [0.0] * len(points)
    for k, i in enumerate(order):
        before = points[order[k - 1]] if k else 0.0
        after = points[order[k + 1]] if k + 1 < len(order) else 1.0
        out[i] = min(1.0, max(points[i] - before, after - points[i], LEAST_WIDTH))
    return out


def density(points: Sequence[float], u: float) -> float:
    total = 1.0  # the flat part counts as one point
    for p, w in zip(points, _widths(points)):
        inside = 0.5 * (math.erf((1 - p) / (w * math.sqrt(2))) - math.erf((0 - p) / (w * math.sqrt(2))))
        total += math.exp(-0.5 * ((u - p) / w) ** 2) / (w * math.sqrt(2 * math.pi) * inside)
    return total / (len(points) + 1)


def _draw(points: Sequence[float], rng: random.Random) -> float:
    i = rng.randrange(len(points) + 1)
    if i == len(points):
        return rng.random()
    w = _widths(points)[i]
    while True:
        u = rng.gauss(points[i], w)
        if 0 <= u < 1:
            return u


def propose(space: Mapping[str, Any], trials: Sequence[tuple[Mapping[str, Any], float]], rng: random.Random, n: int = 1) -> list[dict[str, Any]]:
    """``n`` settings to try next; ``trials`` are settings with their scores, smaller better.  Plain values of the space stay as they are."""
    ranked = sorted(trials, key=lambda t: t[1])
    good = ranked[: max(1, math.ceil(SHARE * len(ranked)))]
    rest = ranked[len(good) :]
    out = []
    for _ in range(n):
        setting = {}
        for name, s in space.items():
            if isinstance(s, Range):
                a, b = ([position(s, t[0][name]) for t in part] for part in (good, rest))
                drawn = [_draw(a, rng) for _ in range(CANDIDATES)]
                setting[name] = value_at(s, max(drawn, key=lambda u: density(a, u) / density(b, u)))
            elif isinstance(s, Choice):
                size = len(s.values)
                a, b = ([(1 + sum(t[0][name] == v for t in part)) / (size + len(part)) for v in s.values] for part in (good, rest))
                drawn = rng.choices(range(size), a, k=CANDIDATES)
                setting[name] = s.values[max(drawn, key=lambda i: a[i] / b[i])]
            else:
                setting[name] = s
        out.append(setting)
    return out
