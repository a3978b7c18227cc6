"""Exploring combinations of search parameters: bounds from what was measured rule others out unmeasured."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import product
from random import Random


@dataclass(frozen=True)
class Point:
    """A measured combination: its places in the ranges, its values, how well it does and what it costs."""

    places: tuple[int, ...]
    values: dict
    perf: float
    cost: float


def pareto_points(points: list[Point]) -> list[Point]:
    """Those that no other betters: by rising cost, each with a better perf than all cheaper ones. Of equal ones the first
    in the order of places stays."""
    out: list[Point] = []
    for p in sorted(points, key=lambda p: (p.cost, -p.perf, p.places)):
        if not out or p.perf > out[-1].perf:
            out.append(p)
    return out


@dataclass
class ParameterSpace:
    """Ranges of values, each in an order in which neither perf nor cost fall (more probes, a longer shortlist...).

    Then a combination does no better than any measured one that is at least as far in every range, and costs no less than
    any measured one that is at most as far. Where a measured point is at least as good as the first bound and at most as
    dear as the second, the combination cannot add a Pareto point and isn't measured. skipped counts these.
    """

    ranges: dict[str, list]
    measured: list[Point] = field(default_factory=list)
    skipped: int = 0

    def bounds(self, places: tuple[int, ...]) -> tuple[float, float]:
        """(perf at most, cost at least) by what was measured."""
        perf, cost = float("inf"), 0.0
        for p in self.measured:
            if all(a >= b for a, b in zip(p.places, places, strict=True)):
                perf = min(perf, p.perf)
            if all(a <= b for a, b in zip(p.places, places, strict=True)):
                cost = max(cost, p.cost)
        return perf, cost

    def explore(self, measure: Callable[[dict], tuple[float, float]], seed: int = 123, most: int | None = None) -> list[Point]:
        """The Pareto points, as of measuring all combinations. measure(values) -> (perf, cost) is a search with its
        evaluation, on Spark. The first and the last combination come first, the others in a seeded order; `most` bounds
        how many are measured, at the price of points."""
        every = list(product(*[range(len(v)) for v in self.ranges.values()]))
        inner = every[1:-1]
        Random(seed).shuffle(inner)
        for places in [*dict.fromkeys((every[0], every[-1])), *inner]:
            if most is not None and len(self.measured) >= most:
                break
            perf, cost = self.bounds(places)
            if any(p.perf >= perf and p.cost <= cost for p in self.measured):
                self.skipped += 1
                continue
            values = {n: r[i] for (n, r), i in zip(self.ranges.items(), places, strict=True)}
            self.measured.append(Point(places, values, *measure(values)))
        return pareto_points(self.measured)
