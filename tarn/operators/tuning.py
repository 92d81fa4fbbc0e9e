"""Guided search of settings: a tree-structured Parzen sampler whose trials are boosted in lockstep, and given up early.

Past trials are parted into the good quarter and the rest. Each setting is drawn where the good ones are dense and the others
are not: of some candidates drawn from the good ones' density, the one with the greatest ratio of both densities is tried next. A batch of
trials shares the binned blocks and the passes; a trial whose running error is above the median of all at equal trees ends.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame

from .boosting import Job, Params, train_jobs


@dataclass(frozen=True)
class Range:
    low: float
    high: float
    log: bool = False
    whole: bool = False

    def at(self, u: float) -> float:
        low, high = (math.log(self.low), math.log(self.high)) if self.log else (self.low, self.high)
        x = low + u * (high - low)
        x = min(max(math.exp(x) if self.log else x, self.low), self.high)
        return int(round(x)) if self.whole else x


# fixed values: the published search space
SPACE = {
    "rate": Range(0.01, 0.1, log=True), "leaves": Range(31, 255, whole=True), "least_rows": Range(20, 200, whole=True), "rows": Range(0.5, 1.0), "columns": Range(0.5, 1.0),
    "l1": Range(1e-4, 1.0, log=True), "l2": Range(1e-3, 10.0, log=True),
}
#: Trials by chance before the sampler guides, candidates for one setting, and the share of trials that are good.
RANDOM, CANDIDATES, GOOD = 8, 24, 0.25


class Parzen:
    """Trials as points of the unit cube with their losses."""

    def __init__(self, dimensions: int, seed: int = 42):
        self.n, self.rng = dimensions, np.random.default_rng(seed)
        self.points: list[np.ndarray] = []
        self.losses: list[float] = []

    def tell(self, point: np.ndarray, loss: float) -> None:
        self.points.append(point)
        self.losses.append(loss)

    def ask(self) -> np.ndarray:
        if len(self.points) < RANDOM:
            return self.rng.random(self.n)
        order = np.argsort(self.losses, kind="stable")
        cut = max(2, math.ceil(GOOD * len(order)))
        x = np.array(self.points)
        return np.array([self._one(x[order[:cut], d], x[order[cut:], d]) for d in range(self.n)])

    def _one(self, good: np.ndarray, rest: np.ndarray) -> float:
        width = _widths(good)
        k = self.rng.integers(0, len(good) + 1, CANDIDATES)  # one kernel is the whole range
        centre, spread = np.append(good, 0.5)[k], np.append(width, 1.0)[k]
        tried = np.where(k == len(good), self.rng.random(CANDIDATES), centre + spread * self.rng.standard_normal(CANDIDATES))
        tried = np.clip(tried, 0.0, 1.0)
        return float(tried[np.argmax(_density(tried, good, width) - _density(tried, rest, _widths(rest)))])


def _widths(points: np.ndarray) -> np.ndarray:
    """A kernel's width: the distance to its farther neighbour, within bounds."""
    order = np.argsort(points)
    padded = np.concatenate([[0.0], points[order], [1.0]])
    gaps = np.maximum(padded[1:-1] - padded[:-2], padded[2:] - padded[1:-1])
    out = np.empty(len(points))
    out[order] = np.clip(gaps, 1.0 / min(100, len(points) + 1), 1.0)
    return out


def _density(x: np.ndarray, points: np.ndarray, width: np.ndarray) -> np.ndarray:
    kernels = np.exp(-0.5 * ((x[:, None] - points) / width) ** 2) / (width * math.sqrt(2 * math.pi))
    return np.log((kernels.sum(axis=1) + 1.0) / (len(points) + 1))


def tune(rows: DataFrame, names: Sequence[str], target: str, held: str, base: Params, trials: int = 16, batch: int = 4, space: dict[str, Range] | None = None, seed: int = 42, category: str | None = None) -> tuple[dict[str, float], float]:
    """The best settings by the error of `held` rows, and that error."""
    space = SPACE if space is None else space
    sampler, rivals, tried = Parzen(len(space), seed), [], []
    while len(tried) < trials:
        points = [sampler.ask() for _ in range(min(batch, trials - len(tried)))]
        settings = [{k: r.at(u) for (k, r), u in zip(space.items(), p, strict=True)} for p in points]
        jobs = [Job(0, seed, replace(base, **s)) for s in settings]
        model = train_jobs(rows, names, [target], jobs, category, held=held, rivals=rivals)
        for p, s, errors in zip(points, settings, model.errors, strict=True):
            loss = min(errors, default=float("inf"))
            sampler.tell(p, loss)
            tried.append((loss, len(tried), s))
        rivals += model.errors
    loss, _, best = min(tried)
    return best, loss
