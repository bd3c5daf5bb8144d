"""Adaptive search of model settings: a tree of Parzen estimators proposes, a median rule ends bad trials early.

Each trial is judged fold after fold by Spark jobs; only its few figures come to the driver, so the search itself is
small whatever the data. Given settings are tried first, so that the best found is never worse than theirs.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from statistics import median

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import metrics
from .learn import ROLLING, TOGETHER, predict

#: Share of trials that count as good, candidates drawn for each proposal, random trials before the first proposal.
GOOD, CANDIDATES, RANDOM = 0.25, 24, 2


@dataclass(frozen=True)
class Number:
    """A setting between two bounds, evenly spread or on a log scale; ``step`` makes it whole steps from the least value."""

    low: float
    high: float
    log: bool = False
    step: float | None = None

    def inner(self, v: float) -> float:
        return math.log(v) if self.log else float(v)

    def value(self, u: float) -> float | int:
        v = min(self.high, max(self.low, math.exp(u) if self.log else u))
        if self.step is None:
            return v
        v = min(self.high, self.low + round((v - self.low) / self.step) * self.step)
        return int(v) if float(self.step).is_integer() and float(self.low).is_integer() else v

    def random(self, r: random.Random) -> float | int:
        return self.value(r.uniform(self.inner(self.low), self.inner(self.high)))


@dataclass(frozen=True)
class Choice:
    """One of some settings without an order."""

    of: tuple

    def random(self, r: random.Random):
        return r.choice(self.of)


Space = dict[str, Number | Choice]


@dataclass
class Trial:
    """Settings, the score of each fold that ran, and the objective; a pruned trial has no objective."""

    number: int
    settings: dict
    scores: list[float] = field(default_factory=list)
    objective: float | None = None

    @property
    def pruned(self) -> bool:
        return self.objective is None

    @property
    def so_far(self) -> float:
        return sum(self.scores) / len(self.scores)


class Parzen:
    """Density of one numeric setting: a normal around each value, cut off at the bounds, and one flat part."""

    def __init__(self, kind: Number, values: Sequence[float]):
        self.low, self.high = kind.inner(kind.low), kind.inner(kind.high)
        self.at = sorted(kind.inner(v) for v in values)
        span = self.high - self.low or 1.0
        ends = [self.low, *self.at, self.high]
        least = span / min(100, len(self.at) + 2)
        self.width = [min(span, max(least, b - a, c - b)) for a, b, c in zip(ends, ends[1:], ends[2:], strict=False)]

    def draw(self, r: random.Random) -> float:
        k = r.randrange(len(self.at) + 1)
        if k == len(self.at):
            return r.uniform(self.low, self.high)
        for _ in range(100):
            v = r.gauss(self.at[k], self.width[k])
            if self.low <= v <= self.high:
                return v
        return self.at[k]

    def density(self, v: float) -> float:
        cdf = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
        total = 1 / ((self.high - self.low) or 1.0)
        for m, w in zip(self.at, self.width, strict=True):
            inside = cdf((self.high - m) / w) - cdf((self.low - m) / w)
            total += math.exp(-0.5 * ((v - m) / w) ** 2) / (w * math.sqrt(2 * math.pi) * max(inside, 1e-12))
        return total / (len(self.at) + 1)


def propose(space: Space, done: Sequence[Trial], r: random.Random) -> dict:
    """The next settings: for each one, of values drawn near good trials, that which is likeliest there and unlikeliest among the others."""
    order = sorted(done, key=lambda t: (t.pruned, -(t.so_far if t.pruned else t.objective), t.number))
    cut = max(1, math.ceil(GOOD * len(order)))
    good, bad = order[:cut], order[cut:] or order
    out = {}
    for name, kind in space.items():
        near, far = ([t.settings[name] for t in part] for part in (good, bad))
        if isinstance(kind, Choice):
            share = lambda v, part: (part.count(v) + 1) / (len(part) + len(kind.of))  # noqa: B023, E731
            weights = [share(v, near) for v in kind.of]
            drawn = r.choices(kind.of, weights, k=CANDIDATES)
            out[name] = max(drawn, key=lambda v: share(v, near) / share(v, far))  # noqa: B023
        else:
            p, q = Parzen(kind, near), Parzen(kind, far)
            out[name] = kind.value(max((p.draw(r) for _ in range(CANDIDATES)), key=lambda v: p.density(v) / q.density(v)))  # noqa: B023
    return out


def hopeless(trial: Trial, done: Sequence[Trial], startup: int = 2, warmup: int = 1) -> bool:
    """Whether a trial's mean so far is below the median of the finished trials' at the same fold."""
    k = len(trial.scores)
    others = [sum(t.scores[:k]) / k for t in done if not t.pruned]
    return k > warmup and len(others) >= startup and trial.so_far < median(others)


def run(judge: Callable[[dict, int], float], folds: int, space: Space, trials: int, seed: int = 17, first: Sequence[dict] = ()) -> list[Trial]:
    """Trials in order; ``judge(settings, fold)`` gives a score, more is better. The objective is mean + 0.10 * worst, as for the grid."""
    done: list[Trial] = []
    for n in range(trials):
        r = random.Random(seed * 1_000_003 + n)
        if n < len(first):
            settings = dict(first[n])
        elif n < len(first) + (0 if first else RANDOM):
            settings = {name: kind.random(r) for name, kind in space.items()}
        else:
            settings = propose(space, done, r)
        trial = Trial(n, settings)
        for k in range(folds):
            trial.scores.append(judge(settings, k))
            if k + 1 < folds and n >= len(first) and hopeless(trial, done):
                break
        else:
            trial.objective = trial.so_far + 0.10 * min(trial.scores)
        done.append(trial)
    return done


def search(df: DataFrame, fit: Callable[..., object], space: Space, trials: int, folds: Sequence[tuple[int, int]] = ROLLING, first: Sequence[dict] = (), seed: int = 17, period: str = "period") -> DataFrame:
    """trial, settings (JSON), state, folds that ran, mean and worst average precision, objective: a row for each trial.

    ``fit(rows, **settings)`` fits a model on the periods up to the fold's first number; it is judged on its second. A fold without
    a positive row scores 0. Pruned trials have the figures of the folds that ran and no objective."""

    def one(settings: dict, k: int) -> float:
        last, test = folds[k]
        scores = predict(fit(df.where(F.col(period) <= last), **settings), df.where(F.col(period) == test), ["label"])
        got = metrics.average_precision(metrics.score_steps(scores, []), []).first()
        return float((got and got["average_precision"]) or 0.0)

    with ThreadPoolExecutor(TOGETHER) as pool:
        begun: list[tuple[dict, dict[int, Future]]] = [(s, {k: pool.submit(one, s, k) for k in range(len(folds))}) for s in first]

        def judge(settings: dict, k: int) -> float:
            """What no rule can end is begun at once: given settings, and the first two folds of others."""
            if k == 0 and not any(s == settings for s, _ in begun):
                begun.append((dict(settings), {j: pool.submit(one, settings, j) for j in range(min(2, len(folds)))}))
            jobs = next(jobs for s, jobs in begun if s == settings)
            if k not in jobs:
                jobs[k] = pool.submit(one, settings, k)
            return jobs[k].result()

        done = run(judge, len(folds), space, trials, seed, first)
    rows = [
        (t.number, json.dumps(t.settings, sort_keys=True), "pruned" if t.pruned else "complete", len(t.scores), round(t.so_far, 6), round(min(t.scores), 6), None if t.pruned else round(t.objective, 6))
        for t in done
    ]
    return SparkSession.active().createDataFrame(rows, "trial int, settings string, state string, folds int, mean double, worst double, objective double")
