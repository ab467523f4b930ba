"""Hyper-parameter search by seeded random draws or by densities of good and bad trials, with pruning, and learning curves.

The table is ranked into folds once and stored. A trial is scored fold by fold;
after each fold it is given up if its mean so far is worse than the median of
what earlier trials had after as many folds. Draws come from digests of seed,
trial and parameter, so reruns and other partitionings agree.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from statistics import NormalDist, median

from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import half_up
from millrace.functions.storage import stored
from millrace.operators import models
from millrace.operators.split import ranked

#: Trials before densities are used, the share of trials that count as good, and candidates that a draw chooses from.
STARTUP, GOOD, CANDIDATES = 5, 0.15, 24
#: Earlier trials that a median needs, and folds that every trial gets.
LEAST_TRIALS, LEAST_FOLDS = 3, 1


@dataclass(frozen=True)
class Param:
    """A range (``low`` to ``high``, of whole numbers or not, even or by logarithm) or a choice."""

    low: float = 0.0
    high: float = 1.0
    whole: bool = False
    log: bool = False
    options: tuple = ()

    def at(self, unit: float):
        """The value at a place from 0 to 1."""
        if self.options:
            return self.options[min(int(unit * len(self.options)), len(self.options) - 1)]
        if self.whole and not self.log:
            return min(int(self.low + unit * (self.high - self.low + 1)), int(self.high))
        value = math.exp(math.log(self.low) + unit * (math.log(self.high) - math.log(self.low))) if self.log else self.low + unit * (self.high - self.low)
        return round(value) if self.whole else value

    def place(self, value) -> float:
        """Where a value stands from 0 to 1."""
        if self.options:
            return (self.options.index(value) + 0.5) / len(self.options)
        if self.whole and not self.log:
            return (value - self.low + 0.5) / (self.high - self.low + 1)
        low, high, v = (math.log(x) if self.log else x for x in (self.low, self.high, value))
        return (v - low) / (high - low) if high > low else 0.5


def unit(*parts) -> float:
    """A number in [0, 1) of a digest."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32


def drawn(space: dict[str, Param], trial: int, seed: int) -> dict:
    return {name: p.at(unit(seed, trial, name)) for name, p in space.items()}


def density(places: list[float], x: float) -> float:
    """A mixture of the even density and one bell for each place, cut to 0 and 1 and as wide as its neighbours are far."""
    total, around = 1.0, sorted([0.0, *places, 1.0])
    for n, p in enumerate(sorted(places), 1):
        wide = min(1.0, max(around[n + 1] - p, p - around[n - 1], 1.0 / (1 + len(places)) / 4, 0.01))
        bell = NormalDist(p, wide)
        total += bell.pdf(x) / (bell.cdf(1.0) - bell.cdf(0.0))
    return total / (len(places) + 1)


def share(values: list, options: tuple, value) -> float:
    """How often an option was taken, each counted once more."""
    return (values.count(value) + 1) / (len(values) + len(options))


def proposed(space: dict[str, Param], done: list[tuple[dict, float]], trial: int, seed: int) -> dict:
    """For each parameter the candidate that good trials make likeliest against the others; ``done`` has losses, the least is best."""
    if len(done) < STARTUP:
        return drawn(space, trial, seed)
    order = sorted(range(len(done)), key=lambda n: (done[n][1], n))
    cut = max(1, math.ceil(GOOD * len(done)))
    good, bad = ([done[n][0] for n in part] for part in (order[:cut], order[cut:]))
    out = {}
    for name, p in space.items():
        if p.options:
            ratio = lambda v: share([t[name] for t in good], p.options, v) / share([t[name] for t in bad], p.options, v)  # noqa: B023, E731
            picks = [p.at(unit(seed, trial, name, c)) for c in range(CANDIDATES)]
        else:
            mine, other = ([p.place(t[name]) for t in part] for part in (good, bad))
            ratio = lambda v: density(mine, p.place(v)) / density(other, p.place(v))  # noqa: B023, E731
            picks = []
            for c in range(CANDIDATES):  # from the good density: a bell around a good place, or anywhere
                which, u = int(unit(seed, trial, name, c, "which") * (len(mine) + 1)), min(max(unit(seed, trial, name, c), 1e-9), 1 - 1e-9)
                x = u if which == len(mine) else NormalDist(mine[which], max(0.05, 1 / (1 + len(mine)) / 2)).inv_cdf(u)
                picks.append(p.at(min(max(x, 0.0), 1.0 - 1e-12)))
        out[name] = max(picks, key=ratio)  # of ties the first
    return out


@dataclass
class Trial:
    number: int
    params: dict
    losses: list[float] = field(default_factory=list)
    pruned: bool = False

    @property
    def loss(self) -> float:
        return sum(self.losses) / len(self.losses)


def hopeless(trial: Trial, earlier: list[Trial]) -> bool:
    """Whether the mean so far is worse than the median of earlier trials' means after as many folds."""
    n = len(trial.losses)
    others = [sum(t.losses[:n]) / n for t in earlier if len(t.losses) >= n]
    return n >= LEAST_FOLDS and len(others) >= LEAST_TRIALS and trial.loss > median(others)


def optimise(space: dict[str, Param], loss: Callable[[dict, int], float], trials: int, k: int, sampler: str = "tpe", prune: bool = True, seed: int = 42, stop_after: int | None = None) -> list[Trial]:
    """The trials of ``loss(params, fold)``, in order. ``stop_after`` ends the search when so many trials in a row were no better."""
    if sampler not in ("tpe", "random"):
        raise ValueError(f"no sampler {sampler!r}")
    made: list[Trial] = []
    for n in range(trials):
        whole = [(t.params, t.loss) for t in made if not t.pruned]
        trial = Trial(n, proposed(space, whole, n, seed) if sampler == "tpe" else drawn(space, n, seed))
        for f in range(k):
            trial.losses.append(loss(trial.params, f))
            if prune and f + 1 < k and hopeless(trial, made):
                trial.pruned = True
                break
        made.append(trial)
        best = min((t for t in made if not t.pruned), key=lambda t: (t.loss, t.number))
        if stop_after is not None and n - best.number >= stop_after:
            break
    return made


def searched(
    df: DataFrame, name: str, space: dict[str, Param], features: list[str], label: str, key: str,
    trials: int = 20, k: int = 3, sampler: str = "tpe", prune: bool = True, seed: int = 42, stop_after: int | None = None,
) -> DataFrame:
    """(trial, params, state, folds, metric, score, best) of a registered model; scores are means over the folds seen, of RMSE or F1."""
    task = models.REGISTRY[name].tasks[0]
    table = models.folded(df, key, k, features, label, task == "classification")
    metric, judge = ("rmse", RegressionEvaluator(labelCol=label, metricName="rmse")) if task == "regression" else ("f1", MulticlassClassificationEvaluator(labelCol=label, metricName="f1"))
    pipe = models.pipeline(name, features, label)
    model, sign = pipe.getStages()[-1], -1 if judge.isLargerBetter() else 1

    def loss(params: dict, fold: int) -> float:
        fitted = pipe.fit(table.where(F.col("fold") != fold), {model.getParam(p): v for p, v in params.items()})
        return sign * judge.evaluate(fitted.transform(table.where(F.col("fold") == fold)))

    made = optimise(space, loss, trials, k, sampler, prune, seed, stop_after)
    best = min((t for t in made if not t.pruned), key=lambda t: (t.loss, t.number))
    rows = [(t.number, json.dumps(t.params), "pruned" if t.pruned else "complete", len(t.losses), metric, sign * t.loss, t is best) for t in made]
    return df.sparkSession.createDataFrame(rows, "trial int, params string, state string, folds int, metric string, score double, best boolean")


def learning_curve(df: DataFrame, name: str, features: list[str], label: str, key: str, shares=(0.1, 0.325, 0.55, 0.775, 1.0), held_out: float = 0.2, seed: int = 42) -> DataFrame:
    """(share, n, train, validation): a model's RMSE or F1 on what it was fitted on and on the held-out rows, by size.

    The rows that come last in the seeded order are held out; each size is a prefix of the others, so a larger one holds
    the smaller. Ranks are made and stored once, and the fits run side by side.
    """
    task = models.REGISTRY[name].tasks[0]
    judge = RegressionEvaluator(labelCol=label, metricName="rmse") if task == "regression" else MulticlassClassificationEvaluator(labelCol=label, metricName="f1")
    table = stored(ranked(df.where(F.col(label).isNotNull()).select(*dict.fromkeys([key, label, *features])), key, seed))
    size = table.count()
    able = size - math.floor(size * held_out)
    last = table.where(F.col("_rank") >= able)

    def one(part: float):
        n = max(1, math.floor(able * part))
        mine = table.where(F.col("_rank") < n)
        fitted = models.fit(mine, name, features, label)
        return float(part), n, float(judge.evaluate(fitted.transform(mine))), float(judge.evaluate(fitted.transform(last)))

    with ThreadPoolExecutor(min(len(shares), models.PARALLEL)) as pool:
        rows = list(pool.map(one, shares)) if size else []
    out = df.sparkSession.createDataFrame(rows, "share double, n long, train double, validation double")
    return out.select("share", "n", half_up(F.col("train"), 4).alias("train"), half_up(F.col("validation"), 4).alias("validation"))
