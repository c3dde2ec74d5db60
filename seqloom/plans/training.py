"""Training control as small state machines, and a logistic scorer trained by summed gradients.

Each step is one aggregation over the samples: gradients are summed in the tasks, and only one row of
sums, as long as the features, reaches the driver.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class PlateauRate:
    """R2: the rate falls by ``factor`` after ``patience`` losses, rounded up to three decimals, without a better one."""

    rate: float
    factor: float = 0.8
    patience: int = 16
    best: float = math.inf
    bad: int = 0

    def step(self, loss: float) -> float:
        loss = math.ceil(loss * 1000) / 1000
        if loss < self.best * (1 - 1e-4):
            self.best, self.bad = loss, 0
        else:
            self.bad += 1
        if self.bad > self.patience:
            self.rate, self.bad = self.rate * self.factor, 0
        return self.rate


@dataclass
class EarlyStop:
    """Stop when the best value of a metric is ``patience`` reports old."""

    patience: int
    values: list[float] = field(default_factory=list)

    def stop(self, value: float) -> bool:
        self.values.append(-math.inf if value != value else value)
        best = max(range(len(self.values)), key=self.values.__getitem__)
        return len(self.values) - 1 - best > self.patience


@dataclass
class Checkpoints:
    """The best state so far, periodic states, and resumption."""

    path: str
    every: int
    least: float = math.inf
    written: list[str] = field(default_factory=list)

    def offer(self, step: int, loss: float, state: dict) -> None:
        if step and step % self.every == 0:
            self._write(f"checkpoint-{step}", step, loss, state)
        if loss < self.least:
            self.least = loss
            self._write("best", step, loss, state)

    def _write(self, name: str, step: int, loss: float, state: dict) -> None:
        with open(f"{self.path}/{name}.json", "w") as f:
            json.dump({"step": step, "least": min(loss, self.least), "state": state}, f)
        self.written.append(name)

    @staticmethod
    def resume(file: str, max_steps: int) -> tuple[int, float, dict, int]:
        """Step, least loss and state; a run that is past ``max_steps`` gets as many more."""
        with open(file) as f:
            got = json.load(f)
        return got["step"], got["least"], got["state"], max_steps + got["step"] if got["step"] >= max_steps else max_steps


@dataclass
class Logistic:
    """A linear scorer with a sigmoid."""

    weights: list[float]
    bias: float = 0.0

    def score(self, features: str = "features"):
        z = F.aggregate(F.zip_with(features, F.array(*[F.lit(float(w)) for w in self.weights]), lambda a, b: a * b), F.lit(float(self.bias)), lambda s, x: s + x)
        return 1 / (1 + F.exp(-z))

    def step(self, samples: DataFrame, rate: float) -> float:
        """One gradient step; returns the mean loss before it. ``samples`` has features and target."""
        p = F.least(F.greatest(self.score(), F.lit(1e-12)), F.lit(1 - 1e-12))
        y = F.col("target").cast("double")
        rows = samples.select("features", y.alias("y"), p.alias("p"))
        gap = F.col("p") - F.col("y")
        sums = [F.sum(gap * F.get("features", F.lit(i))).alias(f"g{i}") for i in range(len(self.weights))]
        loss = F.avg(-(F.col("y") * F.ln("p") + (1 - F.col("y")) * F.ln(1 - F.col("p")))).alias("loss")
        got = rows.agg(F.count(F.lit(1)).alias("n"), loss, F.sum(gap).alias("gb"), *sums).first()
        if got["n"]:
            self.weights = [w - rate * got[f"g{i}"] / got["n"] for i, w in enumerate(self.weights)]
            self.bias -= rate * got["gb"] / got["n"]
        return got["loss"] if got["n"] else math.nan


def report(steps: DataFrame, every: int) -> DataFrame:
    """Of each ``every`` steps the mean loss and the steps a second. ``steps`` has step (from 0), loss and seconds."""
    parts = steps.groupBy(F.floor(F.col("step") / every).alias("report"))
    return parts.agg(F.avg("loss").alias("loss"), F.try_divide(F.count(F.lit(1)), F.sum("seconds")).alias("steps_per_second"))


def train(samples: DataFrame, model: Logistic, steps: int, rate: PlateauRate, checkpoints: Checkpoints | None = None, stop: EarlyStop | None = None) -> list[float]:
    """The step loop (R1, R6): samples are kept in memory and on disk; returns the losses."""
    samples = samples.select("features", "target").persist()
    losses = []
    for n in range(steps):
        loss = model.step(samples, rate.rate)
        losses.append(loss)
        rate.step(loss)
        if checkpoints:
            checkpoints.offer(n, loss, asdict(model))
        if stop and stop.stop(-loss):
            break
    samples.unpersist()
    return losses
