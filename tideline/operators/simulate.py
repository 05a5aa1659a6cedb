"""Draws of a mean-reverting diffusion with held inputs, by Euler-Maruyama steps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def levels(kind: str, steps: int, dt: float, base: float, value: float | list[float] = 0.0, start: float = 0.0, end: float | None = None) -> np.ndarray:
    """The level that an intervention sets at each step. constant: value is added from
    start to end; ramp: it grows from nothing at start to value at end, and stays;
    precomputed: value lists what is added at each step, its last number on and on."""
    t = np.arange(steps) * dt
    if kind == "constant":
        return base + np.where((t >= start) & (t < (np.inf if end is None else end)), value, 0.0)
    if kind == "ramp":
        stop = steps * dt if end is None else end
        return base + value * np.clip((t - start) / max(stop - start, 1e-12), 0.0, 1.0)
    if kind == "precomputed":
        given = np.asarray(value, float)
        return base + given[np.minimum(np.arange(steps), len(given) - 1)]
    raise ValueError(f"unknown intervention: {kind}")


def batch_width(items: int, bytes_each: int, budget: int) -> int:
    """How many items fit the budget together: all, or so many halvings less; one at least."""
    width = max(1, items)
    while width > 1 and width * bytes_each > budget:
        width = -(-width // 2)
    return width


def simulate(spark: SparkSession, draws: int, steps: int, dt: float = 0.1, rate: float = 0.5, level: float = 1.0, noise: float = 0.3, shift: float | list[float] = 0.0, seed: int = 0, kind: str = "constant", start: float = 0.0, end: float | None = None) -> DataFrame:
    """(arm, draw, time, value) of a reference arm and, if shift isn't 0, an action
    arm whose level is changed (see levels) and that shares the reference's noise. A
    draw's numbers depend on seed and draw alone."""
    arms = [("reference", levels("constant", steps, dt, level))]
    if np.any(shift):
        arms.append(("action", levels(kind, steps, dt, level, shift, start, end)))

    def run(batches):
        for pdf in batches:
            for draw in pdf["id"]:
                z = np.random.default_rng([seed, draw]).standard_normal(steps) * noise * np.sqrt(dt)
                for arm, target in arms:
                    x, out = 0.0, np.empty(steps)
                    for i in range(steps):
                        x += rate * (target[i] - x) * dt + z[i]
                        out[i] = x
                    yield pd.DataFrame({"arm": arm, "draw": draw, "time": np.arange(1, steps + 1) * dt, "value": out})

    return spark.range(draws).mapInPandas(run, "arm string, draw long, time double, value double")
