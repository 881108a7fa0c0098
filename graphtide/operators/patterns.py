"""Prebuilt models and small plug-ins: signal chain, supply chains, disruption cascade, availability calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphtide.sources.sysd import Model


def signal_chain(signal: str = "STEP(10, 5)", delay: float = 6.0, smoothing: float = 4.0, threshold: float = 5.0, gain: float = 1.0, end: float = 50.0, dt: float = 0.5) -> Model:
    """A signal that is delayed, smoothed, compared with a threshold and accumulated."""
    m = Model("SignalChain", dt, 0.0, end)
    m.param("delay", delay).param("smoothing", smoothing).param("threshold", threshold).param("gain", gain)
    m.aux("signal", signal).aux("delayed", "DELAY3(signal, delay)").aux("smoothed", "SMOOTH(delayed, smoothing)")
    m.aux("response", "IF(smoothed > threshold, gain * (smoothed - threshold), 0)")
    return m.stock("Response", 0.0, {"respond": "response"})


def supply_chain(echelons: int, demand: str = "100", inventory: float = 500.0, lead: float = 3.0, dt: float = 1.0, end: float = 100.0) -> Model:
    """n echelons, each shipping what it can to the one below and ordering from the one above."""
    m = Model("SupplyChain", dt, 0.0, end)
    m.param("lead", lead).param("target", inventory)
    m.aux("order_0", demand)
    for i in range(1, echelons + 1):
        m.aux(f"ship_{i}", f"MIN(MAX(0, Inventory_{i}) / dt, order_{i - 1})")
        m.aux(f"order_{i}", f"MAX(0, order_{i - 1} + (target - Inventory_{i}) / lead)")
        source = f"SMOOTH(ship_{i + 1}, lead)" if i < echelons else f"SMOOTH(order_{i}, lead)"
        m.stock(f"Inventory_{i}", inventory, {f"receive_{i}": source}, {f"send_{i}": f"ship_{i}"})
    return m


def disruption_cascade(runs: DataFrame, steps: int = 40) -> DataFrame:
    """(run_id, step, demand) of runs (run_id, buyers, base, panic, start, length): demand while buyers see a shortage.

    From start on, for length steps, awareness spreads by half of what is left each step and fades by a fifth after.
    """
    grid = runs.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    on = F.least(F.greatest(F.col("step") - F.col("start") + 1, F.lit(0)), F.col("length"))
    off = F.greatest(F.col("step") - F.col("start") - F.col("length") + 1, F.lit(0))
    aware = (1 - F.pow(F.lit(0.5), on)) * F.pow(F.lit(0.8), off)
    return grid.select("run_id", "step", (F.col("buyers") * F.col("base") * (1 + F.col("panic") * aware)).alias("demand"))


def amplification(demand: DataFrame) -> DataFrame:
    """(run_id, before, during, amplification): mean demand in steps 5 to 9 and 11 to 20."""
    mean = lambda a, b: F.avg(F.when(F.col("step").between(a, b), F.col("demand")))
    out = demand.groupBy("run_id").agg(mean(5, 9).alias("before"), mean(11, 20).alias("during"))
    return out.withColumn("amplification", F.try_divide("during", "before"))


def available(t: Column, hours: tuple[float, float], weekdays: tuple[int, ...]) -> Column:
    """Whether a time in days since the epoch is within hours of the day on one of the weekdays (Monday 0)."""
    day, hour = F.floor(t), (t - F.floor(t)) * 24
    weekday = F.pmod(day + 3, F.lit(7))
    return (hour >= hours[0]) & (hour < hours[1]) & weekday.isin(*weekdays)
