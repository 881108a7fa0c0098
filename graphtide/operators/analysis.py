"""Scenario comparison, sensitivity estimators, and aggregates that calibration and optimisation rest on.

Simulated outputs are tables; every estimator is an aggregate over them. Sample matrices are made on the driver,
a row for each run.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scans import average_rank, running_sum
from .skyline import skyline


def final_values(trajectories: DataFrame) -> DataFrame:
    """(run_id, var, value) at each run's last step."""
    return trajectories.groupBy("run_id", "var").agg(F.max_by("value", "step").alias("value"))


def deviations(finals: DataFrame, baseline: int, relative: bool = True) -> DataFrame:
    """(run_id, var, value, base, deviation) against a baseline run: relative where the base is not 0."""
    base = finals.where(F.col("run_id") == baseline).select("var", F.col("value").alias("base"))
    diff = F.col("value") - F.col("base")
    out = F.when(F.abs("base") > 1e-12, diff / F.abs("base")).otherwise(diff) if relative else diff
    return finals.join(base, "var").select("run_id", "var", "value", "base", out.alias("deviation"))


def tornado(outputs: DataFrame) -> DataFrame:
    """(param, low, high, spread) from outputs (param, side, y) with sides low and high; smallest spread first."""
    wide = outputs.groupBy("param").agg(F.max(F.when(F.col("side") == "low", F.col("y"))).alias("low"), F.max(F.when(F.col("side") == "high", F.col("y"))).alias("high"))
    return wide.withColumn("spread", F.abs(F.col("high") - F.col("low"))).orderBy("spread", "param")


def rank_scenarios(scores: DataFrame, how: str = "mean") -> DataFrame:
    """(scenario, score, rank) of scores (scenario, query, score); the best first."""
    f = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum}[how]
    out = scores.groupBy("scenario").agg(f("score").alias("score"))
    ranked = running_sum(out.withColumn("_one", F.lit(1)), [], [F.desc("score"), F.col("scenario")], "_one", "rank")
    return ranked.select("scenario", "score", F.col("rank").cast("int").alias("rank"))


# ---------------------------------------------------------------- samples


def latin_hypercube(n: int, k: int, seed: int = 42) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return (np.stack([rng.permutation(n) for _ in range(k)], axis=1) + rng.random((n, k))) / n


def radical_inverse(n: int, k: int, seed: int = 42) -> np.ndarray:
    """A shifted low-discrepancy sequence: digits of the index mirrored in the first k prime bases."""
    primes, c = [], 2
    while len(primes) < k:
        if all(c % p for p in primes):
            primes.append(c)
        c += 1
    out = np.zeros((n, k))
    for j, b in enumerate(primes):
        i, f = np.arange(1, n + 1), 1.0
        while i.any():
            f /= b
            out[:, j] += f * (i % b)
            i = i // b
    return (out + np.random.default_rng(seed).random(k)) % 1.0


def saltelli(n: int, names: list[str], ranges: dict[str, tuple[float, float]], seed: int = 42) -> list[tuple]:
    """Rows (run_id, row, part, parameters) for parts A, B and AB_<i>: A with the i-th column of B."""
    k = len(names)
    low, high = np.array([ranges[p] for p in names]).T
    u = radical_inverse(n, 2 * k, seed)
    a, b = low + u[:, :k] * (high - low), low + u[:, k:] * (high - low)
    parts = [("A", a), ("B", b)] + [(f"AB_{names[i]}", np.where(np.arange(k) == i, b, a)) for i in range(k)]
    return [(i * len(parts) + j, i, part, *map(float, m[i])) for i in range(n) for j, (part, m) in enumerate(parts)]


def sobol(outputs: DataFrame) -> DataFrame:
    """(param, first, total) of outputs (row, part, y): one aggregate over the rows' A, B and AB values, clamped to [0, 1]."""
    base = outputs.where("part in ('A', 'B')").groupBy("row").agg(F.max(F.when(F.col("part") == "A", F.col("y"))).alias("ya"), F.max(F.when(F.col("part") == "B", F.col("y"))).alias("yb"))
    ab = outputs.where(F.startswith("part", F.lit("AB_"))).select("row", F.expr("substring(part, 4)").alias("param"), F.col("y").alias("yab"))
    moments = base.agg((F.sum("ya") + F.sum("yb")).alias("s"), (F.sum(F.col("ya") * F.col("ya")) + F.sum(F.col("yb") * F.col("yb"))).alias("q"), (2 * F.count(F.lit(1))).alias("m"))
    moments = moments.select((F.col("s") / F.col("m")).alias("mean"), (F.col("q") / F.col("m") - F.pow(F.col("s") / F.col("m"), 2)).alias("var"))
    sums = ab.join(base, "row").groupBy("param").agg(F.avg(F.col("yb") * F.col("yab")).alias("b"), F.avg(F.col("ya") * F.col("yab")).alias("a"))
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    f0 = F.col("mean") * F.col("mean")
    return sums.crossJoin(F.broadcast(moments)).select("param", clamp(F.try_divide(F.col("b") - f0, F.col("var"))).alias("first"), clamp(1 - F.try_divide(F.col("a") - f0, F.col("var"))).alias("total"))


def morris_sample(names: list[str], ranges: dict[str, tuple[float, float]], trajectories: int, levels: int = 4, seed: int = 42) -> list[tuple]:
    """Rows (run_id, trajectory, point, changed, step, parameters): each point moves one parameter."""
    rng, k = np.random.default_rng(seed), len(names)
    delta = levels / (2 * (levels - 1))
    low, high = np.array([ranges[p] for p in names]).T
    rows = []
    for r in range(trajectories):
        x = rng.integers(0, max(levels // 2, 1), k) / (levels - 1)
        order = rng.permutation(k)
        for i in range(k + 1):
            changed = names[order[i - 1]] if i else None
            if i:
                x = x.copy()
                x[order[i - 1]] += delta
            rows.append((len(rows), r, i, changed, delta, *map(float, low + x * (high - low))))
    return rows


def morris(outputs: DataFrame) -> DataFrame:
    """(param, mu, mu_star, sigma) of outputs (trajectory, point, changed, step, y), by differences along trajectories."""
    w = Window.partitionBy("trajectory").orderBy("point")
    effects = outputs.withColumn("effect", (F.col("y") - F.lag("y").over(w)) / F.col("step")).where("changed is not null")
    return effects.groupBy(F.col("changed").alias("param")).agg(F.avg("effect").alias("mu"), F.avg(F.abs("effect")).alias("mu_star"), F.coalesce(F.stddev_samp("effect"), F.lit(0.0)).alias("sigma"))


def average_ranks(rows: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """With rank_<column>: ranks from 1, ties sharing their mean rank."""
    for c in columns:
        rows = average_rank(rows, c, f"rank_{c}", by)
    return rows


def gram(rows: DataFrame, columns: list[str]) -> np.ndarray:
    """The matrix of cross moments of the columns and a one, from a single aggregate."""
    full = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    flat = rows.agg(*[F.sum(a * b).alias(f"m{i}_{j}") for i, a in enumerate(full) for j, b in enumerate(full) if i <= j]).first()
    k = len(full)
    out = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            out[i, j] = out[j, i] = flat[f"m{i}_{j}"]
    return out


def src(rows: DataFrame, params: list[str], y: str) -> dict[str, float]:
    """Standardised regression coefficients of y on the parameters."""
    g = gram(rows, [*params, y])
    n, mean = g[0, 0], g[0, 1:] / g[0, 0]
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    beta = np.linalg.lstsq(cov[:-1, :-1], cov[:-1, -1], rcond=None)[0]
    return {p: float(b * s / sd[-1]) if sd[-1] > 0 else 0.0 for p, b, s in zip(params, beta, sd, strict=False)}


def prcc(rows: DataFrame, params: list[str], y: str) -> dict[str, float]:
    """Partial rank correlations: ranks by windows, then what is left of their covariance with y without the other parameters."""
    ranked = average_ranks(rows, [*params, y])
    g = gram(ranked, [f"rank_{c}" for c in [*params, y]])
    n, mean = g[0, 0], g[0, 1:] / g[0, 0]
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    out = {}
    for i, p in enumerate(params):
        others, pair = [j for j in range(len(params)) if j != i], [i, len(params)]
        left = cov[np.ix_(pair, pair)] - cov[np.ix_(pair, others)] @ np.linalg.pinv(cov[np.ix_(others, others)]) @ cov[np.ix_(others, pair)]
        spread = left[0, 0] * left[1, 1]
        out[p] = float(left[0, 1] / np.sqrt(spread)) if spread > 1e-12 * max(cov[i, i] * cov[-1, -1], 1e-300) else 0.0
    return out


def oat(names: list[str], ranges: dict[str, tuple[float, float]]) -> list[tuple]:
    """Rows (run_id, param, side, parameters): one parameter at an end of its range, the others in the middle."""
    mid = {p: (a + b) / 2 for p, (a, b) in ranges.items()}
    rows = []
    for p in names:
        for side, v in zip(("low", "high"), ranges[p], strict=True):
            rows.append((len(rows), p, side, *[float((mid | {p: v})[q]) for q in names]))
    return rows


# ---------------------------------------------------------------- fronts and errors


def pareto(rows: DataFrame, objectives: list[str], key: str) -> DataFrame:
    """The front of the rows, see :func:`graphtide.operators.skyline.skyline`; key names the rows and plays no part."""
    return skyline(rows, objectives)


def interpolated(series: DataFrame, times: DataFrame, by: list[str], t: str = "t", value: str = "value") -> DataFrame:
    """The value at each time (by, t) of a series (by, t, value): linear between points, held at the ends."""
    both = series.select(*by, t, value, F.lit(0).alias("_ask")).unionByName(times.select(*by, t, F.lit(None).cast("double").alias(value), F.lit(1).alias("_ask")))
    # The next point is the last one before it in falling order: frames that only grow are linear.
    before = Window.partitionBy(*by).orderBy(t, "_ask", value).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*by).orderBy(F.desc(t), "_ask", value).rowsBetween(Window.unboundedPreceding, 0)
    point = F.when(F.col("_ask") == 0, F.struct(F.col(t).alias("t"), F.col(value).alias("v")))
    both = both.withColumn("_l", F.last(point, True).over(before)).withColumn("_r", F.last(point, True).over(after))
    share = F.try_divide(F.col(t) - F.col("_l.t"), F.col("_r.t") - F.col("_l.t"))
    mixed = F.col("_l.v") + (F.col("_r.v") - F.col("_l.v")) * F.coalesce(share, F.lit(0.0))
    return both.where("_ask = 1").select(*by, t, F.coalesce(mixed, F.col("_l.v"), F.col("_r.v")).alias(value))


def errors(simulated: DataFrame, observed: DataFrame) -> DataFrame:
    """(run_id, sse, mae, max_error) of trajectories (run_id, var, t, value) against observations (var, t, value).

    A run counts for the observed variables that it has; one that has none has no row.
    """
    asked = simulated.select("run_id", "var").distinct().join(observed.select("var", "t"), "var")
    at = interpolated(simulated, asked, ["run_id", "var"])
    both = at.join(observed.select("var", "t", F.col("value").alias("seen")), ["var", "t"])
    d = F.col("value") - F.col("seen")
    return both.groupBy("run_id").agg(F.sum(d * d).alias("sse"), F.avg(F.abs(d)).alias("mae"), F.max(F.abs(d)).alias("max_error"))


def runs_table(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    """Sample rows as a table; text and whole-number columns keep their kinds."""
    return spark.createDataFrame(rows, columns)
