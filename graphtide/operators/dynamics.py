"""Simulation of system-dynamics models: one run is one row of parameters.

``simulate_sql`` folds a model as native expressions (Euler or RK4, no pipelines or random numbers);
``simulate`` runs any model in Arrow batches, vectorised over the runs of a batch. Both give one long
table (run_id, step, t, var, kind, value) or, with ``last``, only each run's final values.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphtide.functions import registry
from graphtide.functions.expressions import Call, Draws, Op, to_column, to_numpy
from graphtide.sources.sysd import Model, System, lower

from . import scans

TRAJECTORY = "run_id long, step int, t double, var string, kind string, value double"


def _steps(model: Model) -> int:
    return int(np.ceil((model.end - model.start) / model.dt - 1e-9))


# ---------------------------------------------------------------- native


def _pure(e) -> bool:
    if isinstance(e, Call) and e.name in ("NOISE", "UNIFORM", "LOGNORMAL"):
        return False
    return all(map(_pure, e.args)) if isinstance(e, (Call, Op)) else True


def simulate_sql(model: Model, runs: DataFrame, method: str = "euler", last: bool = False) -> DataFrame:
    """Runs (run_id, a column for each parameter) as a fold over the steps, inside the JVM.

    The state of a step is a struct; stages and auxiliaries are bound by one-element transforms, so that none
    is computed twice. A column named like a stock sets its initial value.
    """
    system = lower(model)
    if system.pipelines or not all(_pure(e) for e in [*system.rates, *[e for _, e in system.auxes]]):
        raise ValueError("pipelines and random numbers need simulate()")
    given = set(runs.columns)
    n, dt, start = _steps(system.model), system.model.dt, system.model.start
    tables = system.model.tables

    def name(v: str) -> Column | None:
        if v in given:
            return F.col(f"`{v}`").cast("double")
        return F.lit(system.model.params[v]) if v in system.model.params else None

    def derivatives(state: dict[str, Column], t: Column, h: Column, use):
        """Binds the auxiliaries in order, then gives use(rates)."""

        def env(bound):
            def get(v):
                if v in bound:
                    return bound[v]
                if v in state:
                    return state[v]
                if v == "t":
                    return t
                if v == "dt":
                    return h
                c = name(v)
                return F.lit(0.0) if c is None else c

            return get

        def bind(left, bound):
            if not left:
                return use([to_column(r, env(bound), tables) for r in system.rates], bound)
            (aux, e), rest = left[0], left[1:]
            value = name(aux) if aux in given else to_column(e, env(bound), tables)
            return F.element_at(F.transform(F.array(value), lambda x: bind(rest, {**bound, aux: x})), 1)

        needed = [(a, e) for a, e in system.auxes]
        return bind(needed, {})

    fields = [f"s{i}" for i in range(len(system.states))]

    def state_of(x) -> dict[str, Column]:
        return {s: x[f] for s, f in zip(system.states, fields, strict=True)}

    def made(values) -> Column:
        return F.struct(*[v.cast("double").alias(f) for v, f in zip(values, fields, strict=True)])

    def let(value: Column, use) -> Column:
        return F.element_at(F.transform(F.array(value), use), 1)

    def step(x, i) -> Column:
        t = F.lit(start) + i * F.lit(dt)
        h = F.least(F.lit(dt), F.lit(system.model.end) - t)
        slope = lambda y, at: derivatives(state_of(y), at, h, lambda r, _: made(r))
        moved = lambda y, k, f: made([y[c] + k[c] * h * f for c in fields])
        if method == "euler":
            return let(slope(x, t), lambda k: moved(x, k, 1.0))
        half = t + h / 2
        return let(slope(x, t), lambda k1: let(slope(moved(x, k1, 0.5), half), lambda k2: let(slope(moved(x, k2, 0.5), half), lambda k3: let(slope(moved(x, k3, 1.0), t + h), lambda k4: made([x[c] + h * (k1[c] + 2 * k2[c] + 2 * k3[c] + k4[c]) / 6 for c in fields])))))

    first = made([F.coalesce(F.col(f"`{s}`").cast("double"), F.lit(i)) if s in given else F.lit(i) for s, i in zip(system.states, system.initial, strict=True)])
    index = F.sequence(F.lit(0), F.lit(n - 1))
    kinds = system.stocks
    if last:
        out = runs.select("run_id", F.aggregate(index, first, step).alias("x"))
        return out.select("run_id", F.lit(n).alias("step"), F.lit(system.model.end).alias("t"), F.explode(F.array(*[F.struct(F.lit(s).alias("var"), F.lit("stock").alias("kind"), F.col("x")[f].alias("value")) for s, f in zip(kinds, fields, strict=False)])).alias("v")).select("run_id", "step", "t", "v.*")
    folded = F.aggregate(index, F.array(first), lambda acc, i: F.array_append(acc, step(F.element_at(acc, -1), i)))
    out = runs.select("run_id", F.posexplode(folded).alias("step", "x"))
    t = F.least(F.lit(start) + F.col("step") * F.lit(dt), F.lit(system.model.end))
    return out.select("run_id", "step", t.alias("t"), F.explode(F.array(*[F.struct(F.lit(s).alias("var"), F.lit("stock").alias("kind"), F.col("x")[f].alias("value")) for s, f in zip(kinds, fields, strict=False)])).alias("v")).select("run_id", "step", "t", "v.*")


# ---------------------------------------------------------------- batches of runs


class Emergent:
    """A switch on a condition: while it holds, a quantity is multiplied, added to or set."""

    def __init__(self, condition: str, target: str, how: str, value: float):
        if how not in ("MULTIPLY", "ADD", "SET"):
            raise ValueError(how)
        self.condition, self.target, self.how, self.value = condition, target, how, value

    def apply(self, x, on):
        changed = x * self.value if self.how == "MULTIPLY" else x + self.value if self.how == "ADD" else np.full_like(np.asarray(x, float), self.value)
        return np.where(on, changed, x)


class Worker:
    """A compiled system that runs many parameter sets at once."""

    def __init__(self, system: System, functions: dict | None = None, emergent: list[Emergent] | None = None):
        from graphtide.functions.expressions import parse

        self.system = system
        tables = system.model.tables
        self.auxes = [(n, to_numpy(e, tables, functions)) for n, e in system.auxes]
        self.rates = [to_numpy(e, tables, functions) for e in system.rates]
        self.pipes = [(system.states.index(p.state), to_numpy(p.input, tables, functions), to_numpy(p.delay, tables, functions), None if p.batch is None else to_numpy(p.batch, tables, functions)) for p in system.pipelines]
        self.emergent = [(e, to_numpy(parse(e.condition), tables, functions)) for e in emergent or []]

    def read(self, t: float, h: float, y: list, params: dict) -> dict:
        env = {**self.system.model.params, **params, **dict(zip(self.system.states, y, strict=True)), "t": t, "dt": h}
        for name, f in self.auxes:
            if name not in params:
                env[name] = f(env)
        for e, condition in self.emergent:
            on = np.not_equal(condition(env), 0)
            if e.target in env:
                env[e.target] = e.apply(env[e.target], on)
        return env

    def slopes(self, t, h, y, params):
        env = self.read(t, h, y, params)
        return [f(env) for f in self.rates]

    def run(self, params: dict[str, np.ndarray], runs: np.ndarray, method: str = "euler", seed: int = 42, hook=None):
        """Yields (step, t, environment) from the first step on. hook(step, t, h, environment) may give more names."""
        m, n = self.system.model, len(runs)
        y = [np.array(params[s], float) if s in params else np.full(n, float(i)) for s, i in zip(self.system.states, self.system.initial, strict=True)]
        params = {k: v for k, v in params.items() if k not in self.system.states} | {"_draws": Draws(runs, seed)}
        held = [[deque() for _ in range(n)] for _ in self.pipes]
        store = [np.zeros(n) for _ in self.pipes]
        t, steps = m.start, _steps(m)
        with np.errstate(all="ignore"):
            for k in range(steps + 1):
                h = min(m.dt, m.end - t) if k < steps else m.dt
                if hook:
                    params = params | hook(k, t, h, self.read(t, h, y, params))
                yield k, t, self.read(t, h, y, params)
                if k == steps:
                    return
                move = lambda a, b, f: [p + q * f for p, q in zip(a, b, strict=True)]
                if method == "euler":
                    y = move(y, self.slopes(t, h, y, params), h)
                else:
                    a = self.slopes(t, h, y, params)
                    b = self.slopes(t + h / 2, h, move(y, a, h / 2), params)
                    c = self.slopes(t + h / 2, h, move(y, b, h / 2), params)
                    d = self.slopes(t + h, h, move(y, c, h), params)
                    y = [p + h * (i + 2 * j + 2 * q + r) / 6 for p, i, j, q, r in zip(y, a, b, c, d, strict=True)]
                y = [np.broadcast_to(np.asarray(v, float), (n,)).copy() for v in y]
                t = m.end if k == steps - 1 else t + h
                if self.pipes:
                    self._deliver(t, h, y, params, held, store)

    def _deliver(self, t, h, y, params, held, store) -> None:
        """Pipelines take in and give out once a step; of what is due, the last comes out (batches: their sum)."""
        n = len(y[0])
        for j, (at, source, delay, batch) in enumerate(self.pipes):
            env = self.read(t, h, y, params)
            value, wait = (np.broadcast_to(np.asarray(f(env), float), (n,)) for f in (source, delay))
            size = None if batch is None else np.maximum(np.broadcast_to(np.asarray(batch(env), float), (n,)), 0.1)
            for i in range(n):
                line, out = held[j][i], 0.0
                if size is None:
                    line.append((t + max(0.0, wait[i]), value[i]))
                else:
                    store[j][i] += value[i] * h
                    whole = np.floor(store[j][i] / size[i]) * size[i]
                    if whole > 0:
                        store[j][i] -= whole
                        line.append((t + max(0.0, wait[i]), whole))
                while line and line[0][0] <= t + 1e-12:
                    due = line.popleft()[1]
                    out = due if size is None else out + due
                y[at][i] = out


def simulate(model: Model, runs: DataFrame, method: str = "euler", last: bool = False, auxes: bool = False, functions: dict | None = None, emergent: list[Emergent] | None = None, seed: int = 42) -> DataFrame:
    """Runs of any model, vectorised over each batch of rows; random numbers depend on run_id alone.

    functions: more scalar functions, over numpy arrays. A null parameter takes the model's own value.
    """
    system = lower(model)
    functions = {**registry.MODEL, **(functions or {})}

    def go(batches):
        worker = Worker(system, functions, emergent)
        for pdf in batches:
            if not len(pdf):
                continue
            ids = pdf["run_id"].to_numpy(np.int64)
            params = {}
            for c in pdf.columns:
                if c != "run_id":
                    x = pdf[c].to_numpy(float)
                    if np.isnan(x).any():
                        default = dict(zip(system.states, system.initial, strict=True)) | system.model.params
                        x = np.where(np.isnan(x), default.get(c, 0.0), x)
                    params[c] = x
            wanted = [(s, "stock") for s in system.stocks] + ([(n, "aux") for n, _ in system.auxes] if auxes else [])
            final = _steps(system.model)
            parts = []
            for k, t, env in worker.run(params, ids, method, seed):
                if last and k < final:
                    continue
                for v, kind in wanted:
                    parts.append(pd.DataFrame({"run_id": ids, "step": np.int32(k), "t": t, "var": v, "kind": kind, "value": np.broadcast_to(np.asarray(env[v], float), ids.shape)}))
                if len(parts) > 200:
                    yield pd.concat(parts)
                    parts = []
            if parts:
                yield pd.concat(parts)

    numeric = [f.name for f in runs.schema if f.dataType.typeName() not in ("string", "boolean")]
    return runs.select(*[f"`{c}`" for c in numeric]).mapInPandas(go, TRAJECTORY)


def ensemble(spark, ranges: dict[str, tuple[float, float]], n: int, kind: str = "uniform", seed: int = 42) -> DataFrame:
    """(run_id, parameters) of n samples: uniform, normal (mean of the range, a quarter of it as deviation) or
    lognormal (mu the log of the low end, sigma a third of the logs' difference)."""
    u = lambda i, j: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("run_id"), F.lit(i), F.lit(j)), 11).cast("double") + 0.5) / F.lit(2.0**53)
    cols = []
    for i, (name, (low, high)) in enumerate(ranges.items()):
        z = F.sqrt(-2 * F.ln(u(i, 0))) * F.cos(2 * np.pi * u(i, 1))
        if kind == "uniform":
            c = F.lit(low) + u(i, 0) * (high - low)
        elif kind == "normal":
            c = F.lit((low + high) / 2) + z * ((high - low) / 4)
        else:
            c = F.exp(F.lit(np.log(low)) + z * ((np.log(high) - np.log(low)) / 3))
        cols.append(c.alias(name))
    return spark.range(n).withColumnRenamed("id", "run_id").select("run_id", *cols)


def bands(trajectories: DataFrame, shares: tuple[float, float] = (0.05, 0.95)) -> DataFrame:
    """(step, t, var, mean, std, low, high) over runs; std is the sample's, 0 for one run; low and high are the
    values at place int(share * n) of the sorted runs."""
    by = ["step", "t", "var"]
    place = lambda q: lambda n: F.least(F.floor(n * q), n - 1)
    ends = scans.at_places(trajectories, by, "value", {"low": place(shares[0]), "high": place(shares[1])})
    means = trajectories.groupBy(*by).agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))
    return means.join(ends, by, "left").select(*by, "mean", "std", "low", "high")


def wide(trajectories: DataFrame, stocks: list[str]) -> DataFrame:
    """A column for each stock, as the exported files have it."""
    return trajectories.groupBy("run_id", "step", F.col("t").alias("time")).pivot("var", stocks).agg(F.first("value"))


def transitions(trajectories: DataFrame, var: str, threshold: float) -> DataFrame:
    """(run_id, step, t, up): the steps at which a quantity crosses a threshold."""
    from pyspark.sql import Window

    w = Window.partitionBy("run_id").orderBy("step")
    on = F.col("value") > threshold
    return trajectories.where(F.col("var") == var).withColumn("on", on).withColumn("before", F.lag("on").over(w)).where("before is not null and on <> before").select("run_id", "step", "t", F.col("on").alias("up"))
