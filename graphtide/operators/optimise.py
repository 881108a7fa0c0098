"""Small numeric optimisation on the driver, with the costly part, the simulations, as one Spark job per generation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass
class LinearResult:
    x: np.ndarray | None
    objective: float | None
    status: str


def lp_minimize(c, a_ub=None, b_ub=None, a_eq=None, b_eq=None, bounds=None) -> LinearResult:
    """min c x with a_ub x <= b_ub, a_eq x = b_eq and bounds (default x >= 0), by a two-phase tableau with Bland's rule."""
    c = np.asarray(c, float)
    n = len(c)
    bounds = bounds or [(0, None)] * n
    low = np.array([b[0] if b[0] is not None else -np.inf for b in bounds], float)
    free = np.isinf(low)
    shift = np.where(free, 0.0, low)
    columns = np.concatenate((np.eye(n), -np.eye(n)[:, free]), axis=1)  # x = columns y + shift, y >= 0
    rows, right, kinds = [], [], []

    def add(row, b, kind):
        row = np.asarray(row, float)
        rows.append(row @ columns)
        right.append(float(b) - row @ shift)
        kinds.append(kind)

    for row, b in zip(a_ub if a_ub is not None else [], b_ub if b_ub is not None else [], strict=True):
        add(row, b, "<=")
    for row, b in zip(a_eq if a_eq is not None else [], b_eq if b_eq is not None else [], strict=True):
        add(row, b, "=")
    for i, (_, up) in enumerate(bounds):
        if up is not None:
            add(np.eye(n)[i], up, "<=")
    m, k = len(rows), columns.shape[1]
    slack = sum(x == "<=" for x in kinds)
    t = np.zeros((m, k + slack + m + 1))
    s = 0
    for i, (row, b, kind) in enumerate(zip(rows, right, kinds, strict=True)):
        t[i, :k], t[i, -1] = row, b
        if kind == "<=":
            t[i, k + s] = 1
            s += 1
        if b < 0:
            t[i] = -t[i]
        t[i, k + slack + i] = 1
    basis = [k + slack + i for i in range(m)]

    def run(cost, allowed):
        for _ in range(20_000):
            reduced = cost[:-1] - cost[basis] @ t[:, :-1]
            enter = next((j for j in range(allowed) if reduced[j] < -1e-9), None)
            if enter is None:
                return "optimal"
            ratios = [(t[i, -1] / t[i, enter], basis[i], i) for i in range(m) if t[i, enter] > 1e-9]
            if not ratios:
                return "unbounded"
            least = min(r[0] for r in ratios)
            _, _, out = min((r[1], r[0], r[2]) for r in ratios if r[0] <= least + 1e-12)
            t[out] /= t[out, enter]
            for i in range(m):
                if i != out:
                    t[i] -= t[i, enter] * t[out]
            basis[out] = enter
        return "stopped"

    artificial = np.concatenate((np.zeros(k + slack), np.ones(m), [0.0]))
    run(artificial, k + slack)
    if artificial[basis] @ t[:, -1] > 1e-7:
        return LinearResult(None, None, "infeasible")
    cost = np.concatenate((c @ columns, np.zeros(slack + m + 1)))
    status = run(cost, k + slack)
    if status != "optimal":
        return LinearResult(None, None, status)
    y = np.zeros(k + slack + m)
    y[basis] = t[:, -1]
    x = columns @ y[:k] + shift
    return LinearResult(x, float(c @ x), "optimal")


def lp_maximize(c, **kw) -> LinearResult:
    r = lp_minimize(-np.asarray(c, float), **kw)
    return LinearResult(r.x, None if r.objective is None else -r.objective, r.status)


def kb_lp(graph, costs: str, limits: str, maximize: bool = False) -> LinearResult:
    """A linear programme from queries: costs gives ?v ?c (and ?low ?high), limits gives ?row ?v ?a ?b, in name order."""
    from graphtide.plans.sparql import flat, query

    def read(text, **wanted):
        rows = query(graph, text)
        return flat(rows, **{k: v for k, v in wanted.items() if k in rows.columns}).collect()

    cs = sorted(read(costs, v="lex", c="num", low="num", high="num"), key=lambda r: r["v"])
    names = [r["v"] for r in cs]
    of = lambda r, k: r[k] if k in r.asDict() else None
    ls = read(limits, row="lex", v="lex", a="num", b="num")
    ids = sorted({r["row"] for r in ls})
    a, b = np.zeros((len(ids), len(names))), np.zeros(len(ids))
    for r in ls:
        a[ids.index(r["row"]), names.index(r["v"])] = r["a"]
        b[ids.index(r["row"])] = r["b"]
    bounds = [(of(r, "low") or 0.0, of(r, "high")) for r in cs]
    return (lp_maximize if maximize else lp_minimize)([r["c"] for r in cs], a_ub=a, b_ub=b, bounds=bounds)


#: A batch objective: points as rows -> their values. Give one that simulates all rows in one Spark job.
Batch = Callable[[np.ndarray], np.ndarray]


def evolve(f: Batch, bounds: list[tuple[float, float]], size: int = 30, rounds: int = 60, seed: int = 42) -> tuple[np.ndarray, float]:
    """Differential evolution; each generation is one call of f."""
    rng = np.random.default_rng(seed)
    low, high = np.array(bounds, float).T
    x = low + rng.random((size, len(low))) * (high - low)
    y = f(x)
    for _ in range(rounds):
        pick = np.array([rng.permutation([j for j in range(size) if j != i])[:3] for i in range(size)])
        trial = np.clip(x[pick[:, 0]] + 0.7 * (x[pick[:, 1]] - x[pick[:, 2]]), low, high)
        keep = rng.random(x.shape) > 0.8
        keep[np.arange(size), rng.integers(0, len(low), size)] = False
        trial = np.where(keep, x, trial)
        z = f(trial)
        better = z <= y
        x[better], y[better] = trial[better], z[better]
        if np.ptp(y) < 1e-12:
            break
    return x[y.argmin()], float(y.min())


def nelder_mead(f: Batch, start: np.ndarray, rounds: int = 400, tolerance: float = 1e-10) -> tuple[np.ndarray, float]:
    """The simplex search; a round's candidate points are evaluated together."""
    n = len(start)
    x = np.vstack([start, *[start + np.eye(n)[i] * (0.05 * abs(start[i]) or 0.00025) for i in range(n)]])
    y = f(x)
    for _ in range(rounds):
        order = y.argsort(kind="stable")
        x, y = x[order], y[order]
        if abs(y[-1] - y[0]) < tolerance:
            break
        mid = x[:-1].mean(axis=0)
        away = mid - x[-1]
        tries = np.stack([mid + away, mid + 2 * away, mid + 0.5 * away, mid - 0.5 * away])
        z = f(tries)
        if z[0] < y[0]:
            best = 1 if z[1] < z[0] else 0
        elif z[0] < y[-2]:
            best = 0
        else:
            best = 2 if z[0] < y[-1] else 3
            if z[best] >= min(z[0], y[-1]):
                x[1:] = x[0] + 0.5 * (x[1:] - x[0])
                y[1:] = f(x[1:])
                continue
        x[-1], y[-1] = tries[best], z[best]
    return x[y.argmin()], float(y.min())


def least_squares(residuals: Callable[[np.ndarray], np.ndarray], start: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Levenberg-Marquardt; residuals maps points (rows) to residual vectors (rows), the differences' points too."""
    x, damp = np.asarray(start, float), 1e-2
    r = residuals(x[None])[0]
    for _ in range(rounds):
        h = 1e-6 * np.maximum(np.abs(x), 1e-3)
        j = ((residuals(x[None] + np.diag(h)) - r) / h[:, None]).T
        step = np.linalg.solve(j.T @ j + damp * np.diag(np.maximum(np.diag(j.T @ j), 1e-12)), -j.T @ r)
        new = residuals((x + step)[None])[0]
        if new @ new < r @ r:
            done = np.abs(step).max() < 1e-12
            x, r, damp = x + step, new, damp / 3
            if done:
                break
        else:
            damp *= 4
    return x


def penalised(f: Batch, constraints: list[Callable[[np.ndarray], np.ndarray]], bounds: list[tuple[float, float]], weight: float = 1e4) -> Batch:
    """f on points clamped to their bounds, plus a penalty for what a constraint (<= 0 is met) exceeds."""
    low, high = np.array(bounds, float).T

    def g(x):
        x = np.clip(x, low, high)
        return f(x) + weight * sum(np.maximum(0.0, c(x)) ** 2 for c in constraints)

    return g


def fronts(y: np.ndarray) -> np.ndarray:
    """The number of each point's front, 0 for those that none dominates (smaller is better)."""
    dominates = (y[:, None] <= y[None]).all(axis=2) & (y[:, None] < y[None]).any(axis=2)
    out, left, k = np.full(len(y), -1), np.ones(len(y), bool), 0
    while left.any():
        now = left & ~(dominates & left[:, None]).any(axis=0)
        out[now], k = k, k + 1
        left &= ~now
    return out


def crowding(y: np.ndarray) -> np.ndarray:
    d = np.zeros(len(y))
    for j in range(y.shape[1]):
        order = y[:, j].argsort(kind="stable")
        span = y[order[-1], j] - y[order[0], j] or 1.0
        d[order[[0, -1]]] = np.inf
        d[order[1:-1]] += (y[order[2:], j] - y[order[:-2], j]) / span
    return d


def nsga2(f: Batch, bounds: list[tuple[float, float]], size: int = 30, rounds: int = 40, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The first front's points and objectives; each generation is one call of f."""
    rng = np.random.default_rng(seed)
    low, high = np.array(bounds, float).T
    x = low + rng.random((size, len(low))) * (high - low)
    y = f(x)
    for _ in range(rounds):
        rank, space = fronts(y), crowding(y)
        a, b = rng.integers(0, len(x), (2, 2, size))
        pick = [np.where((rank[i] < rank[j]) | ((rank[i] == rank[j]) & (space[i] > space[j])), i, j) for i, j in (a, b)]
        p, q = x[pick[0]], x[pick[1]]
        wide = 0.5 * np.abs(p - q)
        child = np.minimum(p, q) - wide + rng.random(p.shape) * (np.abs(p - q) + 2 * wide)
        child += (rng.random(p.shape) < 0.1) * rng.normal(0, 0.1, p.shape) * (high - low)
        child = np.clip(child, low, high)
        x, y = np.vstack((x, child)), np.vstack((y, f(child)))
        rank, space = fronts(y), crowding(y)
        keep = np.lexsort((-space, rank))[:size]
        x, y = x[keep], y[keep]
    best = fronts(y) == 0
    return x[best], y[best]


def calibrate(simulate: Callable, observed, bounds: dict[str, tuple[float, float]], metric: str = "sse", method: str = "evolution", seed: int = 42) -> tuple[dict[str, float], float]:
    """Parameters whose simulation is nearest to the observations. simulate: table of runs -> trajectories."""
    from .analysis import errors, runs_table

    names, spark = list(bounds), observed.sparkSession

    def f(points):
        runs = runs_table(spark, [(i, *map(float, p)) for i, p in enumerate(points)], ["run_id", *names])
        found = {r["run_id"]: r[metric] for r in errors(simulate(runs), observed).collect()}
        return np.array([found[i] for i in range(len(points))])

    box = [bounds[n] for n in names]
    if method == "evolution":
        x, y = evolve(f, box, 12, 12, seed)
    else:
        x, y = nelder_mead(f, np.array([(a + b) / 2 for a, b in box]), 60)
    return dict(zip(names, map(float, x), strict=True)), y
