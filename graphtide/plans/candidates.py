"""One query answered for many candidates at once: the candidate's number goes through joins and aggregates.

A query may use the candidates' parameters as variables that it doesn't bind itself. Every group of patterns
is met with the candidates, so filters, optional parts and subqueries see each candidate's values, parts
join within a candidate, and aggregates are made for each. A population is then one job, not one job each.

Where a grouped query meets its parameters only in comparisons at its end and in counts and sums, rows that no
candidate can tell apart are put together first. What meets the candidates then has a row for each group and
each interval between neighbouring parameters, however many rows the graph has.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass, fields, is_dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtide.functions import terms as T
from graphtide.operators import optimise
from graphtide.plans.sparql import Compiler, parsed
from graphtide.plans.sparql_parser import AGGREGATES, Expr, Node, Query

#: Candidates of a block, which is sent to all tasks; more come in further blocks.
BLOCK = 10_000
RUN = "run_id"


_COMPARED = {"<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}
_FLIPPED = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}


def _aggregates(e) -> list[Expr]:
    if not isinstance(e, Expr):
        return []
    return [e] if e.op in AGGREGATES else [x for a in e.args for x in _aggregates(a)]


def _mentions(x, names: set[str]) -> bool:
    """Whether a part of a query has any of the names in it."""
    if isinstance(x, str):
        return x in names
    if is_dataclass(x):
        return any(_mentions(getattr(x, f.name), names) for f in fields(x))
    return isinstance(x, list | tuple) and any(_mentions(y, names) for y in x)


def _conjuncts(e: Expr) -> list[Expr]:
    return [x for a in e.args for x in _conjuncts(a)] if e.op == "&&" else [e]


@dataclass
class _Condensed:
    """A query whose parameters are only compared at its end: what is left without them, (value, operator,
    parameter) of each comparison, and (aggregate, operand, sign, parameter) of each aggregate."""

    base: Node
    tests: list[tuple]
    found: list[tuple]


def _condensed(q: Query, params: set[str]) -> _Condensed | None:
    """The query in that form, or None where it has another one."""
    base, conditions = q.where, []
    while base.kind == "filter":
        conditions += _conjuncts(base.value)
        base = base.parts[0]
    tests, found = [], []
    for e in conditions:
        if not _mentions(e, params):
            base = Node("filter", [base], e)
            continue
        if e.op not in _COMPARED:
            return None
        (a, b), op = e.args, e.op
        if a.op == "VAR" and a.args[0] in params:
            a, b, op = b, a, _FLIPPED[op]
        if b.op != "VAR" or b.args[0] not in params or _mentions(a, params):
            return None
        tests.append((a, op, b.args[0]))
    if _mentions(base, params) or q.distinct or _mentions(q.group, params):
        return None
    for e in [x for y in [*[e for _, e in q.columns or []], *q.having, *[e for e, _ in q.order]] for x in _aggregates(y)]:
        distinct, *args = e.args
        sign = param = None
        if distinct or e.op not in ("COUNT", "SUM") or len(args) > 1 or (e.op == "SUM" and not args):
            return None
        arg = args[0] if args else None
        if e.op == "SUM" and arg.op in ("+", "-") and len(arg.args) == 2 and arg.args[1].op == "VAR" and arg.args[1].args[0] in params:
            sign, param, arg = (1 if arg.op == "+" else -1), arg.args[1].args[0], arg.args[0]
        if arg is not None and _mentions(arg, params):
            return None
        found.append((e.op, arg, sign, param))
    return _Condensed(base, tests, found)


def _cell(cuts: np.ndarray):
    """The place of a number among sorted ones: odd for one of them, even between two."""

    @F.pandas_udf("int")
    def place(v: pd.Series) -> pd.Series:
        x = v.to_numpy()
        return pd.Series((np.searchsorted(cuts, x, "left") + np.searchsorted(cuts, x, "right")).astype(np.int32))

    return place


class _ForCandidates(Compiler):
    """Compiles a query whose solutions all carry a candidate's number and parameters."""

    def __init__(self, graph, candidates: DataFrame, cuts: dict[str, np.ndarray], strict: bool = False):
        super().__init__(graph, strict)
        self.candidates, self.carried, self.cuts = candidates, candidates.columns, cuts

    def whole(self, q: Query) -> DataFrame:
        """The query's solutions, by way of rows that are put together where its form allows that."""
        grouped = q.group or any(_aggregates(e) for _, e in q.columns or []) or any(map(_aggregates, q.having))
        form = _condensed(q, set(self.carried)) if grouped and q.columns is not None and q.limit is None and not q.offset else None
        return self.select(q) if form is None else self.together(q, form)

    def together(self, q: Query, form: _Condensed) -> DataFrame:
        rows, _, _ = Compiler(self.graph, self.strict).node(form.base)
        env = {c: F.col(c) for c in rows.columns}
        keys, cells = [f"_key{i}" for i in range(len(q.group))], [f"_cell{i}" for i in range(len(form.tests))]
        made = {k: T.key(env[g]) if g in env else F.lit(None).cast("string") for k, g in zip(keys, q.group, strict=True)}
        made |= {f"_term{i}": env.get(g, F.lit(None).cast(T.TERM)) for i, g in enumerate(q.group)}
        for i, (a, _, _) in enumerate(form.tests):
            t = self.value(a, env)
            made[f"_v{i}"] = F.when(t.isNotNull(), T._num(t)).otherwise(F.lit(0.0))
        sums = [F.count(F.lit(1)).alias("_rows")]
        for i, (op, arg, _, param) in enumerate(form.found):
            if arg is None:
                continue
            t = self.value(arg, env)
            made[f"_x{i}"] = T.key(t).isNotNull() if op == "COUNT" else t["num"] if param is None else F.when(t.isNotNull(), T._num(t))
            sums += [F.count_if(f"_x{i}").alias(f"_n{i}")] if op == "COUNT" else [F.sum(f"_x{i}").alias(f"_s{i}"), F.count(f"_x{i}").alias(f"_n{i}")]
        rows = rows.select(*[c.alias(n) for n, c in made.items()])
        for i, (_, _, param) in enumerate(form.tests):
            rows = rows.withColumn(cells[i], _cell(self.cuts[param])(F.col(f"_v{i}")))
        terms = [f"_term{i}" for i in range(len(keys))]
        # All values of a cell compare alike with every candidate's, so one of them stands for it.
        rows = rows.groupBy(*keys, *cells).agg(*[F.min(f"_v{i}").alias(f"_v{i}") for i in range(len(cells))], *[F.min(t).alias(t) for t in terms], *sums)
        rows = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)
        each = self.candidates.select(*[F.col(c)["num"].alias(f"_p_{c}") for c in self.carried])
        met = rows.drop(*terms).crossJoin(F.broadcast(each))
        for i, (_, op, param) in enumerate(form.tests):
            met = met.where(_COMPARED[op](F.col(f"_v{i}"), F.col(f"_p_{param}")))
        out = [F.sum("_rows").alias("_rows")]
        for i, (op, arg, sign, param) in enumerate(form.found):
            n = F.col("_rows" if arg is None else f"_n{i}")
            out.append((F.sum(n) if op == "COUNT" else F.sum(f"_s{i}") if param is None else F.sum(F.col(f"_s{i}") + sign * n * F.col(f"_p_{param}"))).alias(f"_agg{i}"))
        got = met.groupBy(f"_p_{RUN}", *keys).agg(*out)
        if keys:
            names = rows.groupBy(*[F.col(k).alias(f"_r{k}") for k in keys]).agg(*[F.min(t).alias(g) for t, g in zip(terms, q.group, strict=True)])
            got = got.join(names, [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in keys])
        got = got.join(F.broadcast(self.candidates), F.col(f"_p_{RUN}") == F.col(RUN)["num"])
        got = got.select(*self.carried, *q.group, F.lit(1).alias("_one"), *[T.number(F.col(f"_agg{i}")).alias(f"_agg{i}") for i in range(len(form.found))])
        found: list = []
        columns = [*[(c, None) for c in self.carried], *[(n, e if e is None else self._named(e, found)) for n, e in q.columns if n not in self.carried]]
        having, order = [self._named(e, found) for e in q.having], [(self._named(e, found), up) for e, up in q.order]
        for e in having:
            got = got.where(self.keep(self.expr(e)(got)))
        for n, e in columns:
            if e is not None:
                got = got.withColumn(n, self.expr(e)(got))
            elif n not in got.columns:
                got = got.withColumn(n, F.lit(None).cast(T.TERM))
        by = self.order(got, order)
        return (got.orderBy(*by) if by else got).select(*[n for n, _ in columns])

    def _named(self, e: Expr, found: list) -> Expr:
        """Replaces the aggregates by variables for their results, numbered as they come."""
        if e.op in AGGREGATES:
            found.append(e)
            return Expr("VAR", [f"_agg{len(found) - 1}"])
        return Expr(e.op, [self._named(a, found) if isinstance(a, Expr) else a for a in e.args])

    def bgp(self, patterns):
        rows, names = super().bgp(patterns)
        bound = [c for c in self.carried if c in names]
        if bound:
            raise ValueError(f"patterns bind the parameters {bound}; compare them in a filter")
        return rows.crossJoin(F.broadcast(self.candidates)), names | set(self.carried)

    def select(self, q: Query) -> DataFrame:
        if q.limit is not None or q.offset:
            raise ValueError("a limit would count the rows of all candidates together")

        grouped = bool(q.group) or any(_aggregates(e) for _, e in q.columns or []) or any(map(_aggregates, q.having))
        columns = None if q.columns is None else [*[(c, None) for c in self.carried], *[x for x in q.columns if x[0] not in self.carried]]
        return super().select(replace(q, columns=columns, group=[*self.carried, *q.group] if grouped else q.group))


def answers(graph, text: str, points: list[dict[str, float]], strict: bool = False) -> DataFrame:
    """(run_id, the query's columns): the solutions of a SELECT query for each candidate.

    points: a dictionary of numbers for each candidate, all with the same names; the place in the list is the
    candidate's run_id. A candidate without a solution has no row.
    """
    return _answers(graph, parsed(text), points, strict)


def _answers(graph, q: Query, points: list[dict[str, float]], strict: bool = False) -> DataFrame:
    if q.form != "select":
        raise ValueError("candidates need a SELECT query")
    spark: SparkSession = graph.spark
    names = sorted(points[0]) if points else []
    out = None
    for at in range(0, max(len(points), 1), BLOCK):
        block = [(at + i, *[float(p[n]) for n in names]) for i, p in enumerate(points[at : at + BLOCK])]
        table = spark.createDataFrame(block, ", ".join([f"{RUN} long", *[f"`{n}` double" for n in names]]))
        terms = table.select(T.number(F.col(RUN)).alias(RUN), *[T.number(F.col(n)).alias(n) for n in names])
        cuts = {n: np.unique(np.array([p[1 + i] for p in block])) for i, n in enumerate(names)}
        rows = _ForCandidates(graph, terms, cuts, strict).whole(q)
        rows = rows.select(F.col(RUN)["num"].cast("long").alias(RUN), *[F.col(c) for c in rows.columns if c not in (RUN, *names)])
        out = rows if out is None else out.unionByName(rows)
    return out


def objective(graph, text: str, names: list[str], value: str, missing: float = float("inf")):
    """A function for the optimisers: points (a row each) to the numbers that a query gives them, in one job a call."""

    def f(x: np.ndarray) -> np.ndarray:
        rows = answers(graph, text, [dict(zip(names, map(float, p), strict=True)) for p in x]).groupBy(RUN).agg(F.min(F.col(value)["num"]).alias("y")).collect()
        found = {r[RUN]: r["y"] for r in rows}
        return np.array([missing if found.get(i) is None else found[i] for i in range(len(x))])

    return f


def kb_optimize(graph, text: str, value: str, bounds: dict[str, tuple[float, float]], maximise: bool = False, size: int = 24, rounds: int = 25, seed: int = 42) -> tuple[dict[str, float], float]:
    """The parameters within their bounds for which a query's number is smallest, or largest; each generation is one job."""
    names, sign = list(bounds), -1.0 if maximise else 1.0
    f = objective(graph, text, names, value, float("inf") * sign)
    x, y = optimise.evolve(lambda p: sign * f(p), [bounds[n] for n in names], size, rounds, seed)
    return dict(zip(names, map(float, x), strict=True)), sign * y


def kb_calibrate(graph, text: str, predicted: str, observed: str, bounds: dict[str, tuple[float, float]], size: int = 24, rounds: int = 25, seed: int = 42) -> tuple[dict[str, float], float]:
    """The parameters for which a query's predicted numbers are nearest to its observed ones, by the sum of squares."""
    names = list(bounds)

    def f(x: np.ndarray) -> np.ndarray:
        rows = answers(graph, text, [dict(zip(names, map(float, p), strict=True)) for p in x])
        d = F.col(predicted)["num"] - F.col(observed)["num"]
        found = {r[RUN]: r["y"] for r in rows.groupBy(RUN).agg(F.sum(d * d).alias("y")).collect()}
        return np.array([found.get(i, float("inf")) for i in range(len(x))])

    x, y = optimise.evolve(f, [bounds[n] for n in names], size, rounds, seed)
    return dict(zip(names, map(float, x), strict=True)), y


def grades(graph, texts: dict[str, str], points: list[dict[str, float]]) -> DataFrame:
    """(run_id, query, n): how many solutions each of several queries has for each candidate, 0 for none."""
    every = graph.spark.range(len(points)).withColumnRenamed("id", RUN)
    out = None
    for name, text in texts.items():
        q = parsed(text)
        if q.group or q.having or q.distinct or any(_aggregates(e) for _, e in q.columns or []) or q.limit is not None or q.offset:
            n = _answers(graph, q, points).groupBy(RUN).agg(F.count(F.lit(1)).alias("n"))
        else:
            n = _answers(graph, replace(q, columns=[("n", Expr("COUNT", [False]))], order=[]), points).select(RUN, F.col("n")["num"].cast("long").alias("n"))
        rows = every.join(n, RUN, "left").select(RUN, F.lit(name).alias("query"), F.coalesce("n", F.lit(0)).alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out
