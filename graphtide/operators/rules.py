"""Production rules: conditions over a graph, actions, and a log of what was done.

A rule's conditions are evaluated as sets: every match is a row of bindings, and an action runs once for
all of them. ``first_only`` gives the one-match-at-a-time behaviour, with the first match in a fixed order.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphtide.functions import terms as T
from graphtide.plans.sparql import Compiler, parsed, query
from graphtide.plans.sparql_parser import Const, Pattern, Var

from .closure import settle
from .events import EXECUTIONS
from .graph import Graph, dealt

_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    ">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
}


def _term(x):
    if isinstance(x, str):
        return Var(x[1:]) if x.startswith("?") else Const(T.IRI, x)
    dt = "boolean" if isinstance(x, bool) else "integer" if isinstance(x, int) else "double"
    return Const(T.LITERAL, str(x).lower(), T.XSD + dt)


def _join(graph: Graph, bindings: DataFrame, rows: DataFrame, how: str = "inner") -> DataFrame:
    c = Compiler(graph)
    a, b = set(bindings.columns) - {"_one"}, set(rows.columns) - {"_one"}
    if how == "left_anti" and not a & b:
        return bindings.limit(0) if rows.limit(1).count() else bindings
    return c.join(bindings, rows, a, b, set(), set(), how)


class Condition:
    """Subclasses turn bindings into the bindings that satisfy them."""

    def match(self, graph: Graph, bindings: DataFrame) -> DataFrame:
        raise NotImplementedError


@dataclass
class TripleCondition(Condition):
    s: object
    p: object
    o: object

    def match(self, graph, bindings):
        return _join(graph, bindings, Compiler(graph).pattern(Pattern(_term(self.s), _term(self.p), _term(self.o))))


@dataclass
class QueryCondition(Condition):
    """A SELECT or ASK query with at least ``least`` results; SELECT results are bindings."""

    text: str
    least: int = 1

    def match(self, graph, bindings):
        q = parsed(self.text)
        rows = query(graph, self.text)
        if q.form == "ask":
            return bindings if rows.first()[0] else bindings.limit(0)
        if self.least > 1 and rows.limit(self.least).count() < self.least:
            return bindings.limit(0)
        return _join(graph, bindings, rows)


@dataclass
class ComparisonCondition(Condition):
    """left op right, each a "?variable" or a number; what is no number counts as 0."""

    left: object
    op: str
    right: object

    def match(self, graph, bindings):
        def side(x):
            if isinstance(x, str) and x.startswith("?"):
                return F.coalesce(F.col(x[1:])["num"], F.lit(0.0)) if x[1:] in bindings.columns else F.lit(0.0)
            return F.lit(float(x)) if not isinstance(x, str) else F.lit(0.0)

        return bindings.where(_COMPARE[self.op](side(self.left), side(self.right)))


@dataclass
class AggregationCondition(Condition):
    """The first column of a query's first row if it is a number, else the number of rows, against a threshold."""

    text: str
    threshold: float
    op: str = ">"

    def match(self, graph, bindings):
        rows = query(graph, self.text)
        first = rows.select(F.col(rows.columns[0])["num"].alias("n")).limit(1).collect()
        value = first[0]["n"] if first and first[0]["n"] is not None else float(rows.count())
        ok = bindings.where(_COMPARE[self.op](F.lit(float(value)), F.lit(float(self.threshold))))
        return ok.withColumn("_agg_result", T.number(F.lit(float(value))))


@dataclass
class And(Condition):
    parts: list[Condition]

    def match(self, graph, bindings):
        for p in self.parts:
            bindings = p.match(graph, bindings)
        return bindings


@dataclass
class Or(Condition):
    """Bindings that satisfy any part, with what the first such part binds."""

    parts: list[Condition]

    def match(self, graph, bindings):
        left = settle(bindings.withColumn("_row", F.monotonically_increasing_id()))
        out = None
        for p in self.parts:
            found = settle(p.match(graph, left))
            out = found if out is None else out.unionByName(found, allowMissingColumns=True)
            left = left.join(found.select("_row"), "_row", "left_anti")
        return out.drop("_row")


@dataclass
class Not(Condition):
    part: Condition

    def match(self, graph, bindings):
        left = settle(bindings.withColumn("_row", F.monotonically_increasing_id()))
        return left.join(self.part.match(graph, left).select("_row"), "_row", "left_anti").drop("_row")


class Action:
    """Subclasses give the graph after the action and a message for each binding."""

    kind = "action"

    def run(self, graph: Graph, bindings: DataFrame) -> tuple[Graph, Column]:
        raise NotImplementedError


def _resolve(x, bindings: DataFrame) -> Column:
    t = _term(x)
    if isinstance(t, Const):
        return T.constant(t.kind, t.lex, t.dt)
    return F.col(t.name) if t.name in bindings.columns else F.lit(None).cast(T.TERM)


@dataclass
class TripleAction(Action):
    s: object
    p: object
    o: object
    graph: str = "default"
    kind = "triple"

    def run(self, graph, bindings):
        s, p, o = (_resolve(x, bindings) for x in (self.s, self.p, self.o))
        ok = s.isNotNull() & p.isNotNull() & o.isNotNull()
        rows = bindings.where(ok).select(s["lex"].alias("s"), s["kind"].alias("s_kind"), p["lex"].alias("p"), o.alias("o"))
        return graph.add(rows, self.graph), F.when(ok, F.lit("ok")).otherwise(F.lit("unresolved"))


@dataclass
class RetractAction(Action):
    s: object = None
    p: object = None
    o: object = None
    kind = "retract"

    def run(self, graph, bindings):
        rows = graph.quads
        wanted = [(n, _resolve(x, bindings)) for n, x in (("s", self.s), ("p", self.p), ("o", self.o)) if x is not None]
        doomed = bindings.select(*[T.key(c).alias(f"_{n}") for n, c in wanted])
        doomed = dealt(doomed, *doomed.columns).distinct()
        own = {"s": T.key(T.term(F.col("s_kind"), F.col("s"))), "p": T.key(T.term(T.IRI, F.col("p"))), "o": T.key(F.col("o"))}
        on = F.lit(True)
        for n, _ in wanted:
            on = on & (own[n] == F.col(f"_{n}"))
        return Graph(rows.join(doomed, on, "left_anti"), graph.functions), F.lit("ok")


@dataclass
class LogAction(Action):
    """A message in which ?name stands for a binding."""

    message: str
    kind = "log"

    def run(self, graph, bindings):
        out = F.lit(self.message)
        for name in sorted((c for c in bindings.columns if not c.startswith("_")), key=len, reverse=True):
            out = F.replace(out, F.lit(f"?{name}"), F.coalesce(F.col(name)["lex"], F.lit("")))
        return graph, out


@dataclass
class CallAction(Action):
    """Runs f(graph, bindings) -> (graph, message): simulations and bridges are such calls."""

    f: Callable[[Graph, DataFrame], tuple[Graph, str]]
    kind = "call"

    def run(self, graph, bindings):
        graph, message = self.f(graph, bindings)
        return graph, F.lit(message)


@dataclass
class Production:
    """Rules run by ascending priority; fire_once: a set of bindings fires once in the engine's life."""

    name: str
    conditions: list[Condition]
    actions: list[Action]
    priority: int = 0
    fire_once: bool = False
    max_fires: int | None = None
    first_only: bool = False


@dataclass
class Engine:
    """Evaluates productions over a graph; executions are rows of graphtide.operators.events.EXECUTIONS."""

    graph: Graph
    rules: list[Production] = field(default_factory=list)
    fired: dict[str, int] = field(default_factory=dict)
    executions: DataFrame | None = None
    _seen: dict[str, DataFrame] = field(default_factory=dict)

    def add_rule(self, r: Production) -> None:
        self.rules = sorted([x for x in self.rules if x.name != r.name] + [r], key=lambda x: x.priority)

    def remove_rule(self, name: str) -> None:
        self.rules = [x for x in self.rules if x.name != name]

    def get_rule(self, name: str) -> Production | None:
        return next((x for x in self.rules if x.name == name), None)

    def reset(self) -> None:
        self.fired, self._seen = {}, {}

    def matches(self, r: Production) -> DataFrame:
        """The bindings that satisfy all conditions of a rule."""
        return And(r.conditions).match(self.graph, self.graph.spark.range(1).select(F.lit(1).alias("_one")))

    def evaluate(self, now: float | None = None) -> DataFrame:
        """One pass over the rules; later rules see what earlier ones did. Gives the pass's executions."""
        now = time.time() if now is None else now
        passes = []
        for r in self.rules:
            room = None if r.max_fires is None else r.max_fires - self.fired.get(r.name, 0)
            if room is not None and room <= 0:
                continue
            found = self.matches(r)
            names = sorted(c for c in found.columns if not c.startswith("_"))
            shown = F.map_from_arrays(F.array(*[F.lit(n) for n in names]).cast("array<string>"), F.array(*[F.col(n)["lex"] for n in names]).cast("array<string>"))
            found = found.withColumn("_sign", F.concat_ws("\x1e", *[F.coalesce(T.key(F.col(n)), F.lit("")) for n in names]) if names else F.lit(""))
            if r.fire_once and r.name in self._seen:
                found = found.join(self._seen[r.name], "_sign", "left_anti")
            limit = 1 if r.first_only else room
            if limit is not None:
                found = found.orderBy("_sign").limit(limit if room is None else min(limit, room))
            found = settle(found)
            n = found.count()
            if not n:
                continue
            self.fired[r.name] = self.fired.get(r.name, 0) + n
            if r.fire_once:
                mine = found.select("_sign")
                self._seen[r.name] = mine if r.name not in self._seen else settle(self._seen[r.name].union(mine))
            for a in r.actions:
                self.graph, message = a.run(self.graph, found)
                passes.append(
                    found.select(
                        F.sha1(F.concat_ws("|", F.lit(r.name), F.lit(a.kind), F.lit(uuid.uuid4().hex), "_sign")).alias("action_id"), F.lit(a.kind).alias("action_type"), F.lit(r.name).alias("rule_name"), F.lit(now).alias("ts"), shown.alias("bindings"),
                        F.lit(None).cast("map<string,string>").alias("output"), F.when(message == "unresolved", "failed").otherwise("done").alias("status"), message.alias("message"),
                    )
                )
        out = self.graph.spark.createDataFrame([], EXECUTIONS)
        for p in passes:
            out = out.unionByName(p)
        out = settle(out)
        self.executions = out if self.executions is None else self.executions.unionByName(out)
        return out
