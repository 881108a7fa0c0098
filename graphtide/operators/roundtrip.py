"""Round trips between graph and simulation for every entity of a class at once.

Each entity has a run of its own: facts give its parameters, its trajectory gives scores by the user's own
aggregates, scores are laid over the graph as facts, queries grade the entities, and grades change parameters
for the next pass. All of it stays in tables, so a pass is a few jobs whatever the number of entities, and
nothing of theirs comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphtide.functions import terms as T
from graphtide.plans.sparql import query

from .bridge import SIM
from .closure import settle
from .graph import Graph
from .rules import Action

EVIDENCE = "evidence"


def value(var: str) -> Column:
    """A stock's values among a run's rows, null in the rows of other stocks."""
    return F.when(F.col("var") == var, F.col("value"))


def last(var: str) -> Column:
    """A stock's value at the run's last step, as a measure."""
    return F.max_by("value", F.when(F.col("var") == var, F.col("step")))


def _numbered(rows: DataFrame) -> DataFrame:
    return settle(rows.withColumn("run_id", F.monotonically_increasing_id()))


def runs_for_class(graph, cls: str, parameters: dict[str, tuple[str, float]]) -> DataFrame:
    """(s, a column for each parameter, run_id): a run for each instance of a class.

    parameters: name -> (predicate, default). Of several numbers the smallest counts; an instance without one
    takes the default, and so do numbers that are NaN. Only the named predicates are read, in one shuffle by subject.
    """
    parts = [graph.scan(p=T.TYPE).where((F.col("o.kind") == T.IRI) & (F.col("o.lex") == cls)).select("s", F.lit("").alias("name"), F.lit(0.0).alias("num"))]
    for predicate in sorted({p for p, _ in parameters.values()}):
        parts.append(graph.scan(p=predicate).where("o.num is not null and not isnan(o.num)").select("s", F.lit(predicate).alias("name"), F.col("o.num").alias("num")))
    values = [F.coalesce(F.min(F.when(F.col("name") == p, F.col("num"))), F.lit(float(d))).alias(n) for n, (p, d) in parameters.items()]
    rows = reduce(DataFrame.union, parts).groupBy("s").agg(F.max((F.col("name") == "").cast("int")).alias("_member"), *values)
    return _numbered(rows.where("_member = 1").drop("_member"))


def scored(trajectories: DataFrame, measures: dict[str, Column], share: float = 0.1) -> DataFrame:
    """(run_id, a column for each measure): the user's scoring functions, as aggregates over a run's rows.

    The rows have step, t, var, value, and head and tail, which tell whether a step is in the first or last
    share of the run's steps. All measures are made in one grouping.
    """
    last = F.max("step").over(Window.partitionBy("run_id"))
    rows = trajectories.withColumn("_last", last).withColumn("head", F.col("step") <= F.col("_last") * share).withColumn("tail", F.col("step") >= F.col("_last") * (1 - share))
    return rows.groupBy("run_id").agg(*[m.cast("double").alias(n) for n, m in measures.items()])


def facts(rows: DataFrame, measures: list[str], graph: str = EVIDENCE) -> DataFrame:
    """Quads of rows (s, measures): each number under the measure's name; nulls and NaN state nothing."""
    pair = F.explode(F.array(*[F.struct(F.lit(SIM + n).alias("p"), F.col(n).cast("double").alias("v")) for n in measures]))
    told = rows.select("s", pair.alias("x")).where("x.v is not null and not isnan(x.v)")
    return told.select(F.lit(graph).alias("g"), "s", F.lit(T.IRI).cast("tinyint").alias("s_kind"), F.col("x.p").alias("p"), T.number(F.col("x.v")).alias("o"))


class Layered:
    """A graph with quads laid over it, neither copied nor compared with it.

    The layer's predicates are given and are its own: the base is not asked for them, and the layer for no others.
    """

    def __init__(self, base, quads: DataFrame, predicates: set[str]):
        self.base, self.layer, self.predicates = base, Graph(quads, once=True), predicates
        self.spark, self.functions = base.spark, base.functions

    def scan(self, s=None, p=None, o=None, g=None, graphs=False) -> DataFrame:
        if p in self.predicates:
            return self.layer.scan(s, p, o, g, graphs)
        below = self.base.scan(s, p, o, g, graphs)
        return below if p is not None else below.unionByName(self.layer.scan(s, p, o, g, graphs))

    def query(self, text: str, **options) -> DataFrame:
        return query(self, text, **options)


def graded(graph, nodes: DataFrame, queries: dict[str, str], node: str = "s", score: str = "score") -> DataFrame:
    """(s, a column for each query): what each query says of each node (s), within 0 and 1.

    A query's solutions bind the node and, if they are to say more than yes, a number. Of several solutions
    the largest number counts; a node without one gets 0. All queries and nodes meet in one grouping.
    """
    parts = [nodes.select("s", F.lit("").alias("name"), F.lit(0.0).alias("y"))]
    for name, text in queries.items():
        rows = query(graph, text)
        y = F.coalesce(F.col(score)["num"], F.lit(0.0)) if score in rows.columns else F.lit(1.0)
        y = F.when(F.isnan(y), 0.0).otherwise(F.least(F.greatest(y, F.lit(0.0)), F.lit(1.0)))
        parts.append(rows.select(F.col(node)["lex"].alias("s"), F.lit(name).alias("name"), y.alias("y")))
    best = [F.coalesce(F.max(F.when(F.col("name") == n, F.col("y"))), F.lit(0.0)).alias(n) for n in queries]
    known = F.max((F.col("name") == "").cast("int")).alias("_node")
    return reduce(DataFrame.union, parts).groupBy("s").agg(known, *best).where("_node = 1").drop("_node")


def full_roundtrip(graph, cls: str, parameters: dict[str, tuple[str, float]], simulate: Callable[[DataFrame], DataFrame], measures: dict[str, Column], queries: dict[str, str]) -> tuple[Layered, DataFrame]:
    """One pass of :func:`closed_loop`: the graph with its evidence, and (s, run_id, parameters, measures, grades)."""
    view, history = closed_loop(graph, cls, parameters, simulate, measures, queries, passes=1)
    return view, history.drop("pass")


def closed_loop(graph, cls: str, parameters: dict[str, tuple[str, float]], simulate: Callable[[DataFrame], DataFrame], measures: dict[str, Column], queries: dict[str, str], nudges: dict[str, Column] | None = None, until: Column | None = None, passes: int = 3) -> tuple[Layered, DataFrame]:
    """Passes of parameters, runs, scores, evidence and grades for all instances of a class.

    simulate: runs (run_id, parameters) -> trajectories. nudges: a parameter's next value from an entity's
    parameters, measures and grades. until: entities for which it is true keep their evidence and take no part in
    later passes; the loop ends when none are left. An entity's evidence is its last pass's alone. Gives the graph with the
    evidence laid over it and the history (pass, s, run_id, parameters, measures, grades); a class without
    instances has no history.
    """
    names, columns = list(parameters), [*parameters, *measures, *queries]
    if len(set(columns)) < len(columns):
        raise ValueError(f"parameters, measures and queries share a name: {sorted(columns)}")
    predicates = {SIM + n for n in measures}
    runs, resting, past = runs_for_class(graph, cls, parameters), None, []
    for k in range(passes):
        found = settle(runs.join(scored(simulate(runs.select("run_id", *names)), measures), "run_id", "left"))
        both = found if resting is None else found.select("s", *measures).union(resting)
        view = Layered(graph, facts(both, list(measures)), predicates)
        state = settle(found.join(graded(view, found.select("s"), queries), "s"))
        past.append(state.select(F.lit(k).alias("pass"), "s", "run_id", *columns))
        if k + 1 == passes:
            break
        going = state
        if until is not None:
            at_rest = F.coalesce(until, F.lit(False))
            rest = state.where(at_rest).select("s", *measures)
            resting, going = rest if resting is None else resting.union(rest), state.where(~at_rest)
            if not going.limit(1).count():
                break
        runs = going.select("s", *[(nudges or {}).get(n, F.col(n)).alias(n) for n in names], "run_id")
    return view, reduce(DataFrame.union, past)


@dataclass
class SimulateMatches(Action):
    """Simulates what a rule matched: a run for each node bound, its scores as facts of the node.

    parameters: name -> a variable of the bindings, as "?name", a number, or (predicate, default) for the node's own
    fact. Of several values of a node the smallest counts; a node without one takes the default, or 0.
    """

    node: str
    parameters: dict[str, str | float | tuple[str, float]]
    simulate: Callable[[DataFrame], DataFrame]
    measures: dict[str, Column]
    into: str = EVIDENCE
    kind = "simulate"

    def run(self, graph, bindings):
        own = {n: x for n, x in self.parameters.items() if isinstance(x, tuple)}
        bound = [F.min(F.col(x[1:])["num"] if isinstance(x, str) else F.lit(float(x))).alias(n) for n, x in self.parameters.items() if n not in own]
        runs = bindings.groupBy(F.col(self.node)["lex"].alias("s")).agg(F.count(F.lit(1)).alias("_n"), *bound).drop("_n")
        for n, (predicate, default) in own.items():
            told = graph.scan(p=predicate).where("o.num is not null").groupBy("s").agg(F.min(F.col("o.num")).alias(n))
            runs = runs.join(told, "s", "left").withColumn(n, F.coalesce(n, F.lit(float(default))))
        runs = _numbered(runs.select("s", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in self.parameters]))
        scores = scored(self.simulate(runs.select("run_id", *self.parameters)), self.measures)
        return graph.add(settle(facts(runs.join(scores, "run_id"), list(self.measures), self.into))), F.lit("simulated")
