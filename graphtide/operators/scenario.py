"""Comparing scenarios: summaries, grades, filters and explanations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphtide.plans.sparql import ask

from . import analysis
from .bridge import grades
from .causal import causes_tree, dependencies
from .graph import Graph


class Comparison:
    """Scenarios (name -> parameters) of a model, simulated as one table of runs; the first is the baseline."""

    def __init__(self, spark, simulate: Callable[[DataFrame], DataFrame], scenarios: dict[str, dict[str, float]]):
        self.spark, self.names = spark, list(scenarios)
        params = sorted({p for s in scenarios.values() for p in s})
        rows = [(i, *[float(s[p]) if p in s else None for p in params]) for i, s in enumerate(scenarios.values())]
        schema = ", ".join(["run_id long", *[f"`{p}` double" for p in params]])
        self.runs, self.scenarios = spark.createDataFrame(rows, schema), scenarios
        self.trajectories = simulate(self.runs)

    def _named(self, rows: DataFrame) -> DataFrame:
        labels = self.spark.createDataFrame(list(enumerate(self.names)), "run_id long, scenario string")
        return rows.join(F.broadcast(labels), "run_id")

    def summary(self) -> DataFrame:
        """A row for each scenario: parameters and final values."""
        finals = analysis.final_values(self.trajectories)
        stocks = [r[0] for r in finals.select("var").distinct().orderBy("var").collect()]
        wide = finals.groupBy("run_id").pivot("var", stocks).agg(F.first("value"))
        return self._named(self.runs.join(wide, "run_id")).drop("run_id")

    def deviation_table(self, relative: bool = True) -> DataFrame:
        return self._named(analysis.deviations(analysis.final_values(self.trajectories), 0, relative)).drop("run_id")

    def _graph(self, base: Graph, evidence: Callable[[DataFrame], DataFrame], i: int) -> Graph:
        return base.add(evidence(self.trajectories.where(F.col("run_id") == i)), "evidence")

    def grade(self, base: Graph, evidence: Callable[[DataFrame], DataFrame], queries: dict[str, str]) -> DataFrame:
        """(scenario, query, score): each scenario's queries over the base facts with its evidence; nothing stays behind."""
        rows = [(name, q, s) for i, name in enumerate(self.names) for q, s in grades(self._graph(base, evidence, i), queries).items()]
        return self.spark.createDataFrame(rows, "scenario string, query string, score double")

    def rank(self, base, evidence, queries, how: str = "mean") -> DataFrame:
        return analysis.rank_scenarios(self.grade(base, evidence, queries), how)

    def filter(self, base: Graph, evidence, asks: list[str]) -> list[str]:
        """Scenarios for which every ASK is true; one that fails counts as false."""
        kept = []
        for i, name in enumerate(self.names):
            g = self._graph(base, evidence, i)
            try:
                if all(ask(g, text) for text in asks):
                    kept.append(name)
            except (SyntaxError, ValueError):
                continue
        return kept

    def explain(self, model, scenario: str, stock: str, graph: Graph | None = None, facts: int = 50) -> dict:
        """A stock's final value and deviation in a scenario, its causes, and facts about it in a graph."""
        row = self.deviation_table().where((F.col("scenario") == scenario) & (F.col("var") == stock)).first()
        chain = [r.path for r in causes_tree(dependencies(self.spark, model), stock, 8).orderBy(F.col("path").cast("string")).collect()]
        known = [] if graph is None else [tuple(r) for r in graph.scan().where(F.contains("s", F.lit(stock))).select("s", "p", "o.lex").orderBy("s", "p").limit(facts).collect()]
        return {"scenario": scenario, "value": row["value"], "deviation": row["deviation"], "causes": chain, "facts": known}
