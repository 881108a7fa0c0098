"""Between graph and simulation: parameters from facts, evidence from trajectories, provenance, closed loops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphtide.functions import terms as T
from graphtide.plans.sparql import parsed, query

from .analysis import final_values
from .graph import Graph

# Names of the provenance vocabulary and of our own terms.
PROV = "http://www.w3.org/ns/prov#"
SIM = "urn:sim:"


def params_from_kb(graph: Graph, claims: DataFrame, default: float = 0.5, exclude: tuple[str, ...] = ("schema", "meta", "fused")) -> DataFrame:
    """(name, value) for claims (name, s, p): the number in the last graph that states it, else the default.

    Graphs count in the order of their names, and within a graph the smallest number counts.
    """
    said = graph.quads.where(~F.col("g").isin(*exclude)).where("o.num is not null or try_cast(o.lex as double) is not null")
    said = said.select("g", "s", "p", F.coalesce("o.num", F.col("o.lex").try_cast("double")).alias("v"))
    best = said.join(claims, ["s", "p"]).groupBy("name").agg(F.max_by(F.struct("g", "v"), F.struct(F.col("g"), (-F.col("v")).alias("n"))).alias("m"))
    return claims.select("name").join(best, "name", "left").select("name", F.coalesce("m.v", F.lit(default)).alias("value"))


def params_for_class(graph: Graph, cls: str) -> DataFrame:
    """(s, params): the numeric facts of each instance of a class, as a map from local predicate names."""
    ids = graph.scan(p=T.TYPE).where(F.col("o.lex") == cls).select("s")
    facts = graph.scan().where("o.num is not null").join(ids, "s").select("s", F.regexp_extract("p", r"([^/#:]+)$", 1).alias("name"), "o.num")
    one = facts.groupBy("s", "name").agg(F.min("num").alias("num"))
    return one.groupBy("s").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "num")))).alias("params"))


def kb_number(graph, text: str, var: str | None = None) -> float:
    """A query as a number: ASK gives 1 or 0, SELECT the first row's variable (in the query's order), else 0."""
    q = parsed(text)
    rows = query(graph, text)
    if q.form == "ask":
        return float(rows.first()[0])
    first = rows.select(F.col(var or rows.columns[0])["num"].alias("n")).limit(1).collect()
    return float(first[0]["n"]) if first and first[0]["n"] is not None else 0.0


def bind_queries(graph, runs: DataFrame, queries: dict[str, str]) -> DataFrame:
    """Runs with a column for each query's number; the graph doesn't change during a run, so each is asked once."""
    return runs.withColumns({name: F.lit(kb_number(graph, text)) for name, text in queries.items()})


def evidence(trajectories: DataFrame, var: str, kind: str = "delta", threshold: float = 0.0, share: float = 0.1) -> DataFrame:
    """(run_id, score) from a stock: percentile (where the last value lies between least and greatest), delta
    (change between the means of the first and last share of steps, relative to the first) or threshold (share
    of steps above)."""
    rows = trajectories.where(F.col("var") == var)
    w = Window.partitionBy("run_id")
    rows = rows.withColumn("_n", F.max("step").over(w))
    head, tail = F.col("step") <= F.col("_n") * share, F.col("step") >= F.col("_n") * (1 - share)
    stats = rows.groupBy("run_id").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.max_by("value", "step").alias("last"), F.avg(F.when(head, F.col("value"))).alias("a"), F.avg(F.when(tail, F.col("value"))).alias("b"), F.avg((F.col("value") > threshold).cast("double")).alias("above")
    )
    score = {
        "percentile": F.coalesce(F.try_divide(F.col("last") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.5)),
        "delta": F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.abs("a")), F.lit(0.0)),
        "threshold": F.col("above"),
    }[kind]
    return stats.select("run_id", score.alias("score"))


def evidence_quads(scores: DataFrame, name: str, graph: str = "evidence") -> DataFrame:
    return scores.select(F.lit(graph).alias("g"), F.concat(F.lit(SIM + "run/"), F.col("run_id").cast("string")).alias("s"), F.lit(T.IRI).cast("tinyint").alias("s_kind"), F.lit(SIM + name).alias("p"), T.number(F.col("score")).alias("o"))


def grades(graph, queries: dict[str, str]) -> dict[str, float]:
    """Each query's first number, kept within 0 and 1; 1 for a true ASK; 0 for a query that fails."""
    out = {}
    for name, text in queries.items():
        try:
            out[name] = min(1.0, max(0.0, kb_number(graph, text)))
        except (SyntaxError, ValueError):
            out[name] = 0.0
    return out


def provenance(trajectories: DataFrame, runs: DataFrame, graph: str = "provenance") -> DataFrame:
    """Quads that tell of each run its parameters and each stock's first and last values, on nodes of its own."""
    node = F.concat(F.lit(SIM + "run/"), F.col("run_id").cast("string"))
    quad = lambda s, p, o: [F.lit(graph).alias("g"), s.alias("s"), F.lit(T.IRI).cast("tinyint").alias("s_kind"), p.alias("p"), o.alias("o")]
    out = runs.select(*quad(node, F.lit(T.TYPE), T.term(T.IRI, F.lit(PROV + "Activity"))))
    params = [c for c in runs.columns if c != "run_id"]
    if params:
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("n"), F.col(c).cast("double").alias("v")) for c in params]))
        out = out.union(runs.select("run_id", pairs.alias("x")).select(*quad(node, F.concat(F.lit(SIM + "param/"), F.col("x.n")), T.number(F.col("x.v")))))
    ends = trajectories.groupBy("run_id", "var").agg(F.min_by("value", "step").alias("start"), F.max_by("value", "step").alias("final"))
    for which in ("start", "final"):
        out = out.union(ends.select(*quad(node, F.concat(F.lit(f"{SIM}{which}/"), F.col("var")), T.number(F.col(which)))))
    return out


def compare_runs(graph: Graph, which: str = "final") -> DataFrame:
    """(run, var, value, change): recorded values of runs and their change from the run before, by run number."""
    head = f"{SIM}{which}/"
    rows = graph.scan().where(F.startswith("p", F.lit(head))).select(F.substring_index("s", "/", -1).cast("long").alias("run"), F.expr(f"substring(p, {len(head) + 1})").alias("var"), F.col("o.num").alias("value"))
    return rows.withColumn("change", F.col("value") - F.lag("value").over(Window.partitionBy("var").orderBy("run")))


class ClosedLoop:
    """Passes of: parameters from facts, simulation, evidence, grades, provenance, rules.

    simulate: table of runs -> trajectories; evidence: name -> (stock, kind); nudge: grades -> parameter changes.
    """

    def __init__(self, graph: Graph, claims: DataFrame, simulate: Callable[[DataFrame], DataFrame], measures: dict[str, tuple[str, str]], grade_queries: dict[str, str], nudge: Callable[[dict], dict] | None = None, rules=None):
        self.graph, self.claims, self.simulate, self.measures, self.grade_queries, self.nudge, self.rules = graph, claims, simulate, measures, grade_queries, nudge, rules
        self.history: list[dict] = []

    def run(self, passes: int = 3) -> Graph:
        spark: SparkSession = self.claims.sparkSession
        changes: dict[str, float] = {}
        for k in range(passes):
            params = {r["name"]: r["value"] for r in params_from_kb(self.graph, self.claims).collect()}
            params = {n: v + changes.get(n, 0.0) for n, v in params.items()}
            runs = spark.createDataFrame([(k, *map(float, params.values()))], ["run_id", *params])
            trajectories = self.simulate(runs)
            for name, (stock, kind) in self.measures.items():
                self.graph = self.graph.add(evidence_quads(evidence(trajectories, stock, kind), name))
            self.graph = self.graph.add(provenance(trajectories, runs))
            found = grades(self.graph, self.grade_queries)
            if self.rules is not None:
                self.rules.graph = self.graph
                self.rules.evaluate(float(k))
                self.graph = self.rules.graph
            finals = {r["var"]: r["value"] for r in final_values(trajectories).collect()}
            self.history.append({"pass": k, "params": params, "grades": found, "finals": finals})
            changes = self.nudge(found) if self.nudge else changes
        return self.graph
