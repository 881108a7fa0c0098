"""Causal structure of models and graphs: dependency trees, feedback loops, their polarity, consistency checks."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtide.functions.expressions import Num, Op, names
from graphtide.sources.sysd import Model, lower

from .closure import depths, paths, settle


def dependencies(spark: SparkSession, model: Model) -> DataFrame:
    """(src, dst, sign): what each flow, auxiliary and stock depends on; an outflow's sign on its stock is -1."""
    system = lower(model)
    rows = []
    for stock, flow, sign, e in system.flows:
        rows.append((flow, stock, sign))
        rows += [(n, flow, 1) for n in names(e) if n not in ("t", "dt", "PI", flow)]
    for aux, e in system.auxes:
        rows += [(n, aux, 1) for n in names(e) if n not in ("t", "dt", "PI")]
    return spark.createDataFrame(sorted(set(rows)), "src string, dst string, sign int")


def causes_tree(edges: DataFrame, name: str, most: int = 10) -> DataFrame:
    """Paths (path, cut) backwards from a name to what it depends on."""
    roots = edges.sparkSession.createDataFrame([(name,)], "node string")
    return paths(edges.select(F.col("dst").alias("a"), F.col("src").alias("b")), roots, most).select("path", "cut")


def effects_tree(edges: DataFrame, name: str, most: int = 10) -> DataFrame:
    """Paths (path, cut) forwards from a name to what depends on it."""
    roots = edges.sparkSession.createDataFrame([(name,)], "node string")
    return paths(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), roots, most).select("path", "cut")


def causes_strip(edges: DataFrame, finals: DataFrame, name: str) -> DataFrame:
    """(src, value): the direct causes of a name with their values."""
    return edges.where(F.col("dst") == name).select("src").join(finals.select(F.col("var").alias("src"), "value"), "src", "left")


def causal_trace(edges: DataFrame, finals: DataFrame, name: str, most: int = 10) -> DataFrame:
    """(part, name, path, cut, value): each cause and effect of a name with the path that it is on, and its direct causes with their values, as the parts causes, effects and strip."""
    none = F.lit(None)
    out = causes_strip(edges, finals, name).select(F.lit("strip").alias("part"), F.col("src").alias("name"), none.cast("array<string>").alias("path"), none.cast("boolean").alias("cut"), "value")
    for part, tree in (("causes", causes_tree), ("effects", effects_tree)):
        rows = tree(edges, name, most).where(F.size("path") > 1)
        out = out.unionByName(rows.select(F.lit(part).alias("part"), F.explode(F.slice("path", 2, F.size("path") - 1)).alias("name"), "path", F.col("cut").cast("boolean").alias("cut"), none.cast("double").alias("value")))
    return out


def loops(edges: DataFrame, most: int = 20) -> DataFrame:
    """(nodes, negatives, kind): every simple cycle of edges (src, dst, sign) up to a length, each once.

    A cycle is grown from its smallest node through larger ones only. It reinforces with an even number of
    negative edges and balances with an odd one. If longer cycles may be left, a warning says so.
    """
    step = edges.select("src", "dst", (F.col("sign") < 0).cast("int").alias("neg"))
    front = step.select(F.col("src").alias("first"), F.array("src", "dst").alias("path"), F.col("neg").alias("negatives")).where("first <= element_at(path, -1)")
    done = None
    for _ in range(most):
        last = F.element_at("path", -1)
        closed = front.where(last == F.col("first")).select(F.slice("path", 1, F.size("path") - 1).alias("nodes"), "negatives")
        done = closed if done is None else done.union(closed)
        front = settle(front.where(last != F.col("first")).join(step, last == F.col("src")).where("dst >= first and (dst = first or not array_contains(path, dst))").select("first", F.array_append("path", F.col("dst")).alias("path"), (F.col("negatives") + F.col("neg")).alias("negatives")))
        if not front.limit(1).count():
            break
    else:
        warnings.warn(f"cycles of more than {most} nodes were left out; give a larger length for them", stacklevel=2)
    kind = F.when(F.col("negatives") % 2 == 0, "reinforcing").otherwise("balancing")
    return done.withColumn("kind", kind)


def loops_for(found: DataFrame, name: str) -> DataFrame:
    return found.where(F.array_contains("nodes", name))


def containment(nodes: DataFrame) -> DataFrame:
    """(node, depth) of nodes (name, parent): roots have depth 0."""
    return depths(nodes.where("parent is not null").select(F.col("parent").alias("a"), F.col("name").alias("b")), nodes.where("parent is null").select(F.col("name").alias("node")))


def conversation_context(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, context): the turns before each turn, oldest first; a turn's parent is the one before it."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return turns.select("conv_id", "turn", F.collect_list("turn").over(w).alias("context"))


def partition_sums(parts: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(whole, total, ok) of parts (whole, fraction): whether fractions add up to 1."""
    return parts.groupBy("whole").agg(F.sum("fraction").alias("total")).withColumn("ok", F.abs(F.col("total") - 1) <= tolerance)


def flow_sides(spark: SparkSession, model: Model) -> DataFrame:
    """(flow, ins, outs, ok): a flow enters at most one stock and leaves at most one."""
    system = lower(model)
    rows = spark.createDataFrame([(f, s) for _, f, s, _ in system.flows] or [], "flow string, sign int")
    return rows.groupBy("flow").agg(F.count_if(F.col("sign") > 0).alias("ins"), F.count_if(F.col("sign") < 0).alias("outs")).withColumn("ok", (F.col("ins") <= 1) & (F.col("outs") <= 1))


def constant_flows(edges: DataFrame, start: float, end: float, dt: float) -> DataFrame:
    """(stock, t, value) of a graph of constant flows (stock, initial, polarity, rate): linear trajectories."""
    net = edges.groupBy("stock").agg(F.max("initial").alias("initial"), F.sum(F.col("rate") * F.when(F.col("polarity") == "negative", -1.0).otherwise(1.0)).alias("net"))
    n = int(round((end - start) / dt))
    return net.select("stock", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("k"), "initial", "net").select("stock", (F.lit(start) + F.col("k") * dt).alias("t"), (F.col("initial") + F.col("net") * F.col("k") * dt).alias("value"))


def zero_divisors(model: Model) -> list[tuple[str, str]]:
    """(where, divisor) of divisions by a name that a parameter sets to 0, or by the number 0."""
    system, found = lower(model), []

    def look(where, e):
        if isinstance(e, Op) and e.op == "/":
            d = e.args[1]
            if (isinstance(d, Num) and d.value == 0) or any(system.model.params.get(n) == 0 for n in names(d)):
                found.append((where, str(d)))
        for a in getattr(e, "args", ()):
            look(where, a)

    for n, e in [*system.auxes, *[(f, e) for _, f, _, e in system.flows]]:
        look(n, e)
    return found


# Roles of model elements in an upper ontology.
ROLES = {"stock": "continuant", "flow": "process", "aux": "quality", "table": "information", "agent": "material entity", "queue": "process", "resource": "material entity", "event": "process boundary"}


def role(kind: str) -> str | None:
    return ROLES.get(kind)


def role_table(spark: SparkSession) -> DataFrame:
    """(kind, role, category): what happens is an occurrent, all else a continuant."""
    rows = [(k, r, "occurrent" if r.startswith("process") else "continuant") for k, r in ROLES.items()]
    return spark.createDataFrame(rows, "kind string, role string, category string")


def valid_role(kind: str) -> bool:
    return kind in ROLES


def roles_of(category: str) -> list[str]:
    """The kinds of elements whose role is a continuant or an occurrent."""
    return [k for k, r in ROLES.items() if r.startswith("process") == (category == "occurrent")]
