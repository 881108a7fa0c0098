"""Agent populations as rows: rules become Columns, messages and neighbours become joins.

A population is a table (type, inst, a column for each property, and, if used, strategy and locked_until). A step
is synchronous: every agent reads the state before the step. Within an agent rules run in descending priority
and later rules see what earlier ones did.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtide.functions.expressions import parse, to_column
from graphtide.sources.sysd import Agent

from .closure import settle

_EFFECT = re.compile(r"^\s*(\w+)\s*(\+=|-=|\*=|/=|=)\s*(.+)$")
_SEND = re.compile(r"^\s*SEND\(\s*['\"]?(\w+)['\"]?\s*,\s*['\"]?(\w+)['\"]?\s*(?:,\s*(.*))?\)\s*$")
_TOPIC = re.compile(r"\binbox_(\w+)")
_SWITCH = re.compile(r"^\s*SWITCH_STRATEGY\(\s*['\"]?(\w+)['\"]?\s*(?:,\s*cooldown\s*=\s*([\d.]+)\s*)?\)\s*$")


def population(spark: SparkSession, agent: Agent) -> DataFrame:
    """The agents of a type in their first state."""
    cols = [F.lit(p.initial).cast("double").alias(p.name) for p in agent.properties]
    first = F.lit(agent.strategies[0] if agent.strategies else None).cast("string")
    return spark.range(agent.count).select(F.lit(agent.name).alias("type"), F.col("id").alias("inst"), *cols, first.alias("strategy"), F.lit(float("-inf")).alias("locked_until"))


def network(spark: SparkSession, kind: str, n: int, name: str = "", seed: int = 42) -> DataFrame:
    """(a, b), both ways: complete, random (each edge with 0.2), small-world (4 nearest, a fifth rewired) or
    scale-free (2 edges for each newcomer)."""
    rng = np.random.default_rng(seed + zlib.adler32(name.encode()))
    if kind in ("complete", "random"):
        x = spark.range(n)
        pairs = x.select(F.col("id").alias("a")).join(x.select(F.col("id").alias("b")), F.col("a") < F.col("b"))
        if kind == "random":
            pairs = pairs.where((F.pmod(F.xxhash64("a", "b", F.lit(int(rng.integers(1 << 30)))), F.lit(1000)) < 200))
        return pairs.union(pairs.select("b", "a"))
    edges = set()
    if kind == "small-world":
        k = min(4, n - 1)
        for i in range(n):
            for j in range(1, k // 2 + 1):
                b = (i + j) % n
                if rng.random() < 0.2:
                    b = int(rng.integers(n))
                if i != b:
                    edges.add((min(i, b), max(i, b)))
    elif kind == "scale-free":
        ends = list(range(min(2, n)))
        for i in range(len(ends), n):
            for b in {int(ends[rng.integers(len(ends))]) for _ in range(2)}:
                edges.add((b, i))
                ends += [b, i]
    else:
        raise ValueError(f"unknown network {kind!r}")
    table = spark.createDataFrame([(int(a), int(b)) for a, b in edges] or [], "a long, b long")
    return table.union(table.select("b", "a"))


def perceived(agents: DataFrame, properties: list[str], edges: DataFrame | None = None, inbox: DataFrame | None = None, topics: list[str] | None = None) -> DataFrame:
    """With what agents see of their neighbours (neighbor_<p>_avg, _min, _max) and of their mail (inbox_<topic>, for
    the topics given or else all)."""
    out = agents
    if edges is not None:
        near = edges.join(agents.select(F.col("inst").alias("b"), *properties), "b").groupBy(F.col("a").alias("inst"))
        seen = near.agg(*[f(p).alias(f"neighbor_{p}_{n}") for p in properties for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))], F.count(F.lit(1)).alias("neighbor_count"))
        out = out.join(seen, "inst", "left")
    if inbox is not None:
        if topics is None:
            topics = [r[0] for r in inbox.select("topic").distinct().orderBy("topic").collect()]
        if topics:
            out = out.join(inbox.groupBy("inst").pivot("topic", topics).count().select("inst", *[F.col(f"`{t}`").alias(f"inbox_{t}") for t in topics]), "inst", "left")
    return out


def decide(agent: Agent, seen: DataFrame, env: dict[str, float], t: float = 0.0) -> tuple[DataFrame, list]:
    """The agents after their rules, and the rules' messages as (condition column name, type, topic, payload).

    A null condition is false; an effect that can't be computed, and a division by zero, change nothing.
    """
    state: dict[str, Column] = {p.name: F.col(p.name) for p in agent.properties}
    bounds = {p.name: p for p in agent.properties}
    columns = set(seen.columns)
    out, sends = seen, []

    def read(name: str) -> Column:
        if name in columns:
            return F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        if name.startswith(f"{agent.name}.") and name.split(".", 1)[1] in columns:
            return F.col(name.split(".", 1)[1])
        return F.lit(float({"t": t, **env}.get(name, 0.0)))

    ordered = sorted((r for r in agent.rules if r.meta), key=lambda r: -r.priority) + sorted((r for r in agent.rules if not r.meta), key=lambda r: -r.priority)
    for k, r in enumerate(ordered):
        fires = F.coalesce(to_column(parse(r.condition), read) != 0, F.lit(False))
        if r.strategy is not None and not r.meta:
            fires = fires & (F.col("strategy") == r.strategy)
        out = out.withColumn(f"_fires{k}", fires)
        fires = F.col(f"_fires{k}")
        for text in r.effects:
            if m := _SEND.match(text):
                payload = {a.strip(): to_column(parse(b), read) for a, _, b in (x.partition("=") for x in (m[3] or "").split(",") if "=" in x)}
                entries = [x for n, c in payload.items() for x in (F.lit(n), c.cast("string"))]
                out = out.withColumn(f"_payload{len(sends)}", F.create_map(*entries) if entries else F.create_map().cast("map<string,string>"))
                sends.append((f"_fires{k}", m[1], m[2], f"_payload{len(sends)}"))
            elif m := _SWITCH.match(text):
                free = fires & (F.lit(t) >= F.col("locked_until"))
                out = out.withColumns({"strategy": F.when(free, m[1]).otherwise(F.col("strategy")), "locked_until": F.when(free, F.lit(t + float(m[2] or 0))).otherwise(F.col("locked_until"))})
            elif m := _EFFECT.match(text):
                name, op, expr = m.groups()
                if name not in state:
                    continue
                value = to_column(parse(expr), read)
                old = F.col(name)
                new = {"+=": old + value, "-=": old - value, "*=": old * value, "/=": F.when(F.abs(value) > 1e-12, old / value).otherwise(old), "=": value}[op]
                p = bounds[name]
                out = out.withColumn(name, F.when(fires, F.greatest(F.lit(p.low), F.least(F.lit(p.high), F.coalesce(new, old)))).otherwise(old))
    return out, sends


def step(agent: Agent, agents: DataFrame, env: dict[str, float], t: float, edges: DataFrame | None = None, inbox: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One step: (agents, messages sent: sender, target_type, topic, payload). Mail sent now is read in the next step."""
    topics = sorted({t for r in agent.rules for text in (r.condition, *r.effects) for t in _TOPIC.findall(text)})
    seen = perceived(agents, [p.name for p in agent.properties], edges, inbox, topics)
    out, sends = decide(agent, seen, env, t)
    out = settle(out)
    mail = agents.sparkSession.createDataFrame([], "sender long, target_type string, topic string, payload map<string,string>")
    for fires, target, topic, payload in sends:
        mail = mail.union(out.where(fires).select(F.col("inst").alias("sender"), F.lit(target), F.lit(topic), payload))
    return out.select(*agents.columns), mail


def deliver(messages: DataFrame, agents: DataFrame) -> DataFrame:
    """(type, inst, topic, sender, payload): each message reaches all agents of its target type."""
    return messages.join(agents.select("type", "inst"), messages["target_type"] == agents["type"]).select("type", "inst", "topic", "sender", "payload")


def delivered(messages: DataFrame, agents: DataFrame) -> DataFrame:
    """(type, sender, topic, n): how many of :func:`deliver`'s rows a sender's messages on a topic make, told from
    the number of agents of each type, without a row for each receiver."""
    sent = messages.groupBy("target_type", "sender", "topic").agg(F.count(F.lit(1)).alias("_sent"))
    there = agents.groupBy("type").agg(F.count(F.lit(1)).alias("_there"))
    return sent.join(F.broadcast(there), F.col("target_type") == F.col("type")).select("type", "sender", "topic", (F.col("_sent") * F.col("_there")).alias("n"))


def aged(mail: DataFrame) -> DataFrame:
    """Mail after a step: each message's time to live (ttl) is one less, and those at 0 are gone."""
    return mail.withColumn("ttl", F.col("ttl") - 1).where("ttl > 0")


def mailbox(kept: DataFrame, sent: DataFrame, agents: DataFrame, ttl: int = 1) -> DataFrame:
    """The next step's mail: what is left of the last one's, and what was sent, which lives for ttl steps."""
    return aged(kept).unionByName(deliver(sent, agents).withColumn("ttl", F.lit(ttl)))


def metrics(agents: DataFrame, properties: list[str]) -> DataFrame:
    """(type, var, value): <Type>_<property>_avg, _sum, _min, _max, _var (the population's; 0 for one agent) and <Type>_count."""
    stats = [("avg", F.avg), ("sum", F.sum), ("min", F.min), ("max", F.max), ("var", F.var_pop)]
    made = agents.groupBy("type").agg(*[f(p).cast("double").alias(f"{p}_{n}") for p in properties for n, f in stats], F.count(F.lit(1)).cast("double").alias("count"))
    pairs = F.array(*[F.struct(F.concat(F.col("type"), F.lit("_" + c)).alias("var"), F.col(c).alias("value")) for c in made.columns if c != "type"])
    return made.select("type", F.explode(pairs).alias("m")).select("type", "m.*")
