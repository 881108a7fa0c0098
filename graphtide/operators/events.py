"""The event log and the log of executed actions: append-only tables and what is asked of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphtide.functions import terms as T

EVENTS = "id string, ts double, event_type string, payload map<string,string>, source string, confidence double"
EXECUTIONS = "action_id string, action_type string, rule_name string, ts double, bindings map<string,string>, output map<string,string>, status string, message string"


class Log:
    """A table of events or executions, newest first when asked."""

    def __init__(self, rows: DataFrame, id_column: str = "id", time: str = "ts"):
        self.rows, self.id, self.time = rows, id_column, time

    def record(self, rows: DataFrame) -> Log:
        return Log(self.rows.unionByName(rows, allowMissingColumns=True), self.id, self.time)

    def query(self, start=None, end=None, n: int = 0, **equal) -> DataFrame:
        """Rows with these values between the times (inclusive), newest first; n: the newest n, 0 for all."""
        rows = self.rows
        for name, value in equal.items():
            if value is not None:
                rows = rows.where(F.col(name) == value)
        if start is not None:
            rows = rows.where(F.col(self.time) >= F.lit(start))
        if end is not None:
            rows = rows.where(F.col(self.time) <= F.lit(end))
        rows = rows.orderBy(F.col(self.time).desc(), F.col(self.id).desc())
        return rows.limit(n) if n else rows

    def recent(self, n: int = 10) -> DataFrame:
        return self.query(n=n)

    def counts(self, by: str, since=None) -> DataFrame:
        rows = self.rows if since is None else self.rows.where(F.col(self.time) >= F.lit(since))
        return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))

    def last_of(self, by: str) -> DataFrame:
        """The newest row of each group."""
        newest = F.max_by(F.struct(*self.rows.columns), F.struct(self.time, self.id)).alias("r")
        return self.rows.groupBy(by).agg(newest).select("r.*")

    def quads(self, namespace: str = "urn:event:", graph: str = "transactions") -> DataFrame:
        """Events as quads: a type, a time, a source, a confidence, and one for each payload entry."""
        ns = F.lit(namespace)
        fixed = [
            (T.TYPE, T.iri(F.concat(ns, F.lit("Event")))),
            (namespace + "eventType", T.string(F.col("event_type"))),
            (namespace + "time", T.number(F.col(self.time))),
            (namespace + "source", T.string(F.col("source"))),
        ]
        made = F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in fixed])
        entries = F.transform(F.map_entries(F.coalesce("payload", F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.concat(ns, e["key"]).alias("p"), F.coalesce(T.number(e["value"].try_cast("double")), T.string(e["value"])).alias("o")))
        rows = self.rows.select(F.concat(ns, F.col(self.id).cast("string")).alias("s"), F.explode(F.concat(made, entries)).alias("t"))
        return rows.where("t.o is not null").select(F.lit(graph).alias("g"), "s", F.lit(T.IRI).cast("tinyint").alias("s_kind"), "t.p", "t.o")


def causal_chain(actions: DataFrame, events: DataFrame, seconds: float = 60.0, most: int = 5) -> DataFrame:
    """For each action the newest events less than ``seconds`` away from it, at most ``most``.

    actions (action_id, ts), events (id, ts). The interval join becomes an equi-join on buckets as wide as
    the interval: an event can only be near actions of its own and the two neighbouring buckets.
    """
    width = F.lit(float(seconds))
    a = actions.select("action_id", F.col("ts").alias("action_ts"), F.explode(F.array(*[(F.floor(F.col("ts") / width) + d).alias("b") for d in (-1, 0, 1)])).alias("bucket"))
    e = events.select(F.col("id").alias("event_id"), F.col("ts").alias("event_ts"), F.floor(F.col("ts") / width).alias("bucket"))
    near = a.join(e, "bucket").where(F.abs(F.col("action_ts") - F.col("event_ts")) < width)
    rank = F.row_number().over(Window.partitionBy("action_id").orderBy(F.col("event_ts").desc(), F.col("event_id").desc()))
    return near.withColumn("rank", rank).where(F.col("rank") <= most).select("action_id", "action_ts", "event_id", "event_ts", "rank")


def rule_status(rules: DataFrame, executions: DataFrame) -> DataFrame:
    """(rule_name, fired, last_ts, last_status) of each rule, those that never fired too."""
    done = executions.groupBy("rule_name").agg(F.count(F.lit(1)).alias("fired"), F.max("ts").alias("last_ts"), F.max_by("status", "ts").alias("last_status"))
    return rules.select("rule_name").join(done, "rule_name", "left").withColumn("fired", F.coalesce("fired", F.lit(0)).cast("long"))


def fill_rate(rows: DataFrame, period: float, time: str = "t", demand: str = "demand", supplied: str = "supplied") -> DataFrame:
    """(period, fill_rate): supplied over demanded in each period of time; 1.0 where nothing was demanded."""
    rows = rows.groupBy(F.floor(F.col(time) / F.lit(float(period))).cast("long").alias("period")).agg(F.sum(demand).alias("d"), F.sum(supplied).alias("s"))
    return rows.select("period", F.when(F.col("d") == 0, 1.0).otherwise(F.col("s") / F.col("d")).alias("fill_rate"))
