"""Streaming jobs over the event log: rules on arrival, counts, fill rates, correlation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtide.operators.graph import QUAD


def event_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Events from Parquet files as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour", time: str = "ts") -> DataFrame:
    """(start, event_type, n) of tumbling windows; events later than ``late`` are dropped by the watermark."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return rows.groupBy(F.window(time, window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def fill_rates(rows: DataFrame, window: str = "7 days", late: str = "1 day", time: str = "ts") -> DataFrame:
    rows = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    sums = rows.groupBy(F.window(time, window).alias("w")).agg(F.sum("demand").alias("d"), F.sum("supplied").alias("s"))
    return sums.select(F.col("w.start").alias("start"), F.when(F.col("d") == 0, 1.0).otherwise(F.col("s") / F.col("d")).alias("fill_rate"))


def correlated(actions: DataFrame, events: DataFrame, seconds: int = 60, late: str = "5 minutes") -> DataFrame:
    """Actions (action_id, action_ts) with the events (id, ts) less than ``seconds`` away, as a stream-stream join."""
    a = actions.withWatermark("action_ts", late)
    e = events.withWatermark("ts", late)
    near = F.expr(f"ts > action_ts - interval {seconds} seconds and ts < action_ts + interval {seconds} seconds")
    return a.join(e, near)


def fire_rules(events: DataFrame, engine, to_quads: Callable[[DataFrame], DataFrame], checkpoint: str, sink: str, id_column: str = "id", late: str = "1 day"):
    """Starts a query that adds each batch's events to the engine's graph and evaluates all its rules on all of it.

    An event id within the watermark triggers once; quads and executions are stored as Parquet, a folder for each
    batch, so that a batch that is run again overwrites its own, and a query that is started again has all earlier facts.
    For rules whose cost should follow the batch see :mod:`graphtide.streaming.incremental`.
    """
    time, given = "ts", engine.graph
    once = events.withWatermark(time, late).dropDuplicatesWithinWatermark([id_column])

    def batch(rows: DataFrame, number: int) -> None:
        if not rows.limit(1).count():
            return
        spark = rows.sparkSession
        to_quads(rows).select("g", "s", "s_kind", "p", "o").write.mode("overwrite").parquet(f"{checkpoint}-facts/batch={number}")
        stored = spark.read.schema(f"{QUAD}, batch int").parquet(f"{checkpoint}-facts").where(F.col("batch") <= number)
        engine.graph = given.add(stored.drop("batch"))
        engine.evaluate().write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return once.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_memory(rows: DataFrame, name: str, mode: str = "append"):
    """Runs a stream to its present end into a table in memory, for tests and looks."""
    q = rows.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return rows.sparkSession.table(name)
