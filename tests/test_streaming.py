"""Streams give what the batch operators give on the same events."""

from pyspark.sql import functions as F

from graphtide.functions import terms as T
from graphtide.operators import rules as R
from graphtide.operators.events import Log
from graphtide.operators.graph import Graph
from graphtide.streaming import jobs

SCHEMA = "id long, ts timestamp, event_type string"


def _files(spark, small, path):
    e = spark.read.parquet(f"{small}/events.parquet").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    e.orderBy("ts").repartitionByRange(4, "ts").write.parquet(path)
    return spark.read.parquet(path)


def test_windowed_counts(spark, small, tmp_path):
    batch = _files(spark, small, str(tmp_path / "in"))
    out = jobs.run_to_memory(jobs.counts(jobs.event_stream(spark, str(tmp_path / "in"), SCHEMA), "60 days", "1 day"), "counts_t", "complete")
    assert out.agg(F.sum("n")).first()[0] == batch.count()


def test_rules_fire_once_for_each_event(spark, small, tmp_path):
    batch = _files(spark, small, str(tmp_path / "in"))
    rule = R.Production("alarm", [R.TripleCondition("?e", "urn:event:eventType", "?k"), R.QueryCondition('SELECT ?e WHERE { ?e <urn:event:eventType> "error" }')], [R.LogAction("?e")], fire_once=True)
    engine = R.Engine(Graph.empty(spark))
    engine.add_rule(rule)

    def quads(rows):
        return Log(rows.select("id", F.col("ts").cast("timestamp").cast("double").alias("ts"), "event_type", F.lit(None).cast("map<string,string>").alias("payload"), F.lit("t").alias("source"))).quads().where(F.col("p") == "urn:event:eventType")

    q = jobs.fire_rules(jobs.event_stream(spark, str(tmp_path / "in"), SCHEMA, 10), engine, quads, str(tmp_path / "ck"), str(tmp_path / "out"), late="60 days")
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.where("event_type = 'error'").count()
    assert T.IRI == 0
