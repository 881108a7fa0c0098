"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of the undirected edges (a, b); component is the smallest node.

    Each round sends every neighbour of a node to the smallest one, first the larger neighbours, then the
    smaller ones; the minima are aggregated before they are shuffled, and no node's neighbours are
    collected. Rounds are checkpointed in the shared folder. Self-loops and repeated edges do no harm;
    edges with a null end are left out.
    """
    shared_dir(edges.sparkSession)
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).where("node is not null").distinct()
    for _ in range(most_rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        e = small.checkpoint()
        # Done when every node has one edge down, to a node that has none.
        counted = e.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("u").alias("nodes")).first()
        if counted["n"] == counted["nodes"] and not e.join(e.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            break
    else:
        raise RuntimeError(f"no fixpoint after {most_rounds} rounds")
    return nodes.join(e, nodes["node"] == e["u"], "left").select("node", F.coalesce("v", "node").alias("component"))
