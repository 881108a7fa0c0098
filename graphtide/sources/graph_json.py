"""Reasoning graphs as JSON, and type boxes and query libraries as files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NODE = "struct<id:string,name:string,type:string,parent:string,text:string,outgoing_edges:array<struct<target:string,type:string,polarity:string>>>"
_EDGE = "struct<source:string,target:string,type:string,polarity:string>"
SCHEMA = f"id string, nodes array<{_NODE}>, edges array<{_EDGE}>, propositions array<{_NODE}>"

# Node and edge types that the general type box allows.
GENERAL = {"nodes": ["CONCEPT", "ENTITY", "PROCESS", "QUALITY", "EVENT", "AGENT"], "edges": ["CAUSES", "PART_OF", "INFLUENCES", "PRECEDES", "HAS_QUALITY", "CONTAINS"]}


def read_graphs(rows: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of graphs in either layout: ``nodes`` with ``edges``, or ``propositions`` with edges inside.

    nodes: graph, id, name, type, parent, text; edges: graph, source, target, type, polarity (default positive).
    """
    g = rows.select(F.from_json(column, SCHEMA).alias("g")).where("g is not null").select("g.*")
    both = g.select(F.col("id").alias("graph"), F.explode(F.coalesce("nodes", "propositions")).alias("n"))
    name = F.coalesce("n.name", "n.id")
    nodes = both.select("graph", F.coalesce("n.id", "n.name").alias("id"), name.alias("name"), F.coalesce("n.type", F.lit("CONCEPT")).alias("type"), "n.parent", "n.text")
    positive = lambda c: F.coalesce(c, F.lit("positive"))
    inner = both.select("graph", F.coalesce("n.id", "n.name").alias("source"), F.explode("n.outgoing_edges").alias("e")).select("graph", "source", "e.target", "e.type", positive(F.col("e.polarity")).alias("polarity"))
    outer = g.select(F.col("id").alias("graph"), F.explode("edges").alias("e")).select("graph", "e.source", "e.target", "e.type", positive(F.col("e.polarity")).alias("polarity"))
    return nodes, outer.unionByName(inner)


def write_graphs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, value): a JSON text for each graph; default values are left out."""
    ns = nodes.select("graph", F.struct("id", "name", F.when(F.col("type") != "CONCEPT", F.col("type")).alias("type"), "parent", "text").alias("n")).groupBy("graph").agg(F.array_sort(F.collect_list("n")).alias("nodes"))
    es = edges.select("graph", F.struct("source", "target", "type", F.when(F.col("polarity") != "positive", F.col("polarity")).alias("polarity")).alias("e")).groupBy("graph").agg(F.array_sort(F.collect_list("e")).alias("edges"))
    return ns.join(es, "graph", "left").select("graph", F.to_json(F.struct(F.col("graph").alias("id"), "nodes", "edges")).alias("value"))


def load_tbox(name: str = "general") -> dict[str, list[str]]:
    """A type box from a JSON file with ``nodes`` and ``edges``; the general one for its name or a missing file."""
    path = Path(name)
    if name == "general" or not path.is_file():
        return GENERAL
    found = json.loads(path.read_text())
    return {"nodes": list(found.get("nodes", [])), "edges": list(found.get("edges", []))}


def load_queries(path: str) -> dict[str, str]:
    """Named queries of a YAML file; none for a missing file."""
    import yaml

    if not Path(path).is_file():
        return {}
    found = yaml.safe_load(Path(path).read_text()) or {}
    found = found.get("queries", found)
    return {k: v["query"] if isinstance(v, dict) else v for k, v in found.items()}
