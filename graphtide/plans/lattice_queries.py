"""Registered queries of type lattices over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphtide.operators import lattice as Y
from graphtide.operators.inference import Lattice
from graphtide.plans.kb_queries import table

QUERIES, SQL = {}, {}


def registered(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@registered(
    """WITH k AS (SELECT o_totalprice AS v, CASE o_orderstatus WHEN 'O' THEN 'ACTION' WHEN 'F' THEN 'EVENT' ELSE 'TRANSFORMATION' END AS t FROM orders
 UNION ALL SELECT c_acctbal, 'PERSON' FROM customer UNION ALL SELECT s_acctbal, 'ORGANIZATION' FROM supplier UNION ALL SELECT p_retailprice, 'MATERIAL' FROM part),
 u AS (SELECT t AS a, t AS b FROM (SELECT DISTINCT t FROM k) UNION ALL SELECT * FROM (VALUES ('ACTION', 'PROCESS'), ('EVENT', 'PROCESS'), ('TRANSFORMATION', 'PROCESS'), ('PERSON', 'AGENT'), ('ORGANIZATION', 'AGENT'),
 ('MATERIAL', 'INTERACTION'), ('ACTION', 'BLOB'), ('EVENT', 'BLOB'), ('TRANSFORMATION', 'BLOB'), ('PERSON', 'BLOB'), ('ORGANIZATION', 'BLOB')) x(a, b))
 SELECT b AS type, count(*) AS n, round(max(v), 2) AS most, round(min(v), 2) AS least FROM k JOIN u ON k.t = u.a GROUP BY 1"""
)
def lattice_built_in(spark, sf_dir):
    """All orders, customers, suppliers and parts as instances of built-in types, rolled up to every type above."""
    status = F.when(F.col("o_orderstatus") == "O", "ACTION").when(F.col("o_orderstatus") == "F", "EVENT").otherwise("TRANSFORMATION")
    rows = table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("v"), status.alias("t"))
    for name, v, t in (("customer", "c_acctbal", "PERSON"), ("supplier", "s_acctbal", "ORGANIZATION"), ("part", "p_retailprice", "MATERIAL")):
        rows = rows.union(table(spark, sf_dir, name).select(v, F.lit(t)))
    measures = {"n": (F.count(F.lit(1)), F.sum), "most": (F.max("v"), F.max), "least": (F.min("v"), F.min)}
    return Y.rolled_up(rows, Y.built_in(spark), "t", measures).select("type", "n", F.round("most", 2).alias("most"), F.round("least", 2).alias("least"))


@registered(
    """SELECT l_orderkey, l_linenumber, a.n_regionkey = b.n_regionkey AND a.n_nationkey <> 3 AND b.n_nationkey <> 3 AS valid FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey"""
)
def lattice_judged_edges(spark, sf_dir):
    """Every line as an edge from its supplier's nation to its customer's, valid within a region; one nation is no type."""
    n = table(spark, sf_dir, "nation")
    region = F.concat(F.lit("region "), F.col("n_regionkey").cast("string"))
    types = n.where("n_nationkey <> 3").select(F.col("n_name").alias("name"), region.alias("parent"))
    types = types.union(n.select(region, F.lit(None).cast("string")).distinct()).union(n.select(F.concat(F.lit("ships in "), region), F.lit(None).cast("string")).distinct())
    limits = n.select(F.concat(F.lit("ships in "), region).alias("edge_type"), region.alias("domain"), region.alias("range")).distinct()
    # A supplier or customer is small beside the lines, and AQE sends it to them where its size allows.
    source = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("source_type"), F.concat(F.lit("ships in "), region).alias("edge_type"))
    target = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("target_type"))
    sold = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(target, "o_custkey")
    edges = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(source, "l_suppkey").join(sold, "l_orderkey")
    return Y.judged(edges, Lattice(types.withColumn("properties", F.lit(None).cast("map<string,boolean>"))), limits).select("l_orderkey", "l_linenumber", "valid")
