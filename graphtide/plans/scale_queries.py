"""Registered queries of scans, order statistics, fronts and queries for many candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphtide.operators import discrete, scans
from graphtide.operators.skyline import skyline
from graphtide.plans.candidates import answers, grades
from graphtide.plans.kb_queries import EX, kb, table

QUERIES, SQL = {}, {}


def registered(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


_ONE = "SELECT event_id, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 1e6 AS a, 200.0 + (event_id % 7) * 60 AS s FROM events"


@registered(
    f"""WITH o AS ({_ONE}), c AS (SELECT *, sum(s) OVER w AS cum FROM o WINDOW w AS (ORDER BY a, event_id ROWS UNBOUNDED PRECEDING))
 SELECT event_id AS entity_id, round(cum + max(a - (cum - s)) OVER (ORDER BY a, event_id ROWS UNBOUNDED PRECEDING), 2) AS dep_t FROM c"""
)
def des_one_queue(spark, sf_dir):
    """All events before a single server: one queue over many tasks."""
    e = table(spark, sf_dir, "events").select(F.lit("all").alias("queue"), F.col("event_id").alias("entity_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.lit(200.0) + (F.col("event_id") % 7) * 60).alias("service_t"))
    first = e.agg(F.min("us")).first()[0] or 0
    return discrete.fifo(e.withColumn("arr_t", (F.col("us") - first) / 1e6)).select("entity_id", F.round("dep_t", 2).alias("dep_t"))


@registered("SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) AS shipped FROM lineitem")
def running_total(spark, sf_dir):
    """A running total over all lines, in no group at all."""
    rows = table(spark, sf_dir, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return scans.running_sum(rows, [], rows.columns, "l_quantity", "shipped").select("l_orderkey", "l_linenumber", "shipped")


@registered(
    """WITH o AS (SELECT l_returnflag, list(l_extendedprice ORDER BY l_extendedprice) AS x FROM lineitem GROUP BY 1)
 SELECT l_returnflag, x[len(x) * 5 // 100 + 1] AS p5, x[len(x) // 2 + 1] AS p50, x[len(x) * 95 // 100 + 1] AS p95 FROM o"""
)
def order_statistics(spark, sf_dir):
    """Exact percentiles of all lines' prices by flag, from counted values."""
    place = lambda q: lambda n: F.floor(n * q / 100)
    return scans.at_places(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", {f"p{q}": place(q) for q in (5, 50, 95)})


_BEATS = " AND ".join(f"q.{c} <= p.{c}" for c in ("x", "y", "z", "u"))


@registered(
    f"""WITH o AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS x, l_tax AS y, -l_discount AS z, -l_quantity AS u FROM lineitem), v AS (SELECT DISTINCT x, y, z, u FROM o)
 SELECT l_orderkey, l_linenumber FROM o p WHERE NOT EXISTS (SELECT 1 FROM v q WHERE {_BEATS} AND (q.x < p.x OR q.y < p.y OR q.z < p.z OR q.u < p.u))"""
)
def skyline_four(spark, sf_dir):
    """The front of all lines: low price and tax, high discount and quantity, with many ties."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("x"), F.col("l_tax").alias("y"), (-F.col("l_discount")).alias("z"), (-F.col("l_quantity")).alias("u"))
    return skyline(rows, ["x", "y", "z", "u"]).select("l_orderkey", "l_linenumber")


@registered(
    f"""WITH k AS (SELECT i AS run_id, i * 10.0 - 500 AS k FROM range(1000) t(i))
 SELECT run_id, '{EX}n' || c_nationkey AS n, round(sum(c_acctbal - k), 2) AS y, count(*)::BIGINT AS m FROM customer, k WHERE c_acctbal > k GROUP BY ALL"""
)
def candidate_objective(spark, sf_dir):
    """A thousand thresholds tried on all customers by one query: the sum above each, by nation."""
    text = f"PREFIX ex: <{EX}> SELECT ?n (SUM(?b - ?k) AS ?y) (COUNT(*) AS ?m) WHERE {{ ?c ex:balance ?b ; ex:nation ?n . FILTER(?b > ?k) }} GROUP BY ?n"
    rows = answers(kb(spark, sf_dir, "customer"), text, [{"k": i * 10.0 - 500} for i in range(1000)])
    return rows.select("run_id", *flat_columns(n="lex", y="num", m="num")).select("run_id", "n", F.round("y", 2).alias("y"), F.col("m").cast("long").alias("m"))


def flat_columns(**columns: str) -> list:
    return [F.col(c)[what].alias(c) for c, what in columns.items()]


@registered(
    """WITH k AS (SELECT i AS run_id, i * 500.0 AS low, i * 500.0 + 2000 AS high FROM range(20) t(i))
 SELECT run_id, 'within' AS query, (SELECT count(*) FROM customer WHERE c_acctbal > low AND c_acctbal < high)::BIGINT AS n FROM k UNION ALL
 SELECT run_id, 'poor suppliers', (SELECT count(*) FROM supplier WHERE s_acctbal < low)::BIGINT FROM k"""
)
def candidate_grades(spark, sf_dir):
    """Two queries graded for twenty candidates, those without a solution with 0."""
    ask = lambda what: f"PREFIX ex: <{EX}> SELECT ?x WHERE {{ {what} }}"
    texts = {"within": ask("?x ex:segment ?s ; ex:balance ?b . FILTER(?b > ?low && ?b < ?high)"), "poor suppliers": ask("?x ex:balance ?b . OPTIONAL { ?x ex:segment ?s } FILTER(!BOUND(?s) && ?b < ?low)")}
    return grades(kb(spark, sf_dir, "customer", "supplier"), texts, [{"low": i * 500.0, "high": i * 500.0 + 2000} for i in range(20)])
