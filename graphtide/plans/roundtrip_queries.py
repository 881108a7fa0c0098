"""Registered queries of round trips between graph and simulation, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphtide.functions import terms as T
from graphtide.operators import dynamics as D
from graphtide.operators import roundtrip as L
from graphtide.operators import rules as R
from graphtide.operators.bridge import SIM
from graphtide.plans.kb_queries import EX, kb
from graphtide.plans.sparql import flat
from graphtide.sources.sysd import parse_sysd

QUERIES, SQL = {}, {}


def registered(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


_MODEL = parse_sysd("dt 1\nfrom 0 to 10\naux k: 0.1\nstock Level: 100\n  - drain: Level * k\n")


def _simulate(runs):
    return D.simulate_sql(_MODEL, runs)


@registered(
    f"""WITH t AS (SELECT c_custkey, s, c_acctbal * pow(0.9, s) AS v FROM customer, range(0, 11) r(s))
 SELECT '{EX}c' || c_custkey AS s, round(max(v) - min(v), 3) AS spread, CAST(count(*) FILTER (abs(v) < 1000) AS DOUBLE) AS below, round(avg(v) FILTER (s <= 1) - avg(v) FILTER (s >= 9), 3) AS fall FROM t GROUP BY 1"""
)
def evidence_own_scores(spark, sf_dir):
    """Scoring functions of a user's own over every customer's trajectory."""
    runs = L.runs_for_class(kb(spark, sf_dir, "customer"), EX + "Customer", {"Level": (EX + "balance", 0.0)})
    level = L.value("Level")
    measures = {
        "spread": F.max(level) - F.min(level),
        "below": F.sum((F.abs(level) < 1000).cast("int")),
        "fall": F.avg(F.when(F.col("head"), level)) - F.avg(F.when(F.col("tail"), level)),
    }
    rows = runs.join(L.scored(_simulate(runs.select("run_id", "Level")), measures), "run_id")
    return rows.select("s", F.round("spread", 3).alias("spread"), "below", F.round("fall", 3).alias("fall"))



def _final():
    return {"final": L.last("Level") / 10000}


_HIGH = {"high": f"SELECT ?s ?score WHERE {{ ?s <{SIM}final> ?score }}"}


@registered(
    f"""SELECT '{EX}c' || c_custkey AS s, round(c_acctbal, 2) AS level, 0.15 AS k, round(f, 6) AS final, round(greatest(0, least(1, f)), 6) AS high, n_name = 'FRANCE' AS known
 FROM (SELECT *, c_acctbal * pow(0.85, 10) / 10000 AS f FROM customer) JOIN nation ON c_nationkey = n_nationkey"""
)
def full_roundtrip(spark, sf_dir):
    """Facts to parameters, runs, evidence and grades for all customers; one query joins the evidence with the facts."""
    g = kb(spark, sf_dir, "customer", "nation")
    queries = _HIGH | {"known": f'SELECT ?s WHERE {{ ?s <{SIM}final> ?f ; <{EX}nation> ?n . ?n <{EX}label> "FRANCE" }}'}
    _, rows = L.full_roundtrip(g, EX + "Customer", {"Level": (EX + "balance", 0.0), "k": (EX + "rate", 0.15)}, _simulate, _final(), queries)
    return rows.select("s", F.round("Level", 2).alias("level"), "k", F.round("final", 6).alias("final"), F.round("high", 6).alias("high"), (F.col("known") == 1).alias("known"))


_LOOP = f"""WITH RECURSIVE p AS (SELECT 0 AS pass, c_custkey, c_nationkey, c_acctbal AS level, 0.05::DOUBLE AS k, c_acctbal * pow(0.95, 10) / 10000 AS f FROM customer
 UNION ALL SELECT pass + 1, c_custkey, c_nationkey, level, k + 0.2 * least(1, f), level * pow(1 - (k + 0.2 * least(1, f)), 10) / 10000 FROM p WHERE pass < 3 AND f >= 0.15)"""


@registered(f"{_LOOP} SELECT pass, '{EX}c' || c_custkey AS s, round(k, 6) AS k, round(f, 6) AS final, round(greatest(0, least(1, f)), 6) AS high FROM p")
def closed_loop(spark, sf_dir):
    """Four passes at most for every customer: grades raise the rate, and those at rest leave the loop."""
    return _loop(spark, sf_dir)[1].select("pass", "s", F.round("k", 6).alias("k"), F.round("final", 6).alias("final"), F.round("high", 6).alias("high"))


def _loop(spark, sf_dir):
    parameters = {"Level": (EX + "balance", 0.0), "k": (EX + "rate", 0.05)}
    return L.closed_loop(kb(spark, sf_dir, "customer", "nation"), EX + "Customer", parameters, _simulate, _final(), _HIGH, {"k": F.col("k") + 0.2 * F.col("high")}, F.col("high") < 0.15, 4)


@registered(
    f"""{_LOOP}, e AS (SELECT c_custkey, c_nationkey, arg_max(f, pass) AS f FROM p GROUP BY ALL)
 SELECT n_name AS l, count(*) AS n, round(avg(f), 6) AS f FROM e JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"""
)
def closed_loop_evidence(spark, sf_dir):
    """A graph query over facts and the evidence that the loop laid over them: each entity's last pass alone."""
    view, _ = _loop(spark, sf_dir)
    rows = view.query(f"SELECT ?l (COUNT(?c) AS ?n) (AVG(?f) AS ?m) WHERE {{ ?c <{SIM}final> ?f ; <{EX}nation> ?k . ?k <{EX}label> ?l }} GROUP BY ?l")
    return flat(rows, l="lex", n="long", m="num").select("l", "n", F.round("m", 6).alias("f"))


@registered(
    f"""SELECT '{EX}c' || c_custkey AS s, round(c_acctbal * pow(0.9, 10) / 10000, 6) AS final, c_acctbal * pow(0.9, 10) / 10000 > 0.3 AS flagged FROM customer WHERE c_acctbal > 5000"""
)
def rules_simulate_matches(spark, sf_dir):
    """A rule simulates all customers that it matches, and the next rule reads the evidence."""
    e = R.Engine(kb(spark, sf_dir, "customer").materialise())
    simulate = L.SimulateMatches("c", {"Level": "?b", "k": (EX + "rate", 0.1)}, _simulate, _final())
    e.add_rule(R.Production("simulate", [R.TripleCondition("?c", EX + "balance", "?b"), R.ComparisonCondition("?b", ">", 5000)], [simulate], priority=1))
    e.add_rule(R.Production("flag", [R.TripleCondition("?c", SIM + "final", "?f"), R.ComparisonCondition("?f", ">", 0.3)], [R.TripleAction("?c", T.TYPE, EX + "Flagged")], priority=2))
    e.evaluate(0.0)
    flagged = e.graph.scan(p=T.TYPE).where(F.col("o.lex") == EX + "Flagged").select("s", F.lit(True).alias("flagged"))
    return e.graph.scan(p=SIM + "final").select("s", F.round("o.num", 6).alias("final")).join(flagged, "s", "left").select("s", "final", F.coalesce("flagged", F.lit(False)).alias("flagged"))
