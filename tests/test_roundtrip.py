"""Round trips: defaults, several numbers, ties, entities at rest, and evidence of the last pass alone."""

import pytest
from pyspark.sql import functions as F

from graphtide.functions import terms as T
from graphtide.operators import roundtrip as L
from graphtide.operators import rules as R
from graphtide.operators.bridge import SIM
from graphtide.operators.dynamics import simulate_sql
from graphtide.operators.graph import Graph
from graphtide.sources.sysd import parse_sysd

X = "http://x/"
MODEL = parse_sysd("dt 1\nfrom 0 to 4\naux k: 0\nstock A: 1\n  + grow: k\n")


def _last():
    return {"last": L.last("A")}


def _graph(spark):
    rows = [(X + n, T.TYPE, X + "Plant") for n in "abc"]
    rows += [(X + "a", X + "size", 2.0), (X + "a", X + "size", 5.0), (X + "b", X + "size", 7.0), (X + "d", X + "size", 1.0), (X + "b", X + "near", X + "a"), (X + "c", X + "near", X + "a")]
    return Graph.of(spark, rows)


def _run(spark, **options):
    queries = {"big": f"SELECT ?s WHERE {{ ?s <{SIM}last> ?v FILTER(?v > 6) }}", "share": f"SELECT ?s (?v / 10 AS ?score) WHERE {{ ?s <{SIM}last> ?v }}"}
    return L.closed_loop(_graph(spark), X + "Plant", {"A": (X + "size", 3.0), "k": (X + "rate", 0.0)}, lambda r: simulate_sql(MODEL, r), _last(), queries, **options)


def test_parameters_come_from_facts(spark):
    runs = L.runs_for_class(_graph(spark), X + "Plant", {"A": (X + "size", 3.0)}).collect()
    assert {r["s"]: r["A"] for r in runs} == {X + "a": 2.0, X + "b": 7.0, X + "c": 3.0}
    assert len({r["run_id"] for r in runs}) == 3


def test_loop_moves_those_not_at_rest(spark):
    view, history = _run(spark, nudges={"k": F.col("k") + 1}, until=F.col("big") == 1, passes=5)
    got = sorted((r["s"][-1], r["pass"], r["k"], r["last"], r["big"], r["share"]) for r in history.collect())
    assert got == [
        ("a", 0, 0.0, 2.0, 0.0, 0.2), ("a", 1, 1.0, 6.0, 0.0, 0.6), ("a", 2, 2.0, 10.0, 1.0, 1.0),
        ("b", 0, 0.0, 7.0, 1.0, 0.7),
        ("c", 0, 0.0, 3.0, 0.0, 0.3), ("c", 1, 1.0, 7.0, 1.0, 0.7),
    ]
    last = {r["s"][-1]: r["o"]["num"] for r in view.scan(p=SIM + "last").collect()}
    assert last == {"a": 10.0, "b": 7.0, "c": 7.0}
    near = view.query(f"SELECT ?x ?v WHERE {{ ?x <{X}near> ?y . ?y <{SIM}last> ?v }}").collect()
    assert sorted((r["x"]["lex"][-1], r["v"]["num"]) for r in near) == [("b", 10.0), ("c", 10.0)]


def test_whole_scan_has_facts_and_evidence_once(spark):
    view, _ = _run(spark, passes=2)
    assert view.scan().count() == 9 + 3
    assert view.scan(p=X + "near").count() == 2


def test_no_instances(spark):
    _, history = L.closed_loop(_graph(spark), X + "Nothing", {"A": (X + "size", 1.0)}, lambda r: simulate_sql(MODEL, r), _last(), {"any": f"SELECT ?s WHERE {{ ?s <{SIM}last> ?v }}"}, until=F.lit(True))
    assert history.count() == 0


def test_names_apart(spark):
    with pytest.raises(ValueError):
        L.closed_loop(_graph(spark), X + "Plant", {"last": (X + "size", 1.0)}, lambda r: r, _last(), {})


def test_grades_of_ties_and_nothing(spark):
    nodes = spark.createDataFrame([(X + "a",), (X + "b",), (X + "z",)], "s string")
    texts = {"size": f"SELECT ?s (?v / 6 AS ?score) WHERE {{ ?s <{X}size> ?v }}", "near": f"SELECT ?s WHERE {{ ?s <{X}near> ?o }}"}
    got = {r["s"][-1]: (r["size"], r["near"]) for r in L.graded(_graph(spark), nodes, texts).collect()}
    assert got == {"a": (pytest.approx(5 / 6), 0.0), "b": (1.0, 1.0), "z": (0.0, 0.0)}


def test_head_and_tail(spark):
    t = spark.createDataFrame([(1, s, float(s), "A", float(s)) for s in range(11)] + [(1, s, float(s), "B", -1.0) for s in range(11)], "run_id long, step int, t double, var string, value double")
    r = L.scored(t, {"up": F.avg(F.when(F.col("tail"), L.value("A"))) - F.avg(F.when(F.col("head"), L.value("A"))), "none": F.max(L.value("C"))}).first()
    assert (r["up"], r["none"]) == (9.0, None)


def test_nulls_state_nothing(spark):
    rows = spark.createDataFrame([("x", 1.0, None), ("y", float("nan"), 2.0)], "s string, m double, n double")
    assert sorted((r["s"], r["p"], r["o"]["num"]) for r in L.facts(rows, ["m", "n"]).collect()) == [("x", SIM + "m", 1.0), ("y", SIM + "n", 2.0)]


def test_rule_simulates_each_node_once(spark):
    e = R.Engine(_graph(spark))
    action = L.SimulateMatches("x", {"A": "?v", "k": (X + "rate", 0.5)}, lambda r: simulate_sql(MODEL, r), _last())
    e.add_rule(R.Production("run", [R.TripleCondition("?x", X + "size", "?v")], [action]))
    done = e.evaluate(0.0)
    assert {r["s"][-1]: r["o"]["num"] for r in e.graph.scan(p=SIM + "last").collect()} == {"a": 4.0, "b": 9.0, "d": 3.0}
    assert {r["action_type"] for r in done.collect()} == {"simulate"}
