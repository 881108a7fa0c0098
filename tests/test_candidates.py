"""Queries for many candidates against one query for each, and the optimisers over them."""

import pytest

from graphtide.plans.candidates import answers, kb_calibrate, kb_optimize, objective
from graphtide.plans.kb_queries import EX, kb
from graphtide.plans.sparql import flat, query

TEXT = f"PREFIX ex: <{EX}> SELECT (SUM(?b - ?k) AS ?y) WHERE {{ ?c ex:balance ?b . OPTIONAL {{ ?c ex:segment ?s . FILTER(?b > ?k) }} {{ SELECT ?c (COUNT(?n) AS ?m) WHERE {{ ?c ex:nation ?n . FILTER(?k < 9000) }} GROUP BY ?c }} FILTER(BOUND(?s)) }}"


def test_each_candidate_gets_its_own_answer(spark, small):
    g = kb(spark, small, "customer")
    points = [0.0, 2500.0, 8999.0, 9500.0]
    got = {r.run_id: r.y.num for r in answers(g, TEXT, [{"k": p} for p in points]).collect()}
    for i, p in enumerate(points):
        one = flat(query(g, TEXT.replace("?k", str(p))), y="num").first().y
        assert got.get(i) == (pytest.approx(one) if one is not None else None)
    assert objective(g, TEXT, ["k"], "y", -1.0)([[9500.0], [0.0]]).tolist() == [-1.0, pytest.approx(got[0])]
    with pytest.raises(ValueError):
        answers(g, TEXT + " LIMIT 3", [{"k": 1.0}])
    with pytest.raises(ValueError):
        answers(g, TEXT, [{"b": 1.0}])


def test_optimum_and_calibration_over_a_graph(spark, small):
    g = kb(spark, small, "customer")
    mean = flat(query(g, f"PREFIX ex: <{EX}> SELECT (AVG(?b) AS ?y) WHERE {{ ?c ex:balance ?b }}"), y="num").first().y
    text = f"PREFIX ex: <{EX}> SELECT (SUM((?b - ?k) * (?b - ?k)) AS ?y) WHERE {{ ?c ex:balance ?b }}"
    found, _ = kb_optimize(g, text, "y", {"k": (0.0, 10_000.0)}, size=12, rounds=12)
    assert found["k"] == pytest.approx(mean, abs=150)
    pairs = f"PREFIX ex: <{EX}> SELECT (?b * ?f AS ?guess) (?b * 3 AS ?seen) WHERE {{ ?c ex:balance ?b }}"
    found, error = kb_calibrate(g, pairs, "guess", "seen", {"f": (0.0, 10.0)}, size=12, rounds=12)
    assert found["f"] == pytest.approx(3.0, abs=0.1) and error >= 0


def test_rows_that_no_candidate_tells_apart_meet_the_candidates_once(spark, small):
    """Filters, counts and sums as one query for each gives them, with ties at the thresholds and unbound values."""
    g = kb(spark, small, "customer")
    ties = [r.c_acctbal for r in spark.read.parquet(f"{small}/customer.parquet").where("c_acctbal > 0").limit(3).collect()]
    points = [{"k": min(ties), "h": 9000.0}, {"k": 0.0, "h": max(ties)}]
    where = "?c ex:nation ?n ; ex:balance ?b . OPTIONAL { ?c ex:segment ?s . FILTER(?b > 3000) }"
    text = f"PREFIX ex: <{EX}> SELECT ?n (SUM(?b - ?k) AS ?y) (COUNT(*) AS ?m) (COUNT(?s) AS ?w) WHERE {{ {where} FILTER(?k <= ?b && ?b < ?h) }} GROUP BY ?n HAVING (COUNT(*) > 1)"
    rows = answers(g, text, points)
    got = {(r.run_id, r.n.lex): [None if x is None else x.num for x in (r.y, r.m, r.w)] for r in rows.collect()}
    want = {}
    for i, p in enumerate(points):
        one = text.replace("?h", str(p["h"]))
        for r in query(g, one.replace("?k", str(p["k"]))).collect():
            want[i, r.n.lex] = [x.num for x in (r.y, r.m, r.w)]
    assert got.keys() == want.keys() and len(got) > 20
    for k in got:
        assert got[k] == pytest.approx(want[k])


def test_what_meets_the_candidates_does_not_grow_with_the_rows(spark, small):
    """Rows of the join with the candidates: one for each group, interval and candidate at most."""
    text = f"PREFIX ex: <{EX}> SELECT (COUNT(*) AS ?m) WHERE {{ ?c ex:balance ?b . FILTER(?b > ?k) }}"
    rows = answers(kb(spark, small, "customer"), text, [{"k": 1000.0 * i} for i in range(3)])
    plan = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, x in enumerate(plan) if "Join" in x and "Cross" in x or "Join Inner, (_v0" in x)
    assert any("Aggregate" in x and "_cell0" in x for x in plan[at:])
