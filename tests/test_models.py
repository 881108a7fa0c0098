"""Models: parsing, lowering, both simulators, units, loops."""

import math

import numpy as np
import pytest

from graphtide.functions.expressions import ExpressionError, parse, to_numpy
from graphtide.operators import causal, dynamics, units
from graphtide.operators.optimise import evolve, fronts, lp_maximize, lp_minimize, nelder_mead, nsga2
from graphtide.operators.patterns import signal_chain, supply_chain
from graphtide.sources.sysd import issues, lower, parse_sysd


def value(text, **env):
    return float(np.asarray(to_numpy(parse(text))({"t": 0.0, "dt": 1.0, **env})))


@pytest.mark.parametrize(("text", "expected"), [("1 + 2 * 3", 7), ("-2 ** 2", -4), ("2 ** 3 ** 2", 512), ("IF(1 > 2, 3, 4)", 4), ("MIN(4, 2, 3)", 2), ("1 < 2", 1), ("not 1 or 1 and 0", 0), ("unknown + 1", 1), ("1.5e2", 150)])
def test_expressions(text, expected):
    assert value(text) == expected


@pytest.mark.parametrize("text", ["1 +", "(1", "f(1 2)", "1 $ 2", "a = 1"])
def test_bad_expressions(text):
    with pytest.raises(ExpressionError):
        parse(text)


def last(spark, text, **kw):
    rows = dynamics.simulate(parse_sysd(text), spark.range(1).withColumnRenamed("id", "run_id"), last=True, **kw).collect()
    return {r["var"]: r["value"] for r in rows}


def test_decay_is_near_the_exponential(spark):
    text = "dt 0.5\nfrom 0 to 10\nstock S: 100\n  - out: S * 0.1\n"
    assert last(spark, text, method="rk4")["S"] == pytest.approx(100 * math.exp(-1), rel=1e-4)


def test_simulators_agree(spark):
    m = parse_sysd("dt 0.25\nfrom 0 to 5\naux k: 0.3\nstock A: 10\n  - move: A * k\nstock B: 0\n  + move: A * k\n  - leave: SMOOTH(B, 2)\n")
    runs = spark.createDataFrame([(0, 0.1), (1, 0.5)], "run_id long, k double")
    for method in ("euler", "rk4"):
        a = {(r.run_id, r.step, r["var"]): r.value for r in dynamics.simulate_sql(m, runs, method).collect()}
        b = {(r.run_id, r.step, r["var"]): r.value for r in dynamics.simulate(m, runs, method).collect()}
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_conservation(spark):
    got = last(spark, "dt 0.25\nfrom 0 to 50\nstock A: 100\n  - m: A * 0.1\nstock B: 0\n  + m: A * 0.1\n")
    assert got["A"] + got["B"] == pytest.approx(100, abs=1e-9)


def test_convey_fills_then_holds(spark):
    text = "dt 1\nfrom 0 to 12\naux x: 100\nstock S: 0\n  + in_: x\n  - out: CONVEY(x, 5)\n"
    runs = spark.range(1).withColumnRenamed("id", "run_id")
    values = [r.value for r in dynamics.simulate(parse_sysd(text), runs).orderBy("step").collect()]
    assert values[5] == 500 and values[-1] == values[-2]


def test_random_runs_do_not_depend_on_batches(spark):
    m = parse_sysd("dt 1\nfrom 0 to 5\nstock S: 0\n  + in_: NOISE(3)\n")
    a = {r.run_id: r.value for r in dynamics.simulate(m, spark.range(20).withColumnRenamed("id", "run_id"), last=True).collect()}
    b = {r.run_id: r.value for r in dynamics.simulate(m, spark.range(20).withColumnRenamed("id", "run_id").repartition(7), last=True).collect()}
    assert a == b and len(set(a.values())) == 20


def test_time_ends_exactly(spark):
    rows = dynamics.simulate(parse_sysd("dt 0.3\nfrom 0 to 1\nstock S: 0\n  + i: 1\n"), spark.range(1).withColumnRenamed("id", "run_id")).orderBy("step").collect()
    assert rows[-1].t == 1.0 and rows[-1].value == pytest.approx(1.0)


def test_parser_keeps_agents_and_queues():
    m = parse_sysd('model M\nagent "X": 3\n  property "hp": 100 min=0 max=200\n  rule heal: when hp < 50\n    hp += 10\nqueue "Q": capacity 5, servers 2, service_time 1.5, event_driven\n  arrival_rate 3\nresource "D": capacity 4\nnonsense here ?\n')
    a, q = m.agents[0], m.queues[0]
    assert (a.count, a.properties[0].high, a.rules[0].effects) == (3, 200, ["hp += 10"])
    assert (q.capacity, q.servers, q.event_driven, q.arrival_rate) == (5, 2, True, "3")
    assert m.resources[0].capacity == 4 and m.ignored == ["nonsense here ?"]


def test_lowering():
    s = lower(parse_sysd("aux d: DELAY3(y, 6)\naux z: y + 1\naux y: x * 2\naux x: 1\nstock S: 0\n  + i: d\n"))
    order = [n for n, _ in s.auxes]
    assert len(s.states) == 4 and order.index("x") < order.index("y") < order.index("z")


def test_issues_and_units():
    m = parse_sysd("stock S: 0 ~unit~\n  + i: rate * missing ~unit/day~\n  - o: S / gone\naux rate: 1 ~unit~\n")
    found = {(level, where) for level, where, _ in issues(m)}
    assert ("error", "i") in found and ("warning", "o") in found
    bad = parse_sysd("stock S: 0 ~unit~\n  + i: rate\naux rate: 1 ~unit~\n")
    assert units.check(bad) and not units.check(parse_sysd("stock S: 0 ~unit~\n  + i: rate\naux rate: 1 ~unit/day~\n"))


def test_loops(spark):
    m = parse_sysd("stock S: 1\n  + i: a\naux a: S * 2\n")
    assert [sorted(r.nodes) for r in causal.loops(causal.dependencies(spark, m)).collect()] in ([["S", "a", "i"]], [["S", "a"]])


def test_factories(spark):
    for m in (signal_chain(), supply_chain(3)):
        rows = dynamics.simulate(m, spark.range(1).withColumnRenamed("id", "run_id"), last=True).collect()
        assert rows and all(math.isfinite(r.value) for r in rows)


def test_linear_programmes():
    r = lp_maximize([3, 5], a_ub=[[1, 0], [0, 2], [3, 2]], b_ub=[4, 12, 18])
    assert r.objective == pytest.approx(36) and r.x == pytest.approx([2, 6])
    r = lp_minimize([1, 1], a_eq=[[1, 2]], b_eq=[4], bounds=[(1, None), (None, None)])
    assert r.objective == pytest.approx(2.5)
    assert lp_minimize([1], a_ub=[[1]], b_ub=[-1]).status == "infeasible"
    assert lp_minimize([-1]).status == "unbounded"


def test_searches():
    f = lambda x: ((x - [1, -2]) ** 2).sum(axis=1)
    assert evolve(f, [(-5, 5), (-5, 5)])[0] == pytest.approx([1, -2], abs=0.05)
    assert nelder_mead(f, np.zeros(2))[0] == pytest.approx([1, -2], abs=1e-3)
    x, y = nsga2(lambda x: np.stack((x[:, 0] ** 2, (x[:, 0] - 2) ** 2), axis=1), [(-5, 5)])
    assert (x >= -0.3).all() and (x <= 2.3).all() and (fronts(y) == 0).all()
