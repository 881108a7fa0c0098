"""Closures against walks, on graphs with and without cycles."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graphtide.operators.closure import _climbed, reach


def walk(edges):
    to, out = defaultdict(set), set()
    for a, b in edges:
        to[a].add(b)
    for a in list(to):
        seen, front = set(), list(to[a])
        while front:
            x = front.pop()
            if x not in seen:
                seen.add(x)
                front += to[x]
        out |= {(a, b) for b in seen}
    return out


def graphs():
    rng = random.Random(5)
    cycle = lambda start, n: [(start + i, start + (i + 1) % n) for i in range(n)]
    yield "dag", [(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(120)) if a < b]
    yield "random", [(rng.randrange(50), rng.randrange(50)) for _ in range(90)]
    yield "cycles", cycle(0, 1) + cycle(10, 2) + cycle(20, 9) + cycle(40, 5) + [(3, 10), (10, 21), (25, 41), (44, 60), (60, 61), (12, 12), (None, 4), (4, None)]
    yield "chain", [(i, i + 1) for i in range(40)] + [(40, 33)]
    yield "none", []


@pytest.mark.parametrize("name, edges", list(graphs()))
def test_reach(spark, name, edges):
    df = spark.createDataFrame([*edges, *edges[:3]], "a long, b long")
    rows = [tuple(r) for r in reach(df).collect()]
    want = walk([e for e in edges if None not in e])
    assert sorted(rows) == sorted(want)


def test_dense_cycles_close_by_their_members(spark):
    """100,000 edges in components of 40 nodes: the pairs are counted, not the paths."""
    n, size = 2_500, 40
    e = spark.range(n * size).select((F.col("id") - F.col("id") % size).alias("base"), (F.col("id") % size).alias("i"))
    edges = e.select((F.col("base") + F.col("i")).alias("a"), (F.col("base") + (F.col("i") + 1) % size).alias("b")).union(e.where("i < 5").select((F.col("base") + F.col("i")).alias("a"), (F.col("base") + (F.col("i") * 7 + 3) % size).alias("b")))
    assert edges.count() > 100_000
    assert reach(edges).count() == n * size * size


@pytest.mark.parametrize("name, edges", list(graphs()))
@pytest.mark.parametrize("many", [0, 100_000])
def test_reach_without_the_edges(spark, name, edges, many):
    """Climbed or doubled, the pairs without edges are the walk's; cycles and high graphs fall back to doubling."""
    df = spark.createDataFrame([*edges, *edges[:3]], "a long, b long")
    rows = [tuple(r) for r in reach(df, far=True, many=many).collect()]
    said = {e for e in edges if None not in e}
    assert sorted(rows) == sorted(walk(said) - said)
    if not many:
        assert sorted(tuple(r) for r in reach(df, many=0).collect()) == sorted(walk(said))


def test_levels_make_each_pair_once(spark):
    """Edges without cycles are climbed; a chain higher than the levels allowed is left to doubling."""
    tree = spark.range(2, 400).select(F.col("id").alias("a"), F.expr("id div 2").alias("b"))
    rows = _climbed(tree)
    assert rows.count() == len(walk([(i, i // 2) for i in range(2, 400)])) and rows.where("d = 1").count() == 398
    chain = spark.range(6).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert _climbed(chain, 6).count() == 21 and _climbed(chain, 5) is None
    assert _climbed(chain.union(chain.select(F.lit(6).cast("long"), F.lit(4).cast("long")).limit(1))) is None


@pytest.mark.parametrize("ends", [3, 1 << 16])
def test_listed_ends_go_in_bounded_rows(spark, monkeypatch, ends):
    """A node's ends are in rows, not pair by pair, and a node that leads to more than a row may hold has several; the pairs are the walk's."""
    from graphtide.operators import closure

    monkeypatch.setattr(closure, "ENDS", ends)
    edges = [(100 + i, i % 9) for i in range(30)] + [(300, 100 + i) for i in range(30)] + [(300, 1), (3, 50), (7, 7)]
    df = spark.createDataFrame([*edges, *edges[:3]], "a string, b string" if ends > 3 else "a long, b long")
    name = str if ends > 3 else int
    rows = reach(df, far=True, many=0, listed=True).collect()
    want = walk(edges) - set(edges)
    assert sorted((r["a"], b) for r in rows for b in r["ends"]) == sorted((name(a), name(b)) for a, b in want)
    assert max(len(r["ends"]) for r in rows) > 3 if ends > 3 else len([r for r in rows if r["a"] == 300]) > 3
    if ends > 3:
        assert len(rows) == len({a for a, _ in want})


def test_a_lone_chain_is_not_stored_with_its_terms(spark, monkeypatch):
    """What a transitive property adds is stored as numbers; only readers of objects look their names up."""
    from graphtide.functions import terms as T
    from graphtide.operators import inference
    from graphtide.operators.graph import Graph

    stored = []
    monkeypatch.setattr(inference, "settle", lambda df, keep=inference.settle: stored.append(df.columns) or keep(df))
    g = Graph.of(spark, [("next", T.TYPE, T.OWL + "TransitiveProperty"), ("a", "next", "b"), ("b", "next", "c"), ("c", "next", ("end",)), ("c", "next", "d")])
    full, new = inference.infer(g, inference.owl_rules()[2:3])
    got = {(r["s"], r["o"]["lex"]) for r in new.collect()}
    assert got == {("a", "c"), ("a", "d"), ("b", "d"), ("a", "end"), ("b", "end")} and new.count() == 5 and full.count() == 10
    assert stored.count(["s", "s_kind", "p", "o"]) == 2  # the graph's own, and what ends in literals
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join")
    assert joins(new.select("s")) < joins(new.select("s", "o"))
