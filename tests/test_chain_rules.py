"""Rules that chain one predicate, with other rules beside them, against a fixpoint in plain Python."""

from graphtide.functions import terms as T
from graphtide.operators import inference
from graphtide.operators.graph import Graph
from graphtide.operators.inference import infer, owl_rules, rdfs_rules, rule

P, Q = "http://x/p", "http://x/q"


def closed(pairs):
    pairs = set(pairs)
    while more := {(a, d) for a, b in pairs for c, d in pairs if b == c} - pairs:
        pairs |= more
    return pairs


def facts(graph, p):
    return {(r.s, r.o.lex) for r in graph.scan(p=p).collect()}


def test_symmetric_transitive_and_literal_ends(spark):
    links = [("a", "b"), ("b", "c"), ("d", "d"), ("e", "f")]
    g = Graph.of(spark, [(P, T.TYPE, T.OWL + "TransitiveProperty"), (P, T.TYPE, T.OWL + "SymmetricProperty"), ("c", P, 7), *[(a, P, b) for a, b in links], ("x", Q, "y"), ("y", Q, "z")])
    full, new = infer(g, owl_rules()[1:3])
    expected = closed(links + [(b, a) for a, b in links] + [("c", "7")])
    assert facts(full, P) == expected
    assert facts(full, Q) == {("x", "y"), ("y", "z")}  # not declared
    assert new.count() == len(expected) - len(links) - 1


def test_chain_fed_by_another_rule(spark):
    sub = T.RDFS + "subClassOf"
    g = Graph.of(spark, [("A", "http://x/below", "B"), ("B", sub, "C"), ("C", sub, "D"), ("http://x/below", T.RDFS + "subPropertyOf", sub), ("i", T.TYPE, "A")])
    full, _ = infer(g, rdfs_rules())
    assert facts(full, sub) == closed([("A", "B"), ("B", "C"), ("C", "D")])
    assert {o for s, o in facts(full, T.TYPE) if s == "i"} == {"A", "B", "C", "D"}


def test_no_facts(spark):
    assert infer(Graph.empty(spark), owl_rules())[1].count() == 0


def pairs_of(spark, quads, body, known=()):
    """What a rule of pairs gives, told by two loops, and the rows of infer."""
    g = Graph.of(spark, [*quads, *[(a, "http://x/near", b) for a, b in known]])
    full, new = infer(g, [rule("near", body, [("?a", "http://x/near", "?b")])])
    rows = [(r.s, r.o.lex) for r in new.collect()]
    assert len(rows) == len(set(rows)) and facts(full, "http://x/near") == set(rows) | set(known)
    return set(rows), new


def test_pairs_that_meet_at_a_node_are_neither_stored_nor_dealt(spark, monkeypatch):
    """Each pair comes once, wherever it meets, and only nodes are shuffled; those of many nodes go the general way."""
    quads = [(f"s{i}", P, f"n{i % m}") for i in range(60) for m in (3, 4)] + [(f"s{i}", Q, f"n{i % 5}") for i in range(30)] + [("s1", P, 7), ("n1", P, "n1")]
    body = [("?a", P, "?n"), ("?b", P, "?n")]
    at = {(s, str(o)) for s, p, o in quads if p == P}
    true = {(a, b) for a, n in at for b, m in at if n == m}
    rows, new = pairs_of(spark, quads, body)
    assert rows == true
    plan = new._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Aggregate" not in plan  # the pairs come from the join as they are
    known = {("s0", "s3"), ("s0", "zz")}
    assert pairs_of(spark, quads, body, known)[0] == true - known
    over = {(a, b) for a, p, n in quads for b, q, m in quads if p == P and q == Q and n == m}
    assert pairs_of(spark, quads, [("?b", Q, "?n"), ("?a", P, "?n")])[0] == over
    assert pairs_of(spark, quads, [("?n", P, "?b"), ("?n", Q, "?a")])[0] == {(a, str(b)) for n, q, a in quads for m, p, b in quads if p == P and q == Q and n == m}
    monkeypatch.setattr(inference, "MANY", 1)
    assert pairs_of(spark, quads, body, known)[0] == true - known
