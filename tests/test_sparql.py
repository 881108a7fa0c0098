"""The query language on small graphs: parsing, unbound values, errors."""

import pytest

from graphtide.functions import terms as T
from graphtide.operators.graph import Graph
from graphtide.plans.sparql import ask, flat, query
from graphtide.plans.sparql_parser import SparqlError, parse

P = "http://x/"


@pytest.fixture(scope="module")
def people(spark):
    return Graph.of(spark, [(P + "a", P + "name", ("Alice",)), (P + "a", P + "age", 30), (P + "b", P + "name", ("Bob", None, "en")), (P + "b", P + "age", 25), (P + "a", P + "knows", P + "b"), (P + "b", P + "knows", P + "c"), (P + "c", P + "knows", P + "a"), (P + "c", P + "note", ("x y",))])


def rows(g, text, **columns):
    return sorted(map(tuple, flat(query(g, f"PREFIX : <{P}> {text}"), **columns).collect()), key=str)


def test_optional_keeps_unbound(people):
    assert rows(people, "SELECT ?x ?n WHERE { ?x :knows ?y OPTIONAL { ?x :name ?n } }", x="lex", n="lex") == [(P + "a", "Alice"), (P + "b", "Bob"), (P + "c", None)]


def test_join_after_optional_goes_with_any_value(people):
    text = "SELECT ?x ?n WHERE { ?x :knows ?y OPTIONAL { ?x :name ?n } { SELECT ?n WHERE { ?z :name ?n } } }"
    got = rows(people, text, x="lex", n="lex")
    assert ((P + "c", "Alice") in got) and ((P + "c", "Bob") in got) and len(got) == 4


def test_paths(people):
    assert rows(people, "SELECT ?y WHERE { :a :knows+ ?y }", y="lex") == [(P + "a",), (P + "b",), (P + "c",)]
    assert rows(people, "SELECT ?y WHERE { :a :knows/:knows ?y }", y="lex") == [(P + "c",)]
    assert rows(people, "SELECT ?y WHERE { ?y ^:knows :a }", y="lex") == [(P + "b",)]


def test_lenient_and_strict_filters(people):
    text = "SELECT ?x WHERE { ?x :knows ?y FILTER(?nothing) }"
    assert len(rows(people, text, x="lex")) == 3
    assert query(people, f"PREFIX : <{P}> {text}", strict=True).count() == 0


def test_numbers_are_equal_by_value(spark):
    g = Graph.of(spark, [(P + "a", P + "v", 1), (P + "b", P + "v", 1.0), (P + "c", P + "v", ("1",))])
    assert rows(g, "SELECT ?x WHERE { ?x :v 1 }", x="lex") == [(P + "a",), (P + "b",)]


def test_language_functions(people):
    assert rows(people, 'SELECT ?x WHERE { ?x :name ?n FILTER(LANGMATCHES(LANG(?n), "*")) }', x="lex") == [(P + "b",)]


def test_ask_and_values(people):
    assert ask(people, f"PREFIX : <{P}> ASK {{ VALUES (?x ?y) {{ (:a :b) (:b UNDEF) }} ?x :knows ?y }}")
    assert not ask(people, f"ASK {{ <{P}a> <{P}knows> <{P}z> }}")


@pytest.mark.parametrize("text", ["SELECT ?x { ?x", "SELECT WHERE", "ASK { ?x :p ?y }", 'SELECT ?x { ?x <p> "open }', "DELETE { }"])
def test_bad_queries(text):
    with pytest.raises(SparqlError):
        parse(text)


def test_prefixes_that_begin_like_keywords():
    q = parse("PREFIX as: <http://as/> PREFIX in: <http://in/> SELECT ?x WHERE { ?x as:p in:q }")
    assert [p.p.lex for p in q.where.parts] == ["http://as/p"]


def test_unbound_is_first_and_numbers_sort_by_value(spark):
    g = Graph.of(spark, [(P + c, P + "v", v) for c, v in zip("abc", (100, 25, 3), strict=True)])
    got = [r[0] for r in flat(query(g, f"SELECT ?v WHERE {{ ?x <{P}v> ?v }} ORDER BY ?v"), v="num").collect()]
    assert got == [3, 25, 100]


def test_change_graphs(spark):
    g = Graph.of(spark, [(P + "a", P + "p", P + "b")], "one")
    g = g.add(g.quads, "two").add(g.quads, "two")
    assert g.quads.count() == 2 and g.count() == 1
    assert g.remove(s=P + "a", graph="one").graphs().collect()[0][0] == "two"
    assert g.remove(s=P + "a").count() == 0
    assert Graph.empty(spark).count() == 0


def test_functions_on_null(spark):
    g = Graph.of(spark, [(P + "a", P + "p", ("",))])
    got = query(g, f"SELECT (STRLEN(?v) AS ?n) (UCASE(?none) AS ?u) (1 / 0 AS ?d) WHERE {{ ?x <{P}p> ?v }}").first()
    assert got["n"]["num"] == 0 and got["u"] is None and got["d"] is None
    assert T.LITERAL == 2


def test_loose_joins_have_no_nested_loop(spark, small):
    from graphtide.plans import coverage_queries as C

    for name in ("loose_join", "loose_optional", "loose_join_alone"):
        plan = C.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_bindings_tell_what_they_leave_out(spark, small):
    import pytest

    from graphtide.plans.kb_queries import EX, kb
    from graphtide.plans.sparql import bindings, query

    rows = query(kb(spark, small, "nation"), f"SELECT ?l WHERE {{ ?n <{EX}label> ?l }}")
    assert len(bindings(rows)) == len(bindings(rows, None)) == 25
    with pytest.warns(UserWarning, match="more than 7"):
        assert len(bindings(rows, 7)) == 7
