"""Registered queries of the knowledge half: graph patterns, functions, ingestion, inference, rules, the log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphtide.functions import terms as T
from graphtide.operators import events as E
from graphtide.operators import rules as R
from graphtide.operators.closure import settle
from graphtide.operators.graph import Graph, MappedGraph
from graphtide.operators.inference import InferredGraph, Lattice, infer, owl_rules, rdfs_rules, rule
from graphtide.plans.sparql import flat, query
from graphtide.sources import mapping as M
from graphtide.sources import rdf_text

EX = "http://example.org/"
QUERIES, SQL = {}, {}


def registered(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mapping(cls, key, prefix, **columns) -> M.Mapping:
    made = {c: {"predicate": EX + p, "type": t, "iri_prefix": EX + (x[0] if x else "")} for c, (p, t, *x) in columns.items()}
    return M.Mapping(EX + cls, key, EX + prefix, "graph/" + cls, None, made, True)


MAPPINGS = {
    "region": _mapping("Region", "r_regionkey", "r", r_name=("label", "string")),
    "nation": _mapping("Nation", "n_nationkey", "n", n_name=("label", "string"), n_regionkey=("partOf", "iri", "r")),
    "customer": _mapping("Customer", "c_custkey", "c", c_name=("name", "string"), c_acctbal=("balance", "float"), c_nationkey=("nation", "iri", "n"), c_mktsegment=("segment", "string")),
    "supplier": _mapping("Supplier", "s_suppkey", "s", s_name=("name", "string"), s_acctbal=("balance", "float"), s_nationkey=("nation", "iri", "n")),
    "part": _mapping("Part", "p_partkey", "p", p_name=("title", "string"), p_brand=("brand", "string"), p_size=("size", "integer"), p_retailprice=("price", "float")),
    "orders": _mapping("Order", "o_orderkey", "o", o_custkey=("customer", "iri", "c"), o_totalprice=("total", "float"), o_orderpriority=("priority", "string"), o_orderstatus=("status", "string")),
}


def kb(spark, sf_dir, *names) -> MappedGraph:
    return MappedGraph(spark, [(MAPPINGS[n], table(spark, sf_dir, n)) for n in names])


def ask(spark, sf_dir, names, text, **columns) -> DataFrame:
    return flat(query(kb(spark, sf_dir, *names), f"PREFIX ex: <{EX}> {text}"), **columns)


def flagship(spark, sf_dir):
    text = "SELECT ?c ?label ?b WHERE { ?c ex:balance ?b . ?c ex:nation ?n . ?n ex:label ?label . FILTER(?b > 5000) } ORDER BY DESC(?b) ?c LIMIT 20"
    return ask(spark, sf_dir, ("customer", "nation"), text, c="lex", label="lex", b="num")


# ---------------------------------------------------------------- ingestion


@registered(f"""SELECT 'customer' AS src, '{EX}name' AS p, count(*) AS n FROM customer UNION ALL SELECT 'customer', '{EX}balance', count(*) FROM customer UNION ALL SELECT 'customer', '{EX}nation', count(*) FROM customer
 UNION ALL SELECT 'customer', '{EX}segment', count(*) FROM customer UNION ALL SELECT 'customer', '{T.TYPE}', count(*) FROM customer UNION ALL SELECT 'nation', '{EX}label', count(*) FROM nation UNION ALL SELECT 'nation', '{EX}partOf', count(*) FROM nation UNION ALL SELECT 'nation', '{T.TYPE}', count(*) FROM nation""")
def ingest_unpivot(spark, sf_dir):
    parts = [M.quads(MAPPINGS[n], table(spark, sf_dir, n)).groupBy("p").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("src"), "p", "n") for n in ("customer", "nation")]
    return reduce(DataFrame.union, parts)


@registered("""SELECT count(*) AS n_rows, count(*) FILTER (o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0) AS n_ingested, count(*) FILTER (o_orderkey % 7 = 0) AS n_no_id,
 count(*) FILTER (o_orderkey % 7 <> 0 AND o_orderkey % 11 = 0) AS n_errors, CAST(3 * count(*) FILTER (o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0) AS BIGINT) AS n_triples FROM orders""")
def ingest_report(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    raw = o.select(F.when(F.col("o_orderkey") % 7 == 0, " ").otherwise(F.col("o_orderkey").cast("string")).alias("id"), F.when(F.col("o_orderkey") % 11 == 0, "abc").otherwise(F.col("o_totalprice").cast("string")).alias("total"), F.lit("yes").alias("flag"))
    m = M.Mapping(EX + "Order", "id", EX + "o", "g", None, {"total": {"predicate": EX + "total", "type": "float", "iri_prefix": ""}, "flag": {"predicate": EX + "flag", "type": "boolean", "iri_prefix": ""}})
    return M.report(m, raw)


@registered("""WITH k AS (SELECT min(c_custkey) AS c FROM customer), s AS (SELECT c_mktsegment AS m FROM customer, k WHERE c_custkey = k.c)
 SELECT 'spo' AS shape, 1 AS n UNION ALL SELECT 'sp', 1 UNION ALL SELECT 's', 5 UNION ALL SELECT 'po', (SELECT count(*) FROM customer, s WHERE c_mktsegment = s.m)
 UNION ALL SELECT 'so', 1 UNION ALL SELECT 'o', (SELECT count(*) FROM customer, s WHERE c_mktsegment = s.m) UNION ALL SELECT 'p', (SELECT count(*) FROM customer) UNION ALL SELECT 'any', 5 * (SELECT count(*) FROM customer)""")
def pattern_shapes(spark, sf_dir):
    """The eight shapes of a triple pattern."""
    from graphtide.plans.sparql_parser import Const

    g = kb(spark, sf_dir, "customer")
    first = table(spark, sf_dir, "customer").orderBy("c_custkey").select("c_custkey", "c_mktsegment").first()
    s, p, o = f"{EX}c{first[0]}", EX + "segment", Const(T.LITERAL, first[1], T.XSD + "string")
    shapes = {"spo": (s, p, o), "sp": (s, p, None), "s": (s, None, None), "po": (None, p, o), "so": (s, None, o), "o": (None, None, o), "p": (None, p, None), "any": (None, None, None)}
    return reduce(DataFrame.union, [g.scan(*c).agg(F.lit(n).alias("shape"), F.count(F.lit(1)).alias("n")) for n, c in shapes.items()])


# ---------------------------------------------------------------- graph patterns

_C = ("customer",)
_SIMPLE = {
    "bgp_2": (("customer",), "SELECT ?c ?n ?b WHERE { ?c ex:name ?n . ?c ex:balance ?b }", {"c": "lex", "n": "lex", "b": "num"}, f"SELECT '{EX}c' || c_custkey AS c, c_name AS n, c_acctbal AS b FROM customer"),
    "bgp_3_star": (("customer",), "SELECT ?n ?b ?s WHERE { ?c ex:name ?n ; ex:balance ?b ; ex:segment ?s }", {"n": "lex", "b": "num", "s": "lex"}, "SELECT c_name AS n, c_acctbal AS b, c_mktsegment AS s FROM customer"),
    "bgp_chain": (("customer", "nation", "region"), "SELECT ?name ?nl ?rl WHERE { ?c ex:name ?name . ?c ex:nation ?n . ?n ex:label ?nl . ?n ex:partOf ?r . ?r ex:label ?rl }", {"name": "lex", "nl": "lex", "rl": "lex"}, "SELECT c_name AS name, n_name AS nl, r_name AS rl FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "bgp_cross_theta": (("nation", "region"), "SELECT ?a ?b WHERE { ?n a ex:Nation ; ex:label ?a . ?r a ex:Region ; ex:label ?b . FILTER(STRLEN(?a) > STRLEN(?b)) }", {"a": "lex", "b": "lex"}, "SELECT n_name AS a, r_name AS b FROM nation, region WHERE length(n_name) > length(r_name)"),
    "bgp_repeated_variable": (("nation",), "SELECT ?n WHERE { ?n ex:partOf ?n }", {"n": "lex"}, "SELECT 'x' AS n WHERE false"),
    "filter_numeric": (_C, "SELECT ?c ?b WHERE { ?c ex:balance ?b . FILTER(?b >= 1000 && ?b < 3000.5) }", {"c": "lex", "b": "num"}, f"SELECT '{EX}c' || c_custkey AS c, c_acctbal AS b FROM customer WHERE c_acctbal >= 1000 AND c_acctbal < 3000.5"),
    "filter_regex": (("part",), 'SELECT ?t WHERE { ?p ex:title ?t . FILTER(REGEX(?t, "^[A-M].*e", "i")) }', {"t": "lex"}, "SELECT p_name AS t FROM part WHERE regexp_matches(p_name, '(?i)^[A-M].*e')"),
    "filter_bound": (("customer", "orders"), "SELECT ?n WHERE { ?c ex:name ?n . OPTIONAL { ?o ex:customer ?c } FILTER(!BOUND(?o)) }", {"n": "lex"}, "SELECT c_name AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "filter_in": (_C, 'SELECT ?n ?s WHERE { ?c ex:name ?n ; ex:segment ?s FILTER(?s IN ("BUILDING", "MACHINERY")) }', {"n": "lex", "s": "lex"}, "SELECT c_name AS n, c_mktsegment AS s FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    "filter_not_in": (_C, 'SELECT ?n ?s WHERE { ?c ex:name ?n ; ex:segment ?s FILTER(?s NOT IN ("BUILDING", "MACHINERY")) }', {"n": "lex", "s": "lex"}, "SELECT c_name AS n, c_mktsegment AS s FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"),
    "optional_left_join": (("customer", "orders"), "SELECT ?n ?t WHERE { ?c ex:name ?n OPTIONAL { ?o ex:customer ?c . ?o ex:total ?t } }", {"n": "lex", "t": "num"}, "SELECT c_name AS n, o_totalprice AS t FROM customer LEFT JOIN orders ON o_custkey = c_custkey"),
    "optional_filter": (("customer", "orders"), "SELECT ?n ?t WHERE { ?c ex:name ?n OPTIONAL { ?o ex:customer ?c . ?o ex:total ?t FILTER(?t > 200000) } }", {"n": "lex", "t": "num"}, "SELECT c_name AS n, o_totalprice AS t FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000"),
    "union_bag": (("customer", "supplier"), "SELECT ?n WHERE { { ?x a ex:Customer ; ex:name ?n } UNION { ?x a ex:Supplier ; ex:name ?n } }", {"n": "lex"}, "SELECT c_name AS n FROM customer UNION ALL SELECT s_name FROM supplier"),
    "union_join": (("customer", "supplier", "nation"), "SELECT ?n ?l WHERE { ?k ex:label ?l . { ?x a ex:Customer ; ex:name ?n ; ex:nation ?k } UNION { ?x a ex:Supplier ; ex:name ?n ; ex:nation ?k } }", {"n": "lex", "l": "lex"}, "SELECT n, n_name AS l FROM (SELECT c_name AS n, c_nationkey AS k FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier) JOIN nation ON k = n_nationkey"),
    "distinct_solutions": (_C, "SELECT DISTINCT ?s WHERE { ?c ex:segment ?s }", {"s": "lex"}, "SELECT DISTINCT c_mktsegment AS s FROM customer"),
    "order_multi": (_C, "SELECT ?s ?b ?n WHERE { ?c ex:segment ?s ; ex:balance ?b ; ex:name ?n } ORDER BY ?s DESC(?b) ?n LIMIT 50", {"s": "lex", "b": "num", "n": "lex"}, "SELECT c_mktsegment AS s, c_acctbal AS b, c_name AS n FROM customer ORDER BY 1, 2 DESC, 3 LIMIT 50"),
    "limit_offset": (_C, "SELECT ?n WHERE { ?c ex:name ?n } ORDER BY ?n LIMIT 10 OFFSET 25", {"n": "lex"}, "SELECT c_name AS n FROM customer ORDER BY 1 LIMIT 10 OFFSET 25"),
    "values_join": (("nation",), f"SELECT ?l WHERE {{ VALUES ?n {{ <{EX}n3> <{EX}n7> <{EX}n99> }} ?n ex:label ?l }}", {"l": "lex"}, "SELECT n_name AS l FROM nation WHERE n_nationkey IN (3, 7, 99)"),
    "bind_arith": (("part",), "SELECT ?t ?v WHERE { ?p ex:title ?t ; ex:price ?x ; ex:size ?z BIND((?x * 2 + ?z) / 4 AS ?v) }", {"t": "lex", "v": "num"}, "SELECT p_name AS t, (p_retailprice * 2 + p_size) / 4 AS v FROM part"),
    "graph_named": (("customer", "supplier"), "SELECT ?n WHERE { GRAPH <graph/Supplier> { ?x ex:name ?n } }", {"n": "lex"}, "SELECT s_name AS n FROM supplier"),
    "graph_variable": (("customer", "supplier"), "SELECT ?g (COUNT(?x) AS ?n) WHERE { GRAPH ?g { ?x ex:name ?v } } GROUP BY ?g", {"g": "lex", "n": "long"}, "SELECT 'graph/Customer' AS g, count(*) AS n FROM customer UNION ALL SELECT 'graph/Supplier', count(*) FROM supplier"),
    "minus_solutions": (("customer", "orders"), "SELECT ?n WHERE { ?c ex:name ?n MINUS { ?o ex:customer ?c } }", {"n": "lex"}, "SELECT c_name AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "exists_filter": (("customer", "orders"), "SELECT ?n WHERE { ?c ex:name ?n FILTER EXISTS { ?o ex:customer ?c . ?o ex:total ?t FILTER(?t > 250000) } }", {"n": "lex"}, "SELECT c_name AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)"),
    "not_exists_filter": (("customer", "orders"), "SELECT ?n WHERE { ?c ex:name ?n FILTER NOT EXISTS { ?o ex:customer ?c . ?o ex:total ?t FILTER(?t > 250000) } }", {"n": "lex"}, "SELECT c_name AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)"),
    "agg_group_having": (("customer", "orders"), "SELECT ?c (COUNT(?o) AS ?n) (MAX(?t) AS ?m) WHERE { ?o ex:customer ?c ; ex:total ?t } GROUP BY ?c HAVING(COUNT(?o) > 12)", {"c": "lex", "n": "long", "m": "num"}, f"SELECT '{EX}c' || o_custkey AS c, count(*) AS n, max(o_totalprice) AS m FROM orders GROUP BY o_custkey HAVING count(*) > 12"),
    "agg_distinct": (("orders",), "SELECT (COUNT(DISTINCT ?c) AS ?n) (COUNT(*) AS ?k) WHERE { ?o ex:customer ?c }", {"n": "long", "k": "long"}, "SELECT count(DISTINCT o_custkey) AS n, count(*) AS k FROM orders"),
    "subquery": (("customer", "orders"), "SELECT ?name ?n WHERE { ?c ex:name ?name . { SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o ex:customer ?c } GROUP BY ?c } FILTER(?n >= 15) }", {"name": "lex", "n": "long"}, "SELECT c_name AS name, n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE n >= 15"),
    "path_sequence": (("customer", "nation", "region"), "SELECT ?n ?r WHERE { ?c ex:name ?n ; ex:nation/ex:partOf/ex:label ?r }", {"n": "lex", "r": "lex"}, "SELECT c_name AS n, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "path_inverse_alt": (("customer", "supplier", "nation"), "SELECT ?l (COUNT(?x) AS ?n) WHERE { ?k ex:label ?l ; ^ex:nation ?x } GROUP BY ?l", {"l": "lex", "n": "long"}, "SELECT n_name AS l, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) JOIN nation ON k = n_nationkey GROUP BY 1"),
    "fn_string": (("part",), 'SELECT ?t (UCASE(?t) AS ?u) (LCASE(?t) AS ?l) (STRLEN(?t) AS ?n) (SUBSTR(?t, 2, 4) AS ?s) (CONCAT(?t, "-", ?b) AS ?c) (STRBEFORE(?t, " ") AS ?x) (STRAFTER(?t, " ") AS ?y) (REPLACE(?t, "[aeiou]", "_") AS ?r) WHERE { ?p ex:title ?t ; ex:brand ?b }', {"t": "lex", "u": "lex", "l": "lex", "n": "long", "s": "lex", "c": "lex", "x": "lex", "y": "lex", "r": "lex"}, "SELECT p_name AS t, upper(p_name) AS u, lower(p_name) AS l, length(p_name) AS n, substr(p_name, 2, 4) AS s, p_name || '-' || p_brand AS c, CASE WHEN instr(p_name, ' ') > 0 THEN substr(p_name, 1, instr(p_name, ' ') - 1) ELSE '' END AS x, CASE WHEN instr(p_name, ' ') > 0 THEN substr(p_name, instr(p_name, ' ') + 1) ELSE '' END AS y, regexp_replace(p_name, '[aeiou]', '_', 'g') AS r FROM part"),
    "fn_test": (("part",), 'SELECT ?t (CONTAINS(?t, "a") AS ?a) (STRSTARTS(?t, "p") AS ?b) (STRENDS(?t, "e") AS ?c) (isLiteral(?t) AS ?d) (isIRI(?p) AS ?e) (isNumeric(?z) AS ?f) (isBlank(?p) AS ?g) WHERE { ?p ex:title ?t ; ex:size ?z }', dict.fromkeys("abcdefg", "bool") | {"t": "lex"}, "SELECT p_name AS t, contains(p_name, 'a') AS a, starts_with(p_name, 'p') AS b, ends_with(p_name, 'e') AS c, true AS d, true AS e, true AS f, false AS g FROM part"),
    "fn_math": (("part",), "SELECT ?p (ABS(0 - ?x) AS ?a) (CEIL(?x) AS ?b) (FLOOR(?x) AS ?c) (ROUND(?x) AS ?d) (-?z AS ?e) WHERE { ?p ex:price ?x ; ex:size ?z }", {"p": "lex", "a": "num", "b": "num", "c": "num", "d": "num", "e": "num"}, f"SELECT '{EX}p' || p_partkey AS p, abs(0 - p_retailprice) AS a, ceil(p_retailprice) AS b, floor(p_retailprice) AS c, round_even(p_retailprice, 0) AS d, CAST(-p_size AS DOUBLE) AS e FROM part"),
    "fn_hash": (("customer",), "SELECT ?n (MD5(?n) AS ?a) (SHA1(?n) AS ?b) (SHA256(?n) AS ?c) WHERE { ?x ex:name ?n }", {"n": "lex", "a": "lex", "b": "lex", "c": "lex"}, "SELECT c_name AS n, md5(c_name) AS a, sha1(c_name) AS b, sha256(c_name) AS c FROM customer"),
    "fn_conditional": (_C, 'SELECT ?n (IF(?b > 0, "pos", "neg") AS ?s) (COALESCE(?zz, ?b) AS ?k) (STR(?c) AS ?i) (DATATYPE(?b) AS ?d) WHERE { ?c ex:name ?n ; ex:balance ?b }', {"n": "lex", "s": "lex", "k": "num", "i": "lex", "d": "lex"}, f"SELECT c_name AS n, CASE WHEN c_acctbal > 0 THEN 'pos' ELSE 'neg' END AS s, c_acctbal AS k, '{EX}c' || c_custkey AS i, '{T.XSD}double' AS d FROM customer"),
    "fn_date": (("orders",), "SELECT ?o (YEAR(?x) AS ?y) (MONTH(?x) AS ?m) (DAY(?x) AS ?d) (HOURS(?x) AS ?h) WHERE { ?o ex:total ?t BIND(FLOOR(?t) * 5000 AS ?x) }", {"o": "lex", "y": "long", "m": "long", "d": "long", "h": "long"}, f"SELECT '{EX}o' || o_orderkey AS o, year(make_timestamp(CAST(floor(o_totalprice) AS BIGINT) * 5000 * 1000000)) AS y, month(make_timestamp(CAST(floor(o_totalprice) AS BIGINT) * 5000 * 1000000)) AS m, day(make_timestamp(CAST(floor(o_totalprice) AS BIGINT) * 5000 * 1000000)) AS d, hour(make_timestamp(CAST(floor(o_totalprice) AS BIGINT) * 5000 * 1000000)) AS h FROM orders"),
}
for _name, (_tables, _text, _columns, _sql) in _SIMPLE.items():

    def _run(spark, sf_dir, tables=_tables, text=_text, columns=_columns):
        return ask(spark, sf_dir, tables, text, **columns)

    QUERIES[_name], SQL[_name] = _run, _sql


@registered("SELECT (SELECT count(*) FROM customer WHERE c_acctbal > 9000) > 0 AS high, false AS none")
def ask_form(spark, sf_dir):
    g = kb(spark, sf_dir, "customer")
    a = query(g, f"PREFIX ex: <{EX}> ASK {{ ?c ex:balance ?b FILTER(?b > 9000) }}").withColumnRenamed("answer", "high")
    return a.crossJoin(query(g, f"PREFIX ex: <{EX}> ASK {{ ?c ex:nothing ?b }}").withColumnRenamed("answer", "none"))


@registered(f"SELECT '{EX}n' || c_nationkey AS s, '{EX}hasSegment' AS p, c_mktsegment AS o FROM customer GROUP BY ALL")
def construct_form(spark, sf_dir):
    rows = query(kb(spark, sf_dir, "customer"), f"PREFIX ex: <{EX}> CONSTRUCT {{ ?n ex:hasSegment ?s }} WHERE {{ ?c ex:nation ?n ; ex:segment ?s }}")
    return rows.select("s", "p", F.col("o.lex").alias("o"))


@registered(f"SELECT '{EX}n' || n_nationkey AS s, unnest(['{T.TYPE}', '{EX}label', '{EX}partOf']) AS p FROM nation WHERE n_name LIKE 'A%' OR n_nationkey = 5")
def describe_form(spark, sf_dir):
    g = kb(spark, sf_dir, "nation")
    rows = query(g, f'PREFIX ex: <{EX}> DESCRIBE ?n WHERE {{ ?n ex:label ?l FILTER(STRSTARTS(?l, "A")) }}')
    return rows.union(query(g, f"DESCRIBE <{EX}n5>")).distinct().select("s", "p")


# ---------------------------------------------------------------- stored graphs


@registered("""SELECT 'graph/Nation' AS g, 3 * count(*) AS n FROM nation UNION ALL SELECT 'copy', 3 * count(*) - 1 FROM nation UNION ALL SELECT 'graph/Region', 2 * count(*) FROM region""")
def graph_copy_remove(spark, sf_dir):
    g = kb(spark, sf_dir, "nation", "region").materialise()
    g = g.copy_graph("graph/Nation", "copy").copy_graph("graph/Region", "gone").remove_graph("gone").remove(s=EX + "n1", p=EX + "label", graph="copy")
    return g.quads.groupBy("g").agg(F.count(F.lit(1)).alias("n"))


@registered("SELECT (SELECT 2 * count(*) FROM region) AS stored, 1 AS added")
def graph_add_idempotent(spark, sf_dir):
    g = kb(spark, sf_dir, "region").materialise()
    new = Graph.of(spark, [(EX + "r0", EX + "size", 3), (EX + "r0", EX + "size", 3.0)])
    first = g.scan().count()
    again = g.add(g.quads).add(new.quads).add(new.quads)
    return again.scan().agg(F.lit(first).alias("stored"), (F.count(F.lit(1)) - first).alias("added"))


@registered(f"SELECT '{EX}p' || p_partkey AS s, p_name AS title, CAST(p_size AS DOUBLE) AS size FROM part")
def ntriples_roundtrip(spark, sf_dir):
    lines = rdf_text.write_ntriples(kb(spark, sf_dir, "part").scan())
    g = Graph(rdf_text.read_ntriples(lines))
    return flat(query(g, f"PREFIX ex: <{EX}> SELECT ?s ?title ?size WHERE {{ ?s ex:title ?title ; ex:size ?size }}"), s="lex", title="lex", size="num")


@registered(f"SELECT '{EX}n' || n_nationkey AS s, n_name AS label, '{EX}r' || n_regionkey AS r FROM nation")
def turtle_roundtrip(spark, sf_dir):
    text = rdf_text.write_turtle(kb(spark, sf_dir, "nation").scan(), {"ex": EX})
    g = Graph(rdf_text.read_turtle(text, prefixes={"ex": EX}))
    return flat(query(g, f"PREFIX ex: <{EX}> SELECT ?s ?label ?r WHERE {{ ?s ex:label ?label ; ex:partOf ?r }}"), s="lex", label="lex", r="lex")


# ---------------------------------------------------------------- inference


def _ontology(spark, sf_dir) -> Graph:
    """Customers typed by nation classes, nations below regions, regions below Place."""
    n, c, r = (table(spark, sf_dir, t) for t in ("nation", "customer", "region"))
    kind = F.lit(T.IRI).cast("tinyint")
    row = lambda s, p, o: [F.lit("default").alias("g"), s.alias("s"), kind.alias("s_kind"), F.lit(p).alias("p"), T.term(T.IRI, o).alias("o")]
    cat = lambda a, b: F.concat(F.lit(EX + a), F.col(b).cast("string"))
    q = c.select(*row(cat("c", "c_custkey"), T.TYPE, cat("n", "c_nationkey")))
    q = q.union(n.select(*row(cat("n", "n_nationkey"), T.RDFS + "subClassOf", cat("r", "n_regionkey"))))
    return Graph(q.union(r.select(*row(cat("r", "r_regionkey"), T.RDFS + "subClassOf", F.lit(EX + "Place")))))


@registered(f"SELECT '{EX}r' || n_regionkey AS c, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT '{EX}Place', count(*) FROM customer UNION ALL SELECT '{EX}n' || c_nationkey, count(*) FROM customer GROUP BY 1")
def rdfs_type_propagation(spark, sf_dir):
    g = InferredGraph(_ontology(spark, sf_dir))
    return g.types().where(F.contains("s", F.lit("/c"))).groupBy("c").agg(F.count(F.lit(1)).alias("n"))


@registered(f"SELECT '{EX}n' || n_nationkey AS a, '{EX}r' || n_regionkey AS b FROM nation UNION ALL SELECT '{EX}n' || n_nationkey, '{EX}Place' FROM nation UNION ALL SELECT '{EX}r' || r_regionkey, '{EX}Place' FROM region")
def rdfs_subclass_closure(spark, sf_dir):
    from graphtide.operators.inference import subclasses

    return subclasses(_ontology(spark, sf_dir))


def _schema(spark, sf_dir, extra) -> Graph:
    rows = kb(spark, sf_dir, "nation", "supplier").materialise()
    return rows.add(Graph.of(spark, extra).quads)


@registered(f"SELECT '{EX}s' || s_suppkey AS s, '{EX}Located' AS c FROM supplier UNION ALL SELECT '{EX}n' || s_nationkey, '{EX}Area' FROM supplier GROUP BY 1")
def rdfs_domain_range(spark, sf_dir):
    g = _schema(spark, sf_dir, [(EX + "nation", T.RDFS + "domain", EX + "Located"), (EX + "nation", T.RDFS + "range", EX + "Area")])
    _, new = infer(g, rdfs_rules()[:2])
    return new.where(F.col("o.lex").isin(EX + "Located", EX + "Area")).select("s", F.col("o.lex").alias("c"))


@registered(f"SELECT '{EX}near' AS p, count(*) AS n FROM supplier UNION ALL SELECT '{EX}related', count(*) FROM supplier")
def rdfs_subproperty(spark, sf_dir):
    g = _schema(spark, sf_dir, [(EX + "nation", T.RDFS + "subPropertyOf", EX + "near"), (EX + "near", T.RDFS + "subPropertyOf", EX + "related")])
    _, new = infer(g, rdfs_rules())
    return new.where(F.col("p").isin(EX + "near", EX + "related")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@registered(f"SELECT '{EX}n' || s_nationkey AS s, '{EX}s' || s_suppkey AS o FROM supplier")
def owl_inverse(spark, sf_dir):
    g = _schema(spark, sf_dir, [(EX + "nation", T.OWL + "inverseOf", EX + "hosts")])
    _, new = infer(g, owl_rules())
    return new.where(F.col("p") == EX + "hosts").select("s", F.col("o.lex").alias("o"))


@registered(f"SELECT '{EX}n' || s_nationkey AS s, '{EX}s' || s_suppkey AS o FROM supplier")
def owl_symmetric(spark, sf_dir):
    g = _schema(spark, sf_dir, [(EX + "nation", T.TYPE, T.OWL + "SymmetricProperty")])
    _, new = infer(g, owl_rules()[1:2])
    return new.where(F.col("p") == EX + "nation").select("s", F.col("o.lex").alias("o"))


@registered("""WITH RECURSIVE e AS (SELECT 'o' || l_orderkey AS a, 'p' || l_partkey AS b FROM lineitem UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem UNION SELECT 's' || s_suppkey, 's' || (s_suppkey // 2) FROM supplier WHERE s_suppkey > 1),
 c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT substr(a, 1, 1) AS kind, count(*) AS n FROM c GROUP BY 1""")
def owl_transitive(spark, sf_dir):
    """Each order above its parts, each part above its suppliers, and these in a tree: all rows, keys as they are."""
    x, u = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier").where("s_suppkey > 1")
    iri = lambda mark, c: F.concat(F.lit(EX + mark), c.cast("string"))
    ends = [(x, "l_orderkey", "l_partkey", "o", "p"), (x, "l_partkey", "l_suppkey", "p", "s"), (u, "s_suppkey", "floor(s_suppkey / 2)", "s", "s")]
    edges = [rows.select(F.expr(a).alias("a"), F.expr(b).alias("b")).distinct().select(iri(m, F.col("a")).alias("s"), T.term(T.IRI, iri(n, F.col("b"))).alias("o")) for rows, a, b, m, n in ends]
    rows = reduce(DataFrame.union, edges).select(F.lit("default").alias("g"), "s", F.lit(0).cast("tinyint").alias("s_kind"), F.lit(EX + "next").alias("p"), "o")
    g = Graph.of(spark, [(EX + "next", T.TYPE, T.OWL + "TransitiveProperty")]).add(rows)
    g = Graph(settle(g.quads), once=True)  # all are in one graph; the closure reads them several times
    full, _ = infer(g, owl_rules()[2:3])
    return full.scan(p=EX + "next", g="default").groupBy(F.expr(f"substring(s, {len(EX) + 1}, 1)").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@registered(f"SELECT '{EX}n' || a.s_nationkey AS s, '{EX}n' || b.s_nationkey AS o FROM supplier a JOIN supplier b ON a.s_suppkey % 20 = b.s_suppkey % 20 GROUP BY ALL")
def owl_functional_sameas(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    rows = s.select(F.lit("default").alias("g"), F.concat(F.lit(EX + "k"), (F.col("s_suppkey") % 20).cast("string")).alias("s"), F.lit(0).cast("tinyint").alias("s_kind"), F.lit(EX + "in").alias("p"), T.term(T.IRI, F.concat(F.lit(EX + "n"), F.col("s_nationkey").cast("string"))).alias("o"))
    g = Graph(rows).add(Graph.of(spark, [(EX + "in", T.TYPE, T.OWL + "FunctionalProperty")]).quads)
    _, new = infer(g, owl_rules()[3:])
    return new.select("s", F.col("o.lex").alias("o"))


@registered(f"SELECT '{EX}s' || a.s_suppkey AS s, '{EX}s' || b.s_suppkey AS o FROM supplier a JOIN supplier b USING (s_nationkey)")
def custom_rule(spark, sf_dir):
    r = rule("neighbours", [("?a", EX + "nation", "?n"), ("?b", EX + "nation", "?n")], [("?a", EX + "neighbour", "?b")])
    _, new = infer(kb(spark, sf_dir, "supplier").materialise(), [r])
    return new.select("s", F.col("o.lex").alias("o"))


@registered("SELECT n_name AS name, 'r' || n_regionkey AS ancestor FROM nation UNION ALL SELECT n_name, 'world' FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region")
def lattice_ancestors(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    region = lambda c: F.concat(F.lit("r"), F.col(c).cast("string"))
    none = F.lit(None).cast("map<string,boolean>").alias("properties")
    types = n.select(F.col("n_name").alias("name"), region("n_regionkey").alias("parent"), none).union(r.select(region("r_regionkey"), F.lit("world"), none))
    return Lattice(types).above.select(F.col("a").alias("name"), F.col("b").alias("ancestor"))


# ---------------------------------------------------------------- events and rules


def _log(spark, sf_dir) -> E.Log:
    return E.Log(table(spark, sf_dir, "events").withColumnRenamed("event_id", "id"))


@registered("SELECT event_id AS id, ts, user_id, value FROM events WHERE event_type = 'purchase' AND ts >= (SELECT min(ts) + INTERVAL 5 DAY FROM events) ORDER BY ts DESC, event_id DESC LIMIT 100")
def tx_query(spark, sf_dir):
    log = _log(spark, sf_dir)
    start = log.rows.agg(F.min("ts") + F.expr("interval 5 days")).first()[0]
    return log.query(start=start, n=100, event_type="purchase").select("id", "ts", "user_id", "value")


@registered("SELECT event_id AS id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def tx_recent(spark, sf_dir):
    return _log(spark, sf_dir).recent(25).select("id", "event_type")


@registered("SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT min(ts) + INTERVAL 10 DAY FROM events) GROUP BY 1")
def tx_count_since(spark, sf_dir):
    log = _log(spark, sf_dir)
    return log.counts("event_type", log.rows.agg(F.min("ts") + F.expr("interval 10 days")).first()[0])


@registered("SELECT event_type, max(struct_pack(ts := ts, id := event_id)).id AS id FROM events GROUP BY 1")
def exec_last(spark, sf_dir):
    return _log(spark, sf_dir).last_of("event_type").select("event_type", "id")


@registered("""WITH e AS (SELECT event_id, epoch_us(ts) / 1e6 AS t, event_type FROM events), j AS (SELECT a.event_id AS action_id, b.event_id AS event_id, row_number() OVER (PARTITION BY a.event_id ORDER BY b.t DESC, b.event_id DESC) AS rank
 FROM e a JOIN e b ON abs(a.t - b.t) < 60 WHERE a.event_type = 'error' AND b.event_type <> 'error') SELECT action_id, event_id, rank FROM j WHERE rank <= 5""")
def causal_chain_60s(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), "event_type")
    actions = e.where("event_type = 'error'").select(F.col("id").alias("action_id"), "ts")
    return E.causal_chain(actions, e.where("event_type <> 'error'"), 60.0, 5).select("action_id", "event_id", "rank")


@registered("SELECT CAST(floor(epoch_us(ts) / 1e6 / 604800) AS BIGINT) AS period, CASE WHEN count(*) FILTER (event_type IN ('view', 'purchase')) = 0 THEN 1.0 ELSE count(*) FILTER (event_type = 'purchase') / count(*) FILTER (event_type IN ('view', 'purchase')) END AS fill_rate FROM events GROUP BY 1")
def service_level_period(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select((F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("event_type").isin("view", "purchase").cast("double").alias("demand"), (F.col("event_type") == "purchase").cast("double").alias("supplied"))
    return E.fill_rate(rows, 604800.0)


@registered("SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1")
def event_quads(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), "event_type", F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("payload"), F.lit("web").alias("source"))
    g = Graph(E.Log(rows).quads())
    return flat(query(g, "SELECT ?kind (COUNT(?e) AS ?n) WHERE { ?e <urn:event:eventType> ?kind ; <urn:event:user> ?u } GROUP BY ?kind"), kind="lex", n="long")


def _engine(spark, sf_dir, *rules) -> R.Engine:
    e = R.Engine(kb(spark, sf_dir, "customer").materialise())
    for r in rules:
        e.add_rule(r)
    return e


@registered(f"SELECT '{EX}c' || c_custkey AS s FROM customer WHERE c_acctbal > 9500")
def rule_threshold_fire(spark, sf_dir):
    r = R.Production("rich", [R.TripleCondition("?c", EX + "balance", "?b"), R.ComparisonCondition("?b", ">", 9500)], [R.TripleAction("?c", T.TYPE, EX + "Rich")])
    e = _engine(spark, sf_dir, r)
    e.evaluate(0.0)
    return e.graph.scan(p=T.TYPE).where(F.col("o.lex") == EX + "Rich").select("s")


@registered(f"SELECT '{EX}c' || c_custkey AS s FROM customer WHERE c_acctbal < 0 AND c_mktsegment <> 'BUILDING'")
def rule_not(spark, sf_dir):
    r = R.Production("debt", [R.TripleCondition("?c", EX + "balance", "?b"), R.ComparisonCondition("?b", "<", 0), R.Not(R.QueryCondition(f'SELECT ?c WHERE {{ ?c <{EX}segment> "BUILDING" }}'))], [R.TripleAction("?c", T.TYPE, EX + "Debtor")])
    e = _engine(spark, sf_dir, r)
    e.evaluate(0.0)
    return e.graph.scan(p=T.TYPE).where(F.col("o.lex") == EX + "Debtor").select("s")


@registered("SELECT 'first' AS rule_name, 3 AS n UNION ALL SELECT 'second', 3")
def rule_priority_max_fires(spark, sf_dir):
    """The rule with the smaller priority runs first, at most three times; the other sees what it did."""
    first = R.Production("first", [R.TripleCondition("?c", EX + "balance", "?b")], [R.TripleAction("?c", EX + "flag", True)], priority=1, max_fires=3)
    second = R.Production("second", [R.TripleCondition("?c", EX + "flag", "?f")], [R.LogAction("seen ?c")], priority=2)
    return _engine(spark, sf_dir, second, first).evaluate(0.0).groupBy("rule_name").agg(F.count(F.lit(1)).cast("int").alias("n"))


@registered("SELECT 4 * count(*) AS left_over FROM customer")
def rule_retract_fire_once(spark, sf_dir):
    r = R.Production("forget", [R.TripleCondition("?c", EX + "segment", "?s")], [R.RetractAction("?c", EX + "segment")], fire_once=True)
    e = _engine(spark, sf_dir, r)
    e.evaluate(0.0)
    e.evaluate(1.0)
    return e.graph.scan().agg(F.count(F.lit(1)).alias("left_over"))
