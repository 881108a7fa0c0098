"""Registered queries of functions and operators that the other modules' queries do not reach, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphtide.functions import terms as T
from graphtide.operators import agents as A
from graphtide.operators import analysis as S
from graphtide.operators import causal as C
from graphtide.operators import discrete as Q
from graphtide.operators import dynamics as D
from graphtide.operators import optimise as O
from graphtide.operators import rules as R
from graphtide.operators.closure import scratch_dir, settle
from graphtide.operators.graph import Graph
from graphtide.operators.inference import InferredGraph, infer, rdfs_rules
from graphtide.operators.stored import StoredGraph
from graphtide.plans.sparql import Compiler, flat, query
from graphtide.plans.sparql_parser import Const
from graphtide.sources import mapping as M
from graphtide.sources import series
from graphtide.sources.sysd import parse_sysd

from .kb_queries import EX, MAPPINGS, ask, kb, table

QUERIES, SQL = {}, {}


def registered(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- the query language

_B = "bool"
_SIMPLE = {
    "op_equal": (("customer",), 'SELECT ?n WHERE { ?c ex:name ?n ; ex:segment ?s FILTER(?s = "BUILDING") }', {"n": "lex"}, "SELECT c_name AS n FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "op_not_equal": (("customer",), 'SELECT ?n WHERE { ?c ex:name ?n ; ex:segment ?s FILTER(?s != "BUILDING" && ?s != "MACHINERY") }', {"n": "lex"}, "SELECT c_name AS n FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"),
    "fn_lang": (("nation",), 'SELECT ?l (LANG(STRLANG(?l, "en-GB")) AS ?a) (LANG(?l) AS ?b) (langMatches(LANG(STRLANG(?l, "en-GB")), "EN") AS ?c) (langMatches(LANG(?l), "*") AS ?d) WHERE { ?n ex:label ?l }', {"l": "lex", "a": "lex", "b": "lex", "c": _B, "d": _B}, "SELECT n_name AS l, 'en-GB' AS a, '' AS b, true AS c, false AS d FROM nation"),
    "fn_same_term": (("nation",), "SELECT ?l (sameTerm(?n, ?n) AS ?a) (sameTerm(?n, ?l) AS ?b) WHERE { ?n ex:label ?l }", {"l": "lex", "a": _B, "b": _B}, "SELECT n_name AS l, true AS a, false AS b FROM nation"),
    "fn_strdt": (("part",), f'SELECT ?t (DATATYPE(STRDT(STR(?z), <{T.XSD}integer>)) AS ?a) (isNumeric(STRDT(STR(?z), <{T.XSD}integer>)) AS ?b) WHERE {{ ?p ex:title ?t ; ex:size ?z }}', {"t": "lex", "a": "lex", "b": _B}, f"SELECT p_name AS t, '{T.XSD}integer' AS a, true AS b FROM part"),
    "fn_hash_long": (("customer",), "SELECT ?n (STRLEN(SHA384(?n)) AS ?a) (STRLEN(SHA512(?n)) AS ?b) (SUBSTR(SHA384(?n), 1, 3) != SUBSTR(SHA512(?n), 1, 3) AS ?c) WHERE { ?x ex:name ?n }", {"n": "lex", "a": "long", "b": "long"}, "SELECT c_name AS n, 96 AS a, 128 AS b FROM customer"),
    "fn_minutes_seconds": (("orders",), "SELECT ?o (MINUTES(?x) AS ?m) (SECONDS(?x) AS ?s) WHERE { ?o ex:total ?t BIND(FLOOR(?t) * 7 AS ?x) }", {"o": "lex", "m": "long", "s": "long"}, f"SELECT '{EX}o' || o_orderkey AS o, (CAST(floor(o_totalprice) AS BIGINT) * 7 // 60) % 60 AS m, (CAST(floor(o_totalprice) AS BIGINT) * 7) % 60 AS s FROM orders"),
    "fn_random": (("customer",), "SELECT ?n (RAND() >= 0 && RAND() < 1 AS ?a) (NOW() > 1700000000 AS ?b) (STRLEN(STRUUID()) AS ?c) (STRSTARTS(STR(UUID()), \"urn:uuid:\") AS ?d) WHERE { ?x ex:name ?n }", {"n": "lex", "a": _B, "b": _B, "c": "long", "d": _B}, "SELECT c_name AS n, true AS a, true AS b, 36 AS c, true AS d FROM customer"),
    "fn_encode_uri": (("part",), "SELECT ?p (ENCODE_FOR_URI(?t) AS ?u) WHERE { ?p ex:title ?t }", {"p": "lex", "u": "lex"}, f"SELECT '{EX}p' || p_partkey AS p, url_encode(p_name) AS u FROM part"),
    "fn_iri": (("nation",), 'SELECT ?l (isIRI(IRI(CONCAT("http://x/", ?l))) AS ?a) (STR(URI(CONCAT("http://x/", ?l))) AS ?b) WHERE { ?n ex:label ?l }', {"l": "lex", "a": _B, "b": "lex"}, "SELECT n_name AS l, true AS a, 'http://x/' || n_name AS b FROM nation"),
    "filter_bound_some": (("customer", "nation"), "SELECT ?l ?n WHERE { ?k ex:label ?l OPTIONAL { ?c ex:nation ?k ; ex:name ?n ; ex:balance ?b FILTER(?b > 9900) } FILTER(BOUND(?n)) }", {"l": "lex", "n": "lex"}, "SELECT n_name AS l, c_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9900"),
    "filter_not_bound": (("customer", "nation"), "SELECT ?l WHERE { ?k ex:label ?l OPTIONAL { ?c ex:nation ?k ; ex:name ?n ; ex:balance ?b FILTER(?b > 9900) } FILTER(!BOUND(?n)) }", {"l": "lex"}, "SELECT n_name AS l FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)"),
    "minus_some": (("customer",), 'SELECT ?n WHERE { ?c ex:name ?n MINUS { ?c ex:segment "BUILDING" } }', {"n": "lex"}, "SELECT c_name AS n FROM customer WHERE c_mktsegment <> 'BUILDING'"),
    "path_plus": (("nation", "region"), "SELECT ?a ?b WHERE { ?a ex:partOf+ ?b }", {"a": "lex", "b": "lex"}, f"SELECT '{EX}n' || n_nationkey AS a, '{EX}r' || n_regionkey AS b FROM nation"),
    "path_optional": (("nation",), "SELECT ?b (COUNT(?a) AS ?n) WHERE { ?a ex:label ?l . ?a ex:partOf? ?b } GROUP BY ?b", {"b": "lex", "n": "long"}, f"SELECT '{EX}r' || n_regionkey AS b, count(*) AS n FROM nation GROUP BY 1 UNION ALL SELECT '{EX}n' || n_nationkey, 1 FROM nation"),
    "base_prologue": (("nation",), f"BASE <{EX}> SELECT ?l WHERE {{ ?n <label> ?l ; <partOf> <r1> }}", {"l": "lex"}, "SELECT n_name AS l FROM nation WHERE n_regionkey = 1"),
    "token_quirks": (("nation",), "select ?l where { # a comment\n ?n ex:label ?l; ex:partOf ?r. filter ( regex(?l, '^.*1$', \"i\") ) } order by desc(?l)", {"l": "lex"}, "SELECT n_name AS l FROM nation WHERE n_name LIKE '%1'"),
}
_SIMPLE["fn_datetime"] = (("nation",), 'SELECT ?l (TZ("2024-03-05T10:20:30+02:00") AS ?a) (TIMEZONE("2024-03-05T10:20:30-05:30") AS ?b) (TZ("2024-03-05T10:20:30") AS ?c) (YEAR(xsd:dateTime("2024-03-05T10:20:30Z")) AS ?d) (MINUTES(xsd:dateTime("2024-03-05T10:20:30Z")) AS ?e) WHERE { ?n ex:label ?l }', {"l": "lex", "a": "lex", "b": "lex", "c": "lex", "d": "long", "e": "long"}, "SELECT n_name AS l, '+02:00' AS a, '-PT5H30M' AS b, '' AS c, 2024 AS d, 20 AS e FROM nation")
for _name, (_tables, _text, _columns, _sql) in _SIMPLE.items():

    def _run(spark, sf_dir, tables=_tables, text=_text, columns=_columns):
        return ask(spark, sf_dir, tables, text, **columns)

    QUERIES[_name], SQL[_name] = _run, _sql


@registered("SELECT s_suppkey AS k FROM supplier WHERE s_nationkey = s_suppkey % 25")
def bgp_repeated_some(spark, sf_dir):
    """A variable that comes twice in one pattern: suppliers whose nation is their number's."""
    x = table(spark, sf_dir, "supplier").select(F.concat(F.lit(EX + "n"), (F.col("s_suppkey") % 25).cast("string")).alias("a"), F.concat(F.lit(EX + "n"), F.col("s_nationkey").cast("string")).alias("b"), F.concat(F.lit(EX + "near"), F.col("s_suppkey").cast("string")).alias("p"))
    g = Graph(x.select(F.lit("default").alias("g"), F.col("a").alias("s"), F.lit(T.IRI).cast("tinyint").alias("s_kind"), "p", T.term(T.IRI, F.col("b")).alias("o")))
    rows = query(g, "SELECT ?p WHERE { ?x ?p ?x }")
    return rows.select(F.substring_index(F.col("p")["lex"], "near", -1).cast("long").alias("k"))


@registered(f"SELECT '{EX}c' || c_custkey AS s, '{EX}place' AS p, '{EX}n' || c_nationkey AS o FROM customer UNION ALL SELECT '{EX}n' || n_nationkey, '{EX}place', '{EX}r' || n_regionkey FROM nation")
def rdfs_subproperty_at_query(spark, sf_dir):
    """Subproperties that are followed as the query runs: nation and partOf are kinds of place."""
    g = kb(spark, sf_dir, "customer", "nation").materialise()
    g = g.add(Graph.of(spark, [(EX + "nation", T.RDFS + "subPropertyOf", EX + "place"), (EX + "partOf", T.RDFS + "subPropertyOf", EX + "place")]).quads)
    rows = InferredGraph(g).scan(p=EX + "place")
    return rows.select("s", "p", F.col("o")["lex"].alias("o"))


@registered(f"SELECT '{EX}n' || n_nationkey AS s, '{EX}r' || n_regionkey AS c FROM nation")
def rdfs_class_instance(spark, sf_dir):
    """What is below a class is of its type."""
    n = table(spark, sf_dir, "nation")
    cat = lambda a, b: F.concat(F.lit(EX + a), F.col(b).cast("string"))
    g = Graph(n.select(F.lit("default").alias("g"), cat("n", "n_nationkey").alias("s"), F.lit(T.IRI).cast("tinyint").alias("s_kind"), F.lit(T.RDFS + "subClassOf").alias("p"), T.term(T.IRI, cat("r", "n_regionkey")).alias("o")))
    _, new = infer(g, [x for x in rdfs_rules() if x.name == "class-as-type"])
    return new.where(F.col("p") == T.TYPE).select("s", F.col("o")["lex"].alias("c"))


# ---------------------------------------------------------------- rules


def _engine(spark, sf_dir, *names):
    return R.Engine(kb(spark, sf_dir, *names).materialise())


@registered("SELECT 'Q1' AS rule, (SELECT count(*) FROM nation) AS fired WHERE (SELECT count(*) FROM customer) > 10")
def rule_aggregation(spark, sf_dir):
    """A rule whose condition is a count over the graph; one that asks for more never fires."""
    e = _engine(spark, sf_dir, "customer", "nation")
    count = f"PREFIX ex: <{EX}> SELECT (COUNT(?c) AS ?n) WHERE {{ ?c ex:balance ?b }}"
    for name, least in (("Q1", 10.0), ("Q2", 1e12)):
        e.add_rule(R.Production(name, [R.TripleCondition("?k", EX + "label", "?l"), R.AggregationCondition(count, least, ">")], [R.LogAction("seen")]))
    return e.evaluate(1.0).groupBy(F.col("rule_name").alias("rule")).agg(F.count(F.lit(1)).alias("fired"))


@registered("SELECT c_name AS n FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'BUILDING'")
def rule_or(spark, sf_dir):
    e = _engine(spark, sf_dir, "customer")
    name = R.TripleCondition("?c", EX + "name", "?n")
    both = R.And([R.TripleCondition("?c", EX + "balance", "?b"), R.ComparisonCondition("?b", "<", 0)])
    building = R.QueryCondition(f'PREFIX ex: <{EX}> SELECT ?c WHERE {{ ?c ex:segment "BUILDING" }}')
    e.add_rule(R.Production("either", [name, R.Or([both, building])], [R.LogAction("seen")]))
    return e.matches(e.get_rule("either")).select(F.col("n")["lex"].alias("n"))


@registered("SELECT 'first' AS pass, 2 * count(*) AS n FROM nation UNION ALL SELECT 'second', 0 FROM nation GROUP BY 1 UNION ALL SELECT 'after reset', count(*) FROM nation")
def rule_reset_remove(spark, sf_dir):
    """Rules that fire once stay silent until they are reset; a removed rule is gone."""
    e = _engine(spark, sf_dir, "nation")
    for name in ("a", "b"):
        e.add_rule(R.Production(name, [R.TripleCondition("?k", EX + "label", "?l")], [R.LogAction("seen")], fire_once=True))
    passes = [("first", e.evaluate(1.0).count()), ("second", e.evaluate(2.0).count())]
    e.reset()
    e.remove_rule("b")
    return spark.createDataFrame([*passes, ("after reset", e.evaluate(3.0).count())], "pass string, n long")


# ---------------------------------------------------------------- models

_FUNCTIONS = """dt 1
from 0 to 1
// run by customers; nation is a parameter of each run
aux nation: 0
table curve
  x: 0, 10, 24
  y: 0, 5, 40
func "area(a, b)" = a * b + 1
aux a_if: IF(nation > 10, 1, 2)
aux b_max: MAX(nation, 7)
aux c_abs: ABS(nation - 12)
aux d_exp: EXP(nation / 10)
aux e_ln: LN(nation + 1)
aux f_sqrt: SQRT(nation) ~metre~
aux g_sin: SIN(nation) + COS(nation)
aux h_pi: PI * 2
aux i_curve: curve(nation)
aux j_macro: area(nation, 3)
aux k_late: l_early + 1
aux l_early: nation * 2
stock Level: 0
  + zero: 0 * nation
"""
_NAMES = ["a_if", "b_max", "c_abs", "d_exp", "e_ln", "f_sqrt", "g_sin", "h_pi", "i_curve", "j_macro", "k_late"]


@registered("""SELECT c_custkey AS run_id, round(CASE WHEN n > 10 THEN 1 ELSE 2 END, 4) AS a_if, round(greatest(n, 7), 4) AS b_max, round(abs(n - 12), 4) AS c_abs, round(exp(n / 10), 4) AS d_exp, round(ln(n + 1), 4) AS e_ln, round(sqrt(n), 4) AS f_sqrt,
 round(sin(n) + cos(n), 4) AS g_sin, round(pi() * 2, 4) AS h_pi, round(CASE WHEN n <= 10 THEN n * 0.5 ELSE 5 + (n - 10) * 2.5 END, 4) AS i_curve, round(n * 3 + 1, 4) AS j_macro, round(n * 2 + 1, 4) AS k_late FROM (SELECT c_custkey, c_nationkey::DOUBLE AS n FROM customer)""")
def sd_functions(spark, sf_dir):
    """Functions, a lookup table, a macro, comments, units and auxiliaries given out of order."""
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), F.col("c_nationkey").cast("double").alias("nation"))
    out = D.simulate(parse_sysd(_FUNCTIONS), runs, auxes=True, last=True)
    return out.groupBy("run_id").agg(*[F.round(F.max(F.when(F.col("var") == n, F.col("value"))), 4).alias(n) for n in _NAMES])


@registered("SELECT c_custkey AS run_id, true AS noise, true AS uniform, true AS lognormal FROM customer")
def sd_random(spark, sf_dir):
    """Random calls stay within their ranges and differ between runs."""
    m = parse_sysd("dt 1\nfrom 0 to 1\naux a: NOISE(2)\naux b: UNIFORM(3, 4)\naux c: LOGNORMAL(0, 1)\nstock L: 0\n  + z: 0 * a\n")
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"))
    out = D.simulate(m, runs, auxes=True, last=True).groupBy("run_id").agg(*[F.max(F.when(F.col("var") == n, F.col("value"))).alias(n) for n in "abc"])
    out = settle(out)
    many = F.broadcast(out.agg(F.coalesce(F.min("b") < F.max("b"), F.lit(False)).alias("many")))
    return out.crossJoin(many).select("run_id", (F.abs("a") <= 2).alias("noise"), (F.col("b").between(3, 4) & F.col("many")).alias("uniform"), (F.col("c") > 0).alias("lognormal"))


@registered("""SELECT c_custkey AS run_id, round(c_nationkey + (5.0 - c_nationkey) * pow(0.5, 10), 4) AS smooth FROM customer""")
def sd_smoothi(spark, sf_dir):
    """A first-order smooth with an initial value: half of the gap goes with each step."""
    m = parse_sysd("dt 1\nfrom 0 to 10\naux nation: 0\naux s: SMOOTHI(nation, 2, 5)\nstock L: 0\n  + z: 0 * s\n")
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), F.col("c_nationkey").cast("double").alias("nation"))
    out = D.simulate(m, runs, auxes=True, last=True)
    return out.where("var = 's'").select("run_id", F.round("value", 4).alias("smooth"))


@registered("SELECT c_custkey AS run_id, round(c_nationkey * (1 - pow(0.5, 4) * 5), 4) AS delayed FROM customer")
def sd_delayn(spark, sf_dir):
    """A constant through a second-order delay, each stage of which passes half of its content on."""
    m = parse_sysd("dt 1\nfrom 0 to 4\naux nation: 0\naux s: DELAYN(nation, 4, 2)\nstock L: 0\n  + z: 0 * s\n")
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), F.col("c_nationkey").cast("double").alias("nation"))
    return D.simulate(m, runs, auxes=True, last=True).where("var = 's'").select("run_id", F.round("value", 4).alias("delayed"))


# ---------------------------------------------------------------- series


@registered("SELECT var, t, value FROM (SELECT 'value' AS var, event_id::DOUBLE AS t, value FROM events UNION ALL SELECT 'user', event_id::DOUBLE, user_id::DOUBLE FROM events)")
def series_import_merge(spark, sf_dir):
    """Wide tables as imported from files, made long and merged."""
    e = table(spark, sf_dir, "events")
    a = series.long(e.select(F.col("event_id").alias("time"), "value"))
    b = series.long(e.select(F.col("event_id").alias("time"), F.col("user_id").alias("user")))
    return series.merge([a, b]).select("var", "t", "value")


# ---------------------------------------------------------------- queues

_DUE = "SELECT event_type AS queue, event_id AS entity_id, event_id * 10.0 AS arr_t, 1000000.0 - event_id AS service_t FROM events"


def _slow(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("queue"), F.col("event_id").alias("entity_id"), (F.col("event_id") * 10.0).alias("arr_t"))


@registered("""WITH e AS (SELECT event_type AS queue, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events) SELECT queue, count(*) FILTER (n > 50) AS dropped, count(*) FILTER (n <= 50) AS kept FROM e GROUP BY queue""")
def des_capacity(spark, sf_dir):
    """Queues that hold fifty entities, none of which is done before the last arrival."""
    out = Q.queue_loop(_slow(spark, sf_dir).withColumn("service_t", F.lit(1e9)), capacity=50)
    return out.groupBy("queue").agg(F.count_if("dropped").alias("dropped"), F.count_if(~F.col("dropped")).alias("kept"))


@registered(f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY arr_t) AS n FROM ({_DUE})), f AS (SELECT queue, entity_id, n, CASE WHEN n = 1 THEN 1 ELSE 1 + row_number() OVER (PARTITION BY queue, n = 1 ORDER BY service_t) END AS place FROM e)
 SELECT queue, entity_id, place FROM f""")
def des_spt_order(spark, sf_dir):
    """Shortest service first: all arrive while the first is served, and the last to arrive are the shortest.

    Services last a million less the number, or, where numbers are so high that later ones would come after the
    first service, as much more for each as lets all come before; that leaves their order as it is.
    """
    jobs = _slow(spark, sf_dir)
    last = jobs.agg(F.max("arr_t")).first()[0] or 0.0
    out = Q.queue_loop(jobs.withColumn("service_t", F.lit(max(1000000.0, 2 * last)) - F.col("entity_id")), discipline="SPT")
    return out.select("queue", "entity_id", F.row_number().over(Window.partitionBy("queue").orderBy("start_t")).cast("long").alias("place"))


@registered("""WITH e AS (SELECT event_type AS queue, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events) SELECT queue, count(*) FILTER (n > 3) AS balks FROM e GROUP BY queue""")
def des_balks(spark, sf_dir):
    """Arrivals that find three or more before them, where none leaves."""
    return Q.balks(Q.fifo(_slow(spark, sf_dir).withColumn("service_t", F.lit(1e9))), 3)


@registered("""WITH e AS (SELECT event_type AS queue, event_id * 10.0 AS arr_t FROM events) SELECT queue, count(*) AS arrivals, count(*) AS departures, 0.0 AS avg_wait FROM e GROUP BY queue""")
def des_queue_metrics(spark, sf_dir):
    """Service so short that none waits."""
    done = Q.fifo(_slow(spark, sf_dir).withColumn("service_t", F.lit(0.5)))
    return Q.queue_metrics(done, Q.length_grid(done, 0.0, 100.0, 10.0)).select("queue", "arrivals", "departures", F.round("avg_wait", 6).alias("avg_wait"))


@registered("SELECT 'enqueue' AS event, true AS called UNION ALL SELECT 'release', true")
def des_hooks(spark, sf_dir):
    """Callbacks run where the loops run: here they count into accumulators."""
    counts = {e: spark.sparkContext.accumulator(0) for e in ("enqueue", "release")}
    seen = {e: lambda *a, c=c: c.add(1) for e, c in counts.items()}
    try:
        for e, f in seen.items():
            Q.on(e, f)
        jobs = _slow(spark, sf_dir)
        Q.queue_loop(jobs.withColumn("service_t", F.lit(1.0))).count()
        Q.resource_loop(jobs.select(F.col("queue").alias("resource"), F.col("entity_id").alias("request_id"), F.col("arr_t").alias("t"), F.lit(1.0).alias("quantity"), F.lit(0).alias("priority"), F.lit(2.0).alias("hold")), 1.0).count()
    finally:
        for e, f in seen.items():
            Q.HOOKS[e].remove(f)
    return spark.createDataFrame([(e, c.value >= jobs.count()) for e, c in counts.items()], "event string, called boolean")


# ---------------------------------------------------------------- agents


@registered("""SELECT s_nationkey AS inst, CASE WHEN count(*) FILTER (s_acctbal < 0) > 0 THEN count(*) FILTER (s_acctbal < 0) END AS debt, CASE WHEN count(*) FILTER (s_acctbal >= 0) > 0 THEN count(*) FILTER (s_acctbal >= 0) END AS credit FROM supplier GROUP BY 1""")
def abm_inbox_topics(spark, sf_dir):
    """What each nation's agent sees of its mail, by topic."""
    mail = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("inst"), F.when(F.col("s_acctbal") < 0, "debt").otherwise("credit").alias("topic"))
    agents = mail.select("inst").distinct()
    return A.perceived(agents, [], None, mail, ["debt", "credit"]).select("inst", F.col("inbox_debt").alias("debt"), F.col("inbox_credit").alias("credit"))


@registered("SELECT 'complete' AS kind, 40 * 39 AS edges, true AS both UNION ALL SELECT 'scale-free', NULL, true UNION ALL SELECT 'small-world', NULL, true UNION ALL SELECT 'random', NULL, true")
def abm_networks(spark, sf_dir):
    """Networks of forty agents: every edge goes both ways."""
    rows = []
    for kind in ("complete", "random", "small-world", "scale-free"):
        net = A.network(spark, kind, 40)
        back = net.select(F.col("b").alias("a"), F.col("a").alias("b"))
        rows.append(net.join(back, ["a", "b"], "left_anti").agg(F.lit(kind).alias("kind"), (F.count(F.lit(1)) == 0).alias("both")).crossJoin(net.agg(F.when(F.lit(kind == "complete"), F.count(F.lit(1))).cast("int").alias("edges"))))
    out = rows[0]
    for x in rows[1:]:
        out = out.union(x)
    return out.select("kind", "edges", "both")


# ---------------------------------------------------------------- analysis and optimisation


@registered("SELECT 'p_size' AS param, 1 AS sign UNION ALL SELECT 'noise', 0")
def sens_prcc(spark, sf_dir):
    """Partial rank correlations: an output that rises with one parameter and not with the other."""
    rows = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("p_size"), (F.pmod(F.xxhash64("p_partkey"), F.lit(1000)) / 1000).alias("noise")).withColumn("y", F.exp(F.col("p_size") / 10))
    found = S.prcc(rows, ["p_size", "noise"], "y")
    return spark.createDataFrame([(p, 1 if v > 0.9 else 0 if abs(v) < 0.5 else -1) for p, v in found.items()], "param string, sign int")


@registered("SELECT * FROM (VALUES ('a', 'low', 0.0, 15.0), ('a', 'high', 4.0, 15.0), ('b', 'low', 2.0, 10.0), ('b', 'high', 2.0, 20.0)) t(param, side, a, b)")
def sens_oat(spark, sf_dir):
    rows = S.oat(["a", "b"], {"a": (0.0, 4.0), "b": (10.0, 20.0)})
    return S.runs_table(spark, rows, ["run_id", "param", "side", "a", "b"]).drop("run_id")


@registered("SELECT 'max' AS kind, 36.0 AS objective, 2.0 AS x, 6.0 AS y UNION ALL SELECT 'min', 4.0, 4.0, 0.0")
def lp_max_min(spark, sf_dir):
    """Two small linear programmes."""
    a = O.lp_maximize([3, 5], a_ub=[[1, 0], [0, 2], [3, 2]], b_ub=[4, 12, 18])
    b = O.lp_minimize([1, 3], a_ub=[[-1, -1]], b_ub=[-4])
    rows = [("max", float(a.objective), *map(float, a.x)), ("min", float(b.objective), *map(float, b.x))]
    return spark.createDataFrame([(k, round(o, 6), round(x, 6), round(y, 6)) for k, o, x, y in rows], "kind string, objective double, x double, y double")


_PREY = "stock Hare: 10\n  + births: Hare * rate\n  - eaten: Fox * 0.1\naux rate: 0.2\nstock Fox: 2\n  + grow: Hare * 0.01\n"


@registered("SELECT * FROM (VALUES ('births'), ('eaten')) t(name)")
def causes_strip_names(spark, sf_dir):
    """The direct causes of a variable, with the values that they end at."""
    m = parse_sysd("dt 1\nfrom 0 to 3\n" + _PREY)
    edges = C.dependencies(spark, m)
    return C.causes_strip(edges, spark.createDataFrame([("Hare", 1.0), ("rate", 2.0), ("Fox", 3.0)], "var string, value double"), "Hare").select(F.col("src").alias("name")).distinct()


@registered("""SELECT 'causes' AS part, * FROM (VALUES ('births'), ('eaten'), ('rate'), ('Fox'), ('grow')) t(name) UNION ALL SELECT 'effects', * FROM (VALUES ('births'), ('grow'), ('Fox'), ('eaten')) t(name) UNION ALL SELECT 'strip', * FROM (VALUES ('births'), ('eaten')) t(name)""")
def causal_trace_parts(spark, sf_dir):
    """Causes, effects and direct causes of a variable, from one call."""
    m = parse_sysd("dt 1\nfrom 0 to 3\n" + _PREY)
    out = C.causal_trace(C.dependencies(spark, m), spark.createDataFrame([("births", 1.0), ("eaten", 2.0)], "var string, value double"), "Hare")
    return out.where("name <> 'Hare'").select("part", "name").distinct()


@registered("SELECT * FROM (VALUES ('continuant', 5), ('occurrent', 3)) t(category, roles)")
def role_categories(spark, sf_dir):
    return C.role_table(spark).groupBy("category").agg(F.count(F.lit(1)).cast("int").alias("roles"))


@registered("""WITH m AS (SELECT s_suppkey, s_nationkey, 1 + s_suppkey % 3 AS ttl FROM supplier) SELECT s_nationkey AS inst, count(*) AS mail, sum(ttl - 1) AS ttl FROM m WHERE ttl > 1 GROUP BY 1""")
def abm_mail_ttl(spark, sf_dir):
    """Mail that is read stays for as many steps as its time to live."""
    mail = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("inst"), (1 + F.col("s_suppkey") % 3).alias("ttl"))
    return A.aged(mail).groupBy("inst").agg(F.count(F.lit(1)).alias("mail"), F.sum("ttl").alias("ttl"))


# ---------------------------------------------------------------- mappings


@registered(f"SELECT '{EX}r' || r_regionkey AS s, '{EX}label' AS p, r_name AS o FROM region")
def mapping_from_spec(spark, sf_dir):
    """A mapping read from its keys, as from a YAML file."""
    spec = {"target_graph": "graph/x", "entity": {"class": EX + "Region", "id_column": "r_regionkey", "id_prefix": EX + "r"}, "columns": {"r_name": {"predicate": EX + "label", "type": "string"}}}
    rows = M.quads(M.Mapping.parse(spec), table(spark, sf_dir, "region"))
    return rows.where(F.col("p") == EX + "label").select("s", "p", F.col("o")["lex"].alias("o"))


# ---------------------------------------------------------------- stored graphs and loose variables


@registered("SELECT c_name AS m, c_acctbal AS b, n_name AS l FROM customer JOIN nation ON c_nationkey = n_nationkey")
def stored_star(spark, sf_dir):
    """A star of three patterns and one more on a graph in three layouts: buckets meet without a shuffle."""
    g = StoredGraph.create(kb(spark, sf_dir, "customer", "nation").materialise().quads, scratch_dir(spark, "stored"), 16)
    return flat(g.query(f"PREFIX ex: <{EX}> SELECT ?m ?b ?l WHERE {{ ?c ex:name ?m ; ex:balance ?b ; ex:nation ?n . ?n ex:label ?l }}"), m="lex", b="num", l="lex")


@registered(f"SELECT '{EX}o' || o_orderkey AS s FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT '{EX}new' FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)")
def stored_object_scan(spark, sf_dir):
    """A bound object on a stored graph that grew: its bucket alone is read, what came twice is there once."""
    quads = kb(spark, sf_dir, "orders").materialise().quads.where(F.col("p") == EX + "priority")
    g = StoredGraph.create(quads, scratch_dir(spark, "stored"), 16)
    fresh = Graph.of(spark, [(EX + "new", EX + "priority", ("1-URGENT", None, None))]).quads
    g.add(quads.where("o.lex = '1-URGENT'").withColumn("g", F.lit("again")).unionByName(fresh))
    return g.scan(p=EX + "priority", o=Const(T.LITERAL, "1-URGENT")).select("s")


_LOOSE = """WITH l AS (SELECT c_custkey, CASE WHEN c_acctbal > 3000 THEN c_mktsegment END AS x FROM customer),
 r AS (SELECT o_custkey, o_orderkey, o_orderpriority, CASE WHEN o_totalprice > 200000 THEN o_orderpriority END AS x FROM orders)"""
_ORDERS = f"'{EX}c' || c_custkey AS c, '{EX}o' || o_orderkey AS o"
_SEGMENT = "?c ex:name ?m ; ex:balance ?b . OPTIONAL { ?c ex:segment ?x . FILTER(?b > 3000) }"
_PRIORITY = "?o ex:customer ?c ; ex:total ?t . OPTIONAL { ?o ex:priority ?x . FILTER(?t > 200000) }"


@registered(f"{_LOOSE} SELECT {_ORDERS}, coalesce(l.x, r.x) AS x FROM l JOIN r ON c_custkey = o_custkey AND (l.x IS NULL OR r.x IS NULL OR l.x = r.x)")
def loose_join(spark, sf_dir):
    """A variable that either side may leave unbound: parts with equal masks meet by equality."""
    return ask(spark, sf_dir, ("customer", "orders"), f"SELECT ?c ?o ?x WHERE {{ {{ {_SEGMENT} }} {{ {_PRIORITY} }} }}", c="lex", o="lex", x="lex")


@registered(f"{_LOOSE} SELECT {_ORDERS}, coalesce(l.x, o_orderpriority) AS x FROM l JOIN r ON c_custkey = o_custkey")
def loose_optional(spark, sf_dir):
    """A second optional part that gives the value where the first one had none."""
    return ask(spark, sf_dir, ("customer", "orders"), f"SELECT ?c ?o ?x WHERE {{ {_SEGMENT} ?o ex:customer ?c . OPTIONAL {{ ?o ex:priority ?x }} }}", c="lex", o="lex", x="lex")


@registered(
    f"""WITH n AS (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey END AS x FROM nation), s AS (SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_nationkey % 5 END AS x FROM supplier)
 SELECT '{EX}n' || n_nationkey AS n, count(*)::BIGINT AS k, count(coalesce(n.x, s.x))::BIGINT AS bound FROM n JOIN s ON n.x IS NULL OR s.x IS NULL OR n.x = s.x GROUP BY ALL"""
)
def loose_join_alone(spark, sf_dir):
    """The same with no other variable in common: what binds nothing goes with all, dealt over salts."""
    c = Compiler(kb(spark, sf_dir, "nation"))
    iri = lambda prefix, x: T.iri(F.concat(F.lit(EX + prefix), x.cast("string")))
    n = table(spark, sf_dir, "nation").select(iri("n", F.col("n_nationkey")).alias("n"), F.when(F.col("n_nationkey") % 2 == 0, T.number(F.col("n_regionkey"))).alias("x"))
    s = table(spark, sf_dir, "supplier").select(iri("s", F.col("s_suppkey")).alias("s"), F.when(F.col("s_acctbal") > 0, T.number(F.col("s_nationkey") % 5)).alias("x"))
    out = c.join(n, s, {"n", "x"}, {"s", "x"}, {"x"}, {"x"})
    return out.groupBy(F.col("n.lex").alias("n")).agg(F.count(F.lit(1)).alias("k"), F.count("x").alias("bound"))
