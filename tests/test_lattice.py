"""Built-in types, roll-ups, and edges judged by domain and range."""

from pyspark.sql import functions as F

from graphtide.functions import terms as T
from graphtide.operators import analysis, lattice
from graphtide.operators.graph import Graph
from graphtide.operators.inference import Lattice, infer, owl_rules, rdfs_rules
from graphtide.sources import series

X = "http://x/"


def test_built_in(spark):
    y = lattice.built_in(spark)
    assert y.types.count() == y.types.select("name").distinct().count() == 53
    assert {r[0] for r in y.ancestors("PERSON").collect()} == {"AGENT", "BLOB"}
    assert {r[0] for r in y.ancestors("MATERIAL").collect()} == {"INTERACTION"}
    assert y.types.where("properties['transitive']").count() == 4


def _small(spark):
    rows = [("top", None), ("a", "top"), ("b", "top"), ("aa", "a"), ("moves", None), ("free", None)]
    return Lattice(spark.createDataFrame([(n, p, None) for n, p in rows], "name string, parent string, properties map<string, boolean>"))


def test_judged(spark):
    edges = [(1, "aa", "moves", "b"), (2, "a", "moves", "b"), (3, "b", "moves", "b"), (4, "aa", "free", "top"), (5, "aa", "moves", "zz"), (6, None, "moves", "b"), (7, "aa", "moves", "b"), (8, "aa", "other", "b"), (9, "top", "moves", "b")]
    limits = spark.createDataFrame([("moves", "a", None), ("moves", None, "top")], "edge_type string, domain string, range string")
    rows = lattice.judged(spark.createDataFrame(edges, "id int, source_type string, edge_type string, target_type string"), _small(spark), limits)
    assert {r["id"]: r["valid"] for r in rows.collect()} == {1: True, 2: True, 3: False, 4: True, 5: False, 6: False, 7: True, 8: False, 9: False}


def test_rolled_up(spark):
    rows = spark.createDataFrame([("aa", 1), ("aa", 5), ("b", 2), ("zz", 9), (None, 9)], "t string, v int")
    got = lattice.rolled_up(rows, _small(spark), "t", {"n": (F.count(F.lit(1)), F.sum), "most": (F.max("v"), F.max)}).collect()
    assert {(r["type"], r["n"], r["most"]) for r in got} == {("aa", 2, 5), ("a", 2, 5), ("b", 1, 2), ("top", 3, 5)}


def test_rules_that_inference_awakes(spark):
    """Domains and transitive predicates that only other rules make known are found, though none is there at first."""
    g = Graph.of(spark, [
        (X + "myDomain", T.RDFS + "subPropertyOf", T.RDFS + "domain"), (X + "knows", X + "myDomain", X + "Person"), (X + "a", X + "knows", X + "b"),
        (X + "Order", T.RDFS + "subClassOf", T.OWL + "TransitiveProperty"), (X + "above", T.TYPE, X + "Order"), (X + "u", X + "above", X + "v"), (X + "v", X + "above", X + "w"), (X + "w", X + "above", X + "x"),
    ])
    _, new = infer(g, rdfs_rules() + owl_rules())
    got = {(r["s"].removeprefix(X), r["p"].removeprefix(X), r["o"]["lex"].removeprefix(X)) for r in new.collect()}
    assert {("a", T.TYPE, "Person"), ("knows", T.RDFS + "domain", "Person"), ("above", T.TYPE, T.OWL + "TransitiveProperty")} <= got
    assert {("u", "above", "w"), ("u", "above", "x"), ("v", "above", "x")} <= got
    assert new.count() == len(got)


def test_ranks_and_errors(spark):
    scores = spark.createDataFrame([("x", "q", 1.0), ("y", "q", 3.0), ("z", "q", 3.0)], "scenario string, query string, score double")
    assert {(r["scenario"], r["rank"]) for r in analysis.rank_scenarios(scores).collect()} == {("y", 1), ("z", 2), ("x", 3)}
    simulated = spark.createDataFrame([(1, "A", 0.0, 0.0), (1, "A", 2.0, 4.0), (2, "B", 0.0, 1.0)], "run_id long, var string, t double, value double")
    observed = spark.createDataFrame([("A", 1.0, 1.0), ("A", 2.0, 4.0)], "var string, t double, value double")
    assert [tuple(r) for r in analysis.errors(simulated, observed).collect()] == [(1, 1.0, 0.5, 1.0)]


def test_export_in_order(spark, tmp_path):
    rows = spark.range(0, 5000, 1, 7).select((4999 - F.col("id")).cast("double").alias("time"), F.col("id").alias("A"))
    series.export(rows, str(tmp_path / "out"))
    times = [float(line.split(",")[0]) for f in sorted((tmp_path / "out").glob("part-*")) for line in f.read_text().splitlines()[1:]]
    assert times == [float(i) for i in range(5000)]
