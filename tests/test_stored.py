"""Stored graphs answer as graphs in memory do, and their plans read and shuffle what they should."""

import re

from compare import found
from pyspark.sql import functions as F

from graphtide.functions import terms as T
from graphtide.operators.closure import scratch_dir
from graphtide.operators.graph import Graph
from graphtide.operators.stored import StoredGraph
from graphtide.plans.kb_queries import EX, kb
from graphtide.plans.sparql_parser import Const


def plan(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def rows(df):
    return found(df.select("g", "s", "s_kind", "p", T.key(F.col("o")).alias("o")))


def test_scans_stars_and_growth(spark, small, tmp_path):
    g = kb(spark, small, "customer", "nation").materialise()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else a plan that needs no buckets doesn't tell those it reads
    try:
        kept = StoredGraph.create(g.quads.unionByName(g.quads.where(F.col("p") == EX + "name")), str(tmp_path / "g"), 8)
        c, n = EX + "c7", Const(T.IRI, EX + "n3")
        for where in ({}, {"s": c}, {"p": EX + "nation"}, {"o": n}, {"s": c, "p": EX + "name"}, {"p": EX + "nation", "o": n}, {"o": n, "g": "graph/Customer"}, {"graphs": True, "s": c}):
            assert rows(kept.scan(**where)) == rows(g.scan(**where)), where
            assert "Exchange" not in plan(kept.scan(**where))
        # A bound object or subject reads one bucket, a bound predicate one folder.
        assert "SelectedBucketsCount: 1 out of 8" in plan(kept.scan(o=n)) and "SelectedBucketsCount: 1 out of 8" in plan(kept.scan(s=c))
        assert re.search(r"PartitionFilters: \[isnotnull\(predicate", plan(kept.scan(p=EX + "nation")))
        text = f"PREFIX ex: <{EX}> SELECT ?c ?m ?b ?n WHERE {{ ?c ex:name ?m ; ex:balance ?b ; ex:nation ?n }}"
        star = kept.query(text)
        assert "Exchange" not in plan(star) and len(re.findall(r"- SortMergeJoin Inner", plan(star))) == 2
        one = lambda d: found(d.select(*[T.key(F.col(x)).alias(x) for x in d.columns]))
        assert one(star) == one(g.query(text))

        more = Graph.of(spark, [(EX + "c7", EX + "nation", EX + "n3"), (EX + "x", EX + "nation", EX + "n3"), (EX + "x", EX + "nation", EX + "n3")])
        had = g.scan(EX + "c7", EX + "nation", n).count()
        assert kept.add(more.quads, "more") == 2 and kept.add(more.quads, "more") == 0
        both = g.add(more.quads, "more")
        for where in ({}, {"o": n}, {"graphs": True, "o": n}, {"g": "more"}, {"p": EX + "nation"}):
            assert rows(kept.scan(**where)) == rows(both.scan(**where)), where
        assert kept.count() == both.count() == g.count() + 2 - had
        again = StoredGraph.open(spark, str(tmp_path / "g"), 8)
        assert rows(again.scan(o=n)) == rows(both.scan(o=n)) and "SelectedBucketsCount: 1 out of 8" in plan(again.scan(o=n))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_the_shared_folder(spark):
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")
