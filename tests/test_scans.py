"""Scans, order statistics and fronts over chunks, against loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from graphtide.operators import analysis, discrete, dynamics, scans
from graphtide.operators.skyline import skyline


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_queue_spans_tasks_and_equals_the_loop(spark):
    """All events in one queue, and beside it small ones that begin and end within a chunk."""
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    rows = events.select(F.lit("all").alias("queue"), F.col("event_id").alias("entity_id"), (F.col("event_id") % 977).cast("double").alias("arr_t"), (F.col("event_id") % 3 * 0.25).alias("service_t"))
    rows = rows.union(spark.createDataFrame([(q, k, float(k // 2), 0.75) for q in ("a", "zz") for k in range(6)], rows.schema))
    spread = scans.chunks(rows, ["queue"], ["arr_t", "entity_id"])
    assert spread.where("queue = 'all'").select(scans.CHUNK).distinct().count() >= 6
    out = discrete.fifo(rows)
    assert "SinglePartition" not in plan(out)
    got = {(r.queue, r.entity_id): (r.dep_t, r.wait) for r in out.collect()}
    free: dict = {}
    for r in sorted(rows.collect(), key=lambda r: (r.arr_t, r.entity_id)):
        start = max(r.arr_t, free.get(r.queue, -math.inf))
        free[r.queue] = start + r.service_t
        assert got[r.queue, r.entity_id] == pytest.approx((free[r.queue], start - r.arr_t), abs=1e-6)
    assert len(got) == rows.count() and discrete.fifo(rows.limit(0)).count() == 0


def test_running_sums_with_nulls_ties_and_no_group(spark):
    rng = random.Random(1)
    data = [(rng.choice(["x", "y", None]), rng.choice([None, 1, 2, 3, 3]), k) for k in range(400)] + [("hot", 7, k) for k in range(600)]
    df = spark.createDataFrame(data, "g string, v long, k long")
    for group in ([], ["g"]):
        got = {r.k + 1000 * (r.g == "hot"): r.s for r in scans.running_sum(df, group, ["k", "v"], "v", "s").collect()}
        if group:
            sums: dict = {}
            for g, v, k in sorted(data, key=lambda x: x[2]):
                sums[g] = sums.get(g, 0) + (v or 0)
                assert got[k + 1000 * (g == "hot")] == sums[g]
        else:
            assert max(got.values()) == sum(v or 0 for _, v, _ in data)
    assert scans.running_sum(df.limit(0), [], ["k"], "v", "s").count() == 0


def test_ranks_and_order_statistics(spark):
    rng = random.Random(2)
    data = [(rng.choice("ab"), rng.choice([0.5, 1.0, 2.0, 2.0, 9.0, None])) for _ in range(500)] + [("c", 4.0)]
    df = spark.createDataFrame(data, "g string, v double")
    out = scans.average_rank(df, "v", "rank", ["g"])
    assert "SinglePartition" not in plan(scans.average_rank(df, "v", "rank"))
    for r in out.collect():
        own = sorted((x is not None, x or 0) for g, x in data if g == r.g)
        places = [i + 1 for i, x in enumerate(own) if x == (r.v is not None, r.v or 0)]
        assert r["rank"] == sum(places) / len(places)
    got = {r.g: (r.lo, r.mid) for r in scans.at_places(df, ["g"], "v", {"lo": lambda n: F.floor(n * 0.05), "mid": lambda n: F.floor(n / 2)}).collect()}
    for g in "abc":
        own = sorted(x for h, x in data if h == g and x is not None)
        assert got[g] == (own[int(len(own) * 0.05)], own[len(own) // 2])
    bands = dynamics.bands(df.select(F.lit(0).alias("step"), F.lit(0.0).alias("t"), F.col("g").alias("var"), "v").withColumnRenamed("v", "value"))
    assert "collect_list" not in plan(bands) and bands.count() == 3


@pytest.mark.parametrize("width, kind", [(1, "ties"), (2, "wide"), (3, "ties"), (3, "wide"), (4, "anti")])
def test_skyline_with_ties_and_repeats(spark, width, kind):
    rng = random.Random(width)

    def one():
        if kind == "ties":
            return tuple(float(rng.randrange(6)) for _ in range(width))
        x = [rng.random() for _ in range(width)]
        return tuple(v / sum(x) for v in x) if kind == "anti" else tuple(x)

    data = [(k, *one()) for k in range(700)]
    data += [(1000 + k, *x[1:]) for k, x in enumerate(data[:80])] + [(2000, *[None] * width), (2001, *[math.nan] * width)]
    names = [f"o{i}" for i in range(width)]
    df = spark.createDataFrame(data, "k long, " + ", ".join(f"{n} double" for n in names))
    front = skyline(df, names)
    assert "NestedLoop" not in plan(front) and "Cartesian" not in plan(front)
    real = {x[1:] for x in data[:-2]}
    best = {x for x in real if not any(y != x and all(a <= b for a, b in zip(y, x, strict=True)) for y in real)}
    assert sorted(r.k for r in front.collect()) == sorted([k for k, *x in data[:-2] if tuple(x) in best] + [2000, 2001])
    assert skyline(df.limit(0), names).count() == 0
    assert analysis.pareto(df, names, "k").count() == front.count()
