"""Reachability over edge tables, and the checkpoints that loops need."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where it is unset a temporary folder is made, but only for a session that runs in one process.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="graphtide-"))
        current = sc._jsc.sc().getCheckpointDir()
    return named or current.get()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path under the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage: it is written as a table in the shared folder and read from there.

    Later reads take only the columns that they need, and joins know the table's size. What Parquet cannot hold (no
    columns, names that differ only by case, columns without a type) goes to the session's checkpoint folder.
    """
    names = {c.lower() for c in df.columns}
    if not names or len(names) < len(df.columns) or "void" in df.schema.simpleString():
        shared_dir(df.sparkSession)
        return df.checkpoint()
    folder = scratch_dir(df.sparkSession, "settled")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: Ends that a node's row in a closure has at most; nodes that reach more have several rows.
ENDS = 1 << 16


def reach(edges: DataFrame, most_rounds: int = 64, far: bool = False, many: int = 100_000, listed: bool = False) -> DataFrame:
    """The transitive closure of (a, b): every pair connected by one edge or more. Null ends are dropped.

    far: without the pairs that are edges themselves. listed: as (a, ends), many b in one row; a may come in several. From so ``many`` edges on, a graph without cycles (but loops of one
    edge) is climbed level by level if it is not too high. In all others paths are doubled by their length. As soon as nodes are seen to
    reach each other they are put in one, the walk starts anew on the smaller graph, and they are given back at
    the end; so cycles cost their pairs, not the paths between them.
    """
    steps = settle(edges.select("a", "b").where("a is not null and b is not null").distinct())
    now, names = steps.where("a <> b"), None
    if steps.count() >= many:
        known = _climbed_rows(now)
        if known is not None:
            rows = known.select("a", F.col("far").alias("ends")).where("size(ends) > 0")
            if not far:
                rows = rows.union(known.select("a", "near")).union(steps.where("a = b").select("a", F.array("b")))
            return rows if listed else rows.select("a", F.explode("ends").alias("b"))
    told = lambda x: x.select("a", F.array("b").alias("ends")) if listed else x
    while True:
        known, cyclic = _doubled(now, most_rounds)
        if not cyclic:
            break
        # Each node goes to the smallest of those that it reaches and that reach it; all that go to one node reach each other over it.
        mutual = known.join(known.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"]).groupBy("a").agg(F.min("b").alias("_least"))
        merged = settle(mutual.select(F.col("a").alias("node"), F.least("a", "_least").alias("to")))
        if names is None:
            names = merged.withColumnRenamed("to", "component")
        else:
            moved = names.join(merged.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
            names = settle(moved.union(merged.join(names, "node", "left_anti")))
        for end in ("a", "b"):
            now = now.join(merged.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        now = settle(now.select("a", "b").where("a <> b").distinct())
    loops = steps.where("a = b").select("a", "b")
    apart = lambda x: settle(x.join(steps, ["a", "b"], "left_anti")) if far else x
    if names is None:
        return told(apart(known.union(loops)))
    members = lambda c: names.select(F.col("component").alias(c), F.col("node").alias(f"_{c}"))
    out = known.join(members("a"), "a", "left").join(members("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    inside = names.select("component", F.col("node").alias("a")).join(names.select("component", F.col("node").alias("b")), "component").select("a", "b")
    out = out.union(inside).union(loops.join(names.select(F.col("node").alias("a")), "a", "left_anti"))
    return told(apart(out) if far else settle(out))


def _climbed(edges: DataFrame, most: int = 32) -> DataFrame | None:
    """(a, b, d) for the closure of edges without loops, d being 1 for edges and more for others; None if there is a
    cycle or more levels."""
    known = _climbed_rows(edges, most)
    if known is None:
        return None
    return known.select("a", F.explode("near").alias("b"), F.lit(1).alias("d")).union(known.select("a", F.explode("far"), F.lit(2)))


def _climbed_rows(edges: DataFrame, most: int = 32) -> DataFrame | None:
    """(a, near, far, n) for the closure of edges without loops: the ends of a's edges, the others that a reaches, and
    how many both are. None if there is a cycle or more levels.

    A node's ends are told once, when those of all nodes it leads to are there: its edges, and their ends' ends. They
    go in rows of ENDS at most, not pair by pair, so what is shuffled is a row for an edge. Nodes that lead to more
    (ends met twice count twice) have their pairs grouped first, so no row and no group grows with the graph.
    """
    leading = settle(edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")))
    fresh = settle(edges.select("b").distinct().join(leading.select(F.col("a").alias("b")), "b", "left_anti")).withColumn("n", F.lit(0))
    counts = known = None
    left = leading.count()
    for _ in range(most):
        # Of each node that leads to fresh ones, how many of its edges lead to nodes that are done, and the ends that these bring.
        met = settle(edges.join(fresh, "b").groupBy("a").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("n") + 1).alias("all")))
        counts = met if counts is None else counts.union(met)
        sums = counts.groupBy("a").agg(F.sum("m").alias("m"), F.sum("all").alias("all"))
        ready = settle(leading.join(met.select("a"), "a", "left_semi").join(sums, "a").where("m = n").select("a", F.ceil(F.col("all") / ENDS).cast("int").alias("parts")))
        more, parts = ready.agg(F.count(F.lit(1)), F.max("parts")).first()
        if not more:
            return None
        own = edges.join(ready, "a")
        if known is None:
            own = own.withColumn("ends", F.lit(None).cast(f"array<{dict(edges.dtypes)['b']}>"))
        else:
            own = own.join(known.select(F.col("a").alias("b"), F.concat("near", "far").alias("ends")), "b", "left")
        # Dealt first: a task's own rows are hardly of one node, so grouping them before would only hold and spill them.
        few = own.where("parts = 1").repartition("a").groupBy("a").agg(F.array_distinct(F.collect_list("b")).alias("near"), F.flatten(F.collect_list("ends")).alias("far"))
        rows = few.select("a", "near", F.array_except("far", "near").alias("far"))
        if parts > 1:
            large = own.where("parts > 1")
            pairs = large.select("a", "parts", "b", F.lit(1).alias("d")).union(large.select("a", "parts", F.explode("ends"), F.lit(2)))
            pairs = pairs.groupBy("a", "parts", "b").agg(F.min("d").alias("d"))
            split = pairs.groupBy("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("_k"))
            rows = rows.union(split.agg(*[F.collect_list(F.when(F.col("d") == d, F.col("b"))).alias(name) for d, name in ((1, "near"), (2, "far"))]).drop("_k"))
        rows = settle(rows.withColumn("n", F.size("near") + F.size("far")))
        known = rows if known is None else known.union(rows)
        left -= more
        if not left:
            return known
        fresh = rows.groupBy(F.col("a").alias("b")).agg(F.sum("n").alias("n"))
    return None


def _doubled(edges: DataFrame, most_rounds: int) -> tuple[DataFrame, bool]:
    """The closure of edges without loops, or, as soon as a node reaches itself, the pairs found so far; and which of them it is.

    With all pairs up to distance k known, those up to 2k are made of a pair and one at distance k exactly. So a
    path is put together at few of its inner nodes, not at each, and depth d takes about log2(d) rounds.
    """
    known, k = settle(edges.select("a", "b", F.lit(1).alias("d"))), 1
    for _ in range(most_rounds):
        exact = known.where(F.col("d") == k)
        longer = known.select("a", F.col("b").alias("m"), F.col("d").alias("_d")).join(exact.select(F.col("a").alias("m"), "b"), "m")
        # Known pairs are at k at most and new ones above, so one grouping by pair tells them apart, without a join of both.
        found = settle(known.unionByName(longer.select("a", "b", (F.col("_d") + k).alias("d"))).groupBy("a", "b").agg(F.min("d").alias("d")).where(F.col("d") > k))
        known, k = known.union(found), 2 * k
        state = found.agg(F.max((F.col("a") == F.col("b")).cast("int")), F.max("d")).first()
        if state[0]:
            return known.select("a", "b"), True
        if state[1] is None or state[1] < k:
            return known.select("a", "b"), False
    raise RuntimeError(f"no fixpoint after {most_rounds} rounds")


def depths(edges: DataFrame, roots: DataFrame, most: int = 100) -> DataFrame:
    """(node, depth): the fewest edges (a -> b) from any root; roots has a column ``node``."""
    seen = settle(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for d in range(1, most + 1):
        front = settle(front.join(edges.select(F.col("a").alias("node"), F.col("b")), "node").select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(d)))
        if not front.limit(1).count():
            break
        seen = settle(seen.union(front))
    return seen


def paths(edges: DataFrame, roots: DataFrame, most: int = 10) -> DataFrame:
    """(root, path, cut): simple paths from each root along (a -> b), as long as they go.

    A path ends at a node without outgoing edges, where it would meet itself, or at the greatest depth; the
    last two are cut.
    """
    front = roots.select(F.col("node").alias("root"), F.array("node").alias("path"))
    done = None
    for d in range(most + 1):
        last = F.element_at("path", -1)
        grown = front.join(edges.select("a", "b"), last == F.col("a"), "left")
        ends = grown.where("b is null").select("root", "path", F.lit(False).alias("cut"))
        loops = grown.where("b is not null and array_contains(path, b)").select("root", F.array_append("path", F.col("b")).alias("path"), F.lit(True).alias("cut"))
        on = grown.where("b is not null and not array_contains(path, b)").select("root", F.array_append("path", F.col("b")).alias("path"))
        part = ends.union(loops)
        if d == most:
            part = part.union(on.select("root", "path", F.lit(True)))
        done = part if done is None else done.union(part)
        if d == most:
            break
        front = settle(on)
        if not front.limit(1).count():
            break
    return done
