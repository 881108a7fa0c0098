"""Graphs stored in three layouts, so that patterns read few files and joins on a subject need no shuffle.

The same unique quads are written three times: in buckets by subject, in folders by predicate sorted by object,
and in buckets by object. A scan takes the layout that its bound positions prune best. One row of each triple
is marked, so a scan over all graphs needs no deduplication either.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphtide.functions import registry
from graphtide.functions import terms as T

from .closure import settle
from .graph import DEFAULT, Graph, dealt

_COLUMNS = ["g", "s", "s_kind", "p", "o", "sk", "ok", "first"]
_TRIPLE = ["sk", "p", "ok"]


def _keyed(rows: DataFrame) -> DataFrame:
    rows = rows if "g" in rows.columns else rows.withColumn("g", F.lit(DEFAULT))
    return rows.select("g", "s", "s_kind", "p", "o", T.key(T.term(F.col("s_kind"), F.col("s"))).alias("sk"), T.key(F.col("o")).alias("ok"))


class StoredGraph:
    """A graph in three tables under a folder; read with :meth:`open`, made with :meth:`create`."""

    def __init__(self, spark: SparkSession, name: str, functions: dict | None = None):
        self.spark, self.name, self.functions = spark, name, {**registry.QUERY, **(functions or {})}

    @classmethod
    def create(cls, rows: DataFrame, folder: str, buckets: int = 64, functions: dict | None = None) -> StoredGraph:
        """Writes quads (g, s, s_kind, p, o), each once; equal terms are one whatever their form."""
        made = cls(rows.sparkSession, f"graph_{uuid.uuid4().hex}", functions)
        made._write(settle(made._unique(_keyed(rows))), folder, buckets, "errorifexists")
        return made

    @classmethod
    def open(cls, spark: SparkSession, folder: str, buckets: int = 64, functions: dict | None = None) -> StoredGraph:
        """A graph that an earlier session wrote, with the same number of buckets."""
        found = cls(spark, f"graph_{uuid.uuid4().hex}", functions)
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{folder}/s").schema.fields)
        for side, by in (("s", "sk"), ("o", "ok")):
            spark.sql(f"CREATE TABLE {found.name}_{side} ({fields}) USING parquet CLUSTERED BY ({by}) INTO {buckets} BUCKETS LOCATION '{folder}/{side}'")
        spark.sql(f"CREATE TABLE {found.name}_p ({fields}, predicate string) USING parquet PARTITIONED BY (predicate) LOCATION '{folder}/p'")
        spark.sql(f"MSCK REPAIR TABLE {found.name}_p")
        return found

    @staticmethod
    def _unique(rows: DataFrame) -> DataFrame:
        rows = dealt(rows, *_TRIPLE).groupBy("g", *_TRIPLE).agg(*[F.any_value(c).alias(c) for c in ("s", "s_kind", "o")])
        return rows.withColumn("first", F.col("g") == F.min("g").over(Window.partitionBy(*_TRIPLE))).select(*_COLUMNS)

    def _write(self, rows: DataFrame, folder: str | None, buckets: int, mode: str) -> None:
        for side, by in (("s", "sk"), ("o", "ok")):
            # Whole buckets in a task where they are small; rebalancing splits what a hot key makes large.
            dealt = rows.withColumn("_b", F.pmod(F.hash(by), F.lit(buckets))).hint("rebalance", "_b").drop("_b")
            w = dealt.write.mode(mode).format("parquet").bucketBy(buckets, by).sortBy(by, "p")
            (w.option("path", f"{folder}/{side}") if folder else w).saveAsTable(f"{self.name}_{side}")
        dealt = rows.withColumn("predicate", F.col("p")).hint("rebalance", "predicate").sortWithinPartitions("predicate", "ok")
        w = dealt.write.mode(mode).format("parquet").partitionBy("predicate")
        (w.option("path", f"{folder}/p") if folder else w).saveAsTable(f"{self.name}_p")

    def table(self, side: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{side}")

    # ------------------------------------------------------------ reading

    @staticmethod
    def layout(s: bool, p: bool, o: bool) -> str:
        """The table for a scan with these positions bound: the subject's or the object's bucket, else the predicate's folder."""
        return "s" if s or not (o or p) else "o" if o else "p"

    def _rows(self, s: str | None, p: str | None, o, g: str | None, graphs: bool, side: str | None = None) -> DataFrame:
        side = side or self.layout(s is not None, p is not None, o is not None)
        rows = self.table(side)
        tests: list[Column] = [F.col("g") == g] if g is not None else [] if graphs else [F.col("first")]
        if s is not None:
            kind = T.BLANK if s.startswith("_:") else T.IRI
            tests.append(F.col("sk") == T.key(T.constant(kind, s)))
        if p is not None:
            tests.append(F.col("p") == p)
            if side == "p":
                tests.append(F.col("predicate") == p)
        if o is not None:
            tests.append(F.col("ok") == T.key(T.constant(o.kind, o.lex, o.dt, o.lang)))
        return reduce(DataFrame.where, tests, rows)

    def scan(self, s: str | None = None, p: str | None = None, o=None, g: str | None = None, graphs: bool = False) -> DataFrame:
        """As :meth:`Graph.scan`, from the layout that fits, without a shuffle."""
        rows = self._rows(s, p, o, g, graphs)
        return rows.select("g" if graphs or g is not None else F.lit(None).cast("string").alias("g"), "s", "s_kind", "p", "o")

    def star(self, predicates: list[str], g: str | None = None) -> DataFrame:
        """(g, s, s_kind, o0, o1, ...): the patterns of one subject, joined bucket by bucket."""
        out = None
        for i, p in enumerate(predicates):
            rows = self._rows(None, p, None, g, False, "s")
            rows = rows.select("sk", F.lit(g).cast("string").alias("g"), "s", "s_kind", F.col("o").alias("o0")) if out is None else rows.select("sk", F.col("o").alias(f"o{i}"))
            out = rows if out is None else out.join(rows, "sk")
        return out.drop("sk")

    def count(self) -> int:
        return self.table("s").where("first").count()

    def contains(self, s: str, p: str, o) -> bool:
        return self.scan(s, p, o).limit(1).count() > 0

    def graphs(self) -> DataFrame:
        return self.table("s").select("g").distinct()

    def predicates(self) -> DataFrame:
        return self.table("p").where("first").groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("o.dt")).alias("datatypes"))

    def query(self, text: str, **options) -> DataFrame:
        from graphtide.plans.sparql import query

        return query(self, text, **options)

    def load(self) -> Graph:
        return Graph(self.table("s").select("g", "s", "s_kind", "p", "o"), self.functions)

    # ------------------------------------------------------------ changing

    def add(self, rows: DataFrame, graph: str | None = None) -> int:
        """Appends the quads that are not there yet and gives their number; only the new rows are shuffled.

        A triple that another graph has is stored for this one too, without the mark of its first row.
        """
        rows = rows.withColumn("g", F.lit(graph)) if graph is not None else rows
        fresh = self._unique(_keyed(rows))
        known = self.table("s").select("sk", *[F.col(c).alias(f"_{c}") for c in ("p", "ok", "g")])
        met = fresh.join(known, (fresh["sk"] == known["sk"]) & (F.col("p") == F.col("_p")) & (F.col("ok") == F.col("_ok")), "left").select(*[fresh[c] for c in _COLUMNS], "_g")
        seen = met.groupBy("g", *_TRIPLE).agg(*[F.any_value(c).alias(c) for c in ("s", "s_kind", "o")], F.bool_or("first").alias("first"), F.count("_g").alias("_held"), F.count_if(F.col("_g") == F.col("g")).alias("_here"))
        new = settle(seen.where("_here = 0").withColumn("first", F.col("first") & (F.col("_held") == 0)).select(*_COLUMNS))
        n = new.count()
        if n:
            buckets = int(next(r.data_type for r in self.spark.sql(f"DESCRIBE FORMATTED {self.name}_s").collect() if r.col_name == "Num Buckets"))
            self._write(new, None, buckets, "append")
        return n
