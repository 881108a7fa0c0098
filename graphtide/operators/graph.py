"""Graphs of quads: stored ones, and virtual ones over mapped tables.

A stored graph is a DataFrame (g, s, s_kind, p, o) that is best written partitioned by p, so that a pattern
with a constant predicate reads one folder. A mapped graph has no quads: a pattern is answered from the
columns that map to its predicate, so Parquet reads two columns and gets the filters pushed down.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtide.functions import registry
from graphtide.functions import terms as T

QUAD = f"g string, s string, s_kind tinyint, p string, o {T.TERM}"
DEFAULT = "default"


class Graph:
    """Quads with set semantics; every change gives a new Graph. functions: scalar functions for queries.

    once: the quads are known to hold each triple once over all graphs, so scans need not deduplicate.
    """

    def __init__(self, quads: DataFrame, functions: dict | None = None, once: bool = False):
        self.quads, self.spark, self.once, self.functions = quads, quads.sparkSession, once, {**registry.QUERY, **(functions or {})}

    @classmethod
    def empty(cls, spark: SparkSession) -> Graph:
        return cls(spark.createDataFrame([], QUAD))

    @classmethod
    def of(cls, spark: SparkSession, rows: list[tuple], graph: str = DEFAULT) -> Graph:
        """From (s, p, o): strings are IRIs; for o also (lex, datatype, tag), or a number or boolean."""
        made = []
        for s, p, o in rows:
            lex, dt, lang, kind = (o, None, None, T.IRI) if isinstance(o, str) else (str(o), None, None, T.LITERAL)
            if isinstance(o, tuple):
                lex, dt, lang = (*o, None, None)[:3]
                kind = T.LITERAL
            elif isinstance(o, bool):
                lex, dt = str(o).lower(), T.XSD + "boolean"
            elif isinstance(o, int):
                dt = T.XSD + "integer"
            elif isinstance(o, float):
                dt = T.XSD + "double"
            made.append((graph, s, p, kind, lex, dt, lang))
        raw = spark.createDataFrame(made, "g string, s string, p string, kind int, lex string, dt string, lang string")
        return cls(raw.select("g", "s", F.when(F.startswith("s", F.lit("_:")), T.BLANK).otherwise(T.IRI).cast("tinyint").alias("s_kind"), "p", typed("kind", "lex", "dt", "lang").alias("o")))

    # ------------------------------------------------------------ reading

    def scan(self, s: str | None = None, p: str | None = None, o=None, g: str | None = None, graphs: bool = False) -> DataFrame:
        """Triples that match the constants; each once, unless graphs asks for the graphs they are in."""
        rows = self.quads
        if g is not None:
            rows = rows.where(F.col("g") == g)
        if s is not None:
            rows = rows.where(F.col("s") == s)
        if p is not None:
            rows = rows.where(F.col("p") == p)
        if o is not None:
            rows = rows.where(T.key(F.col("o")) == T.key(T.constant(o.kind, o.lex, o.dt, o.lang)))
        if graphs or g is not None:
            return rows.select("g", "s", "s_kind", "p", "o")
        rows = rows.select("s", "s_kind", "p", "o")
        return (rows if self.once else distinct(rows)).withColumn("g", F.lit(None).cast("string"))

    def count(self) -> int:
        return self.scan().count()

    def contains(self, s: str, p: str, o) -> bool:
        return self.scan(s, p, o).limit(1).count() > 0

    def graphs(self) -> DataFrame:
        return self.quads.select("g").distinct()

    def predicates(self) -> DataFrame:
        """(p, n, datatypes): the catalog of predicates."""
        return self.scan().groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("o.dt")).alias("datatypes"))

    def query(self, text: str, **options) -> DataFrame:
        from graphtide.plans.sparql import query

        return query(self, text, **options)

    # ------------------------------------------------------------ changing

    def fresh(self, rows: DataFrame, graph: str | None = None) -> DataFrame:
        """The rows that are in no graph yet (or not in the named one)."""
        known = self.quads if graph is None else self.quads.where(F.col("g") == graph)
        return identified(rows).join(identified(known).select("s", "s_kind", "p", "_k"), ["s", "s_kind", "p", "_k"], "left_anti").drop("_k").select(*rows.columns)

    def add(self, rows: DataFrame, graph: str | None = None) -> Graph:
        """With more quads; those already there change nothing."""
        rows = rows.withColumn("g", F.lit(graph)) if graph is not None or "g" not in rows.columns else rows
        both = self.quads.unionByName(rows.select("g", "s", "s_kind", "p", "o"))
        keys = ["s", "s_kind", "p", "_k"]
        return Graph(dealt(identified(both), *keys).dropDuplicates(["g", *keys]).drop("_k"), self.functions)

    def remove(self, s: str | None = None, p: str | None = None, o=None, graph: str | None = None) -> Graph:
        """Without the matching triples; with graph, only there."""
        doomed = self.scan(s, p, o, graph, graphs=True)
        keys = ["g", "s", "s_kind", "p", "_k"]
        return Graph(identified(self.quads).join(identified(doomed).select(*keys), keys, "left_anti").select("g", "s", "s_kind", "p", "o"), self.functions)

    def remove_graph(self, graph: str) -> Graph:
        return Graph(self.quads.where(F.col("g") != graph), self.functions)

    def copy_graph(self, source: str, target: str) -> Graph:
        return self.add(self.quads.where(F.col("g") == source).withColumn("g", F.lit(target)))

    def write(self, path: str) -> None:
        """Parquet, a folder for each predicate, sorted by subject within files."""
        self.quads.withColumn("predicate", F.col("p")).repartition("p").sortWithinPartitions("p", "s").write.partitionBy("predicate").mode("overwrite").parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Graph:
        return cls(spark.read.parquet(path).select("g", "s", "s_kind", "p", "o"))


def identified(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_k", T.key(F.col("o")))


def distinct(rows: DataFrame, often: bool = False) -> DataFrame:
    """Each triple once; often: one may come very often, so a task's own rows are put together before they are dealt."""
    keys = ["s", "s_kind", "p", "_k"]
    rows = identified(rows)
    return (rows if often else dealt(rows, *keys)).dropDuplicates(keys).drop("_k")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys, to be grouped by them and maybe more.

    A grouping that keeps a whole term, or keys that hardly repeat, would else sort or hold all rows of a task before
    they are dealt, and a small file of mapped rows is one task, however many quads it becomes.
    """
    return rows.repartition(*keys)


def typed(kind: str, lex: str, dt: str, lang: str) -> Column:
    """A term from columns whose datatype varies by row."""
    local = F.when(F.startswith(F.col(dt), F.lit(T.XSD)), F.substring_index(dt, "#", -1))
    is_int = local.isin(*[k for k, v in T.NUMERIC.items() if v == "int"])
    is_float = local.isin(*[k for k, v in T.NUMERIC.items() if v == "float"])
    flag = F.when(F.lower(lex).isin("true", "1"), 1.0).when(F.lower(lex).isin("false", "0"), 0.0)
    num = F.when(is_int | is_float, F.col(lex).try_cast("double")).when(local == "boolean", flag)
    vtype = F.when(F.col(kind) < T.LITERAL, F.lit(None)).when(is_int, "int").when(is_float, "float").when(local == "boolean", "bool").otherwise("str")
    return T.term(F.col(kind), F.col(lex), F.col(dt), F.col(lang), num, vtype)


class MappedGraph:
    """A virtual graph: mappings over DataFrames, read on demand. Mappings come from graphtide.sources.mapping."""

    def __init__(self, spark: SparkSession, mapped: list, functions: dict | None = None):
        self.spark, self.mapped, self.functions = spark, mapped, {**registry.QUERY, **(functions or {})}

    def scan(self, s: str | None = None, p: str | None = None, o=None, g: str | None = None, graphs: bool = False) -> DataFrame:
        parts = []
        for mapping, source in self.mapped:
            if g is not None and mapping.graph != g:
                continue
            for predicate, value in mapping.objects():
                if p is not None and predicate != p:
                    continue
                subject = mapping.subject()
                rows = source
                if s is not None:
                    if not s.startswith(mapping.prefix):
                        continue
                    rows = rows.where(F.trim(F.col(mapping.id_column).cast("string")) == s.removeprefix(mapping.prefix))
                rows = rows.select(F.lit(mapping.graph).alias("g"), subject.alias("s"), F.lit(T.IRI).cast("tinyint").alias("s_kind"), F.lit(predicate).alias("p"), value.alias("o"))
                rows = rows.where("s is not null and o is not null")
                if o is not None:
                    rows = rows.where(T.key(F.col("o")) == T.key(T.constant(o.kind, o.lex, o.dt, o.lang)))
                parts.append(rows)
        if not parts:
            return self.spark.createDataFrame([], QUAD)
        return reduce(DataFrame.unionByName, parts)

    def star(self, predicates: list[str], g: str | None = None) -> DataFrame | None:
        """(g, s, s_kind, o0, o1, ...): the objects of several predicates of one subject, without a join.

        None unless ids are unique, no mapping's ids can be another's, and no mapping has a predicate twice.
        """
        prefixes = [m.prefix for m, _ in self.mapped]
        apart = all(i == j or not b.startswith(a) for i, a in enumerate(prefixes) for j, b in enumerate(prefixes))
        if not apart or not all(m.unique for m, _ in self.mapped):
            return None
        parts = []
        for mapping, source in self.mapped:
            objects = mapping.objects()
            known = [p for p, _ in objects]
            if (g is not None and mapping.graph != g) or not set(predicates) <= set(known):
                continue
            if len(set(known)) < len(known):
                return None
            values = dict(objects)
            rows = source.select(F.lit(mapping.graph).alias("g"), mapping.subject().alias("s"), F.lit(T.IRI).cast("tinyint").alias("s_kind"), *[values[p].alias(f"o{i}") for i, p in enumerate(predicates)])
            parts.append(rows.where("s is not null" + "".join(f" and o{i} is not null" for i in range(len(predicates)))))
        if not parts:
            return self.spark.createDataFrame([], "g string, s string, s_kind tinyint" + "".join(f", o{i} {T.TERM}" for i in range(len(predicates))))
        return reduce(DataFrame.unionByName, parts)

    def query(self, text: str, **options) -> DataFrame:
        from graphtide.plans.sparql import query

        return query(self, text, **options)

    def materialise(self) -> Graph:
        from graphtide.sources.mapping import quads

        return Graph(reduce(DataFrame.unionByName, [quads(m, d) for m, d in self.mapped]), self.functions)
