"""Declarative mappings from tables and CSV files to quads."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtide.functions import terms as T

#: Column types of a mapping and the datatype of each; "iri" columns become IRIs.
DATATYPES = {"string": "string", "float": "double", "integer": "integer", "boolean": "boolean"}


@dataclass
class Mapping:
    """One table's mapping: a class, an id column, and a predicate with a type for each mapped column.

    unique: the id column has no value twice; then patterns on one subject are read in one scan.
    """

    cls: str
    id_column: str
    prefix: str
    graph: str = "default"
    csv: str | None = None
    columns: dict[str, dict] = field(default_factory=dict)
    unique: bool = False

    @classmethod
    def parse(cls, spec: dict) -> Mapping:
        prefixes = spec.get("prefixes") or {}

        def expand(name: str) -> str:
            head, _, local = name.partition(":")
            return name if name.startswith(("http://", "https://")) or head not in prefixes else prefixes[head] + local

        columns = {}
        for name, c in (spec.get("columns") or {}).items():
            kind = c.get("type", "string")
            if kind not in (*DATATYPES, "iri"):
                raise ValueError(f"column {name}: unknown type {kind!r}")
            columns[name] = {"predicate": expand(c["predicate"]), "type": kind, "iri_prefix": expand(c.get("iri_prefix") or "")}
        entity = spec["entity"]
        return cls(expand(entity["class"]), entity["id_column"], expand(entity.get("id_prefix") or ""), expand(spec.get("target_graph") or "default"), spec.get("csv"), columns, bool(entity.get("unique", False)))

    @classmethod
    def load(cls, path: str) -> Mapping:
        import yaml

        return cls.parse(yaml.safe_load(Path(path).read_text()))

    def subject(self) -> Column:
        """The row's IRI, null for a blank id."""
        raw = F.trim(F.col(f"`{self.id_column}`").cast("string"))
        return F.when(raw != "", F.concat(F.lit(self.prefix), raw))

    def value(self, name: str) -> Column:
        """The column's term; null for blanks and for what its type can't hold."""
        c = self.columns[name]
        raw = F.trim(F.col(f"`{name}`").cast("string"))
        raw = F.when(raw != "", raw)
        kind = c["type"]
        if kind == "iri":
            return T.iri(F.concat(F.lit(c["iri_prefix"]), raw))
        if kind == "boolean":
            flag = F.when(F.lower(raw).isin("1", "true", "yes"), "true").when(F.lower(raw).isin("0", "false", "no"), "false")
            return T.literal(flag, T.XSD + "boolean")
        if kind == "integer":
            return T.literal(F.when(raw.try_cast("double") == F.floor(raw.try_cast("double")), raw), T.XSD + "integer")
        if kind == "float":
            return T.literal(F.when(raw.try_cast("double").isNotNull(), raw), T.XSD + "double")
        return T.literal(raw, T.XSD + "string")

    def objects(self) -> list[tuple[str, Column]]:
        """(predicate, term) of each triple of a row, the type first."""
        return [(T.TYPE, T.term(T.IRI, F.lit(self.cls))), *[(c["predicate"], self.value(n)) for n, c in self.columns.items()]]

    def broken(self) -> Column:
        """Whether a column has a value that its type can't hold."""
        bad = F.lit(False)
        for n in self.columns:
            raw = F.trim(F.col(f"`{n}`").cast("string"))
            bad = bad | ((F.coalesce(raw, F.lit("")) != "") & self.value(n).isNull())
        return bad


def load_all(folder: str) -> list[Mapping]:
    return [Mapping.load(str(p)) for p in sorted(Path(folder).glob("*.y*ml"))]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def quads(mapping: Mapping, source: DataFrame, strict: bool = False) -> DataFrame:
    """The quads of a table: one narrow pass that unpivots the mapped columns.

    A row with a blank id gives nothing; a row with a value that its column's type can't hold gives nothing
    either, or, if strict, an error.
    """
    rows = source
    if strict:
        rows = rows.where(F.when(mapping.broken(), F.raise_error(F.lit("a value does not fit its column's type"))).otherwise(F.lit(True)))
    else:
        rows = rows.where(~mapping.broken())
    made = F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in mapping.objects()])
    rows = rows.select(F.lit(mapping.graph).alias("g"), mapping.subject().alias("s"), F.lit(T.IRI).cast("tinyint").alias("s_kind"), F.explode(made).alias("t"))
    return rows.where("s is not null and t.o is not null").select("g", "s", "s_kind", "t.p", "t.o")


def report(mapping: Mapping, source: DataFrame) -> DataFrame:
    """One row: rows read, rows ingested, rows without an id, rows with a broken value, triples made."""
    blank, bad = mapping.subject().isNull(), mapping.broken()
    ok = ~blank & ~bad
    made = F.lit(0)
    for _, o in mapping.objects():
        made = made + o.isNotNull().cast("int")
    return source.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(ok).alias("n_ingested"), F.count_if(blank).alias("n_no_id"), F.count_if(~blank & bad).alias("n_errors"), F.coalesce(F.sum(F.when(ok, made)), F.lit(0)).cast("long").alias("n_triples")
    )
