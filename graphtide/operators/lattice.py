"""The built-in types, and edges judged by where their types stand in a lattice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .inference import Lattice

# The built-in types, children by parent; MATERIAL is an interaction, not a resource.
ROOTS = ["BLOB", "OBSERVATION", "INTERACTION", "STRUCTURAL"]
CHILDREN = {
    "BLOB": ["AGENT", "PROCESS", "RESOURCE", "GOAL", "CONSTRAINT", "STATE", "PROPERTY"],
    "AGENT": ["PERSON", "ORGANIZATION", "SYSTEM"],
    "PROCESS": ["ACTION", "EVENT", "TRANSFORMATION"],
    "RESOURCE": ["INFORMATION", "ENERGY"],
    "GOAL": ["INTENTION", "REQUIREMENT"],
    "CONSTRAINT": ["RULE", "REGULATION", "LIMITATION"],
    "STATE": ["CONDITION", "STATUS"],
    "PROPERTY": ["QUALITY", "QUANTITY"],
    "OBSERVATION": ["SIMULATION_OBSERVATION"],
    "INTERACTION": ["CAUSAL", "INFORMATIONAL", "MATERIAL"],
    "CAUSAL": ["CAUSES", "ENABLES", "DEPENDS", "PREVENTS"],
    "INFORMATIONAL": ["COMMUNICATED", "SUPPORTS", "ATTACKS", "CONTRADICTS"],
    "MATERIAL": ["FLOWS_TO", "PRODUCES", "CONSUMES", "TRANSFORMS"],
    "STRUCTURAL": ["MERONYMIC", "SPATIAL", "TAXONOMIC"],
    "MERONYMIC": ["PART_OF", "HAS_ATTRIBUTE"],
    "SPATIAL": ["LOCATED_AT", "EMPLOYED_BY"],
    "TAXONOMIC": ["IS_A", "INSTANCE_OF"],
}
TRANSITIVE = ["CAUSES", "DEPENDS", "PART_OF", "IS_A"]
SYMMETRIC = ["CONTRADICTS"]


def built_in(spark: SparkSession) -> Lattice:
    """The lattice of the built-in types, with their properties transitive and symmetric."""
    parents = [(r, None) for r in ROOTS] + [(c, p) for p, below in CHILDREN.items() for c in below]
    rows = [(name, parent, {"transitive": name in TRANSITIVE, "symmetric": name in SYMMETRIC}) for name, parent in parents]
    return Lattice(spark.createDataFrame(rows, "name string, parent string, properties map<string, boolean>"))


def at_or_below(lattice: Lattice) -> DataFrame:
    """(a, b): b is a itself or an ancestor of it."""
    own = lattice.types.select(F.col("name").alias("a"), F.col("name").alias("b")).where("a is not null")
    return own.union(lattice.above.select("a", "b")).distinct()


def rolled_up(rows: DataFrame, lattice: Lattice, column: str, measures: dict) -> DataFrame:
    """(type, measures): aggregates of the rows of each type and of all types below it.

    measures: name -> (an aggregate by type, how such parts are put together), as (F.count(...), F.sum). Rows are
    aggregated by their own type before they meet the lattice, so a type that holds most of them is one row there.
    Rows of unknown or null type count nowhere; types without rows don't come.
    """
    parts = rows.groupBy(F.col(column).alias("a")).agg(*[f.alias(n) for n, (f, _) in measures.items()])
    return parts.join(at_or_below(lattice), "a").groupBy(F.col("b").alias("type")).agg(*[put(n).alias(n) for n, (_, put) in measures.items()])


def judged(edges: DataFrame, lattice: Lattice, limits: DataFrame) -> DataFrame:
    """Edges (source_type, edge_type, target_type, ...) with ``valid``.

    Valid are those whose three types are in the lattice, the source at or below the edge type's domain and the
    target at or below its range, where limits (edge_type, domain, range) state them; a null states nothing, and
    several rows for an edge type must all hold. Each combination of types is judged once and joined back.
    """
    kinds = ["source_type", "edge_type", "target_type"]
    below, known = at_or_below(lattice), lattice.types.select("name").where("name is not null").distinct()
    asked = edges.select(*kinds).na.drop().distinct()
    for c in kinds:
        asked = asked.join(known.withColumnRenamed("name", c), c, "left_semi")
    stated = asked.join(limits.select("edge_type", "domain", "range"), "edge_type", "left")
    for c, limit in (("source_type", "domain"), ("target_type", "range")):
        stands = below.select(F.col("a").alias(c), F.col("b").alias(limit), F.lit(True).alias(f"_{limit}"))
        stated = stated.join(stands, [c, limit], "left").withColumn(f"_{limit}", F.col(limit).isNull() | F.coalesce(f"_{limit}", F.lit(False)))
    good = stated.groupBy(*kinds).agg(F.min((F.col("_domain") & F.col("_range")).cast("int")).alias("_good"))
    return edges.join(good, kinds, "left").withColumn("valid", F.coalesce(F.col("_good") == 1, F.lit(False))).drop("_good")
