"""Ordered scans and order statistics in which no group, and no table, is one task.

Rows are dealt by ranges of group and order into chunks. Running values are computed within each chunk; what
the chunks before it hold of the same group is carried over as one associative total for each. Only groups
that cross a chunk's border have totals to carry, so at most two rows for each chunk come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .closure import settle

CHUNK = "_chunk"


def chunks(rows: DataFrame, group: list[str], order: list[str | Column], partitions: int | None = None) -> DataFrame:
    """The rows with their chunk's number, in ranges of group and order; equal rows are kept apart by their place."""
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group, *order, "_tie"]
    return settle(rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *keys).withColumn(CHUNK, F.spark_partition_id()))


def within(group: list[str], order: list[str | Column]) -> Window:
    """The window over a chunk's rows of a group up to the present one."""
    return Window.partitionBy(CHUNK, *group).orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, 0)


def carried(totals: DataFrame, group: list[str], start: tuple, step: Callable[[tuple, tuple], tuple]) -> DataFrame:
    """(_chunk, group, before_...): what the chunks before hold of each group that crosses a border.

    totals: a row for each chunk and group, with the columns that step takes; start is the value before the
    first chunk, step(value, total) the value behind one. The result has two rows for each chunk at most.
    """
    values = [c for c in totals.columns if c not in (CHUNK, *group)]
    key = F.struct(*[F.col(c) for c in group]) if group else F.lit(0)
    marked = totals.withColumn("_group", key)
    across = marked.groupBy("_group").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_group")
    state: dict = {}
    out = []
    for r in sorted(marked.join(across, "_group", "left_semi").collect(), key=lambda r: r[CHUNK]):
        g = r["_group"]
        now = state.get(g, start)
        out.append((r[CHUNK], *[r[c] for c in group], *now))
        state[g] = step(now, tuple(r[c] for c in values))
    types = dict(totals.dtypes)
    schema = ", ".join([f"{CHUNK} int", *[f"`{c}` {types[c]}" for c in group], *[f"`before_{c}` {types[c]}" for c in values]])
    return totals.sparkSession.createDataFrame(out, schema)


def with_carry(local: DataFrame, carry: DataFrame, group: list[str]) -> DataFrame:
    """The rows with what is carried into their chunk, null where nothing is."""
    same = reduce(Column.__and__, [local[c].eqNullSafe(carry[c]) for c in [CHUNK, *group]])
    return local.join(F.broadcast(carry), same, "left").drop(*[carry[c] for c in [CHUNK, *group]])


def running_sum(rows: DataFrame, group: list[str], order: list[str | Column], value: str, name: str, partitions: int | None = None) -> DataFrame:
    """With the sum of a column over the rows up to each one in its group; nulls count as nothing.

    Equal places in the order follow each other in any way. An empty table gives no rows.
    """
    local = chunks(rows, group, order, partitions).withColumn(name, F.coalesce(F.sum(value).over(within(group, order)), F.lit(0)))
    kind = dict(local.dtypes)[name]
    totals = local.groupBy(CHUNK, *group).agg(F.coalesce(F.sum(value), F.lit(0)).cast(kind).alias("sum"))
    carry = carried(totals, group, (0.0 if kind == "double" else 0,), lambda now, t: (now[0] + t[0],))
    return with_carry(local, carry, group).withColumn(name, F.col(name) + F.coalesce("before_sum", F.lit(0))).drop("before_sum", CHUNK, "_tie")


def average_rank(rows: DataFrame, column: str, name: str, by: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """With ranks from 1, in each group of by; equal values share their mean rank, nulls come first.

    Values are counted before they are put in order, so a value that holds most of the rows is one row in the scan.
    """
    by = by or []
    counts = rows.groupBy(*by, F.col(column)).agg(F.count(F.lit(1)).alias("_n"))
    places = running_sum(counts, by, [column], "_n", "_last", partitions).select(*by, column, (F.col("_last") - (F.col("_n") - 1) / 2).alias(name))
    right = places.select(*[F.col(c).alias(f"_r_{c}") for c in [*by, column]], name)
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in [*by, column]])
    return rows.join(right, same).drop(*[f"_r_{c}" for c in [*by, column]])


def at_places(rows: DataFrame, by: list[str], column: str, places: dict[str, Callable[[Column], Column]], partitions: int | None = None) -> DataFrame:
    """(by, a column for each place): exact order statistics; a place is a function from the group's count of
    values to an index from 0. Nulls are left out, groups without a value have no row."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(*by, F.col(column)).agg(F.count(F.lit(1)).alias("_n"))
    ordered = settle(running_sum(counts, by, [column], "_n", "_last", partitions))
    sizes = ordered.groupBy(*by).agg(F.sum("_n").alias("_all"))
    right = sizes.select(*[F.col(c).alias(f"_r_{c}") for c in by], "_all")
    both = ordered.join(right, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in by], F.lit(True)))
    holds = {name: (f(F.col("_all")) < F.col("_last")) & (f(F.col("_all")) >= F.col("_last") - F.col("_n")) for name, f in places.items()}
    hit = both.where(reduce(Column.__or__, holds.values()))
    return hit.groupBy(*by).agg(*[F.max(F.when(c, F.col(column))).alias(name) for name, c in holds.items()])
