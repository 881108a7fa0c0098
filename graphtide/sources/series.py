"""Time series: import from CSV, filling of gaps, merging, export."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UNITS = {"hours": 3600.0, "days": 86400.0, "seconds": 1.0}


def long(table: DataFrame, time_unit: str = "hours") -> DataFrame:
    """(var, t, value) of a table whose first column is time, as numbers or ISO times; what is no number is null.

    ISO times count from the first row's in the unit.
    """
    time, *variables = table.columns
    raw = F.trim(F.col(f"`{time}`").cast("string"))
    number, stamp = raw.try_cast("double"), F.unix_micros(raw.try_cast("timestamp")) / 1e6
    is_number = table.select(F.min(number.isNotNull().cast("int"))).first()[0] == 1
    if is_number:
        t = number
    else:
        first = table.select(F.min(stamp)).first()[0]
        t = (stamp - F.lit(first)) / UNITS[time_unit]
    pairs = F.explode(F.array(*[F.struct(F.lit(v.strip().replace(" ", "_")).alias("var"), F.trim(F.col(f"`{v}`").cast("string")).try_cast("double").alias("value")) for v in variables]))
    return table.select(t.alias("t"), pairs.alias("x")).select("x.var", "t", "x.value")


def read(spark: SparkSession, path: str, fill: str | None = "forward", time_unit: str = "hours") -> DataFrame:
    rows = long(spark.read.option("header", True).csv(path), time_unit)
    return filled(rows, fill) if fill else rows


def filled(series: DataFrame, how: str = "forward") -> DataFrame:
    """Without gaps: forward (leading gaps take the first value), interpolate (linear in t, ends held) or zero.

    A variable without any value becomes 0.
    """
    if how == "zero":
        return series.withColumn("value", F.coalesce("value", F.lit(0.0)))
    # The next point is the last one before it in falling order: frames that only grow are linear.
    before = Window.partitionBy("var").orderBy("t", "value").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("var").orderBy(F.desc("t"), "value").rowsBetween(Window.unboundedPreceding, 0)
    point = F.when(F.col("value").isNotNull(), F.struct(F.col("t").alias("t"), F.col("value").alias("v")))
    rows = series.withColumn("_l", F.last(point, True).over(before)).withColumn("_r", F.last(point, True).over(after))
    held = F.coalesce(F.col("_l.v"), F.col("_r.v"), F.lit(0.0))
    if how == "forward":
        return rows.withColumn("value", held).drop("_l", "_r")
    if how != "interpolate":
        raise ValueError(f"unknown fill {how!r}")
    share = F.try_divide(F.col("t") - F.col("_l.t"), F.col("_r.t") - F.col("_l.t"))
    mixed = F.col("_l.v") + (F.col("_r.v") - F.col("_l.v")) * share
    return rows.withColumn("value", F.coalesce("value", mixed, held)).drop("_l", "_r")


def merge(tables: list[DataFrame]) -> DataFrame:
    """The union of series; a variable in two of them is an error."""
    seen: set[str] = set()
    for t in tables:
        own = {r[0] for r in t.select("var").distinct().collect()}
        if own & seen:
            raise ValueError(f"variables given twice: {sorted(own & seen)}")
        seen |= own
    return reduce(DataFrame.unionByName, tables)


def export(wide: DataFrame, path: str) -> None:
    """CSV files with headers, in ranges of time: the files' order by name is that of time."""
    wide.orderBy("time").write.mode("overwrite").option("header", True).csv(path)
