"""Contiguous shards of near equal bytes, cut from global prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ordered_prefix


def balanced_shards(rows: DataFrame, n_shards: int, size: Column, order: list[Column]) -> DataFrame:
    """Adds ``size``, ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in each shard) to the rows.

    In the given order, a row goes to the shard that the middle of its bytes falls into when all bytes are
    cut at n_shards equal targets; so shards are contiguous and differ from the target by less than one
    row's size. Per-partition totals are all that the driver sees.

    Null order keys come first; equal rows are kept apart by their place in the input. A null size counts
    as 0. An empty table gives an empty result; more shards than rows leaves shards empty. Columns of the
    input named size, shard or slot are replaced.
    """
    light = rows.drop("shard", "slot").withColumn("size", F.coalesce(size.cast("long"), F.lit(0)))
    numbered, _, total = ordered_prefix(light, order, "size")
    middle = F.expr(f"(_before * 2 + size) * {n_shards}L div {max(2 * total, 1)}L")
    shard = F.least(middle, F.lit(n_shards - 1)).cast("int")
    placed = numbered.withColumn("shard", shard)
    starts = {r.shard: r.start for r in placed.groupBy("shard").agg(F.min("_pos").alias("start")).collect()}
    start = F.element_at(F.array(*[F.lit(starts.get(k, 0)).cast("long") for k in range(n_shards)]), F.col("shard") + 1)
    return placed.withColumn("slot", F.col("_pos") - start).drop("_pos", "_before")


def shard_documents(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """Shards documents in doc_id order by UTF-8 bytes of the text plus 8.

    Null texts count as empty: size 8, checksum 0. Rows with a null doc_id come first.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = balanced_shards(rows, n_shards, F.col("size"), [F.col("doc_id").asc_nulls_first(), F.col("text_crc32")])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 24) -> None:
    """Writes whole rows in one folder per shard, in slot order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = balanced_shards(docs, n_shards, F.octet_length(text) + 8, [F.col("doc_id").asc_nulls_first(), F.crc32(text)])
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
