"""Helpers that the operators share: scratch tables in the cluster's shared folder and ordered prefix sums.

Anything that must be computed once is written to the folder named by ``spark.checkpoint.dir``; it
survives lost executors, and every executor can read it.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The word pattern of the text operators: runs of anything but ASCII white space.
ASCII_SPACE = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(text):
    """Column: A-Z to lower case, nothing else."""
    return F.translate(text, _UPPER, _LOWER)


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


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the rows of a batch that goes to Python, so that a batch of long texts stays small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


class Scratch:
    """Tables of one operator call, in a folder of their own under the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df as Parquet and reads it back."""
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Lets Spark delete the shuffle files of frames that are no longer held, which it does as the driver collects garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, name: str = "") -> None:
        try:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the JVM may be gone at exit
            return


def with_row_ids(df: DataFrame, name: str = "_rid") -> DataFrame:
    """A long per row, unique also among equal rows; write the result before using it twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


def add_fields(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    return T.StructType([*schema.fields, *fields])


# ---------------------------------------------------------------- ordered prefix sums


def _groups(batch: pa.RecordBatch, group: str | None) -> np.ndarray | None:
    return None if group is None else batch.column(batch.schema.get_field_index(group)).to_numpy(zero_copy_only=False)


def _runs(it: Iterator[pa.RecordBatch], group: str | None, weight: str, carry: tuple | None):
    """For each batch: (batch, rows before in the group, weight before in the group); at last the state.

    carry: (group, rows, weight) that earlier partitions hold of the group this partition begins with.
    """
    key, count, total = carry or (None, 0, 0)
    known = carry is not None
    for batch in it:
        n = batch.num_rows
        if not n:
            continue
        w = batch.column(batch.schema.get_field_index(weight)).to_numpy(zero_copy_only=False).astype(np.int64)
        before, idx = np.cumsum(w) - w, np.arange(n)
        g = _groups(batch, group)
        if g is None:
            starts = np.zeros(n, bool)
        else:
            starts = np.empty(n, bool)
            starts[1:] = g[1:] != g[:-1]
            starts[0] = not known or g[0] != key
            key = g[-1]
        known = True
        at = np.maximum.accumulate(np.where(starts, idx, -1))
        inside = at >= 0
        pos = np.where(inside, idx - at, count + idx)
        pre = np.where(inside, before - before[np.maximum(at, 0)], total + before)
        yield batch, pos, pre
        count, total = int(pos[-1]) + 1, int(pre[-1] + w[-1])


def _summary(group: str | None, weight: str) -> Callable:
    def run(it):
        first = last = None
        n_groups = 0
        for batch, pos, pre in _runs(it, group, weight, None):
            g = _groups(batch, group)
            w = batch.column(batch.schema.get_field_index(weight)).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = np.array([""] * batch.num_rows, object) if g is None else g
            starts = np.flatnonzero(pos == 0)
            for start in starts.tolist():
                if start:
                    end = start - 1
                    last = (keys[end], int(pos[end]) + 1, int(pre[end] + w[end]))
                first = first or last  # the group that ends here, if it was the first
                n_groups += 1
            last = (keys[-1], int(pos[-1]) + 1, int(pre[-1] + w[-1]))
        if last:
            first = first or last
            yield pa.RecordBatch.from_pydict(
                {"pid": [TaskContext.get().partitionId()], "groups": [n_groups], "first_key": [first[0]], "first_n": [first[1]], "first_w": [first[2]], "last_key": [last[0]], "last_n": [last[1]], "last_w": [last[2]]},
                schema=pa.schema([("pid", pa.int32()), ("groups", pa.int64()), ("first_key", pa.string()), ("first_n", pa.int64()), ("first_w", pa.int64()), ("last_key", pa.string()), ("last_n", pa.int64()), ("last_w", pa.int64())]),
            )

    return run


def _number(group: str | None, weight: str, carries: dict) -> Callable:
    def run(it):
        carry = carries.get(TaskContext.get().partitionId())
        for batch, pos, pre in _runs(it, group, weight, carry):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pos, pa.int64()), pa.array(pre, pa.int64())], [*batch.schema.names, "_pos", "_before"])

    return run


def ordered_prefix(df: DataFrame, order: list, weight: str, group: str | None = None, partitions: int | None = None) -> tuple[DataFrame, int, int]:
    """Adds ``_pos`` (rows before) and ``_before`` (weight before), both within the group and in the given order.

    Rows are range-partitioned and sorted once and checkpointed; one row of totals for each partition goes
    to the driver, which carries sums over partition borders. So a group may span any number of tasks,
    however many rows it holds. group: name of a string column without nulls. Ties beyond the order are
    broken by the rows' place in the input, which also splits equal rows over tasks. Returns the frame, the
    number of rows and the total weight.
    """
    spark = df.sparkSession
    shared_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*([F.col(group)] if group else []), *order, F.col("_tie")]
    placed = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_tie").checkpoint()
    parts = sorted(placed.mapInArrow(_summary(group, weight), "pid int, groups long, first_key string, first_n long, first_w long, last_key string, last_n long, last_w long").collect(), key=lambda r: r.pid)
    carries, held, rows, total = {}, None, 0, 0
    for p in parts:
        if held:
            carries[p.pid] = held
        if group is None or (held and held[0] == p.first_key and p.groups == 1):
            held = (p.last_key if group else None, (held[1] if held else 0) + p.last_n, (held[2] if held else 0) + p.last_w)
        else:
            held = (p.last_key, p.last_n, p.last_w)
    schema = add_fields(placed.schema, T.StructField("_pos", T.LongType()), T.StructField("_before", T.LongType()))
    out = placed.mapInArrow(_number(group, weight, carries), schema)
    if group is None and held:
        rows, total = held[1], held[2]
    return out, rows, total
