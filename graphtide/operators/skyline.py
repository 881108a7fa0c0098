"""Fronts of any number of objectives, without comparing all pairs.

Every partition first drops what its own rows dominate. The objectives' space is cut into a grid; a cell all of
whose coordinates are above another occupied cell's is dominated whole. What is left in a cell can only be
dominated from cells that are no higher in any coordinate: their points are sent there, and each cell takes its
rows in lexical order, in which a point comes behind all that dominate it.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .closure import settle

#: Cells of the grid at most; so many numbers come to the driver.
CELLS = 1000
_BLOCK = 512


def _undominated(front: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which rows of x, distinct and in lexical order, no row of the front and no other row of x is below or equal to."""
    keep = np.ones(len(x), bool)
    for at in range(0, len(front), _BLOCK):
        left = np.flatnonzero(keep)
        keep[left[(front[at : at + _BLOCK, None, :] <= x[None, left, :]).all(2).any(0)]] = False
    left = np.flatnonzero(keep)
    y = x[left]
    below = (y[:, None, :] <= y[None, :, :]).all(2)
    np.fill_diagonal(below, False)
    keep[left[below.any(0)]] = False
    return keep


def _front(width: int, grouped: bool):
    """Streams sorted rows (cell, own, objectives) and passes on those that no row before them in the cell dominates."""

    def run(batches):
        cell, front = None, np.empty((0, width))
        for batch in batches:
            cells = batch.column(0).to_numpy()
            own = batch.column(1).to_numpy(zero_copy_only=False)
            x = np.stack([batch.column(2 + i).to_numpy() for i in range(width)], axis=1)
            cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(x)]
            kept = np.zeros(len(x), bool)
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b and cells[a] != cell:
                    cell, front = cells[a], np.empty((0, width))
                for at in range(a, b, _BLOCK):
                    block = slice(at, min(at + _BLOCK, b))
                    keep = _undominated(front, x[block])
                    kept[block] = keep
                    front = np.concatenate([front, x[block][keep]])
            if (kept & own).any():
                yield batch.filter(pa.array(kept & own))

    return run


def skyline(rows: DataFrame, objectives: list[str]) -> DataFrame:
    """Rows that none is at least as good as in all objectives (smaller is better) and better in one.

    Rows with equal objectives stand or fall together. A null or NaN objective compares with nothing: such rows
    stay and dominate none. An empty table gives no rows; columns of any other name are kept.
    """
    names = [f"_x{i}" for i in range(len(objectives))]
    real = reduce(Column.__and__, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in objectives])
    points = rows.where(real).select(*[F.col(c).cast("double").alias(n) for c, n in zip(objectives, names, strict=True)]).distinct()
    schema = "cell int, own boolean, " + ", ".join(f"{n} double" for n in names)
    flat = points.select(F.lit(0).alias("cell"), F.lit(True).alias("own"), *names)
    # Each partition's own front, whatever lies in it.
    local = settle(flat.sortWithinPartitions(*names).mapInArrow(_front(len(names), False), schema))

    per = max(2, int(CELLS ** (1 / len(names)) + 1e-9))
    cuts = local.agg(*[F.percentile_approx(n, [k / per for k in range(1, per)]).alias(n) for n in names]).first()
    place = [reduce(Column.__add__, [(F.col(n) > F.lit(v)).cast("int") for v in sorted(set(cuts[n]))]) if cuts[n] else F.lit(0) for n in names]
    coded = settle(local.withColumn("cell", reduce(lambda a, b: a * per + b, place).cast("int")))
    cells = np.array(sorted(r.cell for r in coded.select("cell").distinct().collect()), int)
    at = np.stack([cells // per ** (len(names) - 1 - i) % per for i in range(len(names))], axis=1) if len(cells) else np.empty((0, len(names)), int)
    alive = np.array([not (at < c).all(1).any() for c in at], bool)
    sent = [(int(a), [int(b) for b, cb, ok in zip(cells, at, alive, strict=True) if ok and (ca <= cb).all()]) for a, ca in zip(cells, at, strict=True)]
    targets = rows.sparkSession.createDataFrame(sent, "_from int, _to array<int>")
    met = coded.join(F.broadcast(targets), F.col("cell") == F.col("_from")).select(F.explode("_to").alias("_cell"), (F.col("_cell") == F.col("_from")).alias("own"), *names).withColumnRenamed("_cell", "cell")
    front = met.repartition("cell").sortWithinPartitions("cell", *names).mapInArrow(_front(len(names), True), schema).select(*names)
    same = reduce(Column.__and__, [F.col(c).cast("double") == F.col(n) for c, n in zip(objectives, names, strict=True)])
    return rows.where(real).join(front, same, "left_semi").unionByName(rows.where(~F.coalesce(real, F.lit(False))))
