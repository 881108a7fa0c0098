"""Nearest neighbours by inner product with balanced posting lists.

Vectors get one more component that makes all of them equally long, so the largest inner product is the
smallest distance. Centroids are fitted on a bounded sample with a penalty on full clusters and linked into
a neighbour graph that each worker holds. Every vector goes to the lists of its nearest centroid and of the
others that are about as near, so a vector near borders is in several lists. A query walks the graph and
searches the lists whose centroids are within a ratio of its nearest one's distance (of the median nearest
distance, if that is larger: a query that sits on a centroid has neighbours elsewhere too). The
ratio is calibrated: some queries are answered by brute force over all rows, and it is the smallest that
finds the wanted share of their answers.

Lists are dealt to bins, neighbouring ones together; a vector or a query goes to a bin once, with its lists
there. Lists longer than a bin's share are cut into parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches

#: Bounds of what is fitted, and the rows of a list and of a bin that are aimed at.
SAMPLE, MOST_LISTS, LIST_ROWS, BIN_POSTS, PROBE_QUERIES = 16_384, 8_192, 8, 1 << 16, 256
#: Lists that a vector is in at most, and how much farther than the nearest centroid theirs may be.
REPLICAS, BORDER = 8, 1.2
#: How much beyond its ratio a query walks, so as not to miss lists that only farther ones lead to.
SLACK = 1.02
_IDS = "array<long>"


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


class CentroidGraph:
    """Centroids and, for each, its nearest others and a few far ones."""

    def __init__(self, points: np.ndarray, others: np.ndarray, degree: int = 24, seed: int = 5):
        self.points = points = points.astype(np.float32)
        n = len(points)
        near = []
        for start in range(0, n, 1024):
            d = _squares(points[start : start + 1024], points)
            d[np.arange(len(d)), np.arange(start, start + len(d))] = np.inf
            count = min(degree, max(n - 1, 1))
            near.append(np.argpartition(d, min(count, n - 1) - 1 if n > 1 else 0, axis=1)[:, :count])
        near = np.concatenate(near) if n > 1 else np.zeros((1, 1), int)
        # Links back, so that every centroid can be reached from those it is near to.
        to, at = near.ravel(), np.repeat(np.arange(n), near.shape[1])
        order = np.argsort(to, kind="stable")
        to, at = to[order], at[order]
        count = np.bincount(to, minlength=n)
        nth = np.arange(len(to)) - (np.cumsum(count) - count)[to]
        back = np.random.default_rng(seed).integers(0, n, (n, degree))  # far ones, where there are fewer
        back[to[nth < degree], nth[nth < degree]] = at[nth < degree]
        self.edges = np.concatenate((near, back), axis=1)
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 32)).astype(int))
        #: The least distance that a ratio is taken of: the median nearest one of vectors that fitted no centroid.
        self.floor = 0.0
        self.floor = float(np.median(self.search(others[:1024], 32)[1][:, 0]))

    def search(self, queries: np.ndarray, beam: int, ratio: float = 0.0, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """For each query the centroids reached and their distances, nearest first, padded with infinity.

        Best-first: in each round a query expands its nearest unexpanded centroids, as long as they are among
        its beam nearest or within ratio times its nearest distance. Only reached centroids are measured.
        """
        queries = queries.astype(np.float32)
        b, n = len(queries), len(self.points)
        seen = np.full((b, n), -1, np.int32)
        ids = np.tile(self.entries, (b, 1))
        seen[:, self.entries] = 0
        dist = np.sqrt(_squares(queries, self.points[self.entries]))
        done = np.zeros(ids.shape, bool)
        count = 0
        order = np.argsort(dist, axis=1)
        ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        live = np.arange(b)
        while len(live):
            k = min(beam, dist.shape[1]) - 1
            most = np.maximum(dist[live, k], np.maximum(dist[live, 0], self.floor) * ratio if ratio else 0)
            open_ = ~done[live] & (dist[live] <= most[:, None]) & np.isfinite(dist[live])
            go = open_.any(axis=1)
            live, open_ = live[go], open_[go]
            if not len(live):
                break
            pick = open_ & (np.cumsum(open_, axis=1) <= step)
            which, at = np.nonzero(pick)
            rows = live[which]
            done[rows, at] = True
            cols = self.edges[ids[rows, at]]
            owner, cols = np.repeat(rows, cols.shape[1]), cols.ravel()
            fresh = seen[owner, cols] < 0
            owner, cols = owner[fresh], cols[fresh]
            stamp = np.arange(count + 1, count + 1 + len(owner), dtype=np.int32)
            seen[owner, cols] = stamp
            once = seen[owner, cols] == stamp  # of a centroid met twice in a round the last
            count += len(owner)
            owner, cols = owner[once], cols[once]
            diff = queries[owner] - self.points[cols]
            found = np.sqrt(np.einsum("ij,ij->i", diff, diff))
            # Only what can be expanded or returned is held.
            fits = found <= np.maximum(dist[owner, k], np.maximum(dist[owner, 0], self.floor) * ratio if ratio else 0)
            owner, cols, found = owner[fits], cols[fits], found[fits]
            width = np.bincount(owner, minlength=b)
            if not width.any():
                continue
            starts = np.cumsum(width) - width
            place = np.arange(len(owner)) - starts[owner]  # owners rise within a round
            more = np.full((b, int(width.max())), np.inf, np.float32)
            more_ids = np.zeros(more.shape, ids.dtype)
            more[owner, place], more_ids[owner, place] = found, cols
            ids, dist, done = np.concatenate((ids, more_ids), 1), np.concatenate((dist, more), 1), np.concatenate((done, np.zeros(more.shape, bool)), 1)
            order = np.argsort(dist, axis=1, kind="stable")
            ids, dist, done = (np.take_along_axis(x, order, 1) for x in (ids, dist, done))
            # What is beyond the beam and the ratio now for every query goes.
            k = min(beam, dist.shape[1]) - 1
            need = (dist <= np.maximum(dist[:, k], np.maximum(dist[:, 0], self.floor) * ratio if ratio else 0)[:, None]) & np.isfinite(dist)
            keep = max(int(need.sum(axis=1).max()), k + 1)
            ids, dist, done = ids[:, :keep], dist[:, :keep], done[:, :keep]
        return ids, dist

    def lists(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists that each vector is put in."""
        rows, lists = [], []
        for start in range(0, len(x), 512):
            ids, d = self.search(x[start : start + 512], 32)
            keep = d[:, :REPLICAS] <= BORDER * np.maximum(d[:, :1], self.floor)
            keep[:, 0] = True
            r, at = np.nonzero(keep)
            rows.append(r + start)
            lists.append(ids[r, at])
        return np.concatenate(rows), np.concatenate(lists)

    def probed(self, x: np.ndarray, ratio: float, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists that each query searches: those within the ratio, and more of the nearest
        ones where these hold less than ``least`` posts."""
        rows, lists = [], []
        for start in range(0, len(x), 256):
            beam = 64
            while True:
                ids, d = self.search(x[start : start + 256], beam, ratio * SLACK)
                posts = np.where(np.isfinite(d), sizes[ids], 0)
                before = np.cumsum(posts, axis=1) - posts
                if beam >= len(sizes) or (before[:, -1] + posts[:, -1] >= min(least, sizes.sum())).all():
                    break
                beam *= 2
            r, at = np.nonzero(np.isfinite(d) & ((d <= ratio * np.maximum(d[:, :1], self.floor) + 1e-6) | (before < least)))
            rows.append(r + start)
            lists.append(ids[r, at])
        return np.concatenate(rows), np.concatenate(lists)


def balanced_centroids(sample: np.ndarray, k: int, rounds: int = 3, seed: int = 11) -> np.ndarray:
    """k-means on the sample, whose vectors are equally long, as the centroids are made to be.

    A full cluster's distances grow with its size, so clusters come out near equal.
    """
    rng = np.random.default_rng(seed)
    sample = sample.astype(np.float32)
    radius = np.sqrt((sample * sample).sum(axis=1).max())
    centers = sample[rng.choice(len(sample), k, replace=False)].copy()
    sizes = np.full(k, len(sample) / k)
    for _ in range(rounds):
        penalty = (1 + 0.3 * (sizes * k / len(sample) - 1)).clip(0.5, 4).astype(np.float32)[None]
        own = np.concatenate([(_squares(sample[s : s + 1024], centers) * penalty).argmin(axis=1) for s in range(0, len(sample), 1024)])
        sizes = 0.5 * sizes + 0.5 * np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        full = np.bincount(own, minlength=k)
        there = np.flatnonzero(full)
        sums = np.zeros_like(centers)
        sums[there] = np.add.reduceat(sample[order], (np.cumsum(full) - full)[there], axis=0)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centers = np.where(length > 0, sums * radius / np.maximum(length, 1e-30), sample[rng.integers(0, len(sample), k)])
    return centers


def _neighbourly(points: np.ndarray) -> np.ndarray:
    """An order of the points that keeps near ones together: halves along the widest component, again and again."""

    def split(at):
        if len(at) <= 2:
            return at
        x = points[at]
        at = at[np.argsort(x[:, x.var(axis=0).argmax()], kind="stable")]
        return np.concatenate((split(at[: len(at) // 2]), split(at[len(at) // 2 :])))

    return split(np.arange(len(points)))


class Bins:
    """Which bins hold the parts of each list."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, least: int):
        self.sizes = sizes
        total = max(int(sizes.sum()), 1)
        self.n = max(least, -(-total // BIN_POSTS))
        share = -(-total // self.n)
        self.parts = np.maximum(1, -(-sizes // share))
        order = _neighbourly(points)
        piece = np.repeat(sizes[order] / self.parts[order], self.parts[order])
        bins = np.minimum((np.cumsum(piece) - piece) * self.n // total, self.n - 1).astype(np.int64)
        starts = np.empty(len(sizes), np.int64)
        starts[order] = np.cumsum(self.parts[order]) - self.parts[order]
        self.starts, self.bins = starts, bins

    def of_posts(self, lists: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return self.bins[self.starts[lists] + salt % self.parts[lists]]

    def of_probes(self, rows: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = self.parts[lists]
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        return np.repeat(rows, parts), np.repeat(lists, parts), self.bins[np.repeat(self.starts[lists], parts) + nth]


def _grouped(rows: np.ndarray, bins: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """One (row, bin) each, with its lists."""
    order = np.lexsort((lists, bins, rows))
    rows, bins, lists = rows[order], bins[order], lists[order]
    first = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (bins[1:] != bins[:-1])))) if len(rows) else np.empty(0, int)
    ends = pa.array(np.append(first, len(rows)), pa.int32())
    return rows[first], bins[first], pa.ListArray.from_arrays(ends, pa.array(lists, pa.int32()))


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vector) -> (id, vec, norm), each once per batch; -0 counts as 0."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_pylist()
        flat = batch.column(1).flatten().to_numpy().astype(np.float64) + 0.0
        offsets = np.concatenate(([0], np.cumsum(batch.column(1).value_lengths().to_numpy())))
        once = {(i, flat[a:b].tobytes()): None for i, a, b in zip(ids, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)}
        norms = [float(np.sqrt(np.square(np.frombuffer(v)).sum())) for _, v in once]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in once], pa.int64()), pa.array([v for _, v in once], pa.binary()), pa.array(norms)], ["id", "vec", "norm"])


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist())).reshape(len(column), -1)


def _lifted(x: np.ndarray, radius: float) -> np.ndarray:
    return np.concatenate((x, np.sqrt(np.maximum(radius * radius - (x * x).sum(1), 0))[:, None]), axis=1)


def _asking(x: np.ndarray, radius: float) -> np.ndarray:
    """Queries made as long as the lifted vectors, which changes no order."""
    return np.concatenate((x * (radius / np.sqrt((x * x).sum(1)))[:, None], np.zeros((len(x), 1))), axis=1)


def _post(graph, radius: float):
    """(vid, vec, ids) -> the same with the vector's lists."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, lists = graph.value.lists(_lifted(_matrix(batch.column(1)), radius))
            ends = pa.array(np.searchsorted(rows, np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(lists, pa.int32()))], [*batch.schema.names, "lists"])

    return run


_ROWS = "bin int, kind int, lists array<int>, qid long, vid long, vec binary, ids array<long>"
_NAMES = [x.split()[0] for x in _ROWS.split(", ")]


def _deal(shipped):
    """(vid, vec, ids, lists) -> a row for each bin."""

    def run(batches):
        bins = shipped.value
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(3)
            rows = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            flat, vid = lists.flatten().to_numpy(), batch.column(0).to_numpy()
            at, where, own = _grouped(rows, bins.of_posts(flat, vid[rows] & 0xFFFFFF), flat)
            take = pa.array(at)
            n = len(at)
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array([0] * n, pa.int32()), own, pa.nulls(n, pa.int64()), batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take)], _NAMES)

    return run


def _probe(graph, shipped, radius: float, ratio: float, k: int):
    """(id, vid, vec) of queries -> a row for each bin that holds a list to be searched."""

    def run(batches):
        bins = shipped.value
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, lists = graph.value.probed(_asking(_matrix(batch.column(2)), radius), ratio, bins.sizes, (k + 1) * REPLICAS)
            rows, lists, where = bins.of_probes(rows, lists)
            at, where, own = _grouped(rows, where, lists)
            take = pa.array(at)
            n = len(at)
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array([1] * n, pa.int32()), own, batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), pa.nulls(n, pa.list_(pa.int64()))], _NAMES)

    return run


class _Bin:
    """The vectors of a bin and the rows of each list."""

    def __init__(self, batches: list[pa.RecordBatch]):
        self.x = np.concatenate([_matrix(b.column(5)) for b in batches])
        self.vid = np.concatenate([b.column(4).to_numpy() for b in batches])
        self.ids = [i for b in batches for i in b.column(6).to_pylist()]
        lengths = np.concatenate([b.column(2).value_lengths().to_numpy() for b in batches])
        lists, rows = np.concatenate([b.column(2).flatten().to_numpy() for b in batches]), np.repeat(np.arange(len(self.vid)), lengths)
        order = np.argsort(lists, kind="stable")
        self.names, starts = np.unique(lists[order], return_index=True)
        self.rows = np.split(rows[order], starts[1:])

    def search(self, batch: pa.RecordBatch, k: int) -> pa.RecordBatch | None:
        """Each query's k nearest rows of its lists here."""
        q, lists = _matrix(batch.column(5)), batch.column(2)
        who = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
        at = np.searchsorted(self.names, flat := lists.flatten().to_numpy())
        there = (at < len(self.names)) & (self.names[np.minimum(at, len(self.names) - 1)] == flat)
        who, at = who[there], at[there]
        order = np.argsort(at, kind="stable")
        who, at = who[order], at[order]
        return self._top(batch, q, who, at, k)

    def _top(self, batch, q, who, at, k):
        qs, rs, ss = [], [], []
        borders = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1, [len(at)])) if len(at) else [0]
        for a, b in zip(borders[:-1], borders[1:], strict=True):
            rows, asked = self.rows[at[a]], who[a:b]
            score = q[asked] @ self.x[rows].T
            if len(rows) > 4 * (k + 1):
                least = np.partition(score, len(rows) - k - 1, axis=1)[:, len(rows) - k - 1]
                i, j = np.nonzero(score >= least[:, None] - 1e-9)
            else:
                i, j = np.divmod(np.arange(score.size), len(rows))
            qs.append(asked[i])
            rs.append(rows[j])
            ss.append(score[i, j])
        if not qs:
            return None
        qs, rs, ss = np.concatenate(qs), np.concatenate(rs), np.concatenate(ss)
        key, first = np.unique(qs * len(self.vid) + rs, return_index=True)
        qs, rs, ss = qs[first], rs[first], ss[first]
        order = np.lexsort((-ss, qs))
        qs, rs, ss = qs[order], rs[order], ss[order]
        count = np.bincount(qs, minlength=batch.num_rows)
        starts = np.cumsum(count) - count
        # Ties with the last come along: among equal scores ids decide. One more, for the query's own row.
        last = ss[np.minimum(starts + k, starts + np.maximum(count, 1) - 1).clip(0, len(ss) - 1)]
        keep = ss >= last[qs] - 1e-9
        qs, rs = qs[keep], rs[keep]
        exact = (self.x[rs] * q[qs]).sum(axis=1)
        qid, qvid = batch.column(3).to_numpy(), batch.column(4).to_numpy()
        owners = np.repeat(np.arange(len(qs)), [len(self.ids[r]) for r in rs])
        ids = np.array([i for r in rs for i in self.ids[r]], np.int64)
        qs, vids, exact = qs[owners], self.vid[rs[owners]], exact[owners]
        other = ~((vids == qvid[qs]) & (ids == qid[qs]))
        qs, vids, exact, ids = qs[other], vids[other], exact[other], ids[other]
        order = np.lexsort((ids, -exact, qs))
        count = np.bincount(qs, minlength=batch.num_rows)
        nth = np.arange(len(qs)) - (np.cumsum(count) - count)[qs[order]]
        order = order[nth < k]
        qs = qs[order]
        return pa.RecordBatch.from_arrays([pa.array(qid[qs]), pa.array(qvid[qs]), pa.array(ids[order]), pa.array(vids[order]), pa.array(exact[order])], ["query_id", "qvid", "vec_id", "vid", "score"])


def _search(k: int):
    """Rows sorted by bin, vectors before queries -> per query and bin the nearest rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bin_, held, ready = None, [], None
        for batch in batches:
            keys = batch.column(0).to_numpy().astype(np.int64) * 2 + batch.column(1).to_numpy()
            borders = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(borders, borders[1:], strict=False):
                if a == b:
                    continue
                if keys[a] >> 1 != bin_:
                    bin_, held, ready = keys[a] >> 1, [], None
                if keys[a] & 1 == 0:
                    held.append(batch.slice(a, b - a))
                elif held:
                    ready = ready or _Bin(held)
                    for start in range(a, b, 256):
                        if (found := ready.search(batch.slice(start, min(256, b - start)), k)) is not None:
                            yield found

    return run


def _exact(shipped, k: int):
    """(vid, vec) -> for each probe query the batch's nearest vectors."""

    def run(batches):
        queries = shipped.value
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = queries @ _matrix(batch.column(1)).T
            n = min(k, scores.shape[1])
            best = np.argpartition(-scores, n - 1, axis=1)[:, :n]
            at = best.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(queries)), n), pa.int32()), pa.array(scores[np.repeat(np.arange(len(queries)), n), at]), batch.column(0).take(pa.array(at))], ["q", "score", "vid"])

    return run


def _first(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group; tasks keep their own first k before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, recall: float = 0.96, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row whose id is divisible by ``every``.

    score is the inner product in double precision; ties go to the smaller id; a query's own row is no
    answer. All candidates come if they are k or fewer, and k otherwise. Rows take no part if the id or the vector is null, or the vector is empty, all zero or holds null
    or non-finite components. Vectors shorter than the longest count as if zeros followed. Rows that repeat
    id and vector count once; rows that share an id but not the vector are queries and candidates of their
    own. No vectors give an empty result. Ids must be numbers
    or strings of digits; others (and null ones) take no part. Other columns are not read, whatever their names.

    Fitted on bounded samples: centroids on SAMPLE vectors, the ratio on PROBE_QUERIES queries, each chosen
    by hash; every row is indexed. Equal vectors are one entry with their k + 1 smallest ids, which is all
    that any answer can hold.
    """
    return _nearest(vectors, k, every, recall, id_col, vec_col)[0]


def _nearest(vectors, k, every, recall, id_col, vec_col):
    spark = vectors.sparkSession
    sc = spark.sparkContext
    small_batches(spark, 2000)
    scratch = Scratch(spark, "nearest")
    schema = "query_id long, rank int, vec_id long, score double"
    empty = spark.createDataFrame([], schema), 0.0
    x = vectors.select(F.expr(f"try_cast(`{id_col}` AS BIGINT)").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = x.where("id is not null and v is not null").where(~bad).where(F.exists("v", lambda c: c != 0))
    longest = x.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return empty
    x = x.withColumn("v", F.when(F.size("v") == longest, F.col("v")).otherwise(F.concat("v", F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("v")))))
    rows = scratch.write(x.mapInArrow(_collapse, "id long, vec binary, norm double").dropDuplicates(["id", "vec"]).withColumn("vid", F.xxhash64("vec")), "rows")
    few = _first(rows, ["vid", "vec"], ["id"], k + 1)
    once = scratch.write(few.groupBy("vid", "vec").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.first("norm").alias("norm")), "vectors")
    n, radius = once.agg(F.count(F.lit(1)), F.max("norm")).first()
    queries = rows.where(F.col("id") % every == 0).select("id", "vid", "vec")
    probes = queries.orderBy(F.xxhash64("id"), "id", "vid").limit(PROBE_QUERIES).select("vec").toArrow()
    if not probes.num_rows:
        return empty
    sample = _lifted(_matrix(once.orderBy("vid", "vec").limit(SAMPLE).select("vec").toArrow().column(0)), radius)
    others = sample[: max(1, min(1024, len(sample) // 8))]
    sample = sample[len(others) :] if len(sample) > len(others) else sample
    lists = int(max(1, min(MOST_LISTS, n // LIST_ROWS, len(sample) // 2)))
    graph = CentroidGraph(balanced_centroids(sample, lists), others)
    shipped = sc.broadcast(graph)
    posts = scratch.write(once.select("vid", "vec", "ids").mapInArrow(_post(shipped, radius), f"vid long, vec binary, ids {_IDS}, lists array<int>"), "posts")
    sizes = np.zeros(lists, np.int64)
    for r in posts.select(F.explode("lists").alias("list")).groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    bins = Bins(graph.points, sizes, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ratio = _calibrate(once, posts, _matrix(probes.column(0)), radius, graph, k, recall)
    dealt = sc.broadcast(bins)
    left = posts.mapInArrow(_deal(dealt), _ROWS)
    right = queries.mapInArrow(_probe(shipped, dealt, radius, ratio, k), _ROWS)
    found = left.union(right).repartition(bins.n, "bin").sortWithinPartitions("bin", "kind").mapInArrow(_search(k), "query_id long, qvid long, vec_id long, vid long, score double")
    found = _first(found.repartition("query_id", "qvid").dropDuplicates(["query_id", "qvid", "vec_id", "vid"]), ["query_id", "qvid"], [F.desc("score"), "vec_id"], k)
    return found.select("query_id", "rank", "vec_id", "score"), ratio


def _calibrate(once: DataFrame, posts: DataFrame, probes: np.ndarray, radius: float, graph: CentroidGraph, k: int, recall: float) -> float:
    """The ratio within which the wanted share of the probes' true neighbours has a list."""
    spark = once.sparkSession
    near = once.select("vid", "vec").mapInArrow(_exact(spark.sparkContext.broadcast(probes), k + 1), "q int, score double, vid long")
    top = _first(near, ["q"], [F.desc("score"), "vid"], k + 1).select("q", "vid")
    told = top.join(posts.select("vid", "lists"), "vid").collect()  # PROBE_QUERIES * (k + 1) rows at most
    lifted = _asking(probes, radius).astype(np.float32)
    needs = []
    for r in told:
        d = np.sqrt(((graph.points[r["lists"]] - lifted[r["q"]]) ** 2).sum(axis=1)).min()
        needs.append((r["q"], d))
    least = np.maximum(graph.search(lifted, 8)[1][:, 0], max(graph.floor, 1e-12))
    needs = sorted(float(d / least[q]) for q, d in needs)
    return max(1.0, needs[min(len(needs) - 1, int(np.ceil(recall * len(needs))))]) * (1 + 1e-6)
