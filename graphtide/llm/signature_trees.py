"""N-gram Jaccard self-join with signature trees.

A tree's leaves are documents: the bitmap of their hashed shingles and their set size. Inner nodes hold the
bitwise or of the bitmaps below them and the range of sizes. Two trees (or one and itself) are walked
together; a pair of nodes is cut when its sizes are too far apart, or when the bits that both have in common
allow too small an overlap. What is left is compared exactly.

Trees are built over stars of documents, so that no task sees the whole table. Stars come from an exact
pigeonhole routing: the hash space is split into more parts than two linked sets can differ in elements, so
linked sets agree on at least one part and meet under its hash. The smallest document under a hash is its
hub; a star is a hub and all that meet it. Documents that share no hash with a common hub are never brought
together. A star of more than a block is cut into blocks, each with the hub; documents that are then not
connected with most of their star are walked against its other blocks.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ordered_prefix, small_batches
from .components import components

_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_RATIO = 1.5  # of a size class's bounds
SPLITS = 8  # of a set whose parts are too often empty


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text, A-Z lowered.

    Fewer than k words give one shingle of all of them; no word gives none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    width = min(k, n)
    acc = np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        acc = mix(acc * _C1 + h[j : n - width + 1 + j])
    return np.unique(acc + np.uint64(width))


class Routing:
    """Size classes and the number of parts in each, for a threshold of percent/100.

    Two sets of at most hi elements that link differ in at most 2 * hi * (100 - t) / (100 + t) elements.
    With that many parts and one more, one part at least has no difference; a few more parts make up for
    parts that are empty in both sets, which carry no key. A set with more empty parts than those is split
    again by another hash, up to SPLITS times (of two linked sets that do not meet both go on), and after
    the last gives keys for its empty parts too, so no link is lost.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.smallest = max(1, math.ceil(percent / max(100 - percent, 1)))  # below, only equal sets link
        his = [max(self.smallest + 1, int(self.smallest * _RATIO))]
        while his[-1] < 2**40:
            his.append(int(his[-1] * max(_RATIO, 100 / percent)) + 1)
        self.his, self.parts, self.spare = np.array(his), [], []
        for hi in his:
            differ = (100 - percent) * 2 * hi // (100 + percent)
            spare = 1 + math.ceil(2 * (differ + 1) * math.exp(-hi / _RATIO / (differ + 1)))
            self.parts.append(differ + 1 + spare)
            self.spare.append(spare)

    def keys(self, s: np.ndarray) -> np.ndarray:
        n = len(s)
        if n < self.smallest:
            return np.empty(0, np.uint64)
        own = int(np.searchsorted(self.his, n))
        found, splits = [], [s]
        for c in (own, own + 1) if n * 100 // self.percent > self.his[own] else (own,):
            for q in range(SPLITS):
                if q == len(splits):
                    splits.append(np.sort(mix(s ^ mix(np.full(1, q, np.uint64)))))
                p = ((splits[q] >> np.uint64(32)) * np.uint64(self.parts[c])) >> np.uint64(32)  # rises with the elements
                starts = np.concatenate(([0], np.flatnonzero(p[1:] != p[:-1]) + 1))
                where, sums = p[starts], np.add.reduceat(mix(splits[q] ^ _C1), starts)
                sparse = self.parts[c] - len(starts) > self.spare[c]
                if sparse and q == SPLITS - 1:
                    empty = np.setdiff1d(np.arange(self.parts[c], dtype=np.uint64), where)
                    where, sums = np.concatenate((where, empty)), np.concatenate((sums, np.zeros(len(empty), np.uint64)))
                found.append(mix(sums + mix(where * _C1 + np.uint64((q << 16) + c + 1))))
                if not sparse:
                    break
        return np.concatenate(found)


_LIGHT = "rid long, doc_id long, th long, n long, s0 long, s1 long, map binary"


def _set_hash(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits that are equal for equal sets."""
    return mix(s ^ _C2).sum(dtype=np.uint64), mix(s + _C3).sum(dtype=np.uint64)


def _light(k: int):
    """Per document its set size, set hash and bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            m = batch.num_rows
            n, s0, s1, maps = np.zeros(m, np.int64), np.zeros(m, np.uint64), np.zeros(m, np.uint64), []
            for i, text in enumerate(batch.column(2)):
                s = shingle_set(text.as_py() or "", k)
                n[i], (s0[i], s1[i]) = len(s), _set_hash(s)
                maps.append(bitmap(s).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rid, rid + m)), batch.column(0), batch.column(1), pa.array(n), pa.array(s0.view(np.int64)), pa.array(s1.view(np.int64)), pa.array(maps, pa.binary())], ["rid", "doc_id", "th", "n", "s0", "s1", "map"])
            rid += m

    return run


def _keys(k: int, percent: int, chunk: int = 512):
    """(text) -> (key, owner) for each key of each distinct set of a chunk; owners are sets' hashes.

    Sets that share an owner's hash by chance only meet more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        routing = Routing(percent)
        for batch in batches:
            for start in range(0, batch.num_rows, chunk):
                found = {}
                for text in batch.slice(start, chunk).column(0):
                    s = shingle_set(text.as_py() or "", k)
                    if len(s) and (same := (len(s), *_set_hash(s))) not in found:
                        found[same] = routing.keys(s)
                if not found:
                    continue
                keys, owners = np.concatenate(list(found.values())), np.repeat(np.array([h for _, h, _ in found], np.uint64), [len(x) for x in found.values()])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(owners.view(np.int64))], ["key", "owner"])

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, owner) sorted by both -> links to the first owner of each key."""
    key = hub = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, owners = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.concatenate(([key is None or keys[0] != key], keys[1:] != keys[:-1]))
        at = np.maximum.accumulate(np.where(new, np.arange(len(keys)), -1))
        hubs = np.where(at >= 0, owners[np.maximum(at, 0)], hub if hub is not None else 0)
        key, hub = keys[-1], hubs[-1]
        links = np.unique(np.stack((owners, hubs))[:, owners != hubs], axis=1)
        if links.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(links[0])), pa.array(np.ascontiguousarray(links[1]))], ["a", "b"])


def band(n: int) -> int:
    """Sets of from 2^b to 2^(b+1) - 1 elements have bitmaps of one length."""
    return int(n).bit_length() - 1


def bitmap(s: np.ndarray) -> np.ndarray:
    """The bitmap of a set, of 8 to 16 bits for each element."""
    if not len(s):
        return np.empty(0, np.uint64)
    bits = np.zeros(max(64, 16 << band(len(s))), bool)
    bits[(s & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


class SignatureTree:
    """Documents of one block in leaf order, and the levels of nodes above them, the leaves' level first.

    A bitmap repeated to the length of longer ones still has every bit that a common element sets there, so
    documents of different bands can be held together: the bound only becomes wider.
    """

    def __init__(self, maps: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray] | None = None, own_bits: np.ndarray | None = None, leaf: int = 16, fan: int = 8):
        self.sets, self.sizes, self.maps = sets, sizes, maps
        #: Elements that share a bit with another of the set; the common bits can hide as many.
        self.own_bits = np.bitwise_count(maps).sum(axis=1, dtype=np.int64) if own_bits is None else own_bits
        self.hidden = sizes - self.own_bits
        self.levels = []  # of (first document, or map, smallest size, largest size, hidden)
        starts, low, high, hidden, step = np.arange(0, len(sizes), leaf), self.sizes, self.sizes, self.hidden, np.arange(0, len(sizes), leaf)
        while True:
            maps, low, high, hidden = np.bitwise_or.reduceat(maps, step), np.minimum.reduceat(low, step), np.maximum.reduceat(high, step), np.maximum.reduceat(hidden, step)
            self.levels.append((starts, maps, low, high, hidden))
            if len(starts) == 1:
                break
            step = np.arange(0, len(starts), fan)
            starts = starts[step]
        self.fan = fan

    def widened(self, words: int) -> SignatureTree:
        return self if words == self.maps.shape[1] else SignatureTree(np.tile(self.maps, (1, words // self.maps.shape[1])), self.sizes, self.sets, self.own_bits)

    def span(self, level: int, node: int) -> tuple[int, int]:
        starts = self.levels[level][0]
        return int(starts[node]), int(starts[node + 1]) if node + 1 < len(starts) else len(self.sizes)

    def children(self, level: int, node: int) -> range:
        return range(node * self.fan, min((node + 1) * self.fan, len(self.levels[level - 1][0])))


def links(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """Whether two sets are alike enough, exactly."""
    if min(len(s), len(t)) * 100 < percent * max(len(s), len(t)):
        return False
    both = np.concatenate((s, t))
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(s) + len(t) - common)


def dual_walk(x: SignatureTree, y: SignatureTree, label_x: np.ndarray, label_y: np.ndarray, percent: int, flags: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Walks two trees of equally long bitmaps together, or one with itself (x is y, label_x is label_y).

    Labels tell which documents are known to be connected; the walk merges labels in place and returns the
    merges. Node pairs whose documents are all connected already are left. With flags, sets aren't needed:
    documents that may link with one of another label are flagged instead, and node pairs are left once all
    of their documents are.
    """
    merged: list[tuple[int, int]] = []

    def cut(a, b, lx, ly):
        # |A & B| >= t (|A| + |B|) / (1 + t) is what a link needs.
        _, ma, la, ha, da = (v[a] for v in x.levels[lx])
        _, mb, lb, hb, db = (v[b] for v in y.levels[ly])
        if ha * 100 < percent * lb or hb * 100 < percent * la:
            return True
        return (int(np.bitwise_count(ma & mb).sum()) + min(int(da), int(db))) * (100 + percent) < percent * int(la + lb)

    def join(i, j):
        a, b = label_x[i], label_y[j]
        lo, hi = min(a, b), max(a, b)
        label_x[label_x == hi] = lo
        if label_y is not label_x:
            label_y[label_y == hi] = lo
        merged.append((int(hi), int(lo)))

    def connected(a0, a1, b0, b1):
        if flags is not None and flags[0][a0:a1].all() and flags[1][b0:b1].all():
            return True
        first = label_x[a0]
        return (label_x[a0:a1] == first).all() and (label_y[b0:b1] == first).all()

    def compare(a0, a1, b0, b1, same):
        common = np.bitwise_count(x.maps[a0:a1, None] & y.maps[None, b0:b1]).sum(axis=2).astype(np.int64)
        common += np.minimum(x.hidden[a0:a1, None], y.hidden[None, b0:b1])
        fits = common * (100 + percent) >= percent * (x.sizes[a0:a1, None] + y.sizes[None, b0:b1])
        fits &= label_x[a0:a1, None] != label_y[None, b0:b1]
        if flags is not None:
            flags[0][a0:a1] |= fits.any(axis=1)
            flags[1][b0:b1] |= fits.any(axis=0)
            return
        for i, j in zip(*np.nonzero(np.triu(fits, 1) if same else fits), strict=True):
            if label_x[a0 + i] != label_y[b0 + j] and links(x.sets[a0 + i], y.sets[b0 + j], percent):
                join(a0 + i, b0 + j)

    own, top_x, top_y = x is y, len(x.levels) - 1, len(y.levels) - 1
    if own:
        for node in range(len(x.levels[0][0])):
            a0, a1 = x.span(0, node)
            compare(a0, a1, a0, a1, True)
    stack = [(top_x, 0, top_y, 0)]
    while stack:
        lx, a, ly, b = stack.pop()
        (a0, a1), (b0, b1) = x.span(lx, a), y.span(ly, b)
        same = own and lx == ly and a == b
        if (same and lx == 0) or connected(a0, a1, b0, b1) or (not same and cut(a, b, lx, ly)):
            continue
        if lx == 0 and ly == 0:
            compare(a0, a1, b0, b1, False)
        elif same:
            below = x.children(lx, a)
            stack += [(lx - 1, i, lx - 1, j) for i in below for j in below if i <= j]
        elif lx >= ly:
            stack += [(lx - 1, i, ly, b) for i in x.children(lx, a)]
        else:
            stack += [(lx, a, ly - 1, j) for j in y.children(ly, b)]
    return merged


def _groups(batches: Iterator[pa.RecordBatch], width: int = 3) -> Iterator[list[tuple]]:
    """Groups of consecutive rows that agree in their first columns."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:width] != row[:width]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


_JOB = "cell long, i int, j int, side int, label long"
_NAMES = [x.split()[0] for x in _JOB.split(", ")]


class _Side:
    """A tree for each band of the documents of one side of a job."""

    def __init__(self, rows: list[tuple], exact: bool):
        self.trees: dict[int, tuple[SignatureTree, np.ndarray, np.ndarray, list]] = {}
        bands: dict[int, list] = {}
        for r in rows:
            data = np.frombuffer(r[5], np.uint64)
            bands.setdefault(band(len(data) if exact else r[6]), []).append((len(data) if exact else r[6], r[5][:8], r[4], data, r))
        for b, members in bands.items():
            members.sort(key=lambda m: m[:3])
            maps = np.stack([bitmap(m[3]) if exact else m[3] for m in members])
            tree = SignatureTree(maps, np.array([m[0] for m in members]), [m[3] for m in members] if exact else None)
            self.trees[b] = tree, np.array([m[2] for m in members]), np.zeros(len(members), bool), [m[4] for m in members]


def _walk_sides(x: _Side, y: _Side, percent: int, flag: bool) -> list[tuple[int, int]]:
    """Walks every pair of bands whose sizes allow a link."""
    found = []
    for a, (tx, lx, fx, _) in x.trees.items():
        for b, (ty, ly, fy, _) in y.trees.items():
            if (x is y and b < a) or tx.sizes[-1] * 100 < percent * ty.sizes[0] or ty.sizes[-1] * 100 < percent * tx.sizes[0]:
                continue
            words = max(tx.maps.shape[1], ty.maps.shape[1])
            wide = tx.widened(words)
            found += dual_walk(wide, wide if tx is ty else ty.widened(words), lx, ly, percent, (fx, fy) if flag else None)
    return found


def _sides(rows: list[tuple], exact: bool) -> tuple[_Side, _Side]:
    parts = [_Side(part, exact) for which in (0, 1) if (part := [r for r in rows if r[3] == which])]
    return parts[0], parts[-1]


def _walk(percent: int):
    """Rows (cell, i, j, side, label, shingles) sorted by cell, i, j -> (a, b): labels that links connect.

    The documents of one side are walked with each other; those of two sides with the other side's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            if found := _walk_sides(*_sides(rows, True), percent, False):
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    return run


def _may(percent: int):
    """Rows (cell, i, j, side, label, map, n, rep) sorted by cell, i, j -> those that may link with another there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            x, y = _sides(rows, False)
            _walk_sides(x, y, percent, True)
            out = [r for side in ((x,) if x is y else (x, y)) for _, _, flags, own in side.trees.values() for r, f in zip(own, flags, strict=True) if f]
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([*[pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], pa.array([r[7] for r in out], pa.int64())], [*_NAMES, "rep"])

    return run


def _again(k: int, most: int = 1 << 23):
    """(jobs, text) -> a row (cell, i, j, side, label, shingles) for each job; at most so many bytes at once."""

    def told(out):
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[x] for r in out], t) for x, t in enumerate(kinds)], [*_NAMES, "shingles"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            for jobs, text in zip(batch.column(0), batch.column(1), strict=True):
                data = shingle_set(text.as_py() or "", k).tobytes()
                for job in jobs.as_py():
                    out.append((*(job[c] for c in _NAMES), data))
                    held += len(data)
                    if held > most:
                        yield told(out)
                        out, held = [], 0
        if out:
            yield told(out)

    return run


def _links(scratch: Scratch, source: DataFrame, light: DataFrame, named: DataFrame, jobs: DataFrame, k: int, percent: int, bitmap_bits: int) -> DataFrame:
    """(a, b): labels that the walks of all jobs connect.

    jobs: (rep, cell, i, j, side, label). Bitmaps are walked first, which leaves the documents that may link
    with another of their job. The texts of these are read again and have their sets made again; a bitmap of
    fixed size keeps most of the other texts from being shuffled.
    """
    maps = jobs.join(light.select(F.col("rid").alias("rep"), "map", "n"), "rep").select(*_NAMES, "map", "n", "rep")
    jobs = scratch.write(maps.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(_may(percent), f"{_JOB}, rep long"), f"may-{uuid.uuid4().hex}")
    del maps
    scratch.release()
    wanted = jobs.groupBy("rep").agg(F.collect_list(F.struct(*_NAMES)).alias("jobs")).join(named, "rep").select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "jobs")
    word, flag = F.pmod("h", F.lit(bitmap_bits // 64)), F.expr("shiftleft(1L, cast(shiftright(h, 58) & 63 as int))")
    flags = jobs.select("rep").distinct().join(named, "rep").select(F.xxhash64("doc_id", "th").alias("h")).select(word.alias("w"), flag.alias("f")).groupBy("w").agg(F.bit_or("f").alias("f"))
    texts = source.withColumn("h", F.xxhash64("doc_id", "th")).withColumn("w", word).join(F.broadcast(flags), "w").where(F.col("f").bitwiseAND(flag) != 0).groupBy("doc_id", "th").agg(F.first("text").alias("text"))
    ready = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t"))).select("jobs", "text")
    sets = ready.mapInArrow(_again(k), f"{_JOB}, shingles binary").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return sets.mapInArrow(_walk(percent), "a long, b long")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, block_shingles: int = 2_000_000, bitmap_bits: int = 1 << 26) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of the documents; rows of one doc_id count as copies.

    Documents link when 100 * |A & B| >= percent * |A | B| over their sets of k-word shingles;
    component_id is the smallest doc_id reachable by links. Null and empty texts have no shingle, link with
    nothing and are their own component. Equal sets are one node, whatever their number. Rows with a null
    doc_id keep a null component_id unless a linked row has an id. Very long texts are whole sets. An empty
    table gives an empty result. Other columns are not read, whatever their names.

    block_shingles bounds what one task holds of a star; bitmap_bits bounds the broadcast filter of the
    second reading (a full filter only lets more texts pass). Neither changes the result.
    """
    _, named = _components(docs, k, percent, block_shingles, bitmap_bits)
    least = named.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("least"))
    return named.join(least, "comp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def first_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one row of each component: that with the smallest doc_id (nulls last, then by row).

    Rows without a shingle all stay. Rows are told apart by doc_id and text, not by doc_id alone: a text that
    is no copy stays even if its doc_id is used by one that is. Of rows equal in both, one stays.
    """
    scratch, named = _components(docs, k, percent)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "rid")
    kept = named.where("n > 0").groupBy("comp").agg(F.min(order).alias("o")).select(F.col("o.doc_id").alias("doc_id"), F.col("o.rid").alias("rid"))
    kept = scratch.write(kept.join(named.select("rid", "th"), "rid").select("doc_id", "th"), "kept")
    key, th = unused(docs, 2)
    marked = docs.withColumn(th, _text_hash(F.col("text"))).withColumn(key, F.xxhash64(F.col("doc_id").try_cast("long"), F.col(th)))
    wordy = has_word(F.col("text"))
    kept = kept.select(F.xxhash64("doc_id", "th").alias(key), F.col("th").alias(th))
    once = marked.where(wordy).join(kept, [key, th], "left_semi").dropDuplicates([key, th])
    return marked.where(~wordy).select(*docs.columns).union(once.select(*docs.columns))


def unused(df: DataFrame, n: int) -> list[str]:
    """So many names that no column of df has."""
    taken = {c.lower() for c in df.columns}
    return [x for x in (f"_{i}" for i in range(len(taken) + n)) if x not in taken][:n]


def _text_hash(text):
    return F.xxhash64(text.cast("string"))


def has_word(text):
    """Whether a text has a word, in DataFrame functions."""
    return F.coalesce(F.length(F.trim(text.cast("string"), F.lit(" \t\n\x0b\x0c\r"))) > 0, F.lit(False))


def _components(docs: DataFrame, k: int, percent: int, block_shingles: int = 2_000_000, bitmap_bits: int = 1 << 26) -> tuple[Scratch, DataFrame]:
    """(rid, doc_id, th, n, comp) of each row; comp is equal for rows whose sets links connect."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    small_batches(spark)
    source = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), _text_hash(F.col("text")).alias("th"), F.col("text").cast("string").alias("text"))
    light = scratch.write(source.mapInArrow(_light(k), _LIGHT), "light")
    node = light.where("n > 0").groupBy("n", "s0", "s1").agg(F.min(F.struct("rid", "doc_id", "th")).alias("r"))
    node = scratch.write(node.select(F.col("r.rid").alias("rep"), "r.doc_id", "r.th", "n", "s0", "s1"), "node")

    # Keys are made in a reading of their own and go straight to the shuffle: stored, they would be the largest table.
    keys = source.select("text").mapInArrow(_keys(k, percent), "key long, owner long")
    met = scratch.write(keys.repartition("key").sortWithinPartitions("key", "owner").mapInArrow(_meet, "a long, b long").distinct(), "met")
    del keys
    scratch.release()
    of = node.select("rep", "n", "s0")
    star = met.join(of.select(F.col("s0").alias("a"), "rep", "n"), "a").join(of.select(F.col("s0").alias("b"), F.col("rep").alias("cell"), F.col("n").alias("hub_n")), "b").where("rep <> cell")
    # A hub with one document of another size has nothing to link.
    fits = F.least("n", "hub_n") * 100 >= percent * F.greatest("n", "hub_n")
    some = star.groupBy("cell").agg(F.count(F.lit(1)).alias("m"), F.max(fits).alias("fits")).where("m > 1 or fits").select("cell")
    star = star.join(some, "cell").select("cell", "rep", "n", F.col("cell").cast("string").alias("cell_key"))
    star = scratch.write(_blocks(star, block_shingles).select("cell", "rep", "n", F.col("block").cast("int").alias("block")), "star")
    hubs = star.select(F.col("cell").alias("rep"), "cell", "block").distinct()
    place = star.select("rep", "cell", "block").union(hubs)
    jobs = scratch.write(place.select("rep", "cell", F.col("block").alias("i"), F.col("block").alias("j"), F.lit(0).alias("side"), F.col("rep").alias("label")), "jobs")
    named = node.select("rep", "doc_id", "th")
    found = scratch.write(_links(scratch, source, light, named, jobs, k, percent, bitmap_bits), "links")
    scratch.release()
    many = scratch.write(star.groupBy("cell").agg(F.max("block").alias("last")).where("last > 0"), "many")
    if many.limit(1).count():
        more = _across(scratch, star.join(many, "cell", "left_semi"), found, block_shingles, percent)
        if more.limit(1).count():
            found = found.union(scratch.write(_links(scratch, source, light, named, more, k, percent, bitmap_bits), "more"))
    label = components(found)
    out = light.join(node.select("rep", "n", "s0", "s1"), ["n", "s0", "s1"], "left").join(label, F.col("rep") == F.col("node"), "left")
    return scratch, out.select("rid", "doc_id", "th", "n", F.coalesce("component", "rep", "rid").alias("comp"))


def _blocks(rows: DataFrame, block_shingles: int) -> DataFrame:
    """Adds block: rows of a cell in order of size, cut at equal numbers of shingles."""
    placed, _, _ = ordered_prefix(rows, [F.col("n"), F.col("rep")], "n", group="cell_key")
    return placed.withColumn("block", F.expr(f"cast(_before div {block_shingles}L as int)"))


def _across(scratch: Scratch, star: DataFrame, found: DataFrame, block_shingles: int, percent: int) -> DataFrame:
    """The jobs between blocks of stars that have several.

    Documents outside of their star's most frequent component are odd. They are cut into blocks of their own,
    each of which is walked with every block of the star whose sizes allow a link.
    """
    names = components(found)
    now = star.join(names, F.col("rep") == F.col("node"), "left").select("cell", "block", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    now = scratch.write(now, "now")
    main = now.groupBy("cell", "comp").count().groupBy("cell").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"))
    odd = now.join(main, "cell").where("comp <> main").select("cell", "rep", "n", "comp", F.col("cell").cast("string").alias("cell_key"))
    odd = scratch.write(_blocks(odd, block_shingles).select("cell", "rep", "n", "comp", F.col("block").alias("i")), "odd")
    sizes = lambda rows, by: rows.groupBy("cell", by).agg(F.min("n").alias(f"{by}_lo"), F.max("n").alias(f"{by}_hi"))
    pairs = sizes(odd, "i").join(sizes(now.withColumnRenamed("block", "j"), "j"), "cell").where(f"100 * i_hi >= {percent} * j_lo and 100 * j_hi >= {percent} * i_lo").select("cell", "i", "j")
    pairs = scratch.write(pairs, "pairs")
    left = odd.join(pairs, ["cell", "i"]).select("rep", "cell", "i", "j", F.lit(0).alias("side"), F.col("comp").alias("label"))
    right = now.withColumnRenamed("block", "j").join(pairs, ["cell", "j"]).select("rep", "cell", "i", "j", F.lit(1).alias("side"), F.col("comp").alias("label"))
    return scratch.write(left.union(right), "across")
