"""Importance resampling towards a target text collection.

Texts are bags of hashed word runs. A bucket's gain is the log of its share in the target over its share in
the corpus; a document's weight is the mean gain of its runs, from one array of gains. Noise that depends
on the document's id alone turns the highest scores into a draw without replacement. Scores are integers,
so an exact histogram of them gives each score's rank offset and the score at which the draw ends.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Bytes of a word, A-Z in lower case; all others part words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: Words whose bucket a task remembers.
HELD = 500_000
#: Texts are hashed in slices of about so many bytes.
SLICE = 8_000_000


class _Buckets(dict):
    """Feature to bucket, remembered up to a bound."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= HELD:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.n
        return found


def _features(words: list[bytes], longest: int) -> list[bytes]:
    out = list(words)
    for k in range(2, longest + 1):
        out += [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    return out


def _hashed(batch: pa.RecordBatch, column: str, buckets: _Buckets, longest: int):
    """Slices of a batch: (first row, words of each text, features of each text, the features' buckets one after another)."""
    texts = batch.column(batch.schema.get_field_index(column))
    first, held, words, sizes, ids = 0, 0, [], [], []
    for i in range(len(texts)):
        text = texts[i].as_py() or b""
        own = text.translate(_WORDS).split()
        found = own if longest == 1 else _features(own, longest)
        words.append(len(own))
        sizes.append(len(found))
        ids.append(np.fromiter(map(buckets.__getitem__, found), np.int64, len(found)))
        held += len(text)
        if held >= SLICE or i == len(texts) - 1:
            yield first, words, np.array(sizes), np.concatenate(ids)
            first, held, words, sizes, ids = i + 1, 0, [], [], []


def bucket_counts(texts: DataFrame, buckets: int = 10_000, longest: int = 1) -> dict[int, int]:
    """Features in each bucket over all texts; at most ``buckets`` numbers come to the driver.

    texts: a column ``text``, null counting as empty.
    """

    def run(batches):
        sums, known = np.zeros(buckets, np.int64), _Buckets(buckets)
        for batch in batches:
            for _, _, _, ids in _hashed(batch, "text", known, longest):
                sums += np.bincount(ids, minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["bucket", "n"])

    found = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "bucket long, n long")
    return {r.bucket: r.n for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = 10_000) -> np.ndarray:
    """Thousandths of the log of each bucket's share in the target over that in the corpus, both with one added."""
    s_all, t_all = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s_all / ((corpus.get(b, 0) + 1.0) * t_all))) for b in range(buckets)], np.int64)


def importance(docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 1, seed: str = "2024") -> DataFrame:
    """Puts n_words, n_features, weight and score (all long) in place of the text; columns of these names are replaced.

    docs: doc_id and text at least; target: text. A null text counts as empty: no features, weight 0. The
    noise comes from the doc_id, so rows that share an id share it; a null id counts as an empty one. A text of any length is read whole.
    """
    table = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest), buckets)

    def run(batches):
        known = _Buckets(buckets)
        for batch in batches:
            for first, words, sizes, ids in _hashed(batch, "_text", known, longest):
                ends = np.cumsum(sizes)
                sums = np.concatenate([[0], np.cumsum(table[ids])])
                weight = (sums[ends] - sums[ends - sizes]) // np.maximum(sizes, 1)
                part = batch.slice(first, len(sizes))
                rest = [c for c, n in zip(part.columns, part.schema.names, strict=True) if n != "_text"]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(words, pa.int64()), pa.array(sizes, pa.int64()), pa.array(weight, pa.int64())], names)

    rows = docs.drop("n_words", "n_features", "weight", "score").withColumn("_text", F.col("text").cast("binary")).drop("text")
    names = [*[c for c in rows.columns if c != "_text"], "n_words", "n_features", "weight"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_text")
    weighed = rows.mapInArrow(run, f"{schema}, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weighed.withColumn("score", (F.col("weight") + noise).cast("long"))


def rank_offsets(scored: DataFrame, wanted: int) -> tuple[list[tuple[int, int]], int | None]:
    """([(score, rows with a higher score)] down to the cutoff, the cutoff score), None if nothing is drawn.

    One row for each integer score comes to the driver. Scores lie in a bounded range whatever the data hold:
    a gain is a thousandfold log of a ratio of two longs, so within 88,000 of 0, and the noise is within
    -3,200 and 22,900; so there are fewer than 203,000.
    """
    before, out, cutoff = 0, [], None
    for r in sorted(scored.groupBy("score").count().collect(), key=lambda r: -r["score"]):
        if before >= wanted:
            break
        out.append((r["score"], before))
        before, cutoff = before + r["count"], r["score"]
    return out, cutoff


def draw(scored: DataFrame, percent: int = 10, least_words: int = 20) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): floor(percent * N / 100) of the N rows with enough words, and all others unranked.

    scored: the columns doc_id, n_words, n_features, weight and score, in a table that was written, as it is
    read more than once. Highest scores come first, ties by doc_id, null being largest, then by features; equal
    rows take following ranks in any order. They are counted before they are dealt by score, so repeated rows, however
    many, are one row in the sort. No score holds more than 1/2,700 of the distinct ids of one weight, by the noise's law.
    """
    able = scored.where(F.col("n_words") >= least_words)
    wanted = percent * able.count() // 100
    offsets, cutoff = rank_offsets(able, wanted)
    columns = ["doc_id", "n_features", "weight", "score"]
    if cutoff is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    drawn = (F.col("n_words") >= least_words) & (F.col("score") >= cutoff)
    starts = scored.sparkSession.createDataFrame(offsets, "score long, _before long")
    order = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "weight").rowsBetween(Window.unboundedPreceding, 0)
    runs = scored.where(drawn).groupBy(*columns).count().withColumn("_last", F.sum("count").over(order)).join(F.broadcast(starts), "score")
    ranks = runs.select(*columns, F.explode(F.sequence(F.col("_before") + F.col("_last") - F.col("count") + 1, F.col("_before") + F.col("_last"))).alias("rank"))
    ranks = ranks.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return ranks.unionByName(scored.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, buckets: int = 10_000, longest: int = 1, seed: str = "2024") -> DataFrame:
    """The digest of :func:`draw` for all documents: extra columns of the input play no part; no rows give no rows."""
    scratch = Scratch(docs.sparkSession, "resampling")
    rows = docs.select(F.col("doc_id").cast("string").try_cast("long").alias("doc_id"), "text")
    scored = importance(rows, target.select("text"), buckets, longest, seed)
    return draw(scratch.write(scored, "scored"), percent, least_words)


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, buckets: int = 10_000, longest: int = 1, seed: str = "2024") -> DataFrame:
    """The drawn documents themselves, all columns as they came, each once; rows equal to the last one drawn come too."""
    ranks = resampled(docs, target, percent, least_words, buckets, longest, seed).where("rank is not null").select(F.col("doc_id").alias("_drawn"), F.col("n_features").alias("_nf"), F.col("weight").alias("_weight")).distinct()
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    wide = importance(docs.select(F.col("doc_id").cast("string").try_cast("long").alias("doc_id"), "text", own.alias("_row")), target.select("text"), buckets, longest, seed)
    same = F.col("doc_id").eqNullSafe(F.col("_drawn")) & (F.col("n_features") == F.col("_nf")) & (F.col("weight") == F.col("_weight"))
    return wide.where(F.col("n_words") >= least_words).join(ranks, same, "left_semi").select("_row.*")
