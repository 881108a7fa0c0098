"""Temperature mixing of sources, realised as budgeted block permutations.

A source with share p of all tokens gets the weight p ** a, normalised. The exponent a is bisected between 1
(natural shares) and 0 (equal shares) until the weights reach a target entropy, or as far as a limit on
repetitions allows. A source's weight times the budget is its own budget: it is gone through in one random
permutation of its blocks after another, and in the last one up to where the budget ends.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, ordered_prefix

BLOCK_ROWS = 1024


def weights(tokens: dict, exponent: float) -> dict:
    total = sum(tokens.values())
    raw = {s: (n / total) ** exponent if n else 0.0 for s, n in tokens.items()}
    norm = sum(raw.values())
    return {s: x / norm for s, x in raw.items()}


def entropy(w: dict) -> float:
    return -sum(x * math.log(x) for x in w.values() if x > 0)


def bisect_exponent(tokens: dict, budget: float, target_entropy: float | None, most_repeats: float | None, rounds: int = 60) -> float:
    """The exponent in [0, 1] that meets the targets.

    Entropy falls and the largest number of repetitions falls too as the exponent grows. The result is the
    largest exponent whose entropy is at least the target (0 if none), raised, if need be, to the smallest
    whose repetitions keep within the limit (1 if none).
    """

    def search(holds_low) -> float:
        low, high = 0.0, 1.0
        for _ in range(rounds):
            mid = (low + high) / 2
            low, high = (mid, high) if holds_low(mid) else (low, mid)
        return (low + high) / 2

    exponent = 1.0
    if target_entropy is not None and entropy(weights(tokens, 1.0)) < target_entropy:
        exponent = 0.0 if entropy(weights(tokens, 0.0)) < target_entropy else search(lambda a: entropy(weights(tokens, a)) >= target_entropy)

    def repeats(a: float) -> float:
        return max(w * budget / tokens[s] for s, w in weights(tokens, a).items() if tokens[s])

    if most_repeats is not None and repeats(exponent) > most_repeats:
        exponent = 1.0 if repeats(1.0) > most_repeats else max(exponent, search(lambda a: repeats(a) > most_repeats))
    return exponent


class Plan:
    """What a mixing decided: per source its weight, passes through all rows, and where the last pass ends."""

    def __init__(self, exponent: float, sources: list[tuple], ends: DataFrame, epochs: DataFrame):
        self.exponent, self.sources, self.ends, self.epochs = exponent, sources, ends, epochs


def _source_key(source: Column) -> Column:
    """A string for each source, nulls being a source of their own."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def _tokens(text: Column) -> Column:
    inner = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, ASCII_SPACE))).cast("long")


def _place(epoch: Column, blocks: Column, seed: int) -> Column:
    """A row's place in an epoch's permutation: blocks in random order, rows in random order in a block."""
    block = F.pmod(F.xxhash64(F.lit(seed), F.col("_id"), F.col("_th")), blocks)
    return F.struct(F.xxhash64(F.lit(seed + 1), epoch, block).alias("b"), block.alias("k"), F.xxhash64(F.lit(seed + 2), epoch, F.col("_id"), F.col("_th")).alias("r"), F.col("_id").alias("i"), F.col("_th").alias("t"))


def plan_mixture(docs: DataFrame, budget: int | None = None, entropy_share: float | None = 0.98, most_repeats: float | None = 2.0, seed: int = 17) -> Plan:
    """Weights and permutations for the documents' sources; ``epochs`` has a row for each use of a document.

    budget: tokens of the mixture, all tokens if not given. entropy_share: target entropy as a share of the
    largest possible. The driver gets one row for each source.
    """
    rows = docs.select(_source_key(F.col("source")).alias("_s"), F.col("source"), F.col("doc_id").try_cast("long").alias("_id"), F.xxhash64("text").alias("_th"), _tokens(F.col("text")).alias("tokens"))
    found = {r["_s"]: r for r in rows.groupBy("_s").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    tokens = {s: r["t"] for s, r in found.items()}
    total = sum(tokens.values())
    budget = total if budget is None else budget
    full_sources = sum(n > 0 for n in tokens.values())
    exponent = bisect_exponent(tokens, budget, None if entropy_share is None else entropy_share * math.log(max(full_sources, 1)), most_repeats) if total else 1.0
    w = weights(tokens, exponent) if total else dict.fromkeys(tokens, 0.0)
    plan = []
    for s, t in tokens.items():
        own = round(w[s] * budget)
        passes, rest = (own // t, own % t) if t else (1, 0)
        plan.append((s, float(w[s]), own, int(passes), int(rest), -(-found[s]["n"] // BLOCK_ROWS)))
    spark = docs.sparkSession
    table = spark.createDataFrame(plan, "_s string, weight double, budget long, passes int, rest long, blocks long")
    table = F.broadcast(table) if len(plan) <= 100_000 else table
    used = rows.join(table, "_s").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("passes")))).where("epoch < passes or rest > 0")
    used = used.withColumn("_place", _place(F.col("epoch"), F.col("blocks"), seed)).withColumn("_group", F.concat_ws("\x1f", F.col("epoch").cast("string"), F.col("_s")))
    placed, _, _ = ordered_prefix(used, [F.col("_place.b"), F.col("_place.k"), F.col("_place.r"), F.col("_place.i").asc_nulls_first(), F.col("_place.t")], "tokens", group="_group")
    out = (F.col("epoch") == F.col("passes")) & (F.col("_before") >= F.col("rest"))
    # The last pass ends before the first row that begins at or behind the budget.
    ends = placed.where(out).groupBy("_s").agg(F.min("_place").alias("_end"))
    ends = table.join(ends, "_s", "left")
    return Plan(exponent, plan, ends, placed.where(~out).select("_s", "source", F.col("_id").alias("doc_id"), "epoch", F.col("_pos").alias("position"), "tokens", "weight"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """(source, doc_id, epoch, position, tokens, weight): each use of a document, in order within its epoch.

    Null sources are one source; null texts have no tokens. A source without tokens is used once as it is;
    rows without tokens go with their block. Repeated rows are used alike. Empty tables give empty results.
    """
    return plan_mixture(docs, **options).epochs.drop("_s")


def mix_documents(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """The mixture as documents with the columns that came in: a document comes once for each use.

    Texts are not shuffled: the sources' budgets and ends are a small table, and a row's place in the last
    pass follows from its id and text. Rows that repeat both share a place.
    """
    ends = plan_mixture(docs, seed=seed, **options).ends
    names = docs.columns
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), _source_key(F.col("source")).alias("_s"), F.col("doc_id").try_cast("long").alias("_id"), F.xxhash64("text").alias("_th"))
    d = d.join(ends.hint("broadcast") if ends.count() <= 100_000 else ends, "_s")
    place = _place(F.col("passes"), F.col("blocks"), seed)
    last = (F.col("rest") > 0) & (F.col("_end").isNull() | (place < F.col("_end")))
    uses = F.col("passes") + last.cast("int")
    return d.where(uses > 0).select("_row", F.explode(F.sequence(F.lit(1), uses)).alias("_use")).select("_row.*")
