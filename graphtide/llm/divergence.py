"""How far the sources of each language differ in their words, exactly, from sparse counts.

A source's divergence from another is a sum over every kept term of the language, also those that neither
source has. Three parts give it without a dense table: terms that one source has are priced from the
histogram of its counts as if the other had none of them, terms that both have are met in a join of
postings and put right, and terms that neither has all cost one constant.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Probabilities are whole parts of this.
SCALE = 1_000_000_000
#: Counters are sent on when they hold this many entries.
HELD = 400_000
#: Bytes of a term, A-Z in lower case; all others part terms.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def _count_terms(batches):
    """(lang, source, term, n, d): occurrences and documents of each term, added up within the task."""
    held, size = {}, 0

    def rows():
        out = [(lang, source, term, n, docs[term]) for (lang, source), (terms, docs) in held.items() for term, n in terms.items()]
        for at in range(0, len(out), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out[at : at + 100_000], strict=True), (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["lang", "source", "term", "n", "d"])

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = text.translate(_TERMS).split()
            terms, docs = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(terms)
            terms.update(words)
            docs.update(set(words))
            size += len(terms)
            if size >= HELD:
                yield from rows()
                held, size = {}, 0
    yield from rows()


def _p(count: str, divisor: str) -> str:
    """SQL: the scaled probability of a count; decimals, as a common term's count times the scale outgrows a long."""
    return f"cast(1 + cast({SCALE} as decimal(10,0)) * ({count} + 1) div {divisor} as long)"


def _cost(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def postings(docs: DataFrame, least_docs: int = 3) -> DataFrame:
    """(lang, term, source, n, total, first): kept terms with their counts in each source and in the language.

    Rows are dealt once by language and term, already added up by task, so both sums need no further
    shuffle; first marks one row of each term.
    """
    texts = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
    found = texts.mapInArrow(_count_terms, "lang string, source string, term binary, n long, d long")
    sums = found.withColumn("term", F.col("term").cast("string")).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    term = Window.partitionBy("lang", "term")
    wide = sums.select("lang", "term", "source", "n", F.sum("n").over(term).alias("total"), F.sum("d").over(term).alias("_d"), (F.min("source").over(term) == F.col("source")).alias("first"))
    return wide.where(F.col("_d") >= least_docs).drop("_d")


def divergences(docs: DataFrame, least_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): each source against each other one, and its most telling terms.

    Reads the columns text, lang and source alone, null being the empty string, so clashing names do no
    harm; equal rows each count. Every (lang, source) that occurs has a row in part ``pair`` for each other
    source of its language, also when it has no terms; without a kept term all values are 0. Part ``term``
    has the ``top`` terms that the source uses more than its language does. Ties go by item. A text of any
    length is counted whole. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = scratch.write(postings(docs, least_docs), "postings")
    langs = kept.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum("n").alias("lang_n"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    groups = docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["n", "k", "v", "lang_n"]).select("lang", "source", "k", "v", (F.col("n") + F.col("v")).alias("div"), (F.col("lang_n") + F.col("v")).alias("lang_div"))
    # A language without a kept term has nothing to divide by and no terms to sum over.
    groups = scratch.write(groups.withColumn("p0", F.when(F.col("div") > 0, F.expr(_p("0", "div"))).otherwise(1)), "groups")
    priced = scratch.write(kept.join(groups, ["lang", "source"]).select("lang", "term", "source", "n", "p0", F.expr(_p("n", "div")).alias("p"), F.expr(_p("total", "lang_div")).alias("q")), "priced")

    one, other = groups.select("lang", "source", "k", "v", "p0"), groups.select("lang", F.col("source").alias("item"), F.col("k").alias("k2"), F.col("p0").alias("q0"))
    pairs = scratch.write(one.join(other, "lang").where("source <> item"), "pairs")
    # One side has the term: both directions at once, from a histogram row (count, terms) of each source.
    histogram = priced.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m"))
    one_sided = histogram.join(pairs.select("lang", "source", "item", "q0"), ["lang", "source"]).groupBy("lang", "source", "item").agg(F.expr(f"sum(m * {_cost('p', 'q0')})").alias("out"), F.expr(f"sum(m * {_cost('q0', 'p')})").alias("back"))
    alone = one_sided.select("lang", "source", "item", F.col("out").alias("add")).union(one_sided.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("add")))
    # Both have it: each unordered pair meets once for each term.
    a = priced.select("lang", "term", "source", "p", "p0")
    b = priced.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    fix = {f"{x}{y}": F.expr(f"sum({_cost(x, y)} - {_cost(x, y + '0')} - {_cost(x + '0', y)})") for x, y in ("pq", "qp")}
    met = a.join(b, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(*[v.alias(k) for k, v in fix.items()], F.count(F.lit(1)).alias("both"))
    met = met.select("lang", "both", F.explode(F.array(F.struct("source", "item", F.col("pq").alias("add")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("qp").alias("add")))).alias("x")).select("lang", "x.*", "both")
    sums = alone.withColumn("both", F.lit(0).cast("long")).unionByName(met).groupBy("lang", "source", "item").agg(F.sum("add").alias("add"), F.sum("both").alias("both"))
    full = pairs.join(sums, ["lang", "source", "item"], "left").na.fill(0, ["add", "both"])
    value = F.expr(f"add + (v - k - k2 + both) * {_cost('p0', 'q0')}")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_source = full.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")).withColumn("rank", F.row_number().over(order))

    telling = priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_cost("p", "q")).alias("value"))
    by_term = telling.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return by_source.unionByName(by_term)
