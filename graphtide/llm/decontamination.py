"""Benchmark passages in documents: a prefix-filtered join of word shingles, native throughout.

An item's windows of words are sets of shingles. A text can hold a window only if it holds all of its
shingles, so its rarest one is the prefix that must be met; where it is met, its place in the window gives
the one start that is possible, which must lie within the text, and the words there are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, lower_ascii, with_row_ids

#: Words of a shingle; shorter items are one shingle.
SHINGLE = 3
#: So many distinct shingles go into the scan of the documents as a set; more of them are joined in a shuffle.
MOST_LITERALS = 20_000


def _parts(text: Column) -> Column:
    """Runs of letters, digits and all beyond ASCII, A-Z in lower case; the first and the last may be empty."""
    return F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _with_words(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_words`` and ``n_words``; only the first and the last part can be empty."""
    rows = rows.withColumn("_parts", _parts(F.col(text)))
    head, tail = (F.element_at("_parts", k) == "" for k in (1, -1))
    rows = rows.withColumn("_words", F.slice("_parts", 1 + head.cast("int"), F.greatest(F.lit(0), F.size("_parts") - head.cast("int") - tail.cast("int"))))
    return rows.withColumn("n_words", F.size("_words").cast("long")).drop("_parts")


def _shingle(words: str, i: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(F.col(words), i + j) for j in range(k)])


def _places(n: Column, k: int) -> Column:
    return F.when(n >= k, F.sequence(F.lit(0), (n - k).cast("int"))).otherwise(F.array().cast("array<int>"))


def _shingled(words: str, places: Column, k: int, **more) -> Column:
    """An array of (i, h, more): place and shingle, and what each of more makes of the place."""
    return F.transform(places, lambda i: F.struct(i.alias("i"), _shingle(words, i, k).alias("h"), *[f(i).alias(name) for name, f in more.items()]))


def _among(words: str, places: Column, k: int, known: list[int]) -> Column:
    return F.filter(places, lambda i: _shingle(words, i, k).isin(known))


def item_windows(items: DataFrame, size: int = 10) -> DataFrame:
    """(item_id, window): each distinct run of ``size`` words of an item; all its words where it has fewer; null ids are ''."""
    rows = _with_words(items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")).where("n_words > 0")
    width = F.least(F.col("n_words"), F.lit(size)).cast("int")
    return rows.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - width), lambda i: F.slice("_words", i + 1, width))).alias("window")).distinct()


def _met(docs: DataFrame, shingles: DataFrame, lengths: list[int], size: int, most: int, scratch: Scratch) -> DataFrame:
    """The documents with ``_met``: places, shingles and surrounding words wherever an item's shingle comes."""
    few = [r[0] for r in shingles.select("h").distinct().limit(most + 1).collect()]
    rows = _with_words(with_row_ids(docs))
    around = lambda i: F.slice("_words", F.greatest(i - (size - 1), F.lit(0)) + 1, F.least(i, F.lit(size - 1)) + size)
    if len(few) <= most:
        for k in lengths:
            rows = rows.withColumn(f"_at{k}", _among("_words", _places(F.col("n_words"), k), k, few))
    else:
        rows = scratch.write(rows, "words")
        every = [rows.select("_rid", F.explode(_shingled("_words", _places(F.col("n_words"), k), k)).alias("x")).select("_rid", "x.*") for k in lengths]
        for k, places in zip(lengths, every, strict=True):
            found = places.join(shingles.where(F.col("k") == k).select("h").distinct(), "h", "left_semi").groupBy("_rid").agg(F.collect_list("i").alias(f"_at{k}"))
            rows = rows.join(found, "_rid", "left").withColumn(f"_at{k}", F.coalesce(f"_at{k}", F.array().cast("array<int>")))
    each = [_shingled("_words", F.col(f"_at{k}"), k, near=around) for k in lengths]
    empty = F.array().cast("array<struct<i:int,h:bigint,near:array<string>>>")
    return rows.withColumn("_met", F.concat(*each) if each else empty).drop("text", "_words", *[f"_at{k}" for k in lengths])


def leaks(docs: DataFrame, items: DataFrame, size: int = 10, most: int = MOST_LITERALS, name: str = "leaks") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with row ids and n_words in place of the text, the places of windows (_rid, start, width) and the items met (_rid, item_id).

    docs: any columns with text among them; items: item_id and text. Null and empty texts have no words and
    are in no place; a text of any length is read whole; repeated rows are rows of their own; items that
    share a window all count, items of one id count once. Empty tables give empty results.
    """
    scratch = Scratch(docs.sparkSession, name)
    owners = scratch.write(item_windows(items, size), "owners")
    windows = scratch.write(owners.select("window").distinct().withColumn("wid", F.monotonically_increasing_id()).withColumn("width", F.size("window")), "windows")
    lengths = sorted(min(SHINGLE, r[0]) for r in windows.select(F.least("width", F.lit(SHINGLE)).alias("k")).distinct().collect())
    parts = [windows.where(F.least("width", F.lit(SHINGLE)) == k).select("wid", F.lit(k).alias("k"), F.explode(_shingled("window", _places(F.col("width"), k), k)).alias("x")).select("wid", "k", F.col("x.i").alias("j"), "x.h") for k in lengths]
    shingles = windows.select("wid", F.lit(0).alias("k"), F.lit(0).alias("j"), F.lit(0).cast("long").alias("h")).limit(0)
    for p in parts:
        shingles = shingles.union(p)
    shingles = scratch.write(shingles, "shingles")

    rows = scratch.write(_met(docs.drop("n_words", "_rid", "_met"), shingles, lengths, size, most, scratch), "rows")
    met = rows.where(F.size("_met") > 0).select("_rid", "n_words", F.explode("_met").alias("x")).select("_rid", "n_words", "x.*")
    # Rarity is counted over all documents; a window with a shingle that comes nowhere cannot come either.
    rarity = met.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    prefix = shingles.join(rarity, "h", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "j", "h")).alias("x")).where("x.n > 0")
    prefix = scratch.write(prefix.select("wid", "x.j", "x.h").join(windows, "wid"), "prefix")
    start = F.col("i") - F.col("j")
    # Place and length bound first; then the words themselves.
    near = met.join(prefix, "h").where((start >= 0) & (start + F.col("width") <= F.col("n_words")))
    near = near.where(F.slice("near", start - F.greatest(F.col("i") - (size - 1), F.lit(0)) + 1, F.col("width")) == F.col("window"))
    places = scratch.write(near.select("_rid", start.alias("start"), "width", "wid").distinct(), "places")
    named = places.select("_rid", "wid").distinct().join(windows.select("wid", "window"), "wid").join(owners, "window").select("_rid", "item_id").distinct()
    return rows.drop("_met"), places.select("_rid", "start", "width").distinct(), named


def leak_spans(places: DataFrame) -> DataFrame:
    """(_rid, start, end): the words covered by any place, as longest runs; end is the word behind."""
    word = places.select("_rid", F.explode(F.sequence("start", F.col("start") + F.col("width") - 1)).alias("w")).distinct()
    island = F.col("w") - F.row_number().over(Window.partitionBy("_rid").orderBy("w"))
    return word.withColumn("_island", island).groupBy("_rid", "_island").agg(F.min("w").alias("start"), (F.max("w") + 1).alias("end")).drop("_island")


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, most: int = MOST_LITERALS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), a row for each document; see :func:`leaks`.

    Without items a document has the digest of the empty string. Ids of items are sorted as strings.
    """
    rows, places, named = leaks(docs.select("doc_id", "text"), items, size, most)
    hit = leak_spans(places).groupBy("_rid").agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("n_hit"))
    ids = named.groupBy("_rid").agg(F.sort_array(F.collect_list("item_id")).alias("_ids"))
    out = rows.select("_rid", "doc_id", "n_words").join(hit, "_rid", "left").join(ids, "_rid", "left")
    ids = F.coalesce("_ids", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, most: int = MOST_LITERALS) -> DataFrame:
    """The documents that hold no window of any item, with the columns that came in."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows, places, _ = leaks(docs.select(own.alias("_row"), "text"), items, size, most)
    return rows.join(places.select("_rid").distinct(), "_rid", "left_anti").select("_row.*")
