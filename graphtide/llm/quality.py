"""Quality rules as a short-circuit cascade of native expressions.

Each rule is a Column over the frame that :func:`with_statistics` makes. The order in which the cascade
tries them comes from a bounded sample: the rule that rejects most per unit of cost goes first. The order
changes only the time, never a verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, Scratch

_BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """fails: true for a document that the rule rejects; null counts as false."""

    name: str
    fails: Column


def default_rules() -> list[Rule]:
    """The rules of the method's verdict, in the order used where a sample says nothing."""
    n = F.col("n_words")
    return [
        Rule("symbol_ratio", F.col("n_symbols") > 0.1 * n),
        Rule("word_length", (F.col("word_chars") < 2.5 * n) | (F.col("word_chars") > 12 * n)),
        Rule("duplicate_lines", 2 * F.col("n_dup_lines") > F.col("_n_lines")),
        Rule("distinct_words", 20 * F.size(F.array_distinct("_words")) < n),
        Rule("letters", F.regexp_count("_text", F.lit(r"\p{L}")) < 0.5 * F.col("word_chars")),
        Rule("ellipsis_lines", 10 * F.regexp_count("_text", F.lit(r"(?m)(\.\.\.|…)$")) > 3 * F.col("_n_lines")),
        Rule("bullet_lines", 10 * F.regexp_count("_text", F.lit(r"(?m)^[ \t]*[•*-] ")) > 9 * F.col("_n_lines")),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """Adds the base statistics, and ``_text``, ``_words`` and ``_n_lines`` for the rules.

    A null text counts as empty: no words, no lines. Words are the runs between ASCII white space.
    A word is repeated when a window of three words around it occurs twice or more in the text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    inner = F.trim(F.col("_text"), F.lit(_BLANKS))
    d = docs.withColumn("_text", text)
    d = d.withColumn("_words", F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, ASCII_SPACE)))
    d = d.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.trim(x, F.lit(_BLANKS)) != ""))
    d = d.withColumn("n_words", F.size("_words").cast("long"))
    d = d.withColumn("_n_lines", F.size("_lines"))
    d = d.withColumns(
        {
            "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.col("_n_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_windows": F.when(
                F.col("n_words") >= 3,
                F.transform(F.sequence(F.lit(1), (F.col("n_words") - 2).cast("int")), lambda i: F.concat_ws(" ", *[F.element_at(F.col("_words"), i + k) for k in range(3)])),
            ).otherwise(F.array().cast("array<string>")),
        }
    )
    # Most texts repeat no window; only the others sort theirs, with places, to find the equal neighbours.
    repeats = F.size("_windows") > F.size(F.array_distinct("_windows"))
    d = d.withColumn("_sorted", F.when(repeats, F.array_sort(F.transform("_windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))))
    n = F.size("_sorted")

    def neighbour(i, step):
        return F.get(F.col("_sorted"), i + step)["w"]

    d = d.withColumn("_repeated", F.filter(F.transform("_sorted", lambda x, i: F.when((x["w"] == F.coalesce(neighbour(i, -1), F.lit(""))) | (x["w"] == F.coalesce(neighbour(i, 1), F.lit(""))), x["i"])), lambda x: x.isNotNull()))
    covered = F.array_distinct(F.flatten(F.transform("_repeated", lambda p: F.array(p, p + 1, p + 2))))
    d = d.withColumn("n_repeat_words", F.when(n > 0, F.size(covered)).otherwise(0).cast("long"))
    return d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def cascade_order(docs: DataFrame, rules: list[Rule], sample_rows: int = 800, seed: int = 7, repeats: int = 10) -> list[Rule]:
    """Orders rules by rejection per cost, both estimated on about sample_rows rows, never more than twice that.

    The sample is written with its statistics, so that a rule's time is that of its own expression; each
    rule runs over ``repeats`` copies of it. An empty sample leaves the order as it is.
    """
    scratch = Scratch(docs.sparkSession, "rule-sample")
    fraction = min(1.0, sample_rows / max(docs.count(), 1))
    sample = scratch.write(with_statistics(docs.sample(fraction, seed).limit(2 * sample_rows)), "rows").where(~F.col("base_failed"))
    copies = sample.select(*sample.columns, F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("_copy"))

    def run(fails: Column) -> tuple[float, int, int]:
        began = time.perf_counter()
        row = copies.agg(F.count_if(fails), F.count(F.lit(1))).first()
        return time.perf_counter() - began, row[0], row[1]

    idle = min(run(F.col("n_words") < 0)[0] for _ in range(2))
    found = []
    for k, rule in enumerate(rules):
        cost, rejected, seen = run(F.coalesce(rule.fails, F.lit(False)))
        found.append((-(rejected / seen if seen else 0) / max(cost - idle, 1e-3), k))
    scratch.drop()
    return [rules[k] for _, k in sorted(found)]


def quality_verdicts(docs: DataFrame, rules: list[Rule] | None = None, ordered: bool = False) -> DataFrame:
    """Adds the base statistics, ``base_failed`` and ``kept`` to the documents.

    kept is false for a text that fails the base test; else the rules are tried one after another and the
    first that fails ends the cascade. With ordered, the rules run in the order given.
    Null, empty and blank texts fail the base test. An empty table gives an empty result. Columns of the
    input whose names clash with the results are replaced.
    """
    rules = default_rules() if rules is None else rules
    clash = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    docs = docs.drop(*clash)
    if not ordered:
        docs_for_sample = docs.select("text")
        rules = cascade_order(docs_for_sample, rules)
    kept = F.lit(True)
    for rule in reversed(rules):
        kept = F.when(F.coalesce(rule.fails, F.lit(False)), F.lit(False)).otherwise(kept)
    # The last conjunct is true and not deterministic: a filter on the verdict stays above these projections.
    # Pushed below, it would be rewritten with each array's whole expression in place of its column.
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(kept) & (F.monotonically_increasing_id() >= 0)
    return with_statistics(docs).withColumn("kept", kept).drop("_text", "_words", "_lines", "_windows", "_sorted", "_repeated", "_n_lines")


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns that came in."""
    names = docs.columns
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("text"))
    return quality_verdicts(d).where("kept").select("_row.*")
