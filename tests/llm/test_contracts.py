"""Operators against their SQL, and operators and stages on odd tables: nulls, repeats, clashing names, no rows."""

import pytest
from compare import expected, found
from pyspark.sql import functions as F

from graphtide.llm import attention_lm, chat, licences, line_dedup, mixing, pieces, quality, sharding, signature_trees
from graphtide.llm.queries import ORACLE_SQL, QUERIES

ROW = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = " ".join(f"word{i} of{i % 7}" for i in range(60))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, small, name):
    assert found(QUERIES[name](spark, small)) == expected(ORACLE_SQL[name], small)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, WORDS, "en", "a", len(WORDS)), (2, WORDS + " more", "en", "a", 1), (2, "Another text, " + " ".join(f"x{i} y{i}" for i in range(80)), "en", None, None),
        (None, "No id here " + " ".join(f"p{i} q{i}" for i in range(80)), None, "b", 3), (None, "No id here " + " ".join(f"p{i} q{i}" for i in range(80)), None, "b", 3),
        (4, None, "en", "a", 0), (4, None, "en", "a", 0), (5, "", "en", "b", 0), (6, " \n\t", None, None, 3), (7, "z " * 40_000, "en", "b", 80_000), (1, WORDS, "en", "a", len(WORDS)),
    ]
    return spark.createDataFrame(rows, ROW)


CLASH = ("n_words", "n_lines", "n_removed", "kept", "_gone", "_id", "_th", "_text", "rid", "th", "comp", "size", "shard", "slot", "epoch", "weight", "tokens", "position", "score", "ids", "_row", "_s", "_0", "_1")


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_tables(spark, odd, stage):
    import corpus_pipeline

    f = corpus_pipeline.STAGES[stage][1]
    plain = f(spark, odd, "").drop("n_tokens")
    assert f(spark, odd.limit(0), "").count() == 0
    wide = odd.withColumns({c: F.lit(f"mine {c}") for c in CLASH})
    got = f(spark, wide, "")
    columns = odd.columns if stage < 4 else plain.columns
    assert found(got.select(*columns)) == found(plain.select(*columns))
    if stage < 4:
        assert got.columns == wide.columns and got.where(" or ".join(f"`{c}` <> 'mine {c}'" for c in CLASH)).count() == 0
    if stage == 2:
        ids = sorted((r.doc_id is None, r.doc_id or 0, (r.text or "")[:8]) for r in plain.collect())
        # Of 1 and its copies the first; the other text of 2 and one of the null ids stay; texts without words all stay.
        assert ids == [(False, 1, "word0 of"), (False, 2, "Another "), (False, 4, ""), (False, 4, ""), (False, 5, ""), (False, 6, " \n\t"), (False, 7, "z z z z "), (True, 0, "No id he")]


def test_operators_on_clashing_names_and_no_rows(spark, odd):
    """Columns that share names with those that an operator makes change none of its values, and no rows give no rows."""
    sure = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"]  # of scoring; the model's own score isn't told here
    operators = {
        "sharding": lambda d: sharding.shard_documents(d, 3), "scoring": lambda d: attention_lm.score_documents(d).select(*sure), "rules": quality.quality_verdicts, "licences": licences.scan_licences,
        "lines": line_dedup.dedup_lines, "mixture": mixing.mixture, "join": signature_trees.jaccard_components, "pieces": pieces.encode_documents,
    }
    wide = odd.withColumns({c: F.lit(f"mine {c}") for c in CLASH})
    for name, f in operators.items():
        plain = f(odd)
        assert f(wide.limit(0)).count() == 0, name
        assert plain.count() >= odd.count() - 3, name
        assert found(f(wide).select(*plain.columns)) == found(plain), name
    turns = spark.createDataFrame([(1, 1, "a", "x" * 500_000), (1, 2, "b", "y"), (1, 2, "b", "y"), (None, None, None, None)], "conv_id long, turn long, role string, text string").withColumns({"part": F.lit("p"), "_key": F.lit("k"), "speaker": F.lit("s")})
    rows = chat.rotate_perspectives(turns).collect()
    assert sum(len(r.text) for r in rows if r.conv_id == 1 and r.perspective == "a") > 500_000 and len({(r.conv_id, r.perspective) for r in rows}) == 3


def test_training_earns_its_place(spark):
    """Held-out texts score higher with the trained attention than with that it starts from."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    mean = lambda: attention_lm.score_documents(docs).where("held_out").agg(F.sum("score") / F.sum("n_tokens")).first()[0]
    trained, unpack = mean(), attention_lm.Attention.unpack
    try:
        attention_lm.Attention.unpack = lambda self, flat: None
        assert trained > mean() + 0.3
    finally:
        attention_lm.Attention.unpack = unpack
