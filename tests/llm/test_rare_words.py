"""Words that are not frequent: their counts, estimates of how many there are, and their part of the score."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from graphtide.llm import attention_lm


def test_tail_against_a_plain_count():
    rng = np.random.default_rng(5)
    words, texts, kept, tokens = np.sort(rng.zipf(1.4, 3000) % 400), rng.integers(0, 40, 3000), 0.9, 5000
    logs = rng.uniform(-30, -1, 3000).astype(np.float32)
    logs[7] = -4000  # a very long word
    batches = [pa.RecordBatch.from_arrays([pa.array(words[a : a + 7]), pa.array(texts[a : a + 7]), pa.array(logs[a : a + 7])], ["words", "texts", "given"]) for a in range(0, 3000, 7)]
    out = [x for b in attention_lm._tail(kept, tokens)(iter(batches)) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    c = Counter(w for w, t in zip(words.tolist(), texts.tolist(), strict=True) if t % 2)
    assert len(out) == 3000 and sum(x[3] for x in out) == len(c)
    for (rid, base, known, _, mixed), w, t, log in zip(out, words.tolist(), texts.tolist(), logs.tolist(), strict=True):
        n = c[w]
        assert (rid, known) == (t // 2, int(n > 0)) and base == pytest.approx(math.log10(n + 1))
        p = kept * 10.0**log + max(n - attention_lm.DISCOUNT, 0) / tokens
        assert mixed == pytest.approx(math.log10(p) if p else log + math.log10(kept), rel=1e-6)


@pytest.mark.parametrize("n", [0, 1, 300, 20_000, 500_000])
def test_distinct_words_are_estimated(n):
    h = np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64)
    parts = [np.zeros(1 << attention_lm.REGISTERS, np.int64) for _ in range(2)]
    attention_lm._ranks(h, parts[0])
    attention_lm._ranks(h[: n // 2], parts[1])
    assert attention_lm._distinct(np.maximum(*parts)) == pytest.approx(n, rel=0.03)


def test_a_word_outside_the_frequent_ones_is_known_by_its_count(spark, monkeypatch):
    """With no frequent words at all, a word that comes often still scores above one that never came."""
    monkeypatch.setattr(attention_lm, "HOT_WORDS", 0)
    rows = [(i, f"common tail{i % 50} vorblisky word{i}") for i in range(300)] + [(10_000, "vorblisky"), (10_001, "vurblosky")]
    docs = spark.createDataFrame([*rows, (10_002, None), (10_003, "")], "doc_id long, text string")
    score = {r.doc_id: (r.score, r.n_tokens) for r in attention_lm.score_documents(docs).collect()}
    assert len(score) == 304 and score[10_000][0] > score[10_001][0] + 2
    assert score[10_002] == pytest.approx(score[10_003]) and all(math.isfinite(s) and s < 0 for s, _ in score.values())


def test_the_copying_head_against_a_plain_count():
    rng = np.random.default_rng(5)
    text = np.repeat(np.arange(6), [1, 30, 2, 80, 1, 50])
    h = rng.integers(0, 9, len(text)).astype(np.uint64)
    left, copied = attention_lm._copied(h, text)
    for t in range(6):
        words = h[text == t].tolist()
        for i, at in enumerate(np.flatnonzero(text == t).tolist()):
            share = attention_lm.COPY * i / (i + attention_lm.COPY_FROM)
            assert abs(10 ** left[at] - (1 - share)) < 1e-12
            assert abs(copied[at] - (share * words[:i].count(words[i]) / i if i else 0)) < 1e-12
            # Over all words the head gives what the others leave, so the mixture stays a distribution.
            assert not i or abs(sum(share * words[:i].count(w) / i for w in set(words[:i])) - share) < 1e-12


def test_held_out_texts_of_a_small_table_are_near_the_counts(spark):
    """At sf0.01 a sixth of the held-out tokens is unseen; what a text repeats of them is not spelled again each time."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = attention_lm.score_documents(docs).where("held_out").collect()
    n = sum(r.n_tokens for r in rows)
    assert sum(r.score for r in rows) / n > sum(r.base_score for r in rows) / n - 0.06
    assert min((r.score - r.base_score) / r.n_tokens for r in rows) > -1.5


def test_words_are_counted_over_all_training_texts(monkeypatch):
    """Every training text counts, whatever its place, and no other; counts told in parts add up."""
    monkeypatch.setattr(attention_lm, "FIRST_WORDS", 40)
    rng, start = np.random.default_rng(3), attention_lm.START
    texts = [[(int(rng.zipf(1.3)) % 90 + 3) | start if j % 2 == 0 else int(rng.integers(3, 6)) for j in range(8)] for _ in range(7000)]
    held = [i % 7 == 2 for i in range(7000)]
    ids = [np.array(x, "<u2").tobytes() for x in texts]
    batch = pa.RecordBatch.from_pydict({"rid": list(range(7000)), "held_out": held, "n_tokens": [4] * 7000, "ids": ids})
    got = Counter()
    for b in attention_lm._first_pass(iter([batch])):
        for kind, key, word, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            got[kind, key, word] += n
    want = Counter({(1, 0, None): 4 * held.count(False)})
    for x, h in zip(texts, held, strict=True):
        if not h:
            want.update((0, i & (start - 1), None) for i in x)
            want.update((2, 0, np.array(x[j : j + 2], "<u2").tobytes()) for j in range(0, 8, 2))
    assert got == want
