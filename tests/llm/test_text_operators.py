"""Operators on texts against brute force: sharding, scoring, rules, lines, licences, pieces."""

import math
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphtide.llm import attention_lm, licences, line_dedup, pieces, quality, sharding
from graphtide.llm.common import ordered_prefix

DOC = "doc_id long, text string"
ODD = [(20000, None), (20001, ""), (20002, " \n\t"), (20003, "a b c\na b c\n---\na B  c!"), (None, "null id doc"), (7, "again and again"), (7, "again and again"), (20004, "x" * 200_000)]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(ODD, DOC))


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---------------------------------------------------------------- prefix sums and shards


@pytest.mark.parametrize("batch", [1, 7, 1000])
@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_ordered_prefix(spark, partitions, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    rng = random.Random(partitions)
    rows = [(rng.choice("abc") if i % 3 else "hot", rng.randrange(50), rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o int, w long").repartition(5)
    got = ordered_prefix(df, [F.col("o")], "w", "g", partitions)[0].collect()
    for g in {r[0] for r in rows}:
        own = sorted((r for r in got if r.g == g), key=lambda r: r._pos)
        assert [r._pos for r in own] == list(range(len(own)))
        assert [r.o for r in own] == sorted(r.o for r in own)
        assert [r._before for r in own] == np.cumsum([0] + [r.w for r in own])[:-1].tolist()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)


def test_shards(docs):
    rows = sharding.shard_documents(docs, 24).collect()
    raw = docs.collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in raw)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [(-1 if r.doc_id is None else r.doc_id) for r in order] == sorted(-1 if r.doc_id is None else r.doc_id for r in rows)
    total, biggest = sum(r.size for r in rows), max(r.size for r in rows)
    for s in range(24):
        own = [r for r in rows if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 24) <= biggest
    assert all(r.law == "bytes" and r.grown_shard is None for r in rows)


def test_shards_of_nothing_and_of_equal_rows(spark):
    assert sharding.shard_documents(spark.createDataFrame([], DOC)).count() == 0
    rows = sharding.shard_documents(spark.createDataFrame([(1, "ab")] * 240, DOC)).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in rows) == [10] * 24


# ---------------------------------------------------------------- language model


def test_scores(docs):
    rows = attention_lm.score_documents(docs).collect()
    raw = docs.collect()
    tokens = lambda t: WORD.findall(lower(t)) + [None]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter(w for r in raw if not held(r.doc_id) for w in tokens(r.text))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for r in raw:
        w = tokens(r.text)
        want[r.doc_id, held(r.doc_id), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 5)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows) == want


def test_the_model_beats_the_counts_on_held_out_texts(spark):
    """With 3.3 million training tokens. With a tenth of them the baseline's one count for any unseen word is cheaper."""
    rows = attention_lm.score_documents(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out").collect()
    n = sum(r.n_tokens for r in rows)
    assert sum(r.score for r in rows) / n > sum(r.base_score for r in rows) / n + 0.05


def test_scores_without_training(spark):
    assert attention_lm.score_documents(spark.createDataFrame([], DOC)).count() == 0
    alone = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 7 == 2)
    r = attention_lm.score_documents(spark.createDataFrame([(alone, "a b")], DOC)).first()
    assert (r.train_tokens, r.n_known, r.base_score) == (0, 0, 0.0) and r.score < 0


def test_every_training_target_is_seen(spark):
    size, k, start = 40, 12, attention_lm.START
    ids_n = np.zeros(start, np.int64)
    ids_n[:size] = 1
    class_of = np.full(start, k - 1)
    class_of[:size] = np.minimum(np.arange(size), k - 1)
    none = np.empty(0, np.int64)
    step, near, overall, rest, begins = attention_lm._distributions(ids_n, size, [(none, none)] * 2, class_of, k, np.ones(size, bool))
    empty = attention_lm.Slots(np.empty(0, np.uint64))
    model = attention_lm.Attention(class_of, k, step, near, overall, rest, begins, attention_lm.Prefixes([], empty, empty, np.zeros(1), np.zeros(1)))
    lengths = [1, 7, 8, 9, 40, 56, 57, 200]
    rows = [(n % 5 == 2, bytearray((np.arange(n) % size | start).astype("<u2").tobytes())) for n in lengths]
    df = spark.createDataFrame(rows, "held_out boolean, ids binary").repartition(3)
    seen = sum(r.seen for r in df.mapInArrow(attention_lm._train(spark.sparkContext.broadcast(model)), "seen long, params binary").collect())
    assert seen == sum(n for n in lengths if n % 5 != 2)


def test_the_model_is_a_distribution():
    rng = np.random.default_rng(1)
    size, k = 40, 12
    ids_n = np.zeros(attention_lm.START, np.int64)
    ids_n[:size] = rng.integers(0, 50, size)
    first = np.arange(size) % 2 == 0
    class_of = np.full(attention_lm.START, k - 1)
    class_of[np.argsort(-ids_n[:size], kind="stable")] = np.minimum(np.arange(size), k - 1)
    pairs = [(rng.choice(k * k, 60, replace=False), rng.integers(1, 20, 60)) for _ in range(2)]
    step, near, overall, rest, begins = attention_lm._distributions(ids_n, size, pairs, class_of, k, first)
    start = attention_lm.START
    words = [np.array(w, "<u2").tobytes() for w in ([2 | start, 5], [2 | start, 5, 7], [4 | start], [4 | start, 9])]
    hashed = [attention_lm._hashes(np.frombuffer(w, "<u2"))[0] for w in words]
    hot, states = attention_lm.Slots(np.array([h[-1] for h in hashed])), attention_lm.Slots(np.concatenate(hashed), 23)
    counts, visits = np.full(len(hot), 3), np.full(len(states), 3)
    for h, n in ((hashed[0][0], 20), (hashed[0][1], 10), (hashed[2][0], 15)):
        visits[states.find(np.array([h]))[0]] = n
    model = attention_lm.Attention(class_of, k, step, near, overall, rest, begins, attention_lm.Prefixes(words, hot, states, counts, visits))
    for context in ([], [2 | start], [2 | start, 5], [4 | start, 9, 2 | start], [6 | start, 11]):
        total = 0.0
        for i in range(size):
            ids = np.array([*context, i | start if first[i] else i], "<u2")
            ends = np.array([0, len(ids)])
            a, b, e = model.blocks(ids, ends)
            prob, real, _ = model.forward(model.read(ids), a, b, e)
            total += prob[real][-1]
        assert total == pytest.approx(1.0, abs=1e-4), context


# ---------------------------------------------------------------- rules


def statistics(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if c[x] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_rules(docs, spark, small):
    rows = quality.quality_verdicts(docs).collect()
    want = Counter((r.doc_id, *statistics(r.text)) for r in docs.collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)
    assert not any(r.kept and r.base_failed for r in rows)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    judged = [(labels[r.doc_id], r.kept) for r in rows if r.doc_id in labels and not r.base_failed]
    assert all(kept == bool(good) for good, kept in judged)


def test_order_changes_no_verdict(docs):
    rules = quality.default_rules()
    a = {(r.doc_id, r.kept) for r in quality.quality_verdicts(docs, rules, True).collect()}
    b = {(r.doc_id, r.kept) for r in quality.quality_verdicts(docs, rules[::-1], True).collect()}
    assert a == b


def test_filter_keeps_rows_as_they_are(docs, spark):
    kept = quality.quality_filter(docs.withColumn("n_words", F.lit("mine")).withColumn("kept", F.lit(3)))
    assert kept.columns == ["doc_id", "text", "n_words", "kept"] and kept.count() > 0
    assert quality.quality_filter(spark.createDataFrame([], DOC)).count() == 0


# ---------------------------------------------------------------- lines


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_edit_similarity():
    rng = random.Random(3)
    for _ in range(800):
        a = [rng.choice([b"a", b"b", b"c", b"d%d" % rng.randrange(9)]) for _ in range(rng.randrange(1, 30))]
        b = list(a)
        for _ in range(rng.randrange(0, 8)):
            i = rng.randrange(len(b) + 1)
            if rng.random() < 0.5:
                b.insert(i, b"z")
            elif len(b) > 1:
                b.pop(min(i, len(b) - 1))
        n = max(len(a), len(b))
        assert line_dedup.similar(a, b, 80) == (distance(a, b) <= n * 20 // 100)


def test_lines_against_brute_force(docs, spark):
    """Groups by exact search over all pairs of lines, with an edit distance of the tests' own."""
    rng = random.Random(5)
    base = ["w%d" % rng.randrange(5000) * 2 for _ in range(60)]
    extra = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(60)] = "changed%d" % rng.randrange(1000)
        extra.append((30000 + i, "  ".join(w).upper() + ".\nown line number %d of this %s text" % (i, "abcdefgh"[i % 8])))
    both = docs.where("doc_id is not null").union(spark.createDataFrame(extra, DOC))
    got = {(r.doc_id, r.text) for r in line_dedup.dedup_lines(both).collect()}
    lines, groups = {}, {}
    for r in both.collect():
        for k, line in enumerate(line_dedup.normalised(r.text or "").split(b"\n")):
            if line.split():
                lines.setdefault(b" ".join(line.split()), []).append((r.doc_id, k, zlib.crc32((r.text or "").encode())))
    norms = [n.split() for n in lines]
    number = {}
    masks = [sum(1 << number.setdefault(w, len(number)) for w in set(x)) for x in norms]
    parent = list(range(len(norms)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in enumerate(norms):
        for b, y in enumerate(norms[:a]):
            most = max(len(x), len(y)) * 20 // 100
            # An edit takes one distinct word away at most.
            if abs(len(x) - len(y)) <= most and (masks[a] & masks[b]).bit_count() >= len(set(x)) - most and distance(x, y) <= most:
                parent[find(a)] = find(b)
    for i, places in enumerate(lines.values()):
        groups.setdefault(find(i), []).extend(places)
    gone = set()
    for places in groups.values():
        gone |= set(places) - {min(places)}
    want = set()
    for r in both.collect():
        mark = zlib.crc32((r.text or "").encode())
        kept = None if r.text is None else "\n".join(x for k, x in enumerate(r.text.split("\n")) if (r.doc_id, k, mark) not in gone)
        want.add((r.doc_id, kept))
    assert len(got ^ want) == 0
    assert sum("W" in (t or "") and d >= 30000 for d, t in got) < 40


def test_most_lines_at_the_threshold_are_found(spark):
    """Recall against the edit similarity of all pairs, with a fifth of the words changed; many words are short."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.choice([2, 3, 5, 7]))) for _ in range(4000)]
    lines = []
    for _ in range(300):
        words = [vocabulary[int(4000 * rng.random() ** 2)] for _ in range(rng.randrange(5, 80))]
        lines.append(words)
        changed = list(words)
        for i in rng.sample(range(len(words)), len(words) // 5):
            changed[i] = "new%s" % rng.choice(vocabulary)
        lines.append(changed)
    split = [line_dedup.normalised(" ".join(x)).split() for x in lines]
    true = [(a, b) for a in range(len(split)) for b in range(a) if line_dedup.similar(split[a], split[b], 80)]
    assert len(true) >= 300
    bits = line_dedup.parities(split).view(np.uint64)
    assert all(np.bitwise_count(bits[a] ^ bits[b]).sum() <= 2 * (max(len(split[a]), len(split[b])) // 5) for a, b in true)
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], DOC)
    gone = {r.doc_id for r in line_dedup.dedup_lines(df).collect() if r.n_removed}
    assert gone <= {a for a, _ in true}
    assert len(gone) >= 0.95 * len({a for a, _ in true})


@pytest.mark.parametrize("words", [range(5, 10), range(10, 17), range(17, 40), range(60, 200)])
def test_similar_lines_share_a_key(words):
    """By length, with as many words replaced, dropped and put in as the threshold allows; none is lost up to 16 words."""
    rng, found, total = random.Random(words.start), 0, 0
    for _ in range(400):
        a = [b"%d" % rng.randrange(10**6) if rng.random() < 0.7 else rng.choice([b"a", b"of", b"the"]) for _ in range(rng.choice(words))]
        b = list(a)
        for _ in range(len(a) // 5):
            i = rng.randrange(len(b))
            b[i : i + 1] = rng.choice([[b"new%d" % rng.randrange(10**6)], [], [b[i], b"more"]])
        if a != b and distance(a, b) <= max(len(a), len(b)) * 20 // 100:
            total += 1
            keys, line = line_dedup.line_keys([a, b], 80)
            found += bool(np.intersect1d(keys[line == 0], keys[line == 1]).size)
    assert total > 100 and found >= (1.0 if words.stop <= 17 else 0.97) * total


def test_a_text_of_very_many_lines(spark):
    text = "\n".join(f"line {i // 2:x} of a very long text {i // 2 * 7919:x} here" for i in range(20_000))
    got = line_dedup.dedup_lines(spark.createDataFrame([(1, text, "x")], "doc_id long, text string, _gone string")).first()
    assert (got.n_lines, got.n_removed) == (20_000, 20_000 - len(got.text.split("\n"))) and got.n_removed >= 10_000


def test_lines_of_odd_rows(spark, docs):
    rows = {r.doc_id: r for r in line_dedup.dedup_lines(docs.where("doc_id >= 20000").withColumn("n_lines", F.lit("x"))).collect()}
    assert rows[20000].text is None and rows[20001].text == "" and rows[20002].text == " \n\t"
    assert (rows[20003].text, rows[20003].n_removed) == ("a b c\n---", 2)
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOC)).count() == 0


# ---------------------------------------------------------------- licences


def test_licences(docs, spark):
    stated = {"Apache-2.0": "Licensed under the Apache License, Version 2.0.", "MIT": "Released under the MIT License.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0."}
    for r in licences.scan_licences(docs.union(spark.createDataFrame([(1, f"x y.\n{s} More.") for s in stated.values()], DOC))).join(docs.select("doc_id"), "doc_id", "left_semi").collect():
        assert len(r.licences) == len(r.starts) == len(r.ends) == r.n_matches
    texts = [r.text or "" for r in docs.collect()] + [f"Some words. {s}" for s in stated.values()]
    rules = licences.Rules()
    for t in texts:
        assert Counter(x for x, _, _ in rules.scan(t)) == Counter({k: t.count(v) for k, v in stated.items() if v in t})


def test_licence_texts_in_order():
    s = licences.SENTENCES
    rules = licences.Rules()
    mit = "Copyright (c) 2001 Somebody\n\n" + ".\n\n".join(s[k].replace("documentation", "\n  documentation") for k in ("mit-grant", "mit-notice", "mit-warranty")) + ". " + s["mit-liability"] + "."
    assert [x for x, _, _ in rules.scan(mit)] == ["MIT"]
    bsd = ". ".join([s["bsd-grant"] + "\n\n1", s["bsd-source"] + ".\n\n2", s["bsd-binary"]]) + "."
    assert [x for x, _, _ in rules.scan(bsd)] == ["BSD-2-Clause"]
    assert [x for x, _, _ in rules.scan(bsd + "\n\n3. " + s["bsd-endorse"] + ".")] == ["BSD-3-Clause"]
    assert rules.scan(s["mit-notice"] + ". " + s["mit-grant"]) == []
    assert rules.scan("") == []


def test_every_known_sentence_is_found_on_one_line_and_wrapped():
    rules = licences.Rules()
    stated = [(i, s) for i, s in licences.SENTENCES.items()] + [(f"is-{name}", form.format(x)) for name, names in licences.NAMES.items() for x in [*names, name] for form in licences.STATEMENTS]
    single = {r[1][0]: r[0] for r in licences.TEXT_RULES if len(r[1]) == 1} | {f"is-{n}": n for n in licences.NAMES}
    for i, sentence in stated:
        i = rules.ids[licences.normalise(sentence)]
        shapes = [sentence, sentence + ".", f"Some words come first.\n\n{sentence}.\n\nAnd some behind.", f"no mark here\n{sentence}\nnor here"]
        shapes += [textwrap.fill(sentence, width, break_long_words=False, break_on_hyphens=False) + "." for width in (1, 20, 37, 60, 76)]
        shapes += ["\n".join("# " + x for x in textwrap.wrap(sentence, 60, break_long_words=False, break_on_hyphens=False))]
        for text in shapes:
            if i in single:
                found = rules.scan(text)
                assert [x[0] for x in found] == [single[i]], (sentence, text)
                start, end = found[0][1:]
                assert licences.normalise(text[start:end]) == licences.normalise(sentence)
    hope = licences.SENTENCES["gpl-hope"] + "."
    for free, name in (("gpl-free", "GPL-3.0-or-later"), ("gpl2-free", "GPL-2.0-or-later")):
        for text in (f"{licences.SENTENCES[free]}. {hope}", f"{textwrap.fill(licences.SENTENCES[free] + '.', 70)}\n\n{textwrap.fill(hope, 70)}"):
            (found,) = rules.scan(text)
            assert found[0] == name and licences.normalise(text[found[1] : found[2]]).endswith("particular purpose")
    apache = " ".join([licences.SENTENCES["apache-notice"] + ".", licences.SENTENCES["apache-copy"], "\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n", licences.SENTENCES["apache-basis"] + "."])
    (found,) = rules.scan(apache)
    assert found == ("Apache-2.0", 0, len(apache)) or found[2] >= len(apache) - 1


# ---------------------------------------------------------------- pieces


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(pieces._read_model(pieces.DEFAULT_MODEL))


CASES = ["", "  a  b ", " x", "x ", "\n\n", "日本語 text ▁ foo", "a" * 1000, "\t\ttabs\x00 null", "é" * 100, "==== ---- ____ !!!!!!!!", "the" * 300, " " * 50 + "x", "ab" * 500, "http://www.example.com/index.html?x=1&y=2", "🙂 ok"]


def test_pieces_equal_the_librarys(model, docs):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    for t in CASES + [r.text for r in docs.collect() if r.text and len(r.text) < 50_000]:
        ids = model.encode(t)
        assert ids == own.encode(t)
        assert model.decode(ids) == own.decode(ids)


def test_streaming_equals_the_whole_search(model):
    rng = random.Random(1)
    letters = [c for c in model.chars if c.isalpha()][:60]
    for _ in range(30):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(40, 300)))
        assert [model.pieces[i] for i in model._span(t)] == model.merged(t)


def test_unigram_viterbi(model):
    """The same pieces read as a unigram model: the best sum over all segmentations."""
    from functools import lru_cache

    uni = pieces.PieceModel(pieces._read_model(pieces.DEFAULT_MODEL))
    uni.kind = pieces.UNIGRAM
    rng = random.Random(2)
    for _ in range(30):
        t = "".join(rng.choice("theandringso") for _ in range(rng.randrange(1, 120)))

        @lru_cache(None)
        def best(at, t=t):
            if at == 0:
                return 0.0
            return max(best(at - n) + uni.scores[uni.id_of[t[at - n : at]]] for n in range(1, min(at, uni.longest) + 1) if t[at - n : at] in uni.id_of)

        ids = list(uni._span(t))
        assert "".join(uni.pieces[i] for i in ids) == t
        assert sum(uni.scores[i] for i in ids) == pytest.approx(best(len(t)))


def test_encoded_rows(docs, spark, model):
    rows = pieces.encode_documents(docs)
    raw = docs.collect()
    assert Counter((r.doc_id, None if r.ids is None else tuple(r.ids), r.n_ids, r.round_trip) for r in rows.collect()) == Counter((r.doc_id, None if r.text is None else tuple(model.encode(r.text)), 0 if r.text is None else len(model.encode(r.text)), None if r.text is None else True) for r in raw)
    back = pieces.decode_ids(rows)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r.doc_id, r.text) for r in raw)
    assert pieces.encode_documents(spark.createDataFrame([], DOC)).count() == 0


def test_keys_of_lines_are_packed_by_bucket():
    """A key is 12 bytes of few rows on its way, and what shares one meets, whether its bucket is read whole or in parts."""
    import pyarrow as pa

    rng = random.Random(5)
    lines = [b" ".join(b"%d" % rng.randrange(40) for _ in range(rng.randrange(10, 16))) for _ in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000), pa.int64()), pa.array(lines, pa.binary())], ["h0", "words"])
    keys, line = line_dedup.line_keys([x.split() for x in lines], 80)
    packed = list(line_dedup._keys(80)(iter([batch.slice(0, 1000), batch.slice(1000)])))
    assert sum(len(k) + len(o) for b in packed for k, o in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)) == 12 * len(keys)
    assert sum(b.num_rows for b in packed) <= min(1 << line_dedup.BUCKETS, len(keys))
    together: dict[int, set] = {}
    for k, x in zip(keys.tolist(), line.tolist()):
        together.setdefault(k, set()).add(x)
    true = sorted(sorted(x) for x in together.values() if len(x) > 1)
    assert len(true) > 100
    table = pa.Table.from_batches(packed * 2).sort_by("bucket").to_batches()  # each line twice, as from two tasks
    for most in (1 << 22, 3):
        met: dict[int, set] = {}
        for b in line_dedup._shared(most)(iter(table)):
            for k, x, hub in zip(*(c.to_pylist() for c in b.columns), strict=True):
                met.setdefault(k, set()).update((x, hub))
        assert sorted(sorted(x) for x in met.values()) == true


def test_hashes_of_words():
    """Words have one hash wherever they come, and different words different ones, whatever their length."""
    words = [b"a", b"b", b"ab", b"abcdefgh", b"abcdefghi", b"abcdefghj", b"x" * 256, b"x" * 257, b"x" * 300, b"\x00", b"\x00\x00"]
    hashes, lengths, starts = line_dedup._flat([b" ".join(words), b"ab", b" ".join(words[::-1])])
    n = len(words)
    assert len(set(hashes[:n].tolist())) == n and hashes[n] == hashes[2] and (hashes[n + 1 :] == hashes[:n][::-1]).all()
    assert lengths[:n].tolist() == [len(w) for w in words] and starts.tolist() == [0, n, n + 1]


def test_pairs_are_compared_once(monkeypatch):
    """Lines that meet under several keys are compared at one of them, and rows are told near as by all pairs."""
    import pyarrow as pa

    rng, calls = random.Random(6), []
    lines = [[b"%d" % rng.randrange(10**6) for _ in range(20)] for _ in range(12)]
    lines = [x[: -3 * c] + [b"new%d" % rng.randrange(10**6) for _ in range(3 * c)] if c else x for x in lines for c in range(3)]
    bits, rows = line_dedup.parities(lines).view(np.int64), []
    for key in range(4):
        for k, x in enumerate(lines):
            rows.append((key, 0, 0, 0, k, k, *bits[k].tolist(), len(x), b" ".join(x), [0, 1, 2, 3]))
    kinds = [pa.int64(), *[pa.int32()] * 3, *[pa.int64()] * 5, pa.int32(), pa.binary(), pa.list_(pa.int64())]
    table = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [*line_dedup._OPEN_NAMES, "words", "keys"])
    similar = line_dedup.similar
    monkeypatch.setattr(line_dedup, "similar", lambda a, b, percent: calls.append((tuple(a), tuple(b))) or similar(a, b, percent))
    links = [x for b in line_dedup._compare(80)(iter([table.slice(0, 50), table.slice(50)])) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    true = {frozenset((a, b)) for a in range(36) for b in range(a) if similar(lines[a], lines[b], 80)}
    assert len(calls) == len(set(calls)) and links and {frozenset(x) for x in links} <= true and {a // 3 for a, _ in links} == set(range(12))
    close = {a for a in range(36) for b in range(36) if a != b and np.bitwise_count(bits[a].view(np.uint64) ^ bits[b].view(np.uint64)).sum() <= 8}
    for most in (1 << 19, 50):
        told = [x for b in line_dedup._within(80, most)(iter([table.slice(0, 7).select(range(10)), table.slice(7, 60).select(range(10)), table.slice(67).select(range(10))])) for x in b.column(4).to_pylist()]
        assert told == sorted(close) * 4
