"""Source divergence, decontamination and resampling against brute force on odd tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphtide.llm import decontamination, divergence, resampling

ROW = "doc_id long, text string, lang string, source string"
CLASH = ("n_words", "n_hit", "n_items", "_rid", "_words", "_met", "value", "rank", "item", "part", "term", "n", "score", "weight", "_row", "_text", "h", "start", "bucket")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
UP = {v: k for k, v in LOW.items()}
LEAK = "Ten words make one window and this item has fourteen of them, 12 Été"


def rows():
    out = [(i, " ".join(f"w{(i * 7 + j * j) % 41} ab{chr(97 + (i + j) % 5)} É{j % 3}" for j in range(10 + i % 17)), ("en", "de", None)[i % 3], f"s{i % 4}" if i % 5 else None) for i in range(60)]
    out += [(100, None, "en", "s0"), (101, "", "xx", "lone"), (102, " .\n", "xx", None), (103, "once only here", "yy", "a"), (None, "No id " * 15, "en", "s1"), (None, "No id " * 15, "en", "s1")]
    out += [(104, f"before {LEAK} after", "en", "s2"), (105, LEAK.upper().replace("É", "é"), "en", "s2"), (106, "x " * 30_000 + LEAK + " tiny item " + "x " * 30_000, "en", "s3"), (107, "one window and this item has fourteen of them", "en", "s3"), (108, "Tiny, ITEM", "en", "s3"), (104, f"before {LEAK} after", "en", "s2")]
    return out + [(200 + i, "the same text for all of them " * 6, "en", "s0") for i in range(40)]


ITEMS = [(1, LEAK), (2, "tiny item"), (3, None), (4, " - "), (5, "nobody has these words at all in any text of theirs"), (None, LEAK), (2, "tiny item"), (10, LEAK + " more")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(), ROW)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def wide(df):
    return df.withColumns({c: F.lit(f"mine {c}") for c in CLASH})


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


# ---------------------------------------------------------------- divergence


def brute_divergence(table, top=200):
    docs, counts, groups = {}, {}, set()
    for _, text, lang, source in table:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW)))
        docs.setdefault(lang, Counter()).update(set(found))
        counts.setdefault((lang, source), Counter()).update(found)
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        one = lambda s: {t: counts[lang, s][t] for t in kept}  # noqa: E731,B023
        total = {t: sum(counts[g][t] for g in groups if g[0] == lang) for t in kept}
        p = lambda n, t: 1 + 10**9 * (n[t] + 1) // (sum(n.values()) + len(kept))  # noqa: E731,B023
        own = one(source)
        sums = []
        for other in (s for la, s in groups if la == lang and s != source):
            q = one(other)
            sums.append((-sum((p(own, t) - p(q, t)) ** 2 // p(q, t) for t in kept), other))
        terms = [(-((p(own, t) - p(total, t)) ** 2 // p(total, t)), t) for t in kept if own[t] and p(own, t) > p(total, t)]
        for part, found in (("pair", sorted(sums)), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
            out += [(lang, source, part, item, -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("held", [divergence.HELD, 5])
def test_divergence(spark, odd, held, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", held)
    for df in (odd.repartition(5), wide(odd)):
        assert sorted(map(tuple, divergence.divergences(df, top=7).collect())) == brute_divergence(rows(), 7)
    assert divergence.divergences(odd.limit(0)).count() == 0


# ---------------------------------------------------------------- decontamination


def brute_contamination(table, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(len(w) - min(len(w), size) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    out = []
    for doc, text, *_ in table:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[x]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=key)


@pytest.mark.parametrize("most", [decontamination.MOST_LITERALS, 3])
def test_contamination(spark, odd, items, most):
    want = brute_contamination(rows(), ITEMS)
    assert sum(r[-1] for r in want) == 5
    for df in (odd.repartition(3), wide(odd)):
        assert sorted(map(tuple, decontamination.contamination(df, wide(items), most=most).collect()), key=key) == want
    assert decontamination.contamination(odd.limit(0), items, most=most).count() == 0
    assert not decontamination.contamination(odd, items.limit(0), most=most).where("contaminated or n_items > 0").count()


def test_leaks_name_places_and_clean_rows_stay(spark, odd, items):
    docs, places, _ = decontamination.leaks(odd, items)
    spans = {r.doc_id: (r.start, r.end) for r in decontamination.leak_spans(places).join(docs, "_rid").collect()}
    assert spans == {104: (1, 15), 105: (0, 13), 106: (30_000, 30_016), 108: (0, 2)}
    mine = wide(odd)
    clean = decontamination.decontaminate(mine, items)
    assert clean.columns == mine.columns
    assert sorted(map(tuple, clean.collect()), key=key) == sorted(map(tuple, mine.where("doc_id is null or doc_id not in (104, 105, 106, 108)").collect()), key=key)


def test_planted_passages_are_caught(spark):
    """Every benchmark text of the smallest tables, cut to any window, is caught wherever it is put."""
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    made = []
    for r in bench.collect():
        w = r.text.split()
        made += [(r.item_id * 10 + k, "Before it. " + " ".join(w[at : at + 12]).translate(UP) + "; behind") for k, at in enumerate(range(0, len(w) - 12, 7))]
    got = decontamination.contamination(spark.createDataFrame(made, "doc_id long, text string"), bench)
    assert got.where("contaminated").count() == len(made)


# ---------------------------------------------------------------- resampling


def brute_resampling(table, items, percent, least, buckets, longest):
    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(), Counter()
    for r in table:
        s.update(features(r[1]))
    for r in items:
        t.update(features(r[1]))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets))))
    known, out = {b: gain(b) for b in {*s, *t}}, []
    for doc, text, *_ in table:
        f = features(text)
        weight = sum(known[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= least])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=key)


@pytest.mark.parametrize("percent, least, buckets, longest", [(10, 20, 10_000, 1), (45, 3, 7, 1), (100, 0, 50, 3), (0, 0, 10, 2)])
def test_resampling(spark, odd, items, percent, least, buckets, longest, monkeypatch):
    monkeypatch.setattr(resampling, "SLICE", 500)
    monkeypatch.setattr(resampling, "HELD", 20)
    want = brute_resampling(rows(), ITEMS, percent, least, buckets, longest)
    for df in (odd.repartition(4), wide(odd)):
        got = resampling.resampled(df, wide(items), percent, least, buckets, longest)
        assert sorted(map(tuple, got.collect()), key=key) == want
    assert resampling.resampled(odd.limit(0), items).count() == 0
    assert resampling.resampled(odd, items.limit(0), percent, least, buckets, longest).count() == odd.count()


def test_repeated_rows_beyond_the_cutoff(spark, items):
    many = spark.createDataFrame([(1, "a b c d e f g h " * 4)] * 30 + [(2, "a b c d e f g h " * 4)] * 10, "doc_id long, text string")
    got = resampling.resampled(many, items, percent=50)
    assert got.count() == 40 and sorted(r["rank"] for r in got.where("rank is not null").collect()) == list(range(1, 21))


def test_drawn_rows_come_whole(spark, odd, items):
    mine = wide(odd)
    drawn = resampling.resample(mine, items, percent=20)
    ids = {r.doc_id for r in resampling.resampled(odd, items, percent=20).where("rank is not null").collect()}
    assert drawn.columns == mine.columns and {r.doc_id for r in drawn.collect()} == ids
    assert drawn.exceptAll(mine).count() == 0
