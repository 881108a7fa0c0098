"""Operators on groups against brute force: chat, neighbours, mixing, the join, and the pipeline."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphtide.llm import chat, mixing, posting_lists
from graphtide.llm.components import components
from graphtide.llm.signature_trees import Routing, jaccard_components, links, shingle_set

DOC = "doc_id long, text string"


# ---------------------------------------------------------------- components


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5100)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in {y for e in edges for y in e}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- chat


@pytest.mark.parametrize("part", [200_000, 300])
def test_rotation(spark, small, part):
    turns = spark.read.parquet(f"{small}/conversations.parquet")
    rows = chat.rotate_perspectives(turns, part).collect()
    whole, said = {}, {}
    for r in sorted(rows, key=lambda r: r.part):
        whole[r.conv_id, r.perspective] = whole.get((r.conv_id, r.perspective), "") + r.text
        for a, b in zip(r.mask_starts, r.mask_ends, strict=True):
            assert r.text[:a].endswith(f"{chat.OPEN}assistant\n") and r.text[a:b].endswith(chat.CLOSE)
        assert r.n_learned == sum(b - a for a, b in zip(r.mask_starts, r.mask_ends, strict=True))
    for t in sorted(turns.collect(), key=lambda t: t.turn):
        said.setdefault(t.conv_id, []).append((t.role, t.text))
    want = {(c, who): chat.render(ts, who)[0] for c, ts in said.items() for who in {w for w, _ in ts} - {chat.SYSTEM}}
    assert whole == want


def test_odd_turns(spark):
    x = spark.createDataFrame([(1, 0, None, None), (1, 0, "a", "x<|im_start|>"), (None, 1, "b", "y"), (2, 0, "system", "s"), (1, 0, "a", "x<|im_start|>")], "conv_id long, turn long, role string, text string")
    rows = {(r.conv_id, r.perspective): r for r in chat.rotate_perspectives(x.withColumn("part", F.lit(9))).collect()}
    assert set(rows) == {(1, "unknown"), (1, "a"), (None, "b")}
    assert rows[1, "a"].n_turns == 3 and rows[1, "a"].text.count(chat.OPEN) == 3
    assert chat.rotate_perspectives(x.limit(0)).count() == 0


# ---------------------------------------------------------------- neighbours


def check(df, k, least):
    rows = [(int(r.vec_id), r.embedding) for r in df.collect() if r.vec_id is not None and r.embedding and all(c is not None and math.isfinite(c) for c in r.embedding) and any(r.embedding)]
    width = max((len(v) for _, v in rows), default=0)
    rows = sorted({(i, tuple(v) + (0.0,) * (width - len(v))) for i, v in rows})
    got = {}
    for r in posting_lists.nearest(df, k).collect():
        got.setdefault(r.query_id, []).append(r)
    hits = total = 0
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    once = Counter(ids.tolist())
    for q in np.flatnonzero(ids % 20 == 0).tolist() if rows else []:
        if once[int(ids[q])] > 1:
            continue
        score = (x * x[q]).sum(axis=1)
        want = sorted((-s, int(i)) for j, (s, i) in enumerate(zip(score, ids, strict=True)) if j != q)[:k]
        own = sorted(got.get(ids[q], []), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, len(want) + 1))
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        exact = {(int(i), round(float(s), 9)) for i, s in zip(ids, score, strict=True)}
        assert all((r.vec_id, round(r.score, 9)) in exact for r in own)
        hits += len({i for _, i in want} & {r.vec_id for r in own})
        total += len(want)
    assert not total or hits / total >= least
    assert set(got) <= {int(i) for i in ids}
    return got


def test_neighbours(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"), 20, 0.9)


def test_neighbours_of_longer_and_shorter_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in rng.normal(size=8) * rng.exponential()]) for i in range(1500)]
    check(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 10, 0.9)


def test_equal_vectors_and_odd_rows(spark):
    rows = [(i, [1.0, 2.0]) for i in range(100)] + [(200, None), (220, [0.0, 0.0]), (240, [1.0, None]), (None, [1.0, 1.0]), (260, [float("nan"), 1.0]), (280, [1.0]), (300, [-1.0, -2.0]), (300, [-1.0, -2.0]), (320, [])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    check(e, 20, 1.0)
    assert posting_lists.nearest(e.limit(0)).count() == 0 and posting_lists.nearest(e.where("vec_id = 3")).count() == 0


def test_vectors_under_one_id_and_clashing_columns(spark):
    rows = [(i, [float(i % 7), 1.0 + i % 5]) for i in range(1, 40)] + [(40, [1.0, 0.0]), (40, [0.0, 1.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"vid": F.lit("x"), "rank": F.lit(1), "id": F.lit(None).cast("string"), "lists": F.lit(2)})
    got = check(e, 5, 0.9)[40]
    assert sorted(r.rank for r in got) == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]  # both rows are answered
    assert posting_lists.nearest(e.where("vec_id = 40"), 5).select("query_id", "vec_id", "score").collect() == [(40, 40, 0.0)] * 2


def test_boundary_vectors_are_replicated_and_little_is_scanned():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20_000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = posting_lists._lifted(x, 1.0)
    graph = posting_lists.CentroidGraph(posting_lists.balanced_centroids(x[1000:13_000], 2000), x[:1000])
    rows, lists = graph.lists(x)
    assert (np.bincount(rows) > 1).mean() > 0.5 and np.bincount(rows).max() <= posting_lists.REPLICAS
    d = np.sqrt(posting_lists._squares(x[:256].astype(np.float32), graph.points))
    ids, found = graph.search(x[:256], 32)
    assert (found[:, 0] <= d.min(axis=1) + 1e-4).mean() > 0.9
    who, probed = graph.probed(x[:256], 1.15, np.bincount(lists, minlength=2000), 100)
    near = d <= 1.15 * np.maximum(d.min(axis=1), graph.floor)[:, None]
    assert near[who, probed].sum() / near.sum() > 0.95 and len(who) / near.size < 0.25


# ---------------------------------------------------------------- mixing


def test_exponent_meets_its_targets():
    t = {"a": 900, "b": 90, "c": 10}
    a = mixing.bisect_exponent(t, 1000, 0.8 * math.log(3), None)
    assert mixing.entropy(mixing.weights(t, a)) == pytest.approx(0.8 * math.log(3), abs=1e-6)
    a = mixing.bisect_exponent(t, 1000, None, 3.0)
    assert a == 1.0
    a = mixing.bisect_exponent(t, 1000, math.log(3), 3.0)
    assert max(w * 1000 / t[s] for s, w in mixing.weights(t, a).items()) == pytest.approx(3.0, abs=1e-6)


@pytest.mark.parametrize("options", [{}, {"entropy_share": 1.0, "most_repeats": 1.5}, {"budget": 5000}, {"budget": 400_000, "entropy_share": 1.0, "most_repeats": None}])
def test_mixture(spark, small, options):
    d = spark.read.parquet(f"{small}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    plan = mixing.plan_mixture(d, **options)
    rows = plan.epochs.collect()
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in d.collect()}
    assert all(r.tokens == words[r.doc_id] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["_s"], {}).setdefault(r.epoch, []).append(r)
    for s, _, budget, passes, rest, _ in plan.sources:
        epochs = by.get(s, {})
        own = {r.doc_id for r in d.where(f"concat('s', source) = '{s}'").collect()}
        assert set(epochs) == set(range(passes + (rest > 0)))
        for e, rs in epochs.items():
            assert sorted(r.position for r in rs) == list(range(len(rs)))
            if e < passes:
                assert {r.doc_id for r in rs} == own
        used = sum(r.tokens for rs in epochs.values() for r in rs)
        assert budget <= used < budget + max(words.values()) or used == budget
    uses = Counter(r.doc_id for r in rows)
    assert uses == Counter(r.doc_id for r in mixing.mix_documents(d, **options).collect())


def test_odd_sources(spark):
    x = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (2, None, None), (None, "c", None), (3, "", "z")], "doc_id long, text string, source string")
    assert mixing.mix_documents(x.withColumn("tokens", F.lit("mine"))).columns == ["doc_id", "text", "source", "tokens"]
    assert mixing.mixture(x).count() == mixing.mix_documents(x).count()
    assert mixing.mixture(x.limit(0)).count() == 0


# ---------------------------------------------------------------- the join


def brute(rows, k, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = {}
    for i in sorted(range(len(rows)), key=lambda i: len(sets[i])):
        common = Counter(j for s in sets[i] for j in seen.get(s, ()))
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                parent[find(i)] = find(j)
        for s in sets[i]:
            seen.setdefault(s, []).append(i)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    out = Counter()
    for i, (d, _) in enumerate(rows):
        known = [x for x in groups[find(i)] if x is not None]
        out[d, len(sets[i]), min(known) if known else None] += 1
    return out


@pytest.fixture(scope="module")
def near(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rng, extra = random.Random(1), []
    base = docs.where("doc_id = 2").first().text.split(" ")
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(1, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        extra.append((10000 + i, " ".join(w)))
    odd = [(20000, None), (20001, ""), (20002, "a b"), (20003, "a  B"), (20003, "a  B"), (None, "no id one two three"), (20004, "w " * 30_000)]
    return docs.union(spark.createDataFrame(extra + odd, DOC))


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 90, 1_000_000), (3, 90, 5_000), (5, 80, 1_000_000), (5, 80, 3_000), (1, 50, 1_000_000)])
def test_join(near, k, percent, block):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(near.withColumn("n", F.lit(1)), k, percent, block).collect())
    assert got == brute([(r.doc_id, r.text) for r in near.collect()], k, percent)


def test_join_of_nothing(spark):
    assert jaccard_components(spark.createDataFrame([], DOC)).count() == 0


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_routing_loses_no_link(percent):
    routing, rng = Routing(percent), np.random.default_rng(percent)
    tried = 0
    for _ in range(3000):
        n = int(rng.integers(3, 120))
        a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        keep = a[rng.random(len(a)) > rng.random() * 0.3]
        b = np.unique(np.concatenate((keep, rng.integers(0, 1 << 64, int(rng.integers(0, max(1, n // 5))), dtype=np.uint64))))
        if len(b) and not np.array_equal(a, b) and links(a, b, percent):
            tried += 1
            assert np.intersect1d(routing.keys(a), routing.keys(b)).size
    assert tried > 50


def test_shingles():
    assert len(shingle_set("a b c d", 3)) == 2 and len(shingle_set("A b", 3)) == 1 and len(shingle_set(" ", 3)) == 0
    assert (shingle_set("A b", 3) == shingle_set("a\tb\n", 3)).all() and len(shingle_set("É", 3)) == 1
    assert (shingle_set("É", 3) != shingle_set("é", 3)).all()


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark, small, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name.replace(" ", "_"))
        stage(spark, docs, small).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == columns
        if name == "near duplicates":
            want = brute([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
            assert {r.doc_id for r in after.collect()} == {d for d, _, c in want if d == c}
        docs = after
    assert 0 < docs.count() <= 2 * before
    last = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert last.count() == docs.count() and last.where("not round_trip").count() == 0
    assert corpus_pipeline.run(spark, small).count() == docs.count()


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
