"""Scores of texts by a causal self-attention language model in numpy, beside a word-count baseline.

A text is read as subword ids of its lower-cased words, with an end mark. The model is one layer of causal
attention over overlapping windows: the position before a target asks, the positions in its window and a
sink answer, and the value of a position is a distribution over the target. One step before, it is what
follows the word begun so far, for the prefixes of frequent words, and what follows the id, for the rest;
further back, it is what comes near the id; the sink's value is the overall distribution. So the mixture
that the attention weights make is a probability, and no softmax over the vocabulary is needed. The values
are counts over all training texts; the asking and answering vectors, the offsets' biases and the sink are
trained by gradient descent, in each task on every block of every training text, and averaged.

Words that are not frequent are counted over all training texts in a shuffle by word, so what is known of
words grows with the corpus. They get their counts, each less DISCOUNT, over all training tokens; what that
leaves is shared as the attention has it, for all words. A last head attends to all earlier
words of the text alike and gives each of them again: its share grows from none at a text's first word to COPY.
All word sequences together have a probability of one at most, but for the error of an estimate of how many such words there are (taken 3 % low for it).

Ids are taken by frequency: the most frequent ``CLASSES - 1`` stand for themselves, the others share a class
and are told apart by their overall frequencies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches
from .pieces import DEFAULT_MODEL, SPACE, _read_model

CLASSES, WIDTH, CONTEXT, STRIDE = 1536, 8, 8, 8
#: Gradient steps that a task's training texts give at least, in batches of from LEAST to MOST blocks.
STEPS, LEAST, MOST = 300, 64, 1024
#: Frequent words are counted in place; only the others are shuffled. Any choice gives the same counts; only
#: frequent words have prefixes.
HOT_WORDS = 1 << 17
#: Distinct words that a task counts before it sends the counts on.
FIRST_WORDS = 300_000
#: Tokens that a distribution counts from the one behind it: after an id, and after a word's beginning.
PRIOR, PREFIX_PRIOR = 10.0, 1.0
DISCOUNT = 0.75  # of the count of a word that is not frequent, left to its spelling
COPY, COPY_FROM = 0.15, 20.0  # share of the words before in a long text, and the words after which it is half of that
REGISTERS = 14  # bits of the register number in estimates of distinct words, whose standard error is 0.8 %
START = 1 << 15  # flag of a word's first id
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


# ---------------------------------------------------------------- tokens


class _Words(dict):
    """Lower-cased word -> its ids as bytes; the older half goes when full."""

    def __init__(self, model: bytes, size: int = 400_000):
        import sentencepiece

        super().__init__()
        self.processor, self.half, self.older = sentencepiece.SentencePieceProcessor(model_proto=model), size // 2, {}
        if self.processor.get_piece_size() >= START:
            raise ValueError(f"a vocabulary of {START - 1} pieces at most")
        self.end = np.array([self.processor.eos_id() | START], "<u2").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        data = self.older.get(word)
        if data is None:
            ids = np.array(self.processor.encode(word.decode("utf-8", "replace")) or [self.processor.unk_id()], "<u2")
            ids[0] |= START
            data = ids.tobytes()
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[word] = data
        return data


_WORDS: dict[int, _Words] = {}


def _tokens(shipped):
    """(doc_id, held_out, text) -> (rid, doc_id, held_out, n_tokens, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = _WORDS.get(shipped_id := hash(shipped.value))
        if words_of is None:
            _WORDS.clear()
            words_of = _WORDS[shipped_id] = _Words(shipped.value)
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            counts, ids = [], []
            for text in batch.column(2):
                value = text.as_py()
                words = value.encode("utf-8", "surrogatepass").lower().split() if value else []
                counts.append(len(words) + 1)
                ids.append(b"".join(map(words_of.__getitem__, words)) + words_of.end)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(range(rid, rid + n), pa.int64()), batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], ["rid", "doc_id", "held_out", "n_tokens", "ids"])
            rid += n

    return run


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column, and where each row begins, with the end."""
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), "<u2"), np.cumsum([0] + [len(x) // 2 for x in data])


def _hashes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each id a 64-bit hash of its word up to it; where words begin; and where they end."""
    begins = ids >= START
    begins[:1] = True
    starts = np.flatnonzero(begins)
    lengths = np.diff(np.append(starts, len(ids)))
    place = np.arange(len(ids)) - np.repeat(starts, lengths)
    x = (ids.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(16)) + np.uint64(1)) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    x ^= x >> np.uint64(32)
    total = np.cumsum(x)
    return total - np.repeat(total[starts] - x[starts], lengths), starts, starts + lengths - 1


def _ranks(h: np.ndarray, ranks: np.ndarray) -> None:
    """Notes hashes in registers: in each, the most leading zeros of a hash there, and one."""
    rest = (h << np.uint64(REGISTERS)).astype(np.float64) / 2.0**64
    np.maximum.at(ranks, (h >> np.uint64(64 - REGISTERS)).astype(np.int64), np.floor(-np.log2(np.maximum(rest, 2.0**-50))).astype(np.int64) + 1)


def _distinct(ranks: np.ndarray) -> float:
    """About how many distinct hashes were noted."""
    m = len(ranks)
    zeros = int((ranks == 0).sum())
    about = 0.7213 / (1 + 1.079 / m) * m * m / (2.0**-ranks.astype(np.float64)).sum()
    return m * float(np.log(m / zeros)) if zeros and about <= 2.5 * m else float(about)


class Slots:
    """A bounded set of hashes with an index for each; of hashes that share a slot the first given stays."""

    def __init__(self, hashes: np.ndarray, bits: int = 22):
        slot = (hashes >> np.uint64(64 - bits)).astype(np.int64)
        _, first = np.unique(slot, return_index=True)
        self.bits, self.hashes, self.table = bits, hashes[first], np.full(1 << bits, -1, np.int32)
        self.table[slot[first]] = np.arange(len(first))

    def __reduce__(self):
        return Slots, (self.hashes, self.bits)

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash, -1 for others."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = self.table[(h >> np.uint64(64 - self.bits)).astype(np.int64)]
        return np.where((at >= 0) & (self.hashes[at] == h), at, -1)


def _first_pass(batches):
    """Counts of ids, tokens and words in all training texts; a task tells its words in parts, which add up."""

    def told(words):
        return pa.RecordBatch.from_arrays([pa.array([2] * len(words), pa.int32()), pa.array([0] * len(words), pa.int64()), pa.array([w for w, _ in words.values()], pa.binary()), pa.array([n for _, n in words.values()], pa.int64())], ["kind", "key", "word", "n"])

    ids_n, tokens, words = np.zeros(START, np.int64), 0, {}
    for batch in _slices(batches, 256):
        train = [not x for x in batch.column("held_out").to_pylist()]
        if not any(train):
            continue
        ids, _ = _flat(batch.column("ids").filter(pa.array(train)))
        ids_n += np.bincount(ids & (START - 1), minlength=START)
        tokens += int(batch.column("n_tokens").to_numpy()[np.array(train)].sum())
        prefix, starts, stops = _hashes(ids)
        found, first, n = np.unique(prefix[stops], return_index=True, return_counts=True)
        for h, a, b, k in zip(found.tolist(), starts[first].tolist(), stops[first].tolist(), n.tolist(), strict=True):
            known = words.get(h)
            words[h] = (known[0], known[1] + k) if known else (ids[a : b + 1].tobytes(), k)
        if len(words) > FIRST_WORDS:
            yield told(words)
            words = {}
    yield told(words)
    at = np.flatnonzero(ids_n)
    yield pa.RecordBatch.from_arrays([pa.array([0] * len(at) + [1], pa.int32()), pa.array([*at.tolist(), 0], pa.int64()), pa.nulls(len(at) + 1, pa.binary()), pa.array([*ids_n[at].tolist(), tokens], pa.int64())], ["kind", "key", "word", "n"])


def _second_pass(shipped):
    """Counts of pairs of classes, frequent words, their prefixes and all other words together, in training texts;
    and registers of the latter."""

    def run(batches):
        class_of, k, hot, states = shipped.value
        rare, ranks = np.zeros(1, np.int64), np.zeros(1 << REGISTERS, np.int64)
        pairs, counts, visits = np.zeros((2, k * k), np.int64), np.zeros(max(len(hot), 1), np.int64), np.zeros(max(len(states), 1), np.int64)
        for batch in _slices(batches, 256):
            train = [not x for x in batch.column("held_out").to_pylist()]
            if not any(train):
                continue
            ids, ends = _flat(batch.column("ids").filter(pa.array(train)))
            text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            c = class_of[ids & (START - 1)]
            for o in (1, 2):
                pairs[o - 1] += np.bincount((c[:-o] * k + c[o:])[text[o:] == text[:-o]], minlength=k * k)
            prefix, _, stops = _hashes(ids)
            at = hot.find(prefix[stops])
            counts += np.bincount(at[at >= 0], minlength=len(counts))
            rare += int((at < 0).sum())
            _ranks(prefix[stops][at < 0], ranks)
            seen = states.find(prefix)
            visits += np.bincount(seen[seen >= 0], minlength=len(visits))
        for kind, x in ((0, pairs[0]), (1, pairs[1]), (2, counts), (3, visits), (4, rare), (5, ranks)):
            at = np.flatnonzero(x)
            for start in range(0, len(at), 100_000):
                part = at[start : start + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(part), pa.int32()), pa.array(part, pa.int64()), pa.array(x[part], pa.int64())], ["kind", "key", "n"])

    return run


def _copied(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word, given by hash and text, in order: log10 of what is left to the other heads, and the probability
    that a word before it in its text is given again."""
    n, at = len(h), np.arange(len(h))
    place = at - np.searchsorted(text, text)
    order = np.lexsort((at, h, text))
    new = np.ones(n, bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
    earlier = np.empty(n, np.int64)
    earlier[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    share = COPY * place / (place + COPY_FROM)
    return np.log10(1 - share), share * earlier / np.maximum(place, 1)


def _tail(kept: float, tokens: int):
    """Rows (word, text, log and, if there is a copying head, left, copied) sorted by word -> for each text the sum over its words of log10(count + 1), how many
    are known, how many known words were first met with it (so that these add up to distinct words), and the
    log10 probability of its words: kept times what the attention gives, with the word's share of the tokens, and
    the copying head's part."""

    def told(w, t, log, left=np.float64(0), copied=np.float64(0)):
        new = np.concatenate(([True], w[1:] != w[:-1]))
        starts = np.flatnonzero(new)
        c = np.add.reduceat(t & 1, starts)
        per = np.repeat(c, np.diff(np.append(starts, len(w))))
        with np.errstate(divide="ignore"):
            share = np.log(np.maximum(per - DISCOUNT, 0) / max(tokens, 1))
            mixed = np.logaddexp(np.log(10) * log.astype(np.float64) + np.log(kept), share) + np.log(10) * left.astype(np.float64)
            mixed = np.logaddexp(mixed, np.log(copied.astype(np.float64))) / np.log(10)
        columns = [t >> 1, np.log10(per + 1.0), (per > 0).astype(np.int64), (new & (per > 0)).astype(np.int64), mixed]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["rid", "logs", "known", "fresh", "mixed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # parts of the last word's rows
        for batch in batches:
            part = [batch.column(i).to_numpy() for i in range(batch.num_columns)]
            if not len(part[0]):
                continue
            if held and held[0][0][0] == part[0][-1]:
                held.append(part)
                continue
            rows = [np.concatenate(x) for x in zip(*held, part, strict=True)]
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            held = [[x[last:] for x in rows]]
            if last:
                yield told(*(x[:last] for x in rows))
        if held:
            yield told(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


# ---------------------------------------------------------------- the model


class Prefixes:
    """What follows a word's beginning, for the beginnings of frequent words.

    Of n visits to a prefix, some go on to a known longer prefix, some end a known word, and the others are
    left to the distribution after the last id; so is a prior.
    """

    def __init__(self, words: list[bytes], hot: Slots, states: Slots, counts: np.ndarray, visits: np.ndarray):
        n = max(len(states), 1)
        self.prior = PREFIX_PRIOR
        self.states, self.n, kids = states, visits.astype(np.float64), np.zeros(n)
        self.ends = np.zeros(n)
        own, up = [], []
        for word in words:
            h, _, _ = _hashes(np.frombuffer(word, "<u2"))
            own.append(h)
            up.append(np.concatenate((np.zeros(1, np.uint64), h[:-1])))
        if words:
            own, up, lengths = np.concatenate(own), np.concatenate(up), np.array([len(w) // 2 for w in words])
            child, first = np.unique(states.find(own), return_index=True)
            parent = states.find(up[first])
            ok = (child >= 0) & (parent >= 0) & (up[first] != 0)
            np.add.at(kids, parent[ok], self.n[child[ok]])
            last = own[np.cumsum(lengths) - 1]
            s, w = states.find(last), hot.find(last)
            ok = (s >= 0) & (w >= 0)
            self.ends[s[ok]] = counts[w[ok]]
        self.left = np.maximum(self.n - kids - self.ends, 0)

    def follow(self, prefix: np.ndarray, starts: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each position, given the one before: a factor on the distribution after its id, and what is added.

        starts: whether the position begins a word; ending: 1 over the share of word beginnings in the
        distribution after the id before.
        """
        at = self.states.find(prefix)
        known = at >= 0
        s, sure = np.where(known[:-1], at[:-1], 0), known[:-1] & (self.n[at[:-1]] > 0)
        total = self.n[s] + self.prior
        factor, plus = np.ones(len(prefix)), np.zeros(len(prefix))
        factor[1:] = np.where(sure, (self.left[s] + self.prior + np.where(starts[1:], self.ends[s] * ending, 0)) / total, 1)
        plus[1:] = np.where(sure & known[1:] & ~starts[1:], self.n[at[1:]] / total, 0)
        return factor.astype(np.float32), plus.astype(np.float32)


class Attention:
    """Parameters of the attention and the distributions that it mixes."""

    def __init__(self, class_of: np.ndarray, k: int, step: np.ndarray, near: np.ndarray, overall: np.ndarray, rest: np.ndarray, begins: np.ndarray, prefixes: Prefixes, seed: int = 3):
        """step, near: (k, k) distributions; overall: of classes; rest: of an id within its class; begins:
        of each class, the share of its ids' weight that begins words."""
        self.class_of, self.k, self.overall, self.rest, self.prefixes = class_of, k, overall.astype(np.float32), rest.astype(np.float32), prefixes
        self.ending = 1 / np.maximum(step @ begins, 1e-12)
        self.step, self.near = step.astype(np.float32).ravel(), near.astype(np.float32).ravel()
        rng = np.random.default_rng(seed)
        self.p = {"ask": rng.normal(0, 0.1, (k + 1, WIDTH)), "answer": rng.normal(0, 0.1, (k, WIDTH)), "bias": np.zeros(CONTEXT + STRIDE - 1), "sink": np.zeros(WIDTH), "floor": np.zeros(1)}
        self.p = {n: v.astype(np.float32) for n, v in self.p.items()}
        i, m = np.arange(STRIDE)[:, None], np.arange(CONTEXT + STRIDE - 1)[None]
        self.offset = i + CONTEXT - m  # of key m from target i
        self.causal = self.offset >= 1

    def blocks(self, ids: np.ndarray, ends: np.ndarray):
        """Windows: index of the first target of each block, and where its text begins and ends."""
        starts, stops = ends[:-1], ends[1:]
        n = -(-(stops - starts) // STRIDE)
        text = np.repeat(np.arange(len(starts)), n)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        return starts[text] + STRIDE * nth, starts[text], stops[text]

    def read(self, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each position: the class, its id's share of the class, and what Prefixes.follow tells."""
        plain = ids & (START - 1)
        c = self.class_of[plain]
        return c, self.rest[plain], *self.prefixes.follow(_hashes(ids)[0], ids >= START, self.ending[c[:-1]])

    def forward(self, flat: tuple[np.ndarray, ...], first: np.ndarray, begin: np.ndarray, end: np.ndarray):
        """Masked attention over a batch of windows; each target is scored in one window only."""
        p, (c, rest, factor, plus) = self.p, flat
        at = first[:, None] + np.arange(-CONTEXT, STRIDE)[None]
        inside = at >= begin[:, None]
        all_c = c[np.clip(at, 0, len(c) - 1)]
        keys, targets = all_c[:, :-1], all_c[:, CONTEXT:]
        asking = np.where(inside[:, CONTEXT - 1 : -1], all_c[:, CONTEXT - 1 : -1], self.k)
        real = at[:, CONTEXT:] < end[:, None]
        q, r = p["ask"][asking], p["answer"][keys]
        bias = np.where(self.causal, p["bias"][np.clip(self.offset - 1, 0, None)], np.float32(-1e9)).astype(np.float32)
        score = np.matmul(q, r.transpose(0, 2, 1))
        score += bias[None]
        score += np.where(inside[:, None, :-1], np.float32(0), np.float32(-1e9))
        np.clip(score, None, 30, out=score)
        weight = np.exp(score, out=score)
        sink = np.exp(np.clip(q @ p["sink"] + p["floor"], None, 30))
        value = self.near[keys[:, None, :] * self.k + targets[:, :, None]]
        i = np.arange(STRIDE)
        last, own = np.minimum(asking, self.k - 1), np.minimum(at[:, CONTEXT:], len(c) - 1)
        share = rest[own]
        value[:, i, i + CONTEXT - 1] = self.step[last * self.k + targets] * factor[own] + plus[own] / share
        value *= share[:, :, None]
        total = weight.sum(axis=2) + sink
        u = self.overall[targets] * share
        prob = (np.einsum("bst,bst->bs", weight, value) + sink * u) / total
        return prob, real, (asking, keys, q, r, weight, value, sink, total, u)

    def gradient(self, prob, real, state) -> dict[str, np.ndarray]:
        asking, keys, q, r, weight, value, sink, total, u = state
        g = weight / total[:, :, None] * (1 - value / prob[:, :, None]) * real[:, :, None]
        gs = sink / total * (1 - u / prob) * real
        n = max(int(real.sum()), 1)
        dq = np.matmul(g, r) + gs[:, :, None] * self.p["sink"]
        dr = np.matmul(g.transpose(0, 2, 1), q)

        def scatter(where, what, size):
            flat, at = what.reshape(-1, WIDTH), where.ravel()
            return np.stack([np.bincount(at, flat[:, j], size) for j in range(WIDTH)], axis=1)

        bias = np.bincount(np.clip(self.offset - 1, 0, None).ravel(), (g.sum(axis=0) * self.causal).ravel(), len(self.p["bias"]))
        out = {"ask": scatter(asking, dq, self.k + 1), "answer": scatter(keys, dr, self.k), "bias": bias, "sink": (gs[:, :, None] * q).sum(axis=(0, 1)), "floor": np.array([gs.sum()])}
        return {name: x / n for name, x in out.items()}

    def pack(self) -> bytes:
        return np.concatenate([x.ravel() for x in self.p.values()]).astype("<f4").tobytes()

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        for name, x in self.p.items():
            self.p[name] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size


class _Adam:
    def __init__(self, model: Attention, rate: float = 0.02):
        self.model, self.rate, self.t = model, rate, 0
        self.m = {n: np.zeros_like(v) for n, v in model.p.items()}
        self.v = {n: np.zeros_like(v) for n, v in model.p.items()}

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        for n, x in g.items():
            self.m[n] += 0.1 * (x - self.m[n])
            self.v[n] += 0.001 * (x * x - self.v[n])
            self.model.p[n] = (self.model.p[n] - self.rate * (self.m[n] / (1 - 0.9**self.t)) / (np.sqrt(self.v[n] / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """All rows in smaller batches, which keep a worker's arrays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _train(shipped, blocks: int = MOST):
    """Gradient descent over a task's training texts -> the parameters, with the number of targets seen."""

    def run(batches):
        import copy

        model = copy.copy(shipped.value)
        adam, seen, seed = _Adam(model), 0, TaskContext.get().partitionId()
        for batch in _slices(batches):
            train = [not x for x in batch.column("held_out").to_pylist()]
            if not any(train):
                continue
            ids, ends = _flat(batch.column("ids").filter(pa.array(train)))
            flat = model.read(ids)
            first, begin, end = model.blocks(ids, ends)
            order = np.random.default_rng(seed).permutation(len(first))
            seed += 1
            for s in range(0, len(order), blocks):
                part = order[s : s + blocks]
                prob, real, state = model.forward(flat, first[part], begin[part], end[part])
                adam.step(model.gradient(prob, real, state))
                seen += int(real.sum())
        yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([model.pack()], pa.binary())], ["seen", "params"])

    return run


def _score(shipped, counted, kept: float, blocks: int = 1024):
    """For each text the frequent words' part of score and baseline; and rows without rid that list the other
    words, with their texts and what the attention gives them."""

    def run(batches):
        model, (hot, counts) = shipped.value, counted.value
        logs, less = np.log10(counts + 1.0), np.log10(kept)
        for batch in _slices(batches):
            n = batch.num_rows
            if not n:
                continue
            ids, ends = _flat(batch.column("ids"))
            flat = model.read(ids)
            first, begin, end = model.blocks(ids, ends)
            log = np.empty(len(ids))
            for s in range(0, len(first), blocks):
                f, e = first[s : s + blocks], end[s : s + blocks]
                prob, real, _ = model.forward(flat, f, begin[s : s + blocks], e)
                at = f[:, None] + np.arange(STRIDE)[None]
                log[at[real]] = np.log10(prob[real])
            prefix, starts, stops = _hashes(ids)
            h, by_word = prefix[stops], np.add.reduceat(log, starts)
            where = hot.find(h)
            owner = np.searchsorted(starts, ends[:-1])
            found = where >= 0
            known = (found & (counts[where] > 0)).astype(np.int64)
            text = np.repeat(np.arange(n), np.diff(np.append(owner, len(starts))))
            left, copied = _copied(h, text)
            with np.errstate(divide="ignore"):
                own = np.where(found, np.logaddexp(np.log(10) * (by_word + less + left), np.log(copied)) / np.log(10), 0.0)
            empty = pa.array([[]] * n, pa.list_(pa.int64()))
            none = empty.cast(pa.list_(pa.float32()))
            sums = [pa.array(np.add.reduceat(x, owner)) for x in (np.where(found, logs[where], 0.0), known, own)]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), batch.column("held_out"), batch.column("n_tokens"), *sums, empty, empty, none, none, none], _SCORED)
            tail = ~found
            if tail.any():
                text = text[tail]
                train = ~np.array(batch.column("held_out").to_pylist(), bool)
                lists = (h[tail].view(np.int64), batch.column("rid").to_numpy()[text] * 2 + train[text], *[x[tail].astype(np.float32) for x in (by_word, left, copied)])
                nulls = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.int64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([*nulls, *[pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in lists]], _SCORED)

    return run


_SCORED = ["rid", "doc_id", "held_out", "n_tokens", "hot_logs", "hot_known", "hot_score", "words", "texts", "given", "left", "copied"]


def _distributions(ids_n: np.ndarray, size: int, pairs: list[tuple[np.ndarray, np.ndarray]], class_of: np.ndarray, k: int, first_ids: np.ndarray):
    smooth = (ids_n[:size] + 1.0) / (ids_n.sum() + size)
    overall = np.bincount(class_of[:size], smooth, k)
    rest = np.ones(START)
    rest[:size] = smooth / overall[class_of[:size]]
    begins = np.bincount(class_of[:size], smooth * first_ids[:size], k) / overall
    tables = []
    for key, n in pairs:
        table = np.zeros(k * k, np.float64)
        table[key] = n
        table = table.reshape(k, k)
        tables.append((table + PRIOR * overall[None]) / (table.sum(axis=1) + PRIOR)[:, None])
    return (*tables, overall, rest, begins)


def classes(ids_n: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Class of each id: its rank by frequency, at most CLASSES - 1."""
    k = min(CLASSES, size)
    order = np.argsort(-ids_n[:size], kind="stable")
    class_of = np.full(START, k - 1, np.int64)
    class_of[order] = np.minimum(np.arange(size), k - 1)
    return class_of, k


def score_documents(docs: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row.

    A row is held out of training if crc32(doc_id as text) mod 7 is 2 (null ids: never). Null texts count
    as empty: the end mark alone. Words are lower-cased in A-Z. base_score adds log10((c + 1) / (N + V + 1))
    over the tokens, with counts over all training texts; score is the model's log10 probability of the
    text's words and its end. Without training texts all counts are 0 and the model is uniform. An
    empty table gives an empty result. Words are counted under 64-bit hashes. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "lm")
    sc = spark.sparkContext
    data = _read_model(model_path)
    pieces = _Words(data, 2).processor
    size = pieces.get_piece_size()
    first_ids = np.array([pieces.id_to_piece(i).startswith(SPACE) or i == pieces.eos_id() for i in range(size)])
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    source = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    tok = scratch.write(source.mapInArrow(_tokens(sc.broadcast(data)), "rid long, doc_id long, held_out boolean, n_tokens long, ids binary"), "tokens")
    few = tok.coalesce(2 * sc.defaultParallelism)

    told = scratch.write(few.mapInArrow(_first_pass, "kind int, key long, word binary, n long").groupBy("kind", "key", "word").agg(F.sum("n").alias("n")), "first")
    ids_n, train_tokens = np.zeros(START, np.int64), 0
    for r in told.where("kind < 2").collect():
        if r["kind"]:
            train_tokens = r["n"]
        else:
            ids_n[r["key"]] = r["n"]
    words = told.where("kind = 2 and n > 1").orderBy(F.desc("n"), "word").limit(HOT_WORDS).select("word").toArrow().column(0).to_pylist()
    hashed = [_hashes(np.frombuffer(w, "<u2"))[0] for w in words]
    hot = Slots(np.array([h[-1] for h in hashed], np.uint64))
    states = Slots(np.concatenate(hashed) if hashed else np.empty(0, np.uint64), 23)
    class_of, k = classes(ids_n, size)

    second = few.mapInArrow(_second_pass(sc.broadcast((class_of, k, hot, states))), "kind int, key long, n long")
    sums = second.groupBy("kind", "key").agg(F.when(F.col("kind") == 5, F.max("n")).otherwise(F.sum("n")).alias("n")).toArrow()
    kind, key, n = (sums.column(i).to_numpy() for i in range(3))

    def counted(which, length):
        out = np.zeros(max(length, 1), np.int64)
        out[key[kind == which]] = n[kind == which]
        return out

    pairs = [(key[kind == o], n[kind == o]) for o in (0, 1)]
    counts, visits, rare = counted(2, len(hot)), counted(3, len(states)), int(counted(4, 1)[0])
    step, near, overall, rest, begins = _distributions(ids_n, size, pairs, class_of, k, first_ids)
    model = Attention(class_of, k, step, near, overall, rest, begins, Prefixes(words, hot, states, counts, visits))
    # As many tasks as have enough training blocks for their steps; each sees every block of its texts once.
    trained = int(ids_n.sum()) // STRIDE
    tasks = max(1, min(2 * sc.defaultParallelism, trained // (STEPS * LEAST)))
    batch = max(LEAST, min(MOST, trained // tasks // STEPS))
    fits = tok.coalesce(tasks).mapInArrow(_train(sc.broadcast(model), batch), "seen long, params binary").where("seen > 0").collect()
    if fits:
        weights = np.array([r["seen"] for r in fits], np.float64)
        model.unpack(np.average([np.frombuffer(r["params"], "<f4") for r in fits], axis=0, weights=weights))
    # Half a token stays with the attention even if no word is frequent.
    kept = 1 - max(rare - DISCOUNT * 0.97 * _distinct(counted(5, 1 << REGISTERS)), 0) / (train_tokens + 0.5)
    scored = tok.mapInArrow(_score(sc.broadcast(model), sc.broadcast((hot, counts)), kept), "rid long, doc_id long, held_out boolean, n_tokens long, hot_logs double, hot_known long, hot_score double, words array<long>, texts array<long>, given array<float>, left array<float>, copied array<float>")
    scored = scratch.write(scored, "scored")
    tail = scored.where("rid is null").select(F.explode(F.arrays_zip("words", "texts", "given", "left", "copied")).alias("x")).select("x.*").repartition("words").sortWithinPartitions("words")
    tail = tail.mapInArrow(_tail(kept, train_tokens), "rid long, logs double, known long, fresh long, mixed double")
    tail = scratch.write(tail.groupBy("rid").agg(*[F.sum(x).alias(x) for x in ("logs", "known", "fresh", "mixed")]), "tail")
    distinct = (tail.agg(F.sum("fresh")).first()[0] or 0) + int((counts > 0).sum())
    floor = float(np.log10(train_tokens + distinct + 1))
    known = (F.col("hot_known") + F.coalesce("known", F.lit(0))).cast("long")
    base = F.col("hot_logs") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(floor)
    score = F.col("hot_score") + F.coalesce("mixed", F.lit(0.0))
    texts = scored.where("rid is not null").drop("words", "texts", "given", "left", "copied")
    return texts.join(tail, "rid", "left").select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
