"""Keyed streams against loops over their rows, stopped after the first file and started again."""

import random
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from graphtide.streaming import keyed

BEGIN = pd.Timestamp("2024-01-01")
LAST = 10_000


def staged(spark, tmp_path, rows, columns, schema, build, order):
    """The stream's rows, its files given a part before a first run and the rest before a second one."""
    pdf = pd.DataFrame(rows, columns=columns).sort_values(order, kind="stable")
    cuts = [0, len(pdf) // 3, 2 * len(pdf) // 3, len(pdf)]
    for k in range(3):
        part = pdf.iloc[cuts[k] : cuts[k + 1]].sample(frac=1, random_state=k)
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
        if k != 1:
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
            out = keyed.run_to_end(build(stream), str(tmp_path / "out"))
    return out


def at(minute):
    return BEGIN + pd.Timedelta(minutes=minute)


def test_mailboxes(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(5), at(rng.randrange(600)), rng.choice("ab"), rng.randrange(0, 5)) for _ in range(150)] + [(-1, at(LAST), "end", 1)]
    got = staged(spark, tmp_path, rows, ["inst", "ts", "topic", "ttl"], "inst long, ts timestamp, topic string, ttl int", lambda s: keyed.mailboxes(s, 1800), "ts")
    zero = int(BEGIN.timestamp()) // 1800
    want = Counter((i, zero + int((t - BEGIN).total_seconds()) // 1800 + k, topic) for i, t, topic, ttl in rows for k in range(1, ttl + 1) if i >= 0)
    assert {(r.inst, r.step, r.topic): r.n for r in got.where("inst >= 0").collect()} == want and got.where("inst >= 0").count() == len(want)


def test_switches(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randrange(4), at(rng.randrange(600)), rng.choice("xyz"), rng.randrange(0, 50) * 60_000) for _ in range(150)] + [(-1, at(LAST), "end", 0)]
    got = staged(spark, tmp_path, rows, ["inst", "ts", "strategy", "cooldown_ms"], "inst long, ts timestamp, strategy string, cooldown_ms long", keyed.switches, "ts")
    want, until = [], {}
    for i, t, strategy, cooldown in sorted(rows):
        ms = t.value // 10**6
        if i >= 0 and ms >= until.get(i, 0):
            until[i] = ms + cooldown
            want.append((i, ms, strategy))
    assert sorted(map(tuple, got.where("inst >= 0").collect())) == want


def test_occurrences(spark, tmp_path):
    plans = [("a", 0, 500, 7), ("b", 33, 90, 100), ("c", 90, 33, 5), ("d", 0, 600, 0), ("e", 200, 599, 1)]
    ms = lambda m: at(m).value // 10**6
    rows = [(n, at(0), ms(a), ms(b), e * 60_000) for n, a, b, e in plans] + [(None, at(m), 0, 0, 0) for m in [*range(0, 600, 9), LAST]]

    def build(s):
        return keyed.occurrences(s.where("name is not null"), s.where("name is null"))

    got = staged(spark, tmp_path, rows, ["name", "ts", "first_ms", "last_ms", "every_ms"], "name string, ts timestamp, first_ms long, last_ms long, every_ms long", build, "ts")
    want = [(n, k, ms(a + k * e)) for n, a, b, e in plans if e for k in range((b - a) // e + 1)]
    assert sorted(map(tuple, got.collect())) == want


def test_firing_once(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice("rs"), rng.choice("gh"), rng.choice("tuv"), k, rng.choice((1, 1, -1))) for k in range(120)]
    got = staged(spark, tmp_path, rows, ["rule", "g", "triple", "seq", "sign"], "rule string, g string, triple string, seq long, sign int", keyed.fire_once, "seq")
    want, on = [], set()
    for rule, g, triple, seq, sign in rows:
        key = (rule, g, triple)
        if sign > 0 and key not in on:
            want.append((*key, seq))
        (on.add if sign > 0 else on.discard)(key)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert got.where(F.col("seq").isNull()).count() == 0


class Held:
    """A handle, its states and its timers in memory, which counts how often a state is read."""

    def __init__(self):
        self.states, self.timers, self.reads, self.writes = {}, set(), 0, 0

    def getListState(self, name, schema):
        return HeldState(self, name)

    getValueState = getListState

    def registerTimer(self, ms):
        self.timers.add(ms)


class HeldState:
    def __init__(self, handle, name):
        self.handle, self.name = handle, name
        handle.states[name] = []

    def exists(self):
        return bool(self.handle.states[self.name])

    def get(self):
        self.handle.reads += 1
        held = self.handle.states[self.name]
        return held[0] if self.name in ("lock", "read") else iter(list(held))

    def update(self, value):
        self.handle.states[self.name] = [value]

    def appendValue(self, value):
        self.handle.writes += 1
        self.handle.states[self.name].append(value)

    def put(self, values):
        self.handle.states[self.name] = list(values)

    def clear(self):
        self.handle.states[self.name] = []


class Moment:
    def __init__(self, ms):
        self.ms = ms

    def getExpiryTimeInMs(self):
        return self.ms

    getCurrentWatermarkInMs = getExpiryTimeInMs


def test_rows_that_the_watermark_passes_together_are_read_together(spark):
    n = 400
    rows = pd.DataFrame({"ts": [at(k) for k in range(n)], "strategy": "x", "topic": "x", "cooldown_ms": 90_000, "ttl": 1, "t": [at(k).value // 10**6 for k in range(n)]})
    for machine, outputs in ((keyed._Cooldown(), n // 2), (keyed._Mailbox(60_000), n)):
        handle = Held()
        machine.init(handle)
        list(machine.handleInputRows((1,), iter([rows]), None))
        fired, out = sorted(handle.timers), []
        for t in fired:
            out += machine.handleExpiredTimer((1,), Moment(at(LAST).value // 10**6), Moment(t))
        assert sum(map(len, out)) == outputs
        assert len(fired) == 1 and handle.writes == 1 and handle.reads <= 2


class _Map(dict):
    """A map state without a store."""

    containsKey = dict.__contains__
    updateValue = dict.__setitem__
    removeKey = dict.__delitem__


def test_keys_of_a_bucket_fire_in_one_call():
    """One call takes all keys of a bucket, and each is switched by its own changes alone."""
    rng = random.Random(9)
    once, state, on, want, got = keyed._Once(["rule", "g", "triple"], None), _Map(), {}, [], []
    once.init(type("Handle", (), {"getMapState": lambda *_: state})())
    for batch in range(5):
        rows = [(rng.choice("ab"), rng.choice(["g", None]), rng.choice("xyz"), batch * 100 + k, rng.choice([1, -1])) for k in range(40)]
        for *key, seq, sign in rows:
            if sign > 0 and not on.get(tuple(key)):
                want.append((*key, seq))
            on[tuple(key)] = sign > 0
        pdf = pd.DataFrame(rows, columns=["rule", "g", "triple", "seq", "sign"]).sample(frac=1, random_state=batch)
        for out in once.handleInputRows((1,), iter([pdf[:15], pdf[15:]]), None):
            got += list(out.itertuples(index=False, name=None))
        assert set(state) == {k for k, v in on.items() if v}
    assert sorted(got, key=lambda r: r[-1]) == want
