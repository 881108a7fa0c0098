"""Keyed state machines over streams: firing once, mailboxes that empty themselves, cooldowns, recurring events.

Each keeps its state in the state store, by key, and works in event time: rows wait until the watermark has
passed them, so neither the order in which they arrive nor the borders of batches matter, and a query that is
started again goes on from its checkpoint.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

_STORE = "spark.sql.streaming.stateStore.providerClass"
#: Groups that keys without timers of their own share.
BUCKETS = 4096


def _with_store(spark: SparkSession) -> None:
    """These processors need a state store that keeps several states for a key; a provider of one's own stays."""
    if "HDFSBacked" in spark.conf.get(_STORE):
        spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Once(StatefulProcessor):
    """Keys of one bucket, each on while it was added and not removed; a row goes out for each time one is switched on.

    A call for each key would cost far more than its work, so a bucket's keys are one call, and each is an entry of
    its map; only the entries that a batch names are read or written.
    """

    def __init__(self, columns: list[str], ttl_ms: int | None):
        self.columns, self.ttl_ms = columns, ttl_ms

    def init(self, handle) -> None:
        self.on = handle.getMapState("on", ", ".join(f"{c} string" for c in self.columns), "since long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        changes: dict[tuple, list] = {}
        for pdf in rows:
            for *mine, seq, sign in zip(*[pdf[c].tolist() for c in (*self.columns, "seq", "sign")], strict=True):
                changes.setdefault(tuple(mine), []).append((seq, -sign))
        out = []
        for mine, told in changes.items():
            on = was = self.on.containsKey(mine)
            since = None
            for seq, off in sorted(told):
                if off < 0 and not on:
                    out.append((*mine, seq))
                    since = seq
                on = off < 0
            if since is not None and on:
                self.on.updateValue(mine, (since,))
            elif was and not on:
                self.on.removeKey(mine)
        if out:
            yield pd.DataFrame(out, columns=[*self.columns, "seq"])

    def close(self) -> None:
        pass


def fire_once(matches: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """(rule, g, triple, seq): the changes that switch a match on, of a stream (rule, g, triple, seq, sign).

    The state's key is rule, triple and graph: the same triple in two batches fires once, in two graphs twice,
    and again after it was removed (sign -1). seq orders changes; batches come in its order. ttl_ms forgets
    a key so long after it fired, in processing time, and then lets it fire again; without it none is forgotten.
    Keys are dealt over BUCKETS groups, a fixed number that checkpoints rest on.
    """
    _with_store(matches.sparkSession)
    key = ["rule", "g", "triple"]
    bucket = F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).alias("bucket")
    return matches.select(bucket, *key, "seq", "sign").groupBy("bucket").transformWithStateInPandas(_Once(key, ttl_ms), "rule string, g string, triple string, seq long", "append", "none" if ttl_ms is None else "ProcessingTime")


def _packed(rows) -> tuple:
    """Tuples as one row of arrays: a list state's elements each cost a message's encoding, a batch's rows so only one."""
    return tuple(map(list, zip(*rows, strict=True)))


def _unpacked(state) -> list[tuple]:
    return [row for part in state.get() for row in zip(*part, strict=True)]


class _Mailbox(StatefulProcessor):
    """Messages of one receiver, each read in as many steps as it lives, from the step after it was sent."""

    def __init__(self, step_ms: int):
        self.step_ms = step_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.mail = handle.getListState("mail", "sent array<long>, topic array<string>, ttl array<long>, n array<long>")
        self.read = handle.getValueState("read", "step long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mail = Counter((t // self.step_ms, topic, ttl) for pdf in rows for t, topic, ttl in zip(pdf["t"].tolist(), pdf["topic"], pdf["ttl"].tolist(), strict=True))
        if mail:
            self.mail.appendValue(_packed((*m, n) for m, n in mail.items()))
            # The step after the first sending one is over then; what is left sets the next timer.
            self.handle.registerTimer((min(sent for sent, *_ in mail) + 2) * self.step_ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # The watermark may have passed several steps at once; all that are over and not yet read go out.
        over = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) // self.step_ms - 1
        done = self.read.get()[0] if self.read.exists() else None
        if done is not None and done >= over:
            return
        mail = _unpacked(self.mail)
        counts: dict[tuple, int] = {}
        for sent, topic, ttl, n in mail:
            for step in range(sent + 1 if done is None else max(sent, done) + 1, min(sent + ttl, over) + 1):
                counts[step, topic] = counts.get((step, topic), 0) + n
        self.read.update((over,))
        left = [m for m in mail if m[0] + m[2] > over]
        if left:
            self.mail.put([_packed(left)])
            self.handle.registerTimer((max(over, min(m[0] for m in left)) + 2) * self.step_ms)
        else:
            self.mail.clear()
        if counts:
            yield pd.DataFrame([(*key, step, topic, n) for (step, topic), n in sorted(counts.items())], columns=["inst", "step", "topic", "n"])

    def close(self) -> None:
        pass


def mailboxes(messages: DataFrame, step_seconds: int, late: str = "0 seconds") -> DataFrame:
    """(inst, step, topic, n): what each receiver reads in each step, of a stream (inst, ts, topic, ttl).

    Steps are whole multiples of step_seconds of event time. A message sent in step s is read in steps s + 1
    to s + ttl. A step goes out when the watermark has passed its end; a mailbox holds no message beyond its time.
    """
    _with_store(messages.sparkSession)
    rows = messages.select("inst", "ts", F.unix_millis("ts").alias("t"), "topic", "ttl").where("ttl > 0").withWatermark("ts", late)
    return rows.groupBy("inst").transformWithStateInPandas(_Mailbox(step_seconds * 1000), "inst long, step long, topic string, n long", "append", "EventTime")


class _Cooldown(StatefulProcessor):
    """The strategy of one agent, which stays for the cooldown that came with it."""

    def init(self, handle) -> None:
        self.handle = handle
        self.lock = handle.getValueState("lock", "until long")
        self.waiting = handle.getListState("waiting", "t array<long>, strategy array<string>, cooldown array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        waiting = [w for pdf in rows for w in zip(pdf["t"].tolist(), pdf["strategy"], pdf["cooldown_ms"].tolist(), strict=True)]
        if waiting:
            self.waiting.appendValue(_packed(waiting))
            self.handle.registerTimer(min(t for t, *_ in waiting))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # All that the watermark has passed is taken at once, so a request is read once for each batch that it waits, not for each other one.
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        waiting = _unpacked(self.waiting)
        due, left = sorted(w for w in waiting if w[0] <= now), [w for w in waiting if w[0] > now]
        if not due:
            return
        until, out = self.lock.get()[0] if self.lock.exists() else None, []
        for t, strategy, cooldown in due:
            if until is None or t >= until:
                until = t + cooldown
                out.append((*key, t, strategy))
        if left:
            self.waiting.put([_packed(left)])
            self.handle.registerTimer(min(w[0] for w in left))
        else:
            self.waiting.clear()
        if out:
            self.lock.update((until,))
            yield pd.DataFrame(out, columns=["inst", "t_ms", "strategy"])

    def close(self) -> None:
        pass


def switches(requests: DataFrame, late: str = "0 seconds") -> DataFrame:
    """(inst, t_ms, strategy): the switches that happen, of a stream of requests (inst, ts, strategy, cooldown_ms).

    A switch locks its agent for its cooldown; requests before the lock ends are refused, those at its end
    are not. Requests of one moment go by name of the strategy. They are taken in order of time once the watermark has passed them.
    """
    _with_store(requests.sparkSession)
    rows = requests.select("inst", "ts", F.unix_millis("ts").alias("t"), "strategy", "cooldown_ms").withWatermark("ts", late)
    return rows.groupBy("inst").transformWithStateInPandas(_Cooldown(), "inst long, t_ms long, strategy string", "append", "EventTime")


class _Recurring(StatefulProcessor):
    """Timers that set themselves again until a schedule's end."""

    def init(self, handle) -> None:
        self.handle = handle
        self.plan = handle.getValueState("plan", "first long, last long, every long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for first, last, every in zip(pdf["first_ms"], pdf["last_ms"], pdf["every_ms"], strict=True):
                if every > 0 and first <= last and not self.plan.exists():
                    self.plan.update((int(first), int(last), int(every)))
                    self.handle.registerTimer(int(first))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        t = expiredTimerInfo.getExpiryTimeInMs()
        first, last, every = self.plan.get()
        # The watermark may have passed several occurrences at once; all of them go out, the timer waits for the next.
        passed = min(last, max(t, timerValues.getCurrentWatermarkInMs() - 1))
        times = list(range(t, passed + 1, every))
        if times[-1] + every <= last:
            self.handle.registerTimer(times[-1] + every)
        yield pd.DataFrame([(*key, (x - first) // every, x) for x in times], columns=["name", "k", "t_ms"])

    def close(self) -> None:
        pass


def occurrences(schedules: DataFrame, clock: DataFrame, late: str = "0 seconds") -> DataFrame:
    """(name, k, t_ms): each occurrence of recurring events once the clock has passed it.

    schedules: a stream (name, ts, first_ms, last_ms, every_ms), a row for each event, which counts once; clock: a stream
    with ts, whose rows only move time on. A schedule that arrives late is made up for.
    """
    _with_store(schedules.sparkSession)
    # Ticks reach the processor, which passes over them: a filter would be pushed below the watermark that they move.
    spread = F.concat(F.lit("\x00tick "), F.pmod(F.xxhash64("ts"), F.lit(256)).cast("string"))
    ticks = clock.select(spread.alias("name"), "ts", *[F.lit(0).cast("long").alias(c) for c in ("first_ms", "last_ms", "every_ms")])
    rows = schedules.select("name", "ts", "first_ms", "last_ms", "every_ms").unionByName(ticks).withWatermark("ts", late)
    return rows.groupBy("name").transformWithStateInPandas(_Recurring(), "name string, k long, t_ms long", "append", "EventTime")


def run_to_end(rows: DataFrame, folder: str) -> DataFrame:
    """Runs a stream to its present end into Parquet; its checkpoint lies beside, so a further run goes on."""
    q = rows.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/rows")
