"""Discrete-event operators: queues, resources and their metrics over tables of arrivals.

A single-server first-come queue has a closed form in two running windows; several servers are folded over the
sorted arrivals of a queue; finite capacity and other disciplines run as an event loop, a queue to a task. Folds
and loops read a queue's rows in order and give them out as they are done, so no queue is held whole.
"""

from __future__ import annotations

import bisect
import heapq
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scans

DEPARTURES = "queue string, entity_id long, arr_t double, start_t double, dep_t double, dropped boolean"
#: Waiting rows that a loop holds in memory; more are put aside in sorted runs on the worker's disk.
HELD = 200_000
_ROWS = 10_000


class _Waiting:
    """Rows (key, order, values...), all numbers, of which the smallest leaves first; few of them are in memory.

    Rows below a limit are in a heap. The others are put aside as they come, in sorted runs on the worker's disk, and
    the next of them are taken from the runs once the heap is empty.
    """

    def __init__(self):
        self.near: list[tuple] = []
        self.late: list[tuple] = []
        self.limit: tuple | None = None
        self.runs: list[list] = []  # file, kinds, rows, rows taken
        self.size = 0

    def push(self, row: tuple) -> None:
        self.size += 1
        if self.limit is None or row < self.limit:
            heapq.heappush(self.near, row)
            if len(self.near) > HELD:
                self.near.sort()
                self.limit = self.near[HELD // 2]
                self.late += self.near[HELD // 2 :]
                del self.near[HELD // 2 :]
        else:
            self.late.append(row)
        if len(self.late) >= HELD:
            self._put_aside()

    def first(self) -> tuple:
        if not self.near:
            self._take()
        return self.near[0]

    def pop(self) -> tuple:
        if not self.near:
            self._take()
        self.size -= 1
        return heapq.heappop(self.near)

    def _put_aside(self) -> None:
        columns = [np.array(c, np.int64 if all(isinstance(x, int) for x in c) else np.float64) for c in zip(*self.late, strict=True)]
        order, n = np.lexsort(columns[::-1]), len(self.late)
        file = tempfile.TemporaryFile()  # noqa: SIM115
        for c in columns:
            c[order].tofile(file)
        self.runs.append([file, [c.dtype for c in columns], n, 0])
        self.late = []

    @staticmethod
    def _read(run: list, most: int) -> list[tuple]:
        file, kinds, n, at = run
        part = []
        for i, kind in enumerate(kinds):
            file.seek((i * n + at) * 8)
            part.append(np.frombuffer(file.read(min(most, n - at) * 8), kind).tolist())
        return list(zip(*part, strict=True))

    def _take(self) -> None:
        """Moves the next rows of the runs to the heap: those that no unread row can precede."""
        if self.late and not self.runs:
            self.near, self.late, self.limit = sorted(self.late), [], None
            return
        if self.late:
            self._put_aside()
        blocks = [self._read(run, max(1000, HELD // len(self.runs))) for run in self.runs]
        open_ = [block[-1] for block, run in zip(blocks, self.runs, strict=True) if run[3] + len(block) < run[2]]
        bound, taken, left, rest = min(open_, default=None), [], [], []
        for block, run in zip(blocks, self.runs, strict=True):
            k = len(block) if bound is None else bisect.bisect_right(block, bound)
            taken += block[:k]
            run[3] += k
            if run[3] < run[2]:
                left.append(block[k] if k < len(block) else self._read(run, 1)[0])
                rest.append(run)
            else:
                run[0].close()
        taken.sort()
        self.near, self.runs, self.limit = taken, rest, min(left, default=None)


def _in_order(rows: DataFrame, group: str, order: list[str], values: list[str], begin: Callable, schema: str) -> DataFrame:
    """Runs a loop over the rows of each group, in order, and gives what it lets out.

    begin(name, out) gives the functions for a row's values and for the end; they append rows without the group to
    out, and give an iterator whose steps let these go. A task reads batches of the sorted rows and writes batches, whatever the size of a group.
    """
    kinds = [f.split() for f in schema.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[k] for _, k in kinds]

    def told(name, out: list[tuple]) -> pa.RecordBatch:
        columns = [[name] * len(out), *zip(*out, strict=True)]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [n for n, _ in kinds])
        out.clear()
        return batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, each, end = [], None, None, tuple
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if each is None or row[0] != name:
                    for _ in end():
                        if len(out) >= _ROWS:
                            yield told(name, out)
                    if out:
                        yield told(name, out)
                    name = row[0]
                    each, end = begin(name, out)
                for _ in each(*row[1:]):
                    if len(out) >= _ROWS:
                        yield told(name, out)
                if len(out) >= _ROWS:
                    yield told(name, out)
        for _ in end():
            if len(out) >= _ROWS:
                yield told(name, out)
        if out:
            yield told(name, out)

    keys = [F.asc(group), *[F.asc_nulls_last(c) for c in order]]
    return rows.select(group, *values).repartition(group).sortWithinPartitions(*keys).mapInArrow(run, schema)


def fifo(arrivals: DataFrame, partitions: int | None = None) -> DataFrame:
    """Departures of arrivals (queue, entity_id, arr_t, service_t) from one server without a limit.

    With C the running sum of service times in order of arrival, the n-th departure is
    C_n + max over k <= n of (arrival_k - C_{k-1}). Both are scans over chunks of a queue, so one queue may span any
    number of tasks.
    """
    order = ["arr_t", "entity_id"]
    w = scans.within(["queue"], order)
    local = scans.chunks(arrivals, ["queue"], order, partitions).withColumn("_c", F.sum("service_t").over(w))
    local = local.withColumn("_lead", F.col("arr_t") - (F.col("_c") - F.col("service_t"))).withColumn("_most", F.max("_lead").over(w))
    # Of a chunk the next one needs the sum of its services and the largest lead; a lead falls by the services before it.
    totals = local.groupBy(scans.CHUNK, "queue").agg(F.sum("service_t").cast("double").alias("sum"), F.max("_lead").cast("double").alias("lead"))
    carry = scans.carried(totals, ["queue"], (0.0, float("-inf")), lambda now, t: (now[0] + t[0], max(now[1], t[1] - now[0])))
    rows = scans.with_carry(local, carry, ["queue"])
    before, lead = F.coalesce("before_sum", F.lit(0.0)), F.coalesce("before_lead", F.lit(float("-inf")))
    rows = rows.withColumn("dep_t", before + F.col("_c") + F.greatest(lead, F.col("_most") - before)).drop("_c", "_lead", "_most", "_tie", scans.CHUNK, "before_sum", "before_lead")
    return rows.withColumn("start_t", F.col("dep_t") - F.col("service_t")).withColumn("wait", F.col("start_t") - F.col("arr_t"))


def multi_server(arrivals: DataFrame, servers: int) -> DataFrame:
    """Departures with several servers, first come first served: each arrival takes the server that is free first.

    The state of the fold is the heap of the servers' free times. Rows without a time of arrival or service are not served.
    """

    def begin(name, out):
        free = [float("-inf")] * servers

        def each(arr, entity, service):
            if arr is None or service is None:
                out.append((entity, arr, None, None))
                return ()
            start = max(arr, free[0])
            heapq.heapreplace(free, start + service)
            out.append((entity, arr, start, start + service))
            return ()

        return each, tuple

    rows = arrivals.select("queue", *[F.col(c).cast(t).alias(c) for c, t in (("arr_t", "double"), ("entity_id", "long"), ("service_t", "double"))])
    return _in_order(rows, "queue", ["arr_t", "entity_id"], ["arr_t", "entity_id", "service_t"], begin, DEPARTURES.removesuffix(", dropped boolean"))


def queue_loop(arrivals: DataFrame, servers: int = 1, capacity: int | None = None, discipline: str = "FIFO", patience: float | None = None) -> DataFrame:
    """Departures of queues with a capacity (waiting and served together; an arrival beyond it is dropped), a
    discipline (FIFO, SPT: shortest service first, EDD: earliest due date first, none: last) and patience (who
    waits longer leaves unserved). Optional columns: due_date."""
    if discipline not in ("FIFO", "SPT", "EDD"):
        raise ValueError(discipline)
    entered, left = HOOKS.get("enqueue", []), HOOKS.get("dequeue", [])

    def begin(name, out):
        waiting, busy = _Waiting(), []  # rows (key, order, arrival, service, id), and a heap of departures
        clock, count = float("-inf"), 0

        def serve(until: float) -> Iterator[None]:
            """Lets servers that are free by then take who waits."""
            nonlocal clock
            while True:
                if len(busy) < servers and waiting.size:
                    _, _, arr, service, entity = waiting.pop()
                    start = max(clock, arr)
                    if patience is not None and start - arr > patience:
                        out.append((entity, arr, None, arr + patience, True))
                    else:
                        out.append((entity, arr, start, start + service, False))
                        for f in left:
                            f(name, entity, start + service)
                        heapq.heappush(busy, start + service)
                    yield
                elif busy and busy[0] <= until:
                    clock = max(clock, heapq.heappop(busy))
                else:
                    return

        def each(arr, entity, service, due):
            nonlocal clock, count
            order, count = count, count + 1
            if busy and busy[0] <= arr:
                yield from serve(arr)
            clock = max(clock, arr)
            if capacity is not None and waiting.size + len(busy) >= capacity:
                out.append((entity, arr, None, None, True))
                for f in entered:
                    f(name, entity, arr, False)
                return
            for f in entered:
                f(name, entity, arr, True)
            waiting.push((order if discipline == "FIFO" else service if discipline == "SPT" else due, order, arr, service, entity))
            if len(busy) < servers:
                yield from serve(arr)

        return each, lambda: serve(float("inf"))

    number = lambda c, none: F.coalesce(F.col(c).cast("double"), F.lit(none))
    due = number("due_date", float("inf")) if "due_date" in arrivals.columns else F.lit(float("inf"))
    rows = arrivals.select("queue", number("arr_t", float("nan")).alias("arr_t"), F.col("entity_id").cast("long").alias("entity_id"), number("service_t", float("nan")).alias("service_t"), due.alias("due_date"))
    return _in_order(rows, "queue", ["arr_t", "entity_id"], ["arr_t", "entity_id", "service_t", "due_date"], begin, DEPARTURES)


def length_grid(departures: DataFrame, start: float, end: float, dt: float) -> DataFrame:
    """(queue, t, length): entities in each queue at the times of a grid, by running sums of +1 and -1."""
    moves = departures.select("queue", F.explode(F.array(F.struct(F.col("arr_t").alias("t"), F.lit(1).alias("d")), F.struct(F.col("dep_t").alias("t"), F.lit(-1).alias("d")))).alias("m")).select("queue", "m.t", "m.d", F.lit(0).alias("probe"))
    steps = int(round((end - start) / dt))
    grid = departures.select("queue").distinct().select("queue", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k")).select("queue", (F.lit(start) + F.col("k") * dt).alias("t"), F.lit(0).alias("d"), F.lit(1).alias("probe"))
    return scans.running_sum(moves.unionByName(grid), ["queue"], ["t", "probe"], "d", "length").where("probe = 1").select("queue", "t", "length")


def balks(departures: DataFrame, limit: int) -> DataFrame:
    """(queue, balks): arrivals that found at least ``limit`` entities in their queue; they still join it."""
    moves = departures.select("queue", F.explode(F.array(F.struct(F.col("arr_t").alias("t"), F.lit(1).alias("d"), F.lit(1).alias("order")), F.struct(F.col("dep_t").alias("t"), F.lit(-1).alias("d"), F.lit(0).alias("order")))).alias("m")).select("queue", "m.*").where("t is not null")
    w = Window.partitionBy("queue").orderBy("t", "order").rowsBetween(Window.unboundedPreceding, -1)
    found = moves.withColumn("before", F.coalesce(F.sum("d").over(w), F.lit(0))).where("d = 1")
    return found.groupBy("queue").agg(F.count_if(F.col("before") >= limit).alias("balks"))


def queue_metrics(departures: DataFrame, grid: DataFrame) -> DataFrame:
    """Arrivals, departures, mean wait, and over the grid's samples mean and largest length and the busy share."""
    served = departures.groupBy("queue").agg(F.count(F.lit(1)).alias("arrivals"), F.count("start_t").alias("departures"), F.avg(F.col("start_t") - F.col("arr_t")).alias("avg_wait"))
    seen = grid.groupBy("queue").agg(F.avg("length").alias("avg_length"), F.max("length").alias("max_length"), F.avg((F.col("length") > 0).cast("double")).alias("utilization"))
    return served.join(seen, "queue")


def whole_arrivals(rates: DataFrame, dt: float) -> DataFrame:
    """(queue, step, n): whole entities that an accumulated rate * dt lets in at each step."""
    w = Window.partitionBy("queue").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    total = rates.withColumn("_sum", F.sum(F.col("rate") * dt).over(w))
    before = F.lag(F.floor("_sum"), 1, 0).over(Window.partitionBy("queue").orderBy("step"))
    return total.withColumn("n", (F.floor("_sum") - before).cast("long")).drop("_sum")


def route(entities: DataFrame, routes: list[tuple[str, str]], default: str) -> DataFrame:
    """Adds ``queue``: of the (condition, queue) routes the first whose condition (SQL) holds."""
    out = None
    for condition, queue in routes:
        c = F.coalesce(F.expr(condition), F.lit(False))
        out = F.when(c, queue) if out is None else out.when(c, queue)
    return entities.withColumn("queue", F.lit(default) if out is None else out.otherwise(default))


def recurring(events: DataFrame) -> DataFrame:
    """Events (name, start, end, interval) at each of their times."""
    n = F.floor((F.col("end") - F.col("start")) / F.col("interval") + 1e-9).cast("int")
    return events.withColumn("k", F.explode(F.sequence(F.lit(0), n))).withColumn("t", F.col("start") + F.col("k") * F.col("interval"))


def resource_loop(requests: DataFrame, capacity: float) -> DataFrame:
    """Grants of requests (resource, request_id, t, quantity, priority, hold): who fits is granted at once; others wait
    by priority, then time, until what is held is given back."""
    before, after, back = (HOOKS.get(e, []) for e in ("pre_request", "post_request", "release"))

    def begin(name, out):
        free, waiting, held = capacity, _Waiting(), []

        def give(now: float) -> Iterator[None]:
            nonlocal free
            while waiting.size and waiting.first()[3] <= free:
                _, asked, k, quantity, hold = waiting.pop()
                free -= quantity
                heapq.heappush(held, (now + hold, k, quantity))
                out.append((k, asked, now, now + hold))
                for f in after:
                    f(name, k, now, quantity)
                yield

        def release() -> Iterator[None]:
            nonlocal free
            at, k, quantity = heapq.heappop(held)
            free += quantity
            for f in back:
                f(name, k, at)
            yield from give(at)

        def each(t, request, quantity, priority, hold):
            while held and held[0][0] <= t:
                yield from release()
            for f in before:
                f(name, request, t, quantity)
            waiting.push((priority, t, request, quantity, hold))
            yield from give(t)

        def end():
            while held:
                yield from release()

        return each, end

    values = ["t", "request_id", "quantity", "priority", "hold"]
    rows = requests.select("resource", *[F.col(c).cast("long" if c == "request_id" else "double").alias(c) for c in values])
    return _in_order(rows, "resource", ["t", "request_id"], values, begin, "resource string, request_id long, t double, granted_t double, released_t double")


def resource_cost(samples: DataFrame, capacity: float, cost: float) -> DataFrame:
    """(resource, cost, busy): sampled utilisation (resource, t, used) times capacity, price and the time since the last sample."""
    dt = F.col("t") - F.lag("t").over(Window.partitionBy("resource").orderBy("t"))
    return samples.withColumn("_dt", F.coalesce(dt, F.lit(0.0))).groupBy("resource").agg(F.sum(F.col("used") / capacity * capacity * cost * F.col("_dt")).alias("cost"), F.sum(F.when(F.col("used") > 0, F.col("_dt")).otherwise(0.0)).alias("busy"))


HOOKS: dict[str, list[Callable]] = {}


def on(event: str, f: Callable) -> None:
    """Registers a callback for the event loops that are made from now on; it runs where the queue's task runs.

    enqueue(queue, entity, t, success), dequeue(queue, entity, t), pre_request and post_request(resource,
    request, t, quantity), release(resource, request, t).
    """
    if event not in ("enqueue", "dequeue", "pre_request", "post_request", "release"):
        raise ValueError(f"unknown event {event!r}")
    HOOKS.setdefault(event, []).append(f)
