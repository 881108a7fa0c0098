"""Queue loops read and give out a queue's rows as they go, and hold few of those that wait."""

import heapq
import random

import duckdb
import pytest
from compare import expected, found
from pyspark.sql import functions as F

from graphtide.operators import discrete
from graphtide.plans import registry


@pytest.mark.parametrize("held", [4, 50, 5000])
def test_rows_put_aside_leave_in_order(held, monkeypatch):
    monkeypatch.setattr(discrete, "HELD", held)
    rng = random.Random(held)
    for keys in (lambda i: float(rng.randrange(50)), lambda i: i, lambda i: float(-i), lambda i: 1.0):
        mine, heap, most = discrete._Waiting(), [], 0
        for i in range(9000):
            if rng.random() < (0.75 if i < 6000 else 0.2):
                row = (keys(i), i, rng.random(), i * 3)
                mine.push(row)
                heapq.heappush(heap, row)
            elif heap:
                assert mine.first() == heap[0]
                assert mine.pop() == heapq.heappop(heap)
            most = max(most, len(mine.near) + len(mine.late))
        assert mine.size == len(heap) and most <= 2 * held + 1000 * (1 + 9000 // held)
        assert [mine.pop() for _ in range(len(heap))] == [heapq.heappop(heap) for _ in range(len(heap))]


def test_a_queue_comes_in_many_batches(spark):
    """No batch that a loop gives holds a whole queue, and several servers serve a long one in time."""
    rows = spark.range(60_000).select(F.lit("q").alias("queue"), F.col("id").alias("entity_id"), F.col("id").cast("double").alias("arr_t"), F.lit(3.0).alias("service_t"))
    sizes = lambda df: [n for (n,) in df.mapInArrow(lambda it: ((__import__("pyarrow").RecordBatch.from_pydict({"n": [b.num_rows]})) for b in it), "n long").collect()]
    for out in (discrete.queue_loop(rows), discrete.multi_server(rows, 2)):
        got = sizes(out)
        assert sum(got) == 60_000 and max(got) <= 20_000
    last = discrete.multi_server(rows, 2).agg(F.max("dep_t")).first()[0]
    assert last == 90_001.0  # two start at 0 and 1, each then serves 30,000 in a row


def test_shortest_first_where_numbers_are_high(spark, small, tmp_path):
    """As many events as come after a million seconds, so that not all wait behind the first one's service as it was."""
    duckdb.sql(f"COPY (SELECT * REPLACE (event_id + k * 150000 AS event_id) FROM '{small}/events.parquet', range(8) r(k)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    for t in "region nation customer supplier part orders lineitem documents embeddings pages benchmark labels conversations".split():
        (tmp_path / f"{t}.parquet").symlink_to(f"{small}/{t}.parquet")
    assert found(registry.queries()["des_spt_order"](spark, str(tmp_path))) == expected(registry.oracle_sql()["des_spt_order"], str(tmp_path))
