"""Every row of the table reaches the operator."""

from graphtide.operators import agents as A
from graphtide.plans import registry


def run(spark, small, name):
    return registry.queries()[name](spark, small)


def test_every_customer(spark, small):
    n = spark.read.parquet(f"{small}/customer.parquet").count()
    for name, key in (("sd_rk4_decay", "run_id"), ("calibration_errors", "run_id"), ("compare_runs", "run")):
        assert run(spark, small, name).select(key).distinct().count() == n
    assert run(spark, small, "params_from_kb").count() == n + 1
    fanout = run(spark, small, "abm_message_fanout").first()
    assert fanout.n == fanout.senders * n > 0


def test_every_event(spark, small):
    n = spark.read.parquet(f"{small}/events.parquet").count()
    assert sum(r.n for r in run(spark, small, "des_multi_server").collect()) == n
    assert run(spark, small, "des_edd_order").count() == n - 1


def test_no_window_holds_all_runs(spark, small):
    plan = run(spark, small, "sd_random")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "collect_set" not in plan


def test_mail_is_counted_without_a_row_for_each_receiver(spark, small):
    """The counts equal those of the rows delivered, with a sender that sends twice and a type that nobody has."""
    agents = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "type string, inst long")
    mail = spark.createDataFrame([(1, "a", "x", {}), (1, "a", "x", {"k": "v"}), (2, "a", "y", {}), (3, "b", "x", {}), (3, "none", "x", {})], "sender long, target_type string, topic string, payload map<string,string>")
    rows = A.deliver(mail, agents).groupBy("type", "sender", "topic").count()
    assert sorted(map(tuple, A.delivered(mail, agents).collect())) == sorted(map(tuple, rows.collect()))


def test_repeated_rows_are_not_sent_whole(spark, small):
    """Rows repeated for each salt may be many times what their file's size lets expect."""
    plan = run(spark, small, "subquery")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [_salt" in plan and "BroadcastHashJoin [_salt" not in plan
