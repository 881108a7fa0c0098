"""Mail of agents."""

from graphtide.operators import agents as A
from graphtide.sources.sysd import parse_sysd


def test_mail_of_any_number_of_topics_is_read(spark):
    agent = parse_sysd('agent "Buyer": 2\n  property "got": 0, min=0, max=9999\n  rule last: when inbox_t1999 > 1 priority 1\n    got = inbox_t1998 + 1\n').agents[0]
    agents = A.population(spark, agent)
    inbox = spark.range(2000).selectExpr("0L AS inst", "'t' || id AS topic").union(spark.sql("SELECT 0L, 't1999'"))
    out, _ = A.step(agent, agents, {}, 0.0, inbox=inbox)
    assert {r.inst: r.got for r in out.collect()} == {0: 2.0, 1: 0.0}
