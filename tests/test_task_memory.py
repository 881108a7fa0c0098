"""What one task holds: a small file of mapped rows is one task, so its quads must be dealt before they are grouped."""

from graphtide.operators.graph import Graph
from graphtide.operators.rules import RetractAction
from graphtide.operators.stored import StoredGraph, _keyed
from graphtide.plans.kb_queries import EX, kb
from graphtide.streaming.incremental import Maintained, changes

FOLDER = "/root/testdata/sf0.001"


def _grouped_in_reading(df) -> bool:
    """Whether the stage that reads the file groups rows: an aggregate below the last exchange of the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan
    return "Aggregate" in plan[plan.rindex("Exchange") :]


def test_scans_and_additions_deal_quads_before_they_group_them(spark):
    g = kb(spark, FOLDER, "customer").materialise()
    assert not _grouped_in_reading(g.scan())
    assert not _grouped_in_reading(g.add(g.quads).quads)


def test_stored_graph_deals_quads_before_it_groups_them(spark):
    assert not _grouped_in_reading(StoredGraph._unique(_keyed(kb(spark, FOLDER, "customer").materialise().quads)))


def test_retraction_deals_what_goes_before_it_groups_it(spark):
    g = Graph(kb(spark, FOLDER, "customer").materialise().quads, once=True)
    found = g.query(f"SELECT ?c WHERE {{ ?c <{EX}segment> ?s }}")
    left, _ = RetractAction("?c", EX + "segment").run(g, found)
    assert not _grouped_in_reading(left.quads)
    assert left.scan().count() == 4 * g.scan(p=EX + "segment").count()


def test_a_maintained_graph_deals_its_log_before_it_groups_it(spark, tmp_path):
    quads = kb(spark, FOLDER, "nation").materialise().quads
    m = Maintained(spark, str(tmp_path), [])
    m.apply(changes(quads), 0)
    assert not _grouped_in_reading(m.quads())
    assert m.quads().count() == quads.count()
