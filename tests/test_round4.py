"""Tables that grow with the input aren't sent through the driver, whatever Spark takes their size for."""

import os
import random

import pytest

import __spark_entry__
from attestor.llm import graph

SMALL = "/root/testdata/sf0.001"


def planned(df) -> str:
    """The plan before it runs, by Spark's own estimates."""
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
@pytest.mark.parametrize("name", ["stored_differences", "component_pattern_join", "retriever_comparison"])
def test_nothing_is_broadcast_by_an_estimate(spark, name):
    plan = planned(__spark_entry__.queries()[name](spark, SMALL))
    sent = [line for line in plan.split("\n") if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]
    assert "SortMergeJoin" in plan and all("LeftAnti" in line and "corpus_id" in line for line in sent)  # one row for each corpus that is rejected


def test_components_need_no_round_to_see_that_they_are_done(spark, monkeypatch):
    """Links that are stars already are stored once; later links start from what is known, and give what all links give at once."""
    rounds = []
    own = graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: rounds.append(name) or own(df, name))
    stars = spark.createDataFrame([(k * 10, k * 10 + j) for k in range(5) for j in range(1, 4)], "a long, b long")
    first = graph.components(stars)
    assert len(rounds) == 1 and {r.node: r.root for r in first.collect()} == {k * 10 + j: k * 10 for k in range(5) for j in range(4)}
    r = random.Random(7)
    for _ in range(3):
        links = [(r.randrange(60), r.randrange(60)) for _ in range(45)]
        root = list(range(60))
        for _ in links:
            for x, y in links:
                root[x] = root[y] = min(root[x], root[y])
        met = spark.createDataFrame(links[:25], "a long, b long")
        later = graph.components(graph.contracted(graph.components(met)).union(spark.createDataFrame(links[25:], "a long, b long")))
        assert all(root[x.node] == x.root for x in later.collect())
        assert {x.node for x in later.collect()} == {n for x in links if x[0] != x[1] for n in x}
