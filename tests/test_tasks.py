"""Groupings over whole tables are dealt to tasks whose number follows the input, whatever the session's shuffle partitions are."""

import re

import pytest

from inkframe.operators import ordered
from inkframe.plans import BUILDS

SF = "/root/testdata/sf0.01"
#: Exchanges of a query that carry its rows: at least as many, each to 60 tasks of 1,000 of the 60,000 rows.
DEALT = {"q_quality_events": 1, "q_wide": 1, "q_roundtrip": 2, "q_composite": 2, "q_ink_fraction": 4}


@pytest.mark.parametrize("name", DEALT)
def test_tasks_follow_the_input(spark, monkeypatch, name):
    monkeypatch.setattr(ordered, "TASK_ROWS", 1000)
    plan = BUILDS[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\(.*, (?:60|120)\), REPARTITION_BY_NUM", plan)) >= DEALT[name]
