"""Joins of large tables are dealt by rows, and what is grouped by the key stays where it was dealt."""

from __future__ import annotations

import re

import pytest

from tallyframe import registry
from tallyframe.operators import relational as R

registry.load()


@pytest.mark.parametrize("name", ["mrt27_priority_queue", "mrt5_25_segment_activity", "mrt31_access_by_area", "qc6_integrity_checks", "qry7_node_counts", "mrt7_sponsor_concentration"])
def test_parts_grow_with_the_rows(spark, sf_dir, monkeypatch, name):
    want = sorted(map(str, registry.QUERIES[name](spark, sf_dir).collect()))
    monkeypatch.setattr(R, "ROWS", 500, raising=False)
    got = registry.QUERIES[name](spark, sf_dir)
    assert sorted(map(str, got.collect())) == want and want
    dealt = [int(n) for n in re.findall(r"hashpartitioning\(\w+#\d+L?, (\d+)\), REPARTITION_BY_NUM", got._jdf.queryExecution().executedPlan().toString())]
    assert max(dealt, default=0) >= registry.Tables(spark, sf_dir).lineitem.count() // 500  # with 4 shuffle partitions as a rule
