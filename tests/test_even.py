"""Joins of rows derived from small files go by shuffles: the files' bytes say nothing of the rows, and broadcasts went through the driver."""

import pytest

from meshwright.operators import spread
from meshwright.plans.registry import QUERIES
from meshwright.sources import tables

DATA = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["contact_classification", "overhang", "element_distances", "nearest_neighbor_distance", "pair_distances", "normal_consistency", "soup_join", "report_json", "ci_summary", "model_compare"])
def test_derived_rows_are_not_broadcast(spark, name):
    assert "BroadcastHashJoin" not in _plan(QUERIES[name](spark, DATA))


def test_attach_shuffles_and_deals_hot_keys_alone(spark):
    big = spark.createDataFrame([(None if i % 5 == 0 else 0 if i % 3 else i % 50, i) for i in range(3000)], "k long, v long")
    small = spark.createDataFrame([(k, str(k)) for k in range(40)], "k long, name string")
    assert "BroadcastHashJoin" not in _plan(spread.attach(big, small, ["k"], rows=5))
    for how in ("inner", "left", "left_semi", "left_anti"):
        names = ["k", "v"] if how.endswith(("semi", "anti")) else ["k", "v", "name"]
        plain = sorted(map(tuple, big.join(small, "k", how).select(names).collect()), key=str)
        for hot in (100, 100_000):
            got = spread.attach(big, small, ["k"], how, rows=5, salts=8, hot=hot)
            assert sorted(map(tuple, got.select(names).collect()), key=str) == plain


def test_rows_of_walls_are_dealt(spark):
    """Tasks grow with the triangles, so that no task holds more of them as the table grows."""
    walls = tables.walls(spark, "/root/testdata/sf0.01")
    wanted = -(-walls.count() * 12 // spread.TASK_TRIANGLES)
    assert wanted > 1
    for rows in (tables.vertices(walls), tables.triangles(walls), tables.wall_boxes(walls)):
        assert rows.rdd.getNumPartitions() == wanted
