from meshwright.operators import classify
from meshwright.sources import tables


def test_batches_to_python_are_bounded(spark):
    """A worker's batch doesn't grow with the rows of a task."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        walls = tables.walls(spark, "/root/testdata/sf0.001").limit(3)
        assert classify.classified(tables.meshes(walls)).select("crown_count").collect() == [(1,)] * 3
        assert int(spark.conf.get(name)) <= 1000
        spark.conf.set(name, "200")  # smaller ones stay
        classify.classified(tables.meshes(walls))
        assert spark.conf.get(name) == "200"
    finally:
        spark.conf.set(name, before)
