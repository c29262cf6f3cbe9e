"""Rows that make many others are dealt to tasks, however small their table's file."""

from meshwright.plans.l1 import profile_faces


def test_faces_of_profiles_are_dealt(spark):
    assert profile_faces(spark, "/root/testdata/sf0.01").rdd.getNumPartitions() > 1
