"""Queries give whole results: all rules, whole reasons."""

import re

from meshwright.plans.walls import face_labels
from meshwright.plans.whole import explained_groups, site_rule_checks
from meshwright.rules.rulesets import ruleset

DATA = "/root/testdata/sf0.001"


def test_site_rule_checks_gives_every_shipped_rule(spark):
    got = site_rule_checks(spark, DATA).groupBy("rule_id").count().collect()
    assert {r["rule_id"] for r in got} == {r["id"] for rules in ruleset("retaining_wall").values() for r in rules}
    assert {r["count"] for r in got} == {200}


def test_explained_groups_gives_whole_reasons(spark):
    whole = {
        "crown": r"faces up: normal [0-9]+\.[0-9] degrees from vertical, limit 45", "foundation": r"faces down: normal [0-9]+\.[0-9] degrees from vertical, limit 135",
        "front": r"upright, faces across the line, on the side of more area \(asymmetry [0-9]\.[0-9]{4}\)", "back": r"upright, faces across the line, on the side of less area \(asymmetry [0-9]\.[0-9]{4}\)",
        "end_left": "upright, faces along the line at one of its ends", "end_right": "upright, faces along the line at one of its ends",
    }
    labels = {(r["element_id"], r["group_id"]): r["category"] for r in face_labels(spark, DATA).collect()}
    got = explained_groups(spark, DATA).collect()
    assert len(got) == len(labels) and {"crown", "front"} <= set(labels.values())
    assert all(re.fullmatch(whole[labels[r["element_id"], r["group_id"]]], r["reason"]) for r in got)
