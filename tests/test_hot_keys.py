"""Ordered operators give the same rows whether a key is ordinary or hot, and whatever the input order."""

import pytest

from pdpspark.operators import ordered
from pdpspark.plans import catalog  # noqa: F401
from pdpspark.plans.registry import PLANS

SF = "/root/testdata/sf0.001"
NAMES = ["turn_merge", "turn_carry", "turn_order", "turn_text_runs", "turn_disclaimers", "turn_title_pair", "turn_captions", "turn_owner",
         "doc_heading_scope", "stack_islands", "stitch_orphans", "card_rows", "award_runs", "same_component", "feature_groups", "job_states",
         "job_progress", "activity_session", "spec_rows", "section_places"]


@pytest.mark.parametrize("name", NAMES)
def test_hot_equals_plain(spark, monkeypatch, name):
    spark.conf.unset(ordered.HOT_ROWS_SETTING)
    plain = sorted(map(repr, PLANS[name](spark, SF).collect()))
    spark.conf.set(ordered.HOT_ROWS_SETTING, "4")
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 2)
    try:
        hot = sorted(map(repr, PLANS[name](spark, SF).collect()))
    finally:
        spark.conf.unset(ordered.HOT_ROWS_SETTING)
    assert hot == plain


def test_too_many_hot_keys_all_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "MAX_HOT_KEYS", 1)
    spark.conf.set(ordered.HOT_ROWS_SETTING, "2")
    try:
        cold, hot = ordered.split_hot(spark.range(100).selectExpr("id % 10 as k", "id"), ["k"])
    finally:
        spark.conf.unset(ordered.HOT_ROWS_SETTING)
    assert cold is None and hot.count() == 100
