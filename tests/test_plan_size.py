"""Queries that read the same rows several times have them made once: a plan that makes them anew each time takes minutes."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def relations(df) -> int:
    """How many times the optimized plan reads a table."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_rejections_read_the_keyed_candidates_only(spark):
    df = entry.queries()["J04_candidates_with_rejections"](spark, SF)
    assert relations(df) <= 3 and sum(r["rejections"] for r in df.collect()) > 0


def test_the_event_sequence_numbers_events_that_are_there(spark):
    df = entry.queries()["W03_W04_event_sequence"](spark, SF)
    assert relations(df) <= 2 and df.where("sequence = 1").count() == df.select("store_id", "item_key").distinct().count() > 0


def test_part_folders_read_the_paths_of_parts_only(spark):
    df = entry.queries()["X18_part_folders"](spark, SF)
    assert relations(df) <= 3 and df.count() == df.distinct().count() > 0


def test_candidates_read_the_messages_no_more_once_they_have_keys(spark):
    from postlode.plans import ledger as B

    assert relations(B.candidates(spark, SF)) <= 7
