"""Registered queries against their SQL, on the smallest tables."""

import os

import pytest
from compare import compare

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
ORACLES = contract.oracle_sql()
# The rest runs with: python tests/compare.py
CHECKED = ("normalize_fields", "url_decode", "w3c_parse", "csv_parse", "csv_rejects", "pred_regex", "pred_numeric_raw_field",
           "scan_evidence", "findings_flat", "multi_agg", "pack_keyed", "grouped_review_category", "run_stats", "event_counts",
           "timeline_csv_roundtrip", "stream_scan", "stream_sequence")


def test_every_query_has_its_sql():
    from wardlog.plans.queries import all_queries

    assert set(all_queries()) <= set(ORACLES) <= set(contract.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, name):
    assert compare(spark, name, contract.queries()[name], ORACLES[name], FOLDER) == ""


def test_every_keyed_rule_of_the_pack_fires(spark):
    from wardlog.plans.queries import PACK, pack_keyed

    fired = {r["rule_id"] for r in pack_keyed(spark, "/root/testdata/sf0.01").select("rule_id").distinct().collect()}
    assert fired == {r.id for r in PACK if r.grouping is not None} and len(fired) == 12


def test_entry(spark):
    assert contract.entry(spark).count() > 0
