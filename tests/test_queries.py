"""Registered queries against DuckDB; POLISLAKE_ALL=1 runs every one of them."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from check import compare, duck

SF = os.environ.get("POLISLAKE_SF_DIR", "/root/testdata/sf0.001")
CORE = ["A05_attendance_summary", "D07_first_wins", "E01_resolve_names", "I12_meeting_relevance", "I15_routed_evidence", "J06_reconcile", "O02_recent_attendance", "Q01_quality_summary", "Q03_duplicate_lists", "Q05_quality_gate", "S02_vote_rows_quarantine", "ST05_replay_sweep_log", "T07_vote_tables", "T08_bill_history", "U09_vote_record_upsert", "U12_question_upsert", "V05_unresolved_identifiers"]
NAMES = sorted(entry.queries()) if os.environ.get("POLISLAKE_ALL") else CORE


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    status, _, _, note = compare(spark, con, SF, name)
    assert status in ("ok", "rows-only"), note


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
