"""Queries against counts over all rows of their tables, made without the registered SQL."""

import os
from datetime import date, timedelta

import pyarrow.parquet as pq
import pytest

from pitspark import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def _intervals():
    """entity, added, announced, removed and removed_announced of every customer."""
    for k in pq.read_table(f"{SF}/customer.parquet", columns=["c_custkey"]).column(0).to_pylist():
        added = date(2024, 1, 1) + timedelta(k % 30)
        yield f"C{k % 200}", added, added - timedelta(7), added + timedelta(20) if k % 3 == 0 else None, added + timedelta(15) if k % 6 == 0 else None


def test_members_come_from_every_customer(spark):
    day = date(2024, 1, 26)
    want = {e for e, added, told, gone, gone_told in _intervals() if told <= day and added <= day and not (gone and gone_told and gone <= day and gone_told <= day)}
    assert {r["entity"] for r in queries.members_as_of(spark, SF).collect()} == want


def test_edges_come_from_every_customer(spark):
    want = [(e, "added", told.isoformat()) for e, _, told, _, _ in _intervals()] + [(e, "removed", told.isoformat()) for e, _, _, _, told in _intervals() if told]
    assert sorted((r["entity"], r["edge"], r["vintage_id"]) for r in queries.membership_edges(spark, SF).collect()) == sorted(want)


def test_identity_stages_every_event(spark):
    ids = pq.read_table(f"{SF}/events.parquet", columns=["event_id"]).column(0).to_pylist()
    got = [r["observation_id"] for r in queries.write_identity(spark, SF).collect()]
    assert sorted(got) == sorted(map(str, ids))
