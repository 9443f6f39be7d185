"""The driver's contract."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_queries_and_sql_agree_in_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_entry_runs(spark):
    assert entry.entry(spark).count() >= 0
