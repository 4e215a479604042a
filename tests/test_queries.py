"""Every registered query against the SQL that defines it."""

from __future__ import annotations

import os

import pytest

from maskwright.plans import all_queries
from tools import check

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")


@pytest.fixture(scope="module")
def con():
    return check.connect(FOLDER)


@pytest.mark.parametrize("name", list(all_queries.QUERIES))
def test_query(spark, con, name):
    df = all_queries.QUERIES[name](spark, FOLDER)
    if name in all_queries.ORACLES:
        assert check.compare(df, con, all_queries.ORACLES[name]).startswith("ok")
    else:
        assert df.count() > 0


@pytest.mark.parametrize("path", ["", "_rounds", "_grouped"])
def test_broken_boxes_are_taken_from_the_whole_table(spark, con, path):
    found = all_queries.QUERIES[f"nms_broken_boxes{path}"](spark, FOLDER)
    assert {r[0] for r in found.selectExpr("media_id % 8").distinct().collect()} == {
        r[0] for r in con.execute("SELECT DISTINCT l_orderkey % 8 FROM lineitem").fetchall()
    }
