"""Catalog queries next to their SQL on the smallest tables, and plan checks."""

import contextlib
import io

import pytest

from compare import compare, connect
from ledgerloom.plans import catalog, oracle

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(catalog.all_queries()) == set(oracle.all_sql())


@pytest.mark.parametrize("name", catalog.all_queries())
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, catalog.all_queries()[name], oracle.all_sql()[name], FOLDER) == ""


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_plans(spark):
    queries = catalog.all_queries()
    fields = plan_of(queries["extract_fields"](spark, FOLDER))
    assert "EvalPython" not in fields and "CartesianProduct" not in fields and "NestedLoop" not in fields
    counts = plan_of(queries["by_language"](spark, FOLDER))
    assert "l_extendedprice" not in counts  # no unused column is read
    assert "WindowGroupLimit" in plan_of(queries["flag_duplicates"](spark, FOLDER))
    assert "NestedLoop" not in plan_of(queries["vendor_scan_batch"](spark, FOLDER))
