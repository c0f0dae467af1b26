"""Every registered query against its SQL, on whole tables."""

import contextlib
import io

import pytest

import __spark_entry__ as entry
from bindings import registry
from tests.compare import connect, differences
from tests.conftest import DATA

QUERIES = registry.QUERIES
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name in QUERIES}
#: Few customers meet the conditions of these; they are compared on a larger set.
SPARSE = {"q57_applicants_among_borrowers": "/root/testdata/sf0.01"}
WRITERS = ("s2_", "s3_", "s4_", "s8_", "k")


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, data, con, name):
    if name in SPARSE:
        data, con = SPARSE[name], connect(SPARSE[name])
    assert differences(QUERIES[name](spark, data), con, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(q for q in QUERIES if not q.startswith(WRITERS)))
def test_plan_has_no_products_and_no_python(spark, data, name):
    """Without any broadcast, no plan may fall back to a nested loop, a product or Python rows."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            QUERIES[name](spark, data).explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for operator in ("NestedLoop", "Cartesian", "PythonEval", "ArrowEval", "InPandas", "CollectLimit"):
        assert operator not in text.getvalue()
