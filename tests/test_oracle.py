"""Every query with SQL gives what the SQL gives; the others run."""

import pytest

from tests import oracle as O

import __spark_entry__ as entry

NAMES = sorted(n for n in entry.queries() if not n.startswith("p") or not n[1].isdigit())


@pytest.fixture(scope="module")
def con():
    return O.database("sf0.001")


@pytest.mark.skipif(not (O.DATA / "sf0.001").exists(), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    O.compare(spark, con, "sf0.001", name, entry.queries()[name], entry.oracle_sql().get(name))
