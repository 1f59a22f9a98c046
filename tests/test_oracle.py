"""Every registered query against its SQL on the smallest test data."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

from checks.compare import difference, oracle_connection
from checks.oracle import ORACLE
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, connection, name):
    assert difference(spark, connection, name, SF) is None


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["contract_address", "contract_name", "price_usd"]
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) - set(ORACLE) == {"table_stats"}


@pytest.mark.parametrize("gone", ["ledgerlens.llm", "xxhash"])
def test_core_queries_stay_without_the_subpackage_or_its_libraries(gone):
    code = f"import sys; sys.modules['{gone}'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120,
                          cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[-1]) == len(QUERIES) and "training-data" in done.stderr
