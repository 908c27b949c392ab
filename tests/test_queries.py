"""Every registered query against its SQL on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from check_queries import TABLES, compare  # noqa: E402

import __spark_entry__ as contract  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    result, _ = compare(spark, con, FOLDER, name)
    assert result.startswith("ok"), result


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
