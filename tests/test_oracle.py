"""Every registered query against its oracle, at the smallest scale."""

import pytest

from oracle import compare, connect
from coterie.workload import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


@pytest.mark.parametrize("name", list(ORACLES))
def test_matches_oracle(spark, connection, name):
    assert compare(spark, connection, SF, name) is None


@pytest.mark.parametrize("name", [name for name in QUERIES if name not in ORACLES])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_whole_ids_of_a_table_whose_squares_no_long_holds(spark, tmp_path):
    rows = 3_100_000
    spark.range(rows).withColumnRenamed("id", "o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    found = QUERIES["synthetic_table"](spark, str(tmp_path)).collect()
    assert len(found) == 6 and all(r["ids_whole"] and r["ids"] == r["filled"] == rows for r in found)
