import pytest
from oracle import connect, duck_rows, spark_rows

import __spark_entry__ as entry
from framelake.plans import headers, records, streams, validation  # noqa: F401  (these add their queries)
from framelake.plans.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    assert set(QUERIES) - set(ORACLES) == {"output_schedule"}
    assert spark_rows(QUERIES[name](spark, sf_dir)) == duck_rows(duck, ORACLES[name])


@pytest.mark.parametrize("name", ["leaky_bucket", "header_activation_asof", "frame_units", "cdef_direction"])
def test_result_does_not_depend_on_partitions(spark, sf_dir, name):
    whole = spark_rows(QUERIES[name](spark, sf_dir))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert spark_rows(QUERIES[name](spark, sf_dir)) == whole
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scan_is_pruned(spark, sf_dir):
    plan = QUERIES["unavailable_reference"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema", 1)[1].split("\n")[0]
