import pytest

from tests.oracle import check
from tracklark.plans import registry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    check(spark, registry.QUERIES[name], registry.SQL[name], SMALL)


@pytest.mark.parametrize("name", ["hysteresis_states", "stationary_lock", "tracker", "smoothing_fit"])
def test_folds_keep_all_rows(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/events.parquet").count()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
