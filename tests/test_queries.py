"""Every registered query of the recording operators against its SQL."""

import pytest

import __spark_entry__
from tapeline.plans import registry
from tests.compare import same_rows


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_rows_as_sql(spark, name):
    same_rows(spark, registry.QUERIES[name], registry.SQL[name])


def test_entry(spark):
    assert set(registry.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize(("name", "scans", "exchanges"), [("section_summary", 1, 1), ("first_partition_report", 1, 1), ("longest_dts", 1, 1), ("track_summary", 1, 1), ("start_times", 1, 1), ("legacy_listing", 1, 1), ("export_plan", 2, 2), ("variable_plan", 3, 3)])
def test_rows_are_read_and_shuffled_once(spark, name, scans, exchanges):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == scans and plan.count("Exchange hashpartitioning") <= exchanges


def test_plans_share_one_shuffle(spark):
    """Partitions, as-of wall clocks and sections need one exchange by file and one by partition, and no Python."""
    from tapeline.plans import standin, timeline_queries

    plan = timeline_queries.sections(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "Python" not in plan and "Arrow" not in plan
    scan = standin.records(spark, "/root/testdata/sf0.001").select("file_id", "track_id")._jdf.queryExecution().executedPlan().toString()
    assert "props" not in scan and "value" not in scan
