"""What registered queries must never plan."""

import pytest

import __spark_entry__ as entry
import workload

FOLDER = "/root/testdata/sf0.001"
BATCH = [n for n in workload.QUERIES if not n.startswith("stream_")]


@pytest.mark.parametrize("name", BATCH)
def test_no_pairwise_joins_and_no_python(spark, name):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "MapInArrow"):
        assert word not in plan


def test_reference_checks_reduce_before_the_shuffle(spark):
    plan = entry.queries()["fk_orphans"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    exchanges = [i for i, x in enumerate(lines) if "Exchange hashpartitioning" in x]
    assert exchanges and all("partial_count" in lines[i + 1] or "HashAggregate" in lines[i + 1] for i in exchanges)


def test_only_needed_columns_are_read(spark):
    plan = entry.queries()["unique_lineitem"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in plan


def test_sums_keep_small_and_large_values(spark):
    from pyspark.sql import functions as F
    from tablecheck.operators.aggregates import ir_aggregate

    def both(df):
        return tuple(ir_aggregate(df, {"s": ("sum", "v"), "a": ("avg", "v")}).first())

    small = spark.range(1000).select(F.lit(0.00004).alias("v"))
    assert both(small) == (0.04, 0.00004)
    assert both(spark.sql("SELECT explode(array(1e15, 0.25D, -3.5D, 1e15)) v"))[0] == 2e15 - 3.25
    assert both(spark.sql("SELECT explode(array(1e25, 1D, double('NaN'))) v"))[0] != 0
    assert both(spark.sql("SELECT explode(array(1e25, 1D)) v"))[0] == 1e25
    assert both(spark.sql("SELECT double(NULL) v")) == (None, None)
