"""Plan shapes that have to hold at any size."""

import re

import pytest
from pyspark.sql import functions as F

from gaugelake.plans import views as W
from gaugelake.plans.queries import QUERIES


@pytest.fixture(scope="module")
def plan_of(spark, sf_dir):
    spark.conf.set("spark.sql.adaptive.enabled", "false")

    def plan(name):
        df = QUERIES[name](spark, sf_dir)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        return df._jdf.queryExecution().executedPlan().toString()

    yield plan
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def columns_read(plan: str) -> list[set[str]]:
    """The columns of each scan."""
    return [{c.split("#")[0] for c in found.split(",")} for found in re.findall(r"FileScan parquet \[([^]]*)\]", plan)]


def shuffles(line: str) -> bool:
    """Whether a line of a plan is a shuffle by key; the views deal rows out as a topic's partitions do."""
    return "Exchange hashpartitioning" in line and "REPARTITION_BY_NUM" not in line


ROLLUPS = [n for n in QUERIES if n.startswith("agg_")]


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_sort_aggregation_and_no_cross_join(plan_of, name):
    plan = plan_of(name)
    assert "SortAggregate" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", list(QUERIES))
def test_nothing_gathers_in_one_task_but_final_totals(plan_of, name):
    """A single partition only ever receives partial aggregates or a top-n."""
    plan = plan_of(name)
    for line, below in zip(plan.splitlines(), plan.splitlines()[1:]):
        if "Exchange SinglePartition" in line:
            assert "partial_" in below or re.search(r"Local|TakeOrdered|HashAggregate", below), below


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith(("parse_", "flatten_", "agg_", "layout_"))])
def test_json_is_parsed_once(plan_of, name):
    lines = [line for line in plan_of(name).splitlines() if "Filter" in line]
    assert not any("parse_json" in line or "from_json(" in line for line in lines)


@pytest.mark.parametrize("name", ROLLUPS)
def test_rollups_aggregate_before_the_shuffle(plan_of, name):
    """The rows' own shuffle, the lowest one by key, receives partial aggregates."""
    lines = plan_of(name).splitlines()
    lowest = max(i for i, line in enumerate(lines) if shuffles(line))
    assert "HashAggregate" in lines[lowest + 1] and "partial_" in lines[lowest + 1]


def test_cascade_shuffles_twice(plan_of):
    assert sum(map(shuffles, plan_of("agg_cascade").splitlines())) == 2


def test_columns_are_pruned(plan_of):
    (read,) = columns_read(plan_of("agg_day_target"))
    assert read == {
        "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"}


@pytest.mark.parametrize("name", ["mon_lag", "mon_gaps", "mon_rate_5m", "mon_stale", "parse_topic", "ingest_dedup", "src_topic_filter"])
def test_envelopes_read_no_payload(plan_of, name):
    scans = columns_read(plan_of(name))
    assert scans and not any({"props", "value"} & read for read in scans)


@pytest.mark.parametrize("name", ["agg_hour_target", "agg_day_target"])
def test_targets_are_cut_before_the_rollup(plan_of, name):
    plan = plan_of(name)
    assert plan.index("HashAggregate") < plan.index("Filter")  # plans read from the result down


def test_tables_of_a_split_for_each_core_are_not_dealt_out(spark):
    cores = spark.sparkContext.defaultParallelism
    even, fewer = (spark.range(0, 100, 1, n).toDF("id") for n in (cores, cores - 1))
    assert W.spread(even, "id") is even
    assert W.spread(fewer, "id").rdd.getNumPartitions() > cores


def test_samples_take_no_decimals(spark, sf_dir):
    values = [0.0, -0.0, 0.3, -0.3, 0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, 12345.5, 2.0**52 + 1, 4503599627370495.5, 1e300,
              float("nan"), float("inf"), float("-inf"), None, 7.000000000000001, 100.49, 100.51]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    both = df.select("x", W.whole(F.col("x")).alias("ours"), F.round("x").alias("theirs")).collect()
    assert [(r.x, str(r.ours)) for r in both if str(r.ours) != str(r.theirs)] == []
    plan = W.samples(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan and "make_dt_interval" not in plan
