"""Shape of the physical plans: what is shuffled, broadcast and pushed down."""

import re

import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx
from foreunc.operators import design, prepare, propagate, ranking
from foreunc.plans import ar_forecast as ar

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def long_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_rows_are_trimmed_before_the_shuffle(spark):
    df = prepare.first_n(fx.targets(spark, FOLDER), 3, ["site_id"], ["datetime", "variable"])
    text = plan(df)
    assert text.count("WindowGroupLimit") == 2


def test_daily_wide_is_one_shuffle_and_reads_only_its_columns(spark):
    df = prepare.daily_wide(fx.driver_readings(spark, FOLDER), ["parameter"], fx.USED)
    text = plan(df)
    assert text.count("Exchange hashpartitioning") == 1
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"event_id", "ts", "event_type", "value"}
    assert "In(event_type" in text


def test_forecast_does_not_shuffle_its_samples(spark):
    spec = fx.spec(spark, FOLDER)
    ids = spark.range(1, 1001).withColumnRenamed("id", "sample_id")
    rows = design.design_matrix(ids, spec, fx.DRAWS)
    forcing = propagate.forcing_table(fx.region_drivers(spark, FOLDER), rows, fx.USED, fx.STEPS)
    out = propagate.propagate_autoregressive(
        rows, forcing, fx.USED, fx.STEPS, fx.DRAWS, fx.SIGMA2
    )
    memoryless = propagate.propagate_memoryless(rows, forcing, fx.USED, fx.STEPS, fx.DRAWS, fx.SIGMA2)
    for text in (plan(out), plan(memoryless)):
        assert "BroadcastHashJoin [member" in text
        # The drivers were written before, so nothing above the design is shuffled.
        assert "Exchange hashpartitioning" not in text and "SortMergeJoin" not in text


def test_ranking_reuses_its_first_exchange(spark):
    lines = fx.table(spark, FOLDER, "lineitem")
    df = ranking.exact_quantiles(
        lines, ["l_returnflag"], "l_extendedprice", {"m": 0.5}, rows_per_bin=500
    )
    df.collect()
    text = plan(df)
    assert text.split("== Initial Plan ==")[0].count("FileScan parquet") == 1
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_no_cross_joins_in_the_flagship_parts(spark):
    spec = fx.spec(spark, FOLDER)
    df = ar.sobol_of_memoryless_model(
        fx.samples(spark, FOLDER), spec, fx.DRAWS, fx.region_drivers(spark, FOLDER), fx.USED,
        fx.STEPS,
    )
    text = plan(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert df.select(F.count_distinct("input")).first()[0] == 7
