import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foreunc.functions.random import Draws
from foreunc.operators import attribution

DRAWS = Draws(11)


def _pair(spark, names, n, low=0.0, high=1.0):
    columns = {
        f"{s}_{x}": DRAWS.uniform(f"{s}:{x}", "id") * (high - low) + low
        for s in ("a", "b")
        for x in names
    }
    return spark.range(1, n + 1).withColumns(columns).withColumn("lead", F.lit(0))


def _by_input(df):
    return {r["input"]: r for r in df.collect()}


def test_linear_model(spark):
    pair = _pair(spark, ["x1", "x2"], 20_000)
    model = attribution.column_model(lambda i: i["x1"] * 2.0 + i["x2"])
    got = _by_input(attribution.sobol(pair, {"x1": ["x1"], "x2": ["x2"]}, model))
    for name, share in (("x1", 0.8), ("x2", 0.2)):
        assert got[name].first_order == pytest.approx(share, abs=0.03)
        assert got[name].total_order == pytest.approx(share, abs=0.03)


def test_ishigami_function(spark):
    """Known indices for a = 7, b = 0.1: S = .314, .442, 0; T = .558, .442, .244."""
    pair = _pair(spark, ["x1", "x2", "x3"], 60_000, -math.pi, math.pi)
    model = attribution.column_model(
        lambda i: F.sin(i["x1"]) + 7.0 * F.pow(F.sin(i["x2"]), F.lit(2.0))
        + 0.1 * F.pow(i["x3"], F.lit(4.0)) * F.sin(i["x1"])
    )
    got = _by_input(attribution.sobol(pair, {x: [x] for x in ("x1", "x2", "x3")}, model))
    for name, first, total in (("x1", 0.314, 0.558), ("x2", 0.442, 0.442), ("x3", 0.0, 0.244)):
        assert got[name].first_order == pytest.approx(first, abs=0.03)
        assert got[name].total_order == pytest.approx(total, abs=0.03)
    assert sum(r.first_order for r in got.values()) < 1.03
    assert sum(r.total_order for r in got.values()) > 0.97


def test_block_swaps_as_one_input(spark):
    pair = _pair(spark, ["x1", "x2", "x3"], 20_000)
    model = attribution.column_model(lambda i: i["x1"] + i["x2"] * i["x1"] + i["x3"])
    got = _by_input(attribution.sobol(pair, {"both": ["x1", "x2"], "x3": ["x3"]}, model))
    assert got["both"].first_order == pytest.approx(got["both"].total_order, abs=0.03)


def test_array_and_table_models_agree(spark):
    pair = _pair(spark, ["x1", "x2"], 5_000)
    blocks = {"x1": ["x1"], "x2": ["x2"]}
    table = attribution.column_model(lambda i: i["x1"] * i["x2"] + i["x2"])
    want = _by_input(attribution.sobol(pair, blocks, table))
    arrays = attribution.sobol_paths(
        pair.drop("id", "lead").repartition(5), blocks,
        lambda i: (i["x1"] * i["x2"] + i["x2"])[:, None],
    )
    got = _by_input(arrays)
    for name in blocks:
        assert got[name].first_order == pytest.approx(want[name].first_order, abs=1e-10)
        assert got[name].total_order == pytest.approx(want[name].total_order, abs=1e-10)


def test_row_and_table_models_agree_and_keep_the_partitioning(spark):
    pair = _pair(spark, ["x1", "x2"], 2_000).withColumn("lead", F.col("id") % 2)
    pair = pair.repartition(4, "lead", "id")
    blocks = {"x1": ["x1"], "x2": ["x2"]}
    y = lambda i: i["x1"] * i["x2"] + i["x2"]
    table = attribution.sobol(pair, blocks, attribution.column_model(y))
    want = {(r.lead, r["input"]): r for r in table.collect()}
    rows = attribution.sobol_by_row(
        pair, blocks, lambda df: df.withColumn("y", y({c: F.col(c) for c in blocks})), ["lead"], "id"
    )
    got = {(r.lead, r["input"]): r for r in rows.collect()}
    assert len(got) == 4
    for name in want:
        assert got[name].first_order == pytest.approx(want[name].first_order, abs=1e-10)
        assert got[name].total_order == pytest.approx(want[name].total_order, abs=1e-10)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") <= 2


def test_array_model_merges_partitions_exactly(spark):
    """A large common offset must not cost precision when partial moments are merged."""
    pair = _pair(spark, ["x"], 4_000).drop("id", "lead")
    model = lambda i: (1e8 + i["x"])[:, None]
    for parts in (1, 64):
        row = attribution.one_at_a_time_paths(pair.repartition(parts), {"x": ["x"]}, model)
        variance = row.where("source = 'all'").first().variance
        assert variance == pytest.approx(1 / 12, rel=0.05)


def test_zero_variance_gives_null_indices(spark):
    pair = _pair(spark, ["x"], 100)
    model = attribution.column_model(lambda i: i["x"] * 0.0 + 3.0)
    row = attribution.sobol(pair, {"x": ["x"]}, model).first()
    assert row.first_order is None and row.total_order is None


def test_nothing_uncertain_has_no_variance(spark):
    samples = spark.range(1, 2_001).select(
        DRAWS.normal("x", "id").alias("x"), DRAWS.normal("e", "id").alias("eps"),
        F.lit(0).alias("lead"),
    )
    pair = attribution.frozen_side(samples, ["x"], zero=["eps"])
    model = attribution.column_model(lambda i: i["x"] * 2.0 + i["eps"])
    got = {
        r.source: r
        for r in attribution.one_at_a_time(pair, {"x": ["x"], "noise": ["eps"]}, model).collect()
    }
    assert got["none"].variance == 0.0
    assert got["x"].variance == pytest.approx(4.0, rel=0.15)
    assert got["x"].share + got["noise"].share == pytest.approx(1.0, abs=0.1)


def test_clamp_keeps_null(spark):
    df = spark.createDataFrame([(-0.1, 0.2), (None, -1.0)], "first_order double, total_order double")
    rows = attribution.clamp_indices(df).collect()
    assert [tuple(r) for r in rows] == [(0.0, 0.2), (None, 0.0)]


def test_first_order_stays_below_total(spark):
    pair = _pair(spark, ["x1", "x2"], 20_000)
    model = attribution.column_model(lambda i: i["x1"] * i["x2"])
    for r in attribution.sobol(pair, {"x1": ["x1"], "x2": ["x2"]}, model).collect():
        assert r.first_order <= r.total_order + 0.03
    assert np.isfinite(r.first_order)
