import numpy as np
import pytest
from pyspark.sql import functions as F

from foreunc.functions.random import Draws
from foreunc.operators import design, propagate

DRAWS = Draws(3)
SPEC = design.DesignSpec(
    names=["intercept", "ar1", "b_t"],
    mean=[1.0, 0.5, 2.0],
    cov=[[0.04, 0.01, 0.0], [0.01, 0.09, -0.02], [0.0, -0.02, 0.16]],
    ic_mean=[5.0],
    ic_sd=[0.3],
    members=3,
    sigma2=0.25,
    noise_rows=5000,
)


def test_parameter_moments(spark):
    ids = spark.range(1, 20_001).withColumnRenamed("id", "sample_id")
    rows = design.design_matrix(ids, SPEC, DRAWS).toPandas()
    x = rows[SPEC.names].to_numpy()
    assert np.abs(x.mean(axis=0) - SPEC.mean).max() < 0.02
    assert np.abs(np.cov(x.T) - np.array(SPEC.cov)).max() < 0.01
    assert (rows["noise_id"] == rows["sample_id"]).all()
    assert set(rows["member"]) == {1, 2, 3}


def test_design_is_one_narrow_projection(spark):
    ids = spark.range(1, 100).withColumnRenamed("id", "sample_id")
    plan = design.design_pair(ids, SPEC, DRAWS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_frozen_covariance_gives_constants(spark):
    factor = design.cholesky([[0.0, 0.0], [0.0, 4.0]])
    assert factor.tolist() == [[0.0, 0.0], [0.0, 2.0]]


def test_fold_by_hand():
    inputs = {
        "ic": np.array([5.0]), "intercept": np.array([0.0]), "ar1": np.array([0.5]),
        "eps": np.array([[1.0, 2.0, 3.0]]),
    }
    assert propagate.ar_paths(inputs, []).tolist() == [[5.0, 3.5, 3.75, 4.875]]


def _drivers(spark):
    rows = [(f"2024-01-0{d}", m, float(10 * d + m)) for d in (1, 2, 3) for m in (1, 2)]
    rows[2] = ("2024-01-02", 1, None)
    return spark.createDataFrame(rows, "d string, parameter int, t double").withColumn(
        "datetime", F.col("d").cast("date")
    )


def test_member_past_the_last_row_takes_the_sampled_mean(spark):
    picks = spark.createDataFrame([(1,), (1,), (2,), (3,)], "member bigint")
    got = {
        (r.member, r.lead): r.t
        for r in propagate.forcing_table(_drivers(spark), picks, ["t"], 3).collect()
    }
    # Date 1: rows 11 (drawn twice) and 12; member 3 does not exist.
    assert got[(1, 1)] == 11.0 and got[(2, 1)] == 12.0
    assert got[(3, 1)] == pytest.approx((11 + 11 + 12) / 3)
    # Date 2: member 1 has no value; only member 2 counts.
    assert got[(1, 2)] == 22.0 and got[(3, 2)] == 22.0


def _forecast(spark, partitions, phi=0.0):
    ids = spark.range(1, 301).withColumnRenamed("id", "sample_id").repartition(partitions)
    rows = design.design_matrix(ids, SPEC, DRAWS)
    forcing = propagate.forcing_table(_drivers(spark), rows, ["t"], 3)
    out = propagate.propagate_autoregressive(
        rows, forcing, ["t"], 3, DRAWS, SPEC.sigma2, noise_phi=phi
    )
    return {r.sample_id: r.y for r in out.collect()}


def test_same_forecast_for_one_and_many_partitions(spark):
    assert _forecast(spark, 1) == _forecast(spark, 64)


def test_forecast_equals_the_recursion_row_by_row(spark):
    got = _forecast(spark, 8)
    ids = spark.range(1, 301).withColumnRenamed("id", "sample_id")
    rows = design.design_matrix(ids, SPEC, DRAWS)
    met = {
        (r.member, r.lead): r.t
        for r in propagate.forcing_table(_drivers(spark), rows, ["t"], 3).collect()
    }
    for r in rows.collect():
        x, path = r.ic - r.intercept, [r.ic]
        for lead in (1, 2, 3):
            eps = 0.5 * DRAWS.normal_values("noise", np.array([r.noise_id]), np.array([lead]))[0]
            x = r.ar1 * x + r.b_t * met[(r.member, lead)] + eps
            path.append(x + r.intercept)
        assert got[r.sample_id] == pytest.approx(path, abs=1e-12)


def test_correlated_noise_keeps_its_variance():
    eps = propagate.noise_block(DRAWS, 0.25, np.arange(1, 20_001), 10, phi=0.7)
    assert np.abs(eps.var(axis=0) - 0.25).max() < 0.015
    assert abs(np.corrcoef(eps[:, 4], eps[:, 5])[0, 1] - 0.7) < 0.02


def test_big_group_ranks_equal_plain_ranks(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), "id")
    u = DRAWS.uniform("rank", "id")
    plain = design.row_numbers(df, ["g"], u, ["id"], slices=1).orderBy("id").collect()
    split = design.row_numbers(df, ["g"], u, ["id"], slices=100).orderBy("id")
    assert [r.position for r in plain] == [r.position for r in split.collect()]


def test_ties_are_broken_by_the_row_key(spark):
    df = spark.range(500).repartition(7).select((F.col("id") % 2).alias("g"), "id")
    got = design.row_numbers(df, ["g"], F.lit(0.5), ["id"]).collect()
    assert all(r.position == r.id // 2 + 1 for r in got)


def test_halves_are_permutations(spark):
    rows = spark.createDataFrame(
        [("2024-01-01", m, float(m), float(-m)) for m in range(1, 8)],
        "d string, parameter int, p double, q double",
    ).withColumn("datetime", F.col("d").cast("date"))
    drawn = design.bootstrap_rows(rows, "datetime", ["parameter"], ["p", "q"], 200, DRAWS)
    pair = design.split_and_shuffle(drawn, "datetime", ["p", "q"], 200, DRAWS).toPandas()
    assert sorted(pair["sample_id"]) == list(range(1, 101))
    assert sorted(pair["a_parameter_seed"]) == list(range(1, 101))
    assert sorted(pair["b_parameter_seed"]) == list(range(101, 201))
    assert (pair["a_p"] == -pair["a_q"]).all()
    assert abs(np.corrcoef(pair["b_p"], pair["b_q"])[0, 1]) < 0.4
    assert (pair["b_p"] != -pair["b_q"]).any()


def test_odd_size_is_refused(spark):
    with pytest.raises(ValueError):
        design.split_and_shuffle(spark.range(1), "id", [], 3, DRAWS)


def test_numbers_in_chunks(spark):
    df = spark.createDataFrame([("a",), ("b",)], "g string")
    rows = design.numbered(df, "g", 25, "i", chunk=10).collect()
    assert sorted((r.g, r.i) for r in rows) == [(g, i) for g in "ab" for i in range(1, 26)]


def test_initial_state_is_half_the_68_interval(spark):
    df = spark.createDataFrame([(1.0, 3.0)], "lo double, hi double")
    assert df.select(design.interval_sd("lo", "hi")).first()[0] == 1.0
    assert design.initial_state(4.0) == pytest.approx(1.98892, abs=1e-5)


def test_leads_without_drivers_are_null(spark):
    """Drivers end before the horizon: the leads they reach have values, those after are null."""
    drivers = spark.createDataFrame(
        [(f"2024-01-0{d}", m, float(m + d)) for d in (1, 2) for m in (1, 2, 3)],
        "d string, parameter int, t double",
    ).withColumn("datetime", F.col("d").cast("date"))
    ids = spark.range(1, 21).withColumnRenamed("id", "sample_id")
    rows = design.design_matrix(ids, SPEC, DRAWS)
    forcing = propagate.forcing_table(drivers, rows, ["t"], 4)
    got = propagate.propagate_autoregressive(rows, forcing, ["t"], 4, DRAWS, SPEC.sigma2).collect()
    assert len(got) == 20
    assert all([v is None for v in r.y] == [False, False, False, True, True] for r in got)


def test_methods_of_many_draws_are_compiled(spark):
    """The JVM interprets methods of more than 8,000 bytes; a stage that has one is split."""
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    ids = spark.range(1, 3).withColumnRenamed("id", "sample_id")
    spec = design.DesignSpec(["intercept"], [1.0], [[1.0]], [0.0], [1.0], members=2, sigma2=1.0, noise_rows=2)
    for make in (design.design_matrix, design.design_pair):
        spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
        make(ids, spec, Draws(1))
        assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8_000
