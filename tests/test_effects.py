import numpy as np
import pytest
from pyspark.sql import functions as F

from foreunc.functions.random import Draws
from foreunc.operators import effects, evaluate
from foreunc.operators.design import DesignSpec
from foreunc.plans import ar_forecast

DRAWS = Draws(8)
FIT = "k int, names array<string>, coef array<double>, vcov array<array<double>>, sigma2 double"


def test_planted_effects_are_found(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(400):
        slope, level = rng.normal(2.0, 0.5), rng.normal(-1.0, 0.0001)
        found = [float(rng.normal(level, 0.3)), float(rng.normal(slope, 0.2))]
        rows.append((k, ["intercept", "b_x"], found, [[0.09, 0.0], [0.0, 0.04]], 1.0))
    rows.append((1000, None, None, None, None))
    fits = spark.createDataFrame(rows, FIT)
    table = {r.term: r for r in effects.effect_variances(fits, ["k"]).collect()}
    assert table["b_x"].between == pytest.approx(0.25, rel=0.2) and table["b_x"].n_series == 400
    assert table["intercept"].between < 0.02 and table["intercept"].within == pytest.approx(0.09)
    near = effects.shrunken_coefficients(fits, ["k"]).where("term = 'b_x'").collect()
    weight = table["b_x"].between / (table["b_x"].between + 0.04)
    for r in near:
        assert r.shrunken == pytest.approx(table["b_x"].mean + weight * (r.coef - table["b_x"].mean))
        assert r.se == pytest.approx(np.sqrt(weight * 0.04))
    one = effects.effect_variances(fits.where("k = 1"), ["k"]).collect()
    assert {r.between for r in one} == {0.0}


def test_effects_and_observation_errors_are_sources(spark):
    spec = DesignSpec(
        ["ar1", "intercept"], [0.5, 1.0], np.zeros((2, 2)), [1.0], [0.0], 1, 1e-12, 500, effect_sd=[0.0, 0.6],
        observation_sigma2=0.64,
    )
    ids = spark.range(1, 501).withColumnRenamed("id", "sample_id")
    drivers = spark.sql("SELECT DATE'2024-01-01' + CAST(id AS INT) AS datetime, 1 AS parameter, 0.0D AS z FROM range(4)")
    found = {(r.lead, r.input): r for r in ar_forecast.sobol_of_ar_model(ids, spec, DRAWS, drivers, [], 4).collect()}
    # The level follows the series' own by 1 - 0.5^t, beside errors of variance 0.64.
    for lead in (1, 4):
        effect = 0.36 * (1 - 0.5**lead) ** 2
        assert found[lead, "random_effect"].total_order == pytest.approx(effect / (effect + 0.64), abs=0.08)
        assert found[lead, "observation"].total_order == pytest.approx(0.64 / (effect + 0.64), abs=0.12)
        assert found[lead, "ar1"].total_order == pytest.approx(0.0, abs=1e-9)
    one = {(r.lead, r.source): r for r in ar_forecast.one_at_a_time_of_ar_model(ids, spec, DRAWS, drivers, [], 4).collect()}
    assert one[4, "observation"].variance == pytest.approx(0.64, rel=0.2)
    assert one[4, "none"].variance == pytest.approx(0.0, abs=1e-12)
    paths = ar_forecast.forecast_rows(ids, spec, DRAWS, drivers, [], 4)
    got = paths.where("lead = 4").agg(F.var_samp("y")).first()[0]
    assert got == pytest.approx(one[4, "all"].variance)


def plain_filter(y, drift, rho, ratio):
    """Log-likelihood parts of one series, date by date."""
    q, n, squares, logs = 1 - ratio, 0, 0.0, 0.0
    m, p = 0.0, q / max(1 - rho * rho, effects.STATIONARY)
    for value, u in zip(y, drift):
        m, p = rho * m + u, rho * rho * p + q
        if not np.isnan(value):
            s = p + ratio
            n, squares, logs = n + 1, squares + (value - m) ** 2 / s, logs + np.log(s)
            m, p = m + p / s * (value - m), p - p * p / s
    return n, squares, logs


def split_rows(spark, count=600):
    rng = np.random.default_rng(5)
    rows, truth = [], {1: (0.8, 0.5), 2: (0.9, 0.0), 3: (0.7, 0.9)}
    for k, (rho, ratio) in truth.items():
        x, z = 0.0, rng.normal(size=count)
        for t in range(count):
            x = rho * x + 0.5 * z[t] + rng.normal(0, np.sqrt(1 - ratio))
            if t % 17 and not 100 < t < 130:
                y = None if t % 23 == 0 else float(4.0 + x + rng.normal(0, np.sqrt(ratio)))
                rows.append((k, t, y, None if t % 41 == 0 else float(z[t])))
    df = spark.createDataFrame(rows, "k int, t int, y double, x double").withColumn(
        "datetime", F.date_add(F.lit("2020-03-05").cast("date"), F.col("t"))
    )
    eye = np.eye(3).tolist()
    fits = [(k, ["ar1", "intercept", "b_x"], [rho, 4.0, 0.5], eye, 1.0) for k, (rho, _) in truth.items()]
    fits += [(4, ["ar1", "intercept", "b_x"], [0.5, 0.0, 0.0], eye, 1.0), (5, None, None, None, None)]
    return df, spark.createDataFrame(fits, FIT), rows, truth


@pytest.mark.parametrize("dates", [512, 7])
def test_blocks_equal_a_plain_filter_and_find_the_ratio(spark, monkeypatch, dates):
    monkeypatch.setattr(effects, "DATES", dates)
    df, fits, rows, truth = split_rows(spark)
    found = {r.k: r for r in effects.error_split(df, fits, ["k"], "y", ["x"]).collect()}
    assert set(found) == {1, 2, 3}
    for k, (rho, ratio) in truth.items():
        mine = {r[1]: r for r in rows if r[0] == k}
        xs = [r[3] for r in mine.values() if r[3] is not None]
        span = range(min(mine), max(mine) + 1)
        y = [np.nan if t not in mine or mine[t][2] is None else mine[t][2] - 4.0 for t in span]
        drift = [0.5 * (np.mean(xs) if t not in mine or mine[t][3] is None else mine[t][3]) for t in span]
        best = None
        for tried in effects.RATIOS:
            n, squares, logs = plain_filter(y, drift, rho, tried)
            like = -0.5 * (n * (np.log(squares / n) + 1 + np.log(2 * np.pi)) + logs)
            if best is None or like > best[0] + 1e-9:
                best = (like, tried, squares / n, n)
        r = found[k]
        assert r.ratio == best[1] and r.n == best[3]
        assert r.log_likelihood == pytest.approx(best[0])
        assert r.process_sigma2 + r.observation_sigma2 == pytest.approx(best[2])
        assert abs(r.ratio - ratio) <= 0.2


def test_a_date_twice_is_an_error(spark):
    df, fits, _, _ = split_rows(spark, 20)
    with pytest.raises(Exception, match="two rows"):
        effects.error_split(df.union(df.limit(1)), fits, ["k"], "y", ["x"]).collect()


def test_levels_are_eliminated_like_dummies(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        site, model, lead, day = f"s{i % 9}", ["a", "b", None][i // 9 % 3], i % 13, float(i % 365)
        y = 0.3 * lead + i % 9 + (2.0 if model == "b" else 0.0) + 0.5 * np.sin(2 * np.pi * day / 365) + 0.1 * rng.normal()
        rows.append((site, model, lead, day, float(y)))
    rows += [("new", "a", 1, 2.0, None), ("s1", "a", None, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "site string, model string, lead int, day double, crps double")
    fit, smooth = evaluate.skill_curve(
        df, within=["site"], categories=["model"], cyclic=("day", 365.0, 1), penalties=[0.0]
    )
    data = [r for r in rows if r[4] is not None and r[2] is not None]
    turn = lambda r: 2 * np.pi * r[3] / 365
    design = np.array([
        [r[2], np.sin(turn(r)), np.cos(turn(r)), r[1] == "a", r[1] == "b", *(r[0] == f"s{k}" for k in range(9))] for r in data
    ], dtype=float)
    want = design @ np.linalg.lstsq(design, np.array([r[4] for r in data]), rcond=None)[0]
    got = [r.smooth for r in smooth.where("crps IS NOT NULL AND lead IS NOT NULL").collect()]
    assert sorted(got) == pytest.approx(sorted(want.tolist()))
    assert fit["edf"] == pytest.approx(14, abs=1e-6) and fit["n"] == 300
    assert smooth.where("site = 'new'").first().smooth is None and smooth.count() == 302
    with pytest.raises(ValueError, match="levels"):
        evaluate.factor_columns(spark.range(500), "id")
