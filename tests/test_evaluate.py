import numpy as np
import pytest
from pyspark.sql import functions as F

from foreunc.functions.random import Draws
from foreunc.operators import evaluate, ranking

DRAWS = Draws(5)


def _pairwise_crps(x, y):
    return np.abs(x - y).mean() - np.abs(x[:, None] - x[None, :]).mean() / 2


def _ensemble(spark, n, groups=3):
    return spark.range(n * groups).select(
        (F.col("id") % groups).cast("int").alias("lead"),
        # Hot repeated value and heavy tails, both at once.
        F.when(F.col("id") % 5 == 0, 0.5)
        .otherwise(F.tan(DRAWS.uniform("y", "id") * 3.0 - 1.5))
        .alias("y"),
    )


@pytest.mark.parametrize("per_bin", [50, 100_000])
def test_scores_equal_their_definitions(spark, monkeypatch, per_bin):
    monkeypatch.setattr(ranking.ranked_values, "__defaults__", (per_bin, None))
    ens = _ensemble(spark, 400)
    obs = spark.createDataFrame([(0, 0.5), (1, -3.0), (2, None)], "lead int, obs double")
    got = {r.lead: r for r in evaluate.scores(ens, obs).collect()}
    data = ens.toPandas()
    for lead, y in ((0, 0.5), (1, -3.0)):
        x = data.loc[data["lead"] == lead, "y"].to_numpy()
        r = got[lead]
        assert r.n == len(x)
        assert r.crps == pytest.approx(_pairwise_crps(x, y), rel=1e-10)
        assert r.pit == pytest.approx((x <= y).mean())
        assert [r.q025, r.q500, r.q975] == pytest.approx(np.quantile(x, [0.025, 0.5, 0.975]))
        assert r.covered == (r.q025 <= y <= r.q975)
    assert got[2].crps is None and got[2].pit is None and got[2].q500 is not None


def test_hot_group_is_split(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        DRAWS.normal("v", "id").alias("v"),
    )
    got = ranking.ranked_values(df, ["k"], "v", rows_per_bin=500).toPandas()
    assert len(got) == 20_000
    want = df.toPandas()
    want["below"] = want.groupby("k")["v"].rank(method="min") - 1
    merged = got.merge(want, on=["k", "v"])
    assert (merged["below_x"] == merged["below_y"]).all()
    assert (got.groupby("k")["n"].first() == want.groupby("k").size()).all()


def test_bins_of_a_clustered_group_are_even(spark):
    df = spark.range(400_000).select(
        F.lit("g").alias("k"),
        F.when(F.col("id") % 5 < 2, F.lit(1000.0) + DRAWS.uniform("v", "id") * 1e-6)
        .otherwise(DRAWS.normal("v", "id") * 1e3).alias("v"),
    )
    counted = df.groupBy(F.struct("k").alias("_key"), "v").agg(F.count("v").alias("copies"))
    layout = ranking._layout(counted, "v", 2000)
    sizes = counted.join(layout, "_key").groupBy(ranking._bin("v").alias("b")).count()
    assert sizes.agg(F.max("count")).first()[0] <= 3 * 2000


def test_many_heavy_groups_are_all_split(spark):
    df = spark.range(60_000).select((F.col("id") % 3000).alias("k"), DRAWS.normal("v", "id").alias("v"))
    counted = df.groupBy(F.struct("k").alias("_key"), "v").agg(F.count("v").alias("copies"))
    assert ranking._layout(counted, "v", 10).count() == 3000


def test_null_keys_are_a_group_and_nan_is_missing(spark):
    rows = [(None, 2.0), (None, 1.0), (1, float("nan")), (1, 5.0), (1, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    got = {(r.k, r.v): (r.below, r.n) for r in ranking.ranked_values(df, ["k"], "v", rows_per_bin=1).collect()}
    assert got == {(None, 1.0): (0, 2), (None, 2.0): (1, 2), (1, 5.0): (0, 1)}


def test_two_observations_of_one_lead_are_an_error(spark):
    ens = spark.createDataFrame([(0, 3.0)], "lead int, y double")
    obs = spark.createDataFrame([(0, 5.0), (0, 6.0)], "lead int, obs double")
    for score in (evaluate.scores, evaluate.pit):
        with pytest.raises(Exception, match="two observations"):
            score(ens, obs).collect()


def test_an_observation_without_members_has_null_scores(spark):
    ens = spark.createDataFrame([(0, 3.0), (1, float("nan"))], "lead int, y double")
    obs = spark.createDataFrame([(0, 5.0), (1, 4.0), (2, 6.0)], "lead int, obs double")
    got = {r.lead: r for r in evaluate.scores(ens, obs).collect()}
    assert got[0].n == 1 and got[1].n == got[2].n == 0
    assert got[2].obs == 6.0 and got[1].crps is got[2].crps is got[2].q500 is None


def test_crps_of_one_member(spark):
    ens = spark.createDataFrame([(0, 3.0)], "lead int, y double")
    obs = spark.createDataFrame([(0, 5.0)], "lead int, obs double")
    assert evaluate.scores(ens, obs).first().crps == pytest.approx(2.0)


def test_pit_ends_and_histogram(spark):
    ens = spark.createDataFrame([(i, float(v)) for i in (0, 1) for v in range(10)], "lead int, y double")
    obs = spark.createDataFrame([(0, -1.0), (1, 99.0)], "lead int, obs double")
    pit = evaluate.scores(ens, obs)
    assert {r.lead: r.pit for r in pit.collect()} == {0: 0.0, 1: 1.0}
    counts = {r.bin: r.n for r in evaluate.histogram(pit, "pit", 4).collect()}
    assert counts == {1: 1, 2: 0, 3: 0, 4: 1}


def test_pit_of_a_calibrated_ensemble_is_uniform(spark):
    ens = spark.range(200 * 200).select(
        (F.col("id") % 200).cast("int").alias("lead"), DRAWS.normal("m", "id").alias("y")
    )
    obs = spark.range(200).select(F.col("id").cast("int").alias("lead"), DRAWS.normal("o", "id").alias("obs"))
    counts = [r.n for r in evaluate.histogram(evaluate.scores(ens, obs), "pit", 5).collect()]
    assert sum(counts) == 200 and min(counts) > 20 and max(counts) < 62


def test_spline_follows_a_curve_and_line_is_exact(spark):
    df = spark.range(400).select(
        (F.col("id") % 40).cast("int").alias("lead"),
    ).withColumn("crps", F.sin(F.col("lead") / 8.0))
    fit, smooth = evaluate.skill_curve(df, knots=[8.0, 16.0, 24.0, 32.0], scale=40.0)
    worst = smooth.agg(F.max(F.abs(F.col("smooth") - F.col("crps")))).first()[0]
    assert worst < 0.02 and fit["n"] == 400
    line = df.withColumn("crps", F.col("lead") * 2.0 + 1.0)
    fit, _ = evaluate.skill_curve(line, penalties=[0.0])
    assert fit["coef"] == pytest.approx([1.0, 2.0])


def test_best_candidate_breaks_ties_by_fields(spark):
    df = spark.createDataFrame([(1.0, 3, 5), (1.0, 2, 9), (2.0, 1, 1)], "rmse double, mtry int, min_n int")
    assert tuple(evaluate.top_by_metric(df, [], "rmse", ["mtry", "min_n"]).first()) == (1.0, 2, 9)


def test_scores_rank_the_ensemble_once(spark):
    """One pass over the members (its cuts stand twice in the plan), with observations that have none and keys that are null."""
    rows = [(s, s % 5 if s % 7 else None, float(s)) for s in range(200)]
    ensemble = spark.createDataFrame(rows, "s int, lead int, y double")
    obs = spark.createDataFrame([(0, 1.0), (1, 2.0), (9, 3.0), (None, 4.0)], "lead int, obs double")
    got = evaluate.scores(ensemble.drop("s"), obs)
    assert got.columns == ["lead", "obs", "n", "q025", "q500", "q975", "resid", "pit", "crps", "covered"]
    found = {r.lead: (r.obs, r.n, r.q500 is None, r.crps is None) for r in got.collect()}
    assert found[9] == (3.0, 0, True, True) and found[None][0] == 4.0 and found[None][1:] == (29, False, False)
    assert found[2][0] is None and found[2][3] and not found[2][2] and len(found) == 7
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("percentile_approx") <= 2


def test_skill_within_levels_reads_a_made_table(spark):
    ensemble = spark.createDataFrame([(i % 6, float(i * i % 37)) for i in range(90)], "lead int, y double")
    obs = spark.createDataFrame([(i, 10.0 + i) for i in range(6)], "lead int, obs double")
    scored = evaluate.scores(ensemble, obs).withColumn("grp", F.col("lead") % 2)
    _, smooth = evaluate.skill_curve(scored, within=["grp"], penalties=[0.0])
    assert "percentile_approx" not in smooth._jdf.queryExecution().optimizedPlan().toString()
    assert smooth.count() == 6
