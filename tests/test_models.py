import numpy as np
import pytest
from pyspark.sql import functions as F

from foreunc.functions.random import Draws
from foreunc.operators import forest, series
from foreunc.plans import ar_forecast

DRAWS = Draws(9)


def _series(spark, n=400):
    """Two series from y_t = c + rho (y_(t-1) - c) + 2 x_t + e_t."""
    rng = np.random.default_rng(0)
    rows = []
    for key, rho, c in ((1, 0.6, 10.0), (2, 0.0, -3.0)):
        x, y = rng.normal(size=n), np.zeros(n)
        y[0] = c
        for t in range(1, n):
            y[t] = c + rho * (y[t - 1] - c) + 2.0 * x[t] + 0.1 * rng.normal()
        for t in range(n):
            rows.append((key, t, float(y[t]), float(x[t])))
    df = spark.createDataFrame(rows, "k int, t int, y double, x double")
    return df.withColumn("datetime", F.date_add(F.lit("2020-01-01").cast("date"), F.col("t")))


def test_recovers_coefficients_and_order(spark):
    fits = {r.k: r for r in series.fit_series(_series(spark), ["k"], "y", ["x"], 2).collect()}
    one = dict(zip(fits[1].names, fits[1].coef))
    assert fits[1].ar_order >= 1
    assert one["ar1"] == pytest.approx(0.6, abs=0.05)
    assert one["intercept"] == pytest.approx(10.0, abs=0.1)
    assert one["b_x"] == pytest.approx(2.0, abs=0.05)
    assert fits[1].sigma2 == pytest.approx(0.01, rel=0.2)
    assert np.all(np.linalg.eigvalsh(np.array(fits[1].vcov)) > 0)


def test_matches_least_squares(spark):
    df = _series(spark)
    fit = series.fit_series(df, ["k"], "y", ["x"], 1, fixed=True).where("k = 1").first()
    data = df.where("k = 1").orderBy("t").toPandas()
    y, x = data["y"].to_numpy(), data["x"].to_numpy()
    design = np.column_stack([y[:-1], x[1:], np.ones(len(y) - 1)])
    beta, rss, *_ = np.linalg.lstsq(design, y[1:], rcond=None)
    assert fit.coef == pytest.approx([beta[0], beta[2] / (1 - beta[0]), beta[1]], rel=1e-8)
    assert fit.sigma2 == pytest.approx(rss[0] / (len(y) - 1 - 3), rel=1e-8)


def test_gap_is_a_missing_lag(spark):
    df = _series(spark).where("k = 1 and t not in (10, 20)")
    rows = series.lagged_rows(df, ["k"], "y", ["x"], 1).na.drop("any")
    assert rows.count() == 398 - 1 - 2


def test_negative_series_use_no_covariates(spark):
    fits = {r.k: r for r in series.fit_with_fallback(_series(spark), ["k"], "y", ["x"], 1).collect()}
    assert fits[1].covariates and not fits[2].covariates
    assert "b_x" in fits[1].names and "b_x" not in fits[2].names


def test_short_series_has_no_fit(spark):
    fit = series.fit_series(_series(spark, 3), ["k"], "y", ["x"], 1).first()
    assert fit.coef is None and fit.ar_order is None


def _train(spark, n=600):
    return spark.range(n).select(
        F.col("id").alias("row_id"),
        (DRAWS.uniform("a", "id") * 4).alias("p"),
        (DRAWS.uniform("b", "id") * 4).alias("q"),
    ).withColumn("y", F.col("p") * 3.0 + DRAWS.normal("e", "row_id") * 0.3)


@pytest.fixture(scope="module")
def bagged(spark):
    return forest.BaggedTrees.fit(
        _train(spark), "y", ["p", "q"], DRAWS, "row_id", trees=8, mtry=2, min_n=5, depth=5
    )


def test_standard_error_equals_its_definition(spark, bagged):
    train = _train(spark)
    new = train.where("row_id < 20")
    counts = np.array(
        [
            [r[f"bag_{b}"] for b in range(8)]
            for r in forest.in_bag_counts(train.select("row_id"), DRAWS, "row_id", 8).collect()
        ],
        dtype=float,
    )
    assert np.array_equal(bagged.gram, counts.T @ counts)
    trees = bagged.pipeline.transform(new).orderBy("row_id").collect()
    got = bagged.predict(new).orderBy("row_id").collect()
    for row, r in zip(trees, got):
        t = np.array([row[f"tree_{b}"] for b in range(8)])
        d = t - t.mean()
        cov = (counts - counts.mean(axis=1, keepdims=True)) @ d / 8
        raw = (cov**2).sum() - bagged.n_train / 64 * (d**2).sum()
        assert r.prediction == pytest.approx(t.mean())
        assert r.se == pytest.approx(np.sqrt(max(raw, 0.0)), abs=1e-9)
    between = bagged.predict(new, se_method="tree_sd").orderBy("row_id").first()
    first = np.array([trees[0][f"tree_{b}"] for b in range(8)])
    assert between.se == pytest.approx(first.std(ddof=1))


def test_saved_trees_predict_the_same(spark, bagged, tmp_path):
    path = bagged.save(spark, str(tmp_path / "model"))
    again = forest.BaggedTrees.load(spark, path)
    new = _train(spark).where("row_id < 50")
    a = bagged.predict(new).orderBy("row_id").select("prediction", "se").collect()
    b = again.predict(new).orderBy("row_id").select("prediction", "se").collect()
    assert a == b
    with pytest.raises(FileNotFoundError):
        forest.BaggedTrees.load(spark, str(tmp_path / "none"))


def test_draws_follow_their_seed(spark):
    df = spark.createDataFrame(
        [(1.0, 0.5, 7), (1.0, 0.5, 7), (1.0, 0.5, 8)], "prediction double, se double, parameter_seed int"
    )
    got = [r[0] for r in df.select(forest.predictive_draw(df, DRAWS)).collect()]
    assert got[0] == got[1] != got[2]


def test_draw_errors(spark):
    with pytest.raises(ValueError, match="parameter_seed"):
        forest.predictive_draw(spark.range(1), DRAWS)
    bad = spark.createDataFrame([(1.0, float("nan"), 1)], "prediction double, se double, parameter_seed int")
    with pytest.raises(Exception, match="NaN"):
        bad.select(forest.predictive_draw(bad, DRAWS)).collect()


def test_tuning_prefers_the_informative_setting(spark):
    table = forest.tune_forest(
        _train(spark), "y", ["p", "q"], DRAWS, "row_id", folds=2, repeats=1,
        grid=[(2, 5), (1, 250)], trees=5, depth=4,
    )
    assert forest.best_parameters(table)["mtry"] == 2


def test_unusable_target_is_skipped(spark):
    assert forest.train_target(spark.range(1), "ticks", "none", [], DRAWS, "id") == (None, None)
    empty = _train(spark).withColumn("y", F.lit(None).cast("double"))
    assert forest.train_target(empty, "ticks", "y", ["p"], DRAWS, "row_id") == (None, None)


def test_themes_report_every_target(spark):
    table = _train(spark, 200).withColumnsRenamed({"y": "abundance"})
    reports = forest.train_themes(
        {"beetles": table}, ["p", "q"], DRAWS, "row_id",
        folds=2, repeats=1, grid=[(1, 5)], trees=3, depth=3,
    )
    assert [r.first().target_variable for r in reports] == ["abundance"]


def test_grid_is_distinct_and_seeded():
    grid = forest.tuning_grid(8)
    assert len(set(grid)) == 20 and grid == forest.tuning_grid(8)
    assert all(1 <= m <= 8 and 2 <= k <= 40 for m, k in grid)


def test_two_rows_of_one_date_are_an_error(spark):
    df = spark.createDataFrame(
        [("a", "2024-01-01", 9.0, None), ("a", "2024-01-01", None, 5.0)], "s string, d string, y double, x double"
    ).withColumn("datetime", F.col("d").cast("date"))
    with pytest.raises(Exception, match="two rows of one date"):
        series.lagged_rows(df, ["s"], "y", ["x"], 1).collect()


def test_a_design_needs_one_series_and_a_value_per_lag(spark):
    schema = "names array<string>, coef array<double>, vcov array<array<double>>, sigma2 double"
    row = (["ar1", "intercept"], [0.5, 1.0], [[1.0, 0.0], [0.0, 1.0]], 1.0)
    two = (["ar1", "ar2", "intercept"], [0.5, 0.1, 1.0], np.eye(3).tolist(), 1.0)
    state = spark.createDataFrame([([1.0], [0.5])], "ic_mean array<double>, ic_sd array<double>")
    assert ar_forecast.spec_from_fit(spark.createDataFrame([row], schema), state, 3, 10).names == row[0]
    for rows in ([], [row, row], [two]):
        with pytest.raises(ValueError):
            ar_forecast.spec_from_fit(spark.createDataFrame(rows, schema), state, 3, 10)


def test_bag_variance_recovers_the_spread_between_bags():
    rng = np.random.default_rng(0)
    bag, tree = rng.normal(0, 0.5, (4000, 50, 1)), rng.normal(0, 1, (4000, 50, 10))
    assert forest.bag_variance(bag + tree).mean() == pytest.approx(0.25, rel=0.05)
    values = rng.normal(size=(3, 4, 5))
    plain = []
    for row in values:
        means = [sum(b) / 5 for b in row]
        centre = sum(means) / 4
        between = sum((m - centre) ** 2 for m in means) / 4
        within = sum((t - m) ** 2 for b, m in zip(row, means) for t in b) / 20
        plain.append(max(between - within / 4, 0.0))
    assert forest.bag_variance(values).tolist() == pytest.approx(plain)


def test_little_bags_know_their_trees(spark, tmp_path):
    train = _train(spark, 400)
    bags = forest.LittleBags.fit(train, "y", ["p", "q"], DRAWS, "row_id", mtry=2, min_n=5, bags=6, trees=3, depth=5)
    new = train.where("row_id < 30")
    got = bags.predict(new).orderBy("row_id").collect()
    scored = bags.pipeline.transform(new).orderBy("row_id").collect()
    for row, r in zip(scored, got):
        values = np.array([
            [bags.leaves[3 * g + t][int(row[f"leaf_{g}"][t])] for t in range(3)] for g in range(6)
        ])
        assert values.mean(axis=1) == pytest.approx([row[f"bag_{g}"] for g in range(6)])
        assert r.prediction == pytest.approx(values.mean())
        assert r.se == pytest.approx(np.sqrt(forest.bag_variance(values[None])[0]))
    halves = forest.in_halves(train, DRAWS, "row_id", 2).agg(F.avg(F.col("half_0").cast("int"))).first()[0]
    assert 0.4 < halves < 0.6
    again = forest.LittleBags.load(spark, bags.save(spark, str(tmp_path / "bags")))
    assert again.predict(new).orderBy("row_id").collect() == got
    with pytest.raises(FileNotFoundError):
        forest.LittleBags.load(spark, str(tmp_path / "none"))


def test_little_bags_read_their_table_once_and_score_by_arrays(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    base = _train(spark, 200)
    bags = forest.LittleBags.fit(
        base.mapInArrow(counted, base.schema), "y", ["p", "q"], DRAWS, "row_id", mtry=2, min_n=5, bags=2, trees=2, depth=4
    )
    assert read.value == 200
    assert "leaf_" not in bags.predict(base)._jdf.queryExecution().optimizedPlan().toString()
    # A root that asks for the second column, then two leaves; and a tree of one leaf.
    nodes = {
        "root": np.array([0, 3]), "feature": np.array([1, 0, 0, 0]), "threshold": np.array([0.5, 0.0, 0.0, 0.0]),
        "upto": np.array([1, 1, 2, 3]), "above": np.array([2, 1, 2, 3]), "value": np.array([9.0, 1.0, 2.0, 3.0]),
    }
    assert forest.reached(nodes, np.array([[9.0, 0.5], [0.0, 0.6]])).tolist() == [[1, 3], [2, 3]]


def test_little_bags_agree_with_the_jackknife(spark):
    train, new = _train(spark, 300).repartition(1).cache(), _train(spark, 340).where("row_id >= 300")
    options = dict(mtry=1, min_n=5, depth=4, parallelism=8)
    exact = forest.BaggedTrees.fit(train, "y", ["p", "q"], DRAWS, "row_id", trees=60, **options)
    bags = forest.LittleBags.fit(train, "y", ["p", "q"], DRAWS, "row_id", bags=20, trees=6, **options)
    one, two = (m.predict(new).agg(F.avg("se")).first()[0] for m in (exact, bags))
    assert 0.5 < two / one < 2


def test_tuning_goes_on_from_its_ledger(spark, tmp_path, monkeypatch):
    ledger, train = str(tmp_path / "ledger"), _train(spark, 200)
    options = dict(folds=2, repeats=2, grid=[(1, 5), (2, 5)], trees=3, depth=3, theme="t")
    plain = {(r.mtry, r.min_n): r.rmse for r in forest.tune_forest(train, "y", ["p", "q"], DRAWS, "row_id", **options).collect()}
    made = []
    real = forest.forest

    def failing(*args, **kwargs):
        if len(made) >= 3:
            raise RuntimeError("killed")
        made.append(args)
        return real(*args, **kwargs)

    monkeypatch.setattr(forest, "forest", failing)
    with pytest.raises(RuntimeError, match="killed"):
        forest.tune_forest(train, "y", ["p", "q"], DRAWS, "row_id", ledger=ledger, parallelism=1, **options)
    kept = forest.read_ledger(spark, ledger).count()
    assert 0 < kept <= 3
    made.clear()
    monkeypatch.setattr(forest, "forest", lambda *a, **k: made.append(a) or real(*a, **k))
    table = forest.tune_forest(train, "y", ["p", "q"], DRAWS, "row_id", ledger=ledger, **options)
    assert len(made) == 8 - kept and forest.read_ledger(spark, ledger).count() == 8
    assert {(r.mtry, r.min_n): r.rmse for r in table.collect()} == pytest.approx(plain)
    # Another target shares the folder and none of the rows.
    other = train.withColumnRenamed("y", "w")
    forest.tune_forest(other, "w", ["p", "q"], DRAWS, "row_id", ledger=ledger, **options)
    assert forest.read_ledger(spark, ledger).groupBy("target").count().count() == 2
