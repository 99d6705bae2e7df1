import numpy as np
import pytest
from pyspark.sql import functions as F

from foreunc.functions.random import Draws
from foreunc.operators import many, propagate, series
from foreunc.operators.design import HALF_WIDTH_68, DesignSpec
from foreunc.plans import ar_forecast

DRAWS = Draws(4)
KEYS = ["site", "variable"]
FIT = "site string, variable int, names array<string>, coef array<double>, vcov array<array<double>>, sigma2 double"
NAMES = ["ar1", "ar2", "intercept", "b_x"]
FITS = [
    ("a", 1, NAMES, [0.5, 0.2, 4.0, 0.3], np.diag([0.01, 0.01, 0.04, 0.02]).tolist(), 0.25),
    ("a", 2, ["ar1", "intercept", "b_x"], [0.4, -2.0, 0.1], [[0.01, 0.002, 0.0], [0.002, 0.03, 0.0], [0.0, 0.0, 0.01]], 0.5),
    ("b", 1, NAMES, [-0.3, 0.1, 1.0, 0.0], np.zeros((4, 4)).tolist(), 0.0),
    ("b", 3, None, None, None, None),
]
ORIGIN = "2024-03-10"


def day(number):
    return f"2024-03-{number:02d}"


def observed():
    """Days 1 to 12, some missing, some without a covariate; a key without any."""
    rng = np.random.default_rng(1)
    rows = []
    for site, variable in (("a", 1), ("a", 2), ("x", 9)):
        for d in range(1, 13):
            if d != 4:
                y = None if d in (6, 7) and variable == 1 else float(rng.normal(3))
                rows.append((site, variable, day(d), y, None if d == 9 else float(rng.normal())))
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "site string, variable int, datetime string, y double, x double")
    return df.withColumn("datetime", F.to_date("datetime"))


def fits(spark):
    return spark.createDataFrame(FITS, FIT)


def plain_state(rows, fit, lags, lookback):
    """The recursion date by date."""
    site, variable, names, coef, _, sigma2 = fit
    of = dict(zip(names, coef))
    seen = {int(r[2][-2:]): r for r in rows if r[:2] == (site, variable)}
    days = range(10 - lookback - lags + 1, 11)
    xs = [seen[d][4] for d in days if d in seen and seen[d][4] is not None]
    x_mean = sum(xs) / len(xs) if xs else float("nan")
    past = []
    for d in days:
        row = seen.get(d)
        x = row[4] if row and row[4] is not None else x_mean
        guess = sum(of.get(f"ar{k}", 0.0) * (past[-k] if len(past) >= k else 0.0) for k in range(1, lags + 1)) + of["b_x"] * x
        known = row and row[3] is not None and d <= 10 - lags
        past.append(row[3] - of["intercept"] if known else guess)
    weights = [1.0]
    for _ in range(lags - 1):
        weights.append(sum(of.get(f"ar{k}", 0.0) * weights[-k] for k in range(1, lags + 1) if k <= len(weights)))
    sd = [HALF_WIDTH_68 * np.sqrt(sigma2 * sum(w * w for w in weights[: h + 1])) for h in range(lags)]
    return [p + of["intercept"] for p in past[-lags:]], sd


@pytest.mark.parametrize("lags", [2, 3])
def test_states_follow_the_recursion(spark, lags):
    got = many.origin_states(frame(spark, observed()), fits(spark), KEYS, "y", ["x"], ORIGIN, lags, lookback=6)
    found = {(r.site, r.variable): r for r in got.collect()}
    assert len(found) == 4 and found["b", 3].ic_mean is None
    for fit in FITS[:2]:
        mean, sd = plain_state(observed(), fit, lags, 6)
        assert found[fit[:2]].ic_mean == pytest.approx(mean)
        assert found[fit[:2]].ic_sd == pytest.approx(sd)
    # No observation at all: without covariates there is no state.
    assert all(np.isnan(v) for v in found["b", 1].ic_mean)


def test_two_rows_of_a_date_are_an_error(spark):
    rows = frame(spark, [*observed(), ("a", 1, day(5), 1.0, 1.0)])
    with pytest.raises(Exception, match="two rows"):
        many.origin_states(rows, fits(spark), KEYS, "y", ["x"], ORIGIN, 2).collect()


def designs(spark, lags=2):
    states = many.origin_states(frame(spark, observed()), fits(spark), KEYS, "y", ["x"], ORIGIN, lags, lookback=6)
    return many.series_designs(fits(spark), states, KEYS, ["x"], lags)


def test_designs_line_up_terms(spark):
    found = {(r.site, r.variable): r for r in designs(spark).collect()}
    assert set(found) == {("a", 1), ("a", 2)}
    assert found["a", 2].mean == [0.4, 0.0, -2.0, 0.1]
    factor = np.array(found["a", 2].factor)
    want = np.zeros((4, 4))
    want[np.ix_([0, 2, 3], [0, 2, 3])] = FITS[1][4]
    assert factor @ factor.T == pytest.approx(want)
    assert found["a", 1].series_no != found["a", 2].series_no and found["a", 1].series_no >= 0
    with pytest.raises(Exception, match="lags"):
        designs(spark, 1).collect()


def drivers(spark, sites=None):
    """Three members over five days; a member lacks a day, and a day is missing."""
    rows = [
        (site, day(11 + t), m, float(m + 0.1 * t + len(site)), None if (m, t) == (2, 1) else float(m * t))
        for site in (sites or ["all"]) for t in (0, 1, 2, 4) for m in (1, 2, 3) if (m, t) != (3, 2)
    ]
    df = spark.createDataFrame(rows, "site string, datetime string, parameter int, z double, x double")
    return df.withColumn("datetime", F.to_date("datetime"))


HORIZON, SAMPLES, MEMBERS = 5, 150, 3


def alone(spark, row, shared):
    """The design of one series, its ids and drivers, for the path of a single series."""
    spec = DesignSpec(
        many.parameter_names(2, ["x"]), row.mean, np.array(row.factor) @ np.array(row.factor).T, row.ic_mean, row.ic_sd,
        MEMBERS, row.sigma2, SAMPLES, many.ic_names(2), (row.series_no,),
    )
    ids = spark.range(1, SAMPLES + 1).withColumnRenamed("id", "sample_id")
    return spec, ids, shared


def close(found, wanted, keys, values):
    a = {tuple(r[k] for k in keys): [r[v] for v in values] for r in found}
    b = {tuple(r[k] for k in keys): [r[v] for v in values] for r in wanted}
    assert a.keys() == b.keys() and a
    for k, row in a.items():
        assert all((x is None) == (y is None) for x, y in zip(row, b[k])), (k, row, b[k])
        assert [x or 0 for x in row] == pytest.approx([y or 0 for y in b[k]], rel=1e-7, abs=1e-9)


@pytest.mark.parametrize("block", [64, 4096])
def test_a_series_among_many_is_as_alone(spark, monkeypatch, block):
    monkeypatch.setattr(many, "BLOCK", block)
    shared = drivers(spark).drop("site")
    designed = designs(spark)
    forced = many.with_forcing(designed, shared, KEYS, ["x"], HORIZON, SAMPLES, MEMBERS, DRAWS, driver_keys=[])
    job = (KEYS, ["x"], HORIZON, SAMPLES, MEMBERS, DRAWS)
    indices = many.sobol_of_series(forced, *job, lags=2).collect()
    paths = many.forecast_of_series(
        many.with_forcing(designed, shared, KEYS, ["x"], HORIZON, SAMPLES, MEMBERS, DRAWS, sides=["a"], driver_keys=[]), *job
    ).collect()
    mean = shared.agg(F.avg("x")).first()[0]
    frozen = designed.select(*KEYS, F.array_repeat(F.lit(mean), HORIZON).alias("x"))
    variances = many.one_at_a_time_of_series(
        many.with_forcing(designed, shared, KEYS, ["x"], HORIZON, SAMPLES, MEMBERS, DRAWS, sides=["a"], driver_keys=[]),
        frozen, *job, lags=2,
    ).collect()
    for row in designed.collect():
        spec, ids, table = alone(spark, row, shared)
        mine = lambda rows: [r for r in rows if (r.site, r.variable) == (row.site, row.variable)]  # noqa: E731,B023
        want = ar_forecast.sobol_of_ar_model(ids, spec, DRAWS, table, ["x"], HORIZON).collect()
        close(mine(indices), want, ["lead", "input"], ["first_order", "total_order"])
        want = ar_forecast.one_at_a_time_of_ar_model(ids, spec, DRAWS, table, ["x"], HORIZON).collect()
        close(mine(variances), want, ["lead", "source"], ["variance", "share"])
        want = ar_forecast.forecast_rows(ids, spec, DRAWS, table, ["x"], HORIZON).collect()
        rows = [{"sample_id": r.sample_id, "lead": t, "y": y} for r in mine(paths) for t, y in enumerate(r.y)]
        close(rows, want, ["sample_id", "lead"], ["y"])


def test_a_block_of_a_series_leaves_one_row(spark, monkeypatch):
    """Blocks are merged to what one block gives; what is shuffled doesn't grow with terms and leads."""
    shared = drivers(spark).drop("site")
    forced = many.with_forcing(designs(spark), shared, KEYS, ["x"], HORIZON, SAMPLES, MEMBERS, DRAWS, sides=["a"], driver_keys=[])
    frozen = designs(spark).select(*KEYS, F.array_repeat(F.lit(1.0), HORIZON).alias("x"))
    job = (KEYS, ["x"], HORIZON, SAMPLES, MEMBERS, DRAWS)
    rows, seen = many._per_block, []

    def counted(*args):
        seen.append(rows(*args))
        return seen[-1]

    monkeypatch.setattr(many, "_per_block", counted)
    whole = many.one_at_a_time_of_series(forced, frozen, *job, lags=2).collect()
    assert [df.count() for df in seen] == [2]
    monkeypatch.setattr(many, "BLOCK", 64)
    seen.clear()
    parts = many.one_at_a_time_of_series(forced, frozen, *job, lags=2).collect()
    assert [df.count() for df in seen] == [6, 6]
    close(parts, whole, ["site", "variable", "lead", "source"], ["variance", "share"])


def test_drivers_of_their_own(spark):
    own = drivers(spark, ["a", "bb"])
    forced = many.with_forcing(designs(spark), own, KEYS, ["x", "z"], HORIZON, SAMPLES, MEMBERS, DRAWS, driver_keys=["site"])
    rows = {(r.site, r.variable): r.forcing for r in forced.collect()}
    assert set(rows) == {("a", 1), ("a", 2)}
    table = {(m, t): z for m, t, z in zip(rows["a", 1].member, rows["a", 1].lead, rows["a", 1].v1)}
    assert table[2, 1] == 3.0 and table[1, 4] is None and table[3, 5] == pytest.approx(4.4)
    # Two rows on the third day: the third member is past the last one, and takes the mean of what was drawn.
    assert 2.2 < table[3, 3] < 3.2


def test_recursion_of_three_lags():
    inputs = {"ar1": np.array([0.5]), "ar2": np.array([0.25]), "ar3": np.array([-0.5]), "intercept": np.array([1.0]),
              "lag2": np.array([2.0]), "lag1": np.array([3.0]), "dayof": np.array([5.0]), "eps": np.array([[0.1, 0.0, 0.0]])}
    names = many.ic_names(3)
    x = [1.0, 2.0, 4.0]
    for e in (0.1, 0.0, 0.0):
        x.append(0.5 * x[-1] + 0.25 * x[-2] - 0.5 * x[-3] + e)
    assert propagate.ar_paths(inputs, [], names).tolist() == [pytest.approx([v + 1.0 for v in x[2:]])]
    with pytest.raises(ValueError, match="initial value"):
        propagate.ar_paths(inputs, [], names[1:])
    with pytest.raises(ValueError, match="gaps"):
        propagate.lag_names(["ar1", "ar3"])


def test_leads_follow_the_calendar(spark):
    picks = spark.createDataFrame([(1,), (1,), (2,)], "member int")
    table = drivers(spark).drop("site")

    def leads(**options):
        found = propagate.forcing_table(table, picks, ["z"], 4, **options).collect()
        return {(r.member, r.lead): r.z for r in found}

    plain = leads()
    assert plain[1, 3] == pytest.approx(4.2) and plain[1, 4] is None and plain[2, 4] is None
    assert leads(driver_offset=1)[1, 1] == pytest.approx(4.1) and leads(driver_offset=1)[1, 4] == pytest.approx(4.4)
    assert leads(driver_offset=-1)[1, 1] is None and leads(driver_offset=-1)[1, 2] == pytest.approx(4.0)
    assert leads(first=day(12))[2, 1] == pytest.approx(5.1)


def test_spec_takes_the_state_of_the_fit(spark):
    rows = frame(spark, observed())
    fit = series.fit_series(rows.where("site = 'x'"), KEYS, "y", [], 1, fixed=True)
    states = many.origin_states(rows, fit, KEYS, "y", [], ORIGIN)
    spec = ar_forecast.spec_from_fit(fit, states, 3, 10)
    assert spec.ic_names == ["ic"] and spec.ic_sd[0] == pytest.approx(HALF_WIDTH_68 * np.sqrt(spec.sigma2))
    with pytest.raises(ValueError, match="exactly one"):
        ar_forecast.spec_from_fit(fit.union(fit), states, 3, 10)
