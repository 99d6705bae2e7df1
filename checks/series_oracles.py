"""SQL counterpart of the queries over many fitted series, several lags and calendar leads."""

from __future__ import annotations

from checks import fixtures as fx
from checks import sqltext as draw
from checks.oracles import BASE, INDICES, LAGGED, NOISE, NOISE_ROWS, SITE_SCORES, design, forcing, regression, rnd, rss, with_
from foreunc.operators.design import HALF_WIDTH_68

# -- fits with their covariance ------------------------------------------------------------------

REGRESSORS = ["lag1", "x1", "x2"]
NAMES = ["ar1", "intercept", "b_x1", "b_x2"]


def _entry(i: int, j: int) -> str:
    a, b = sorted((i, j))
    return f"s_{REGRESSORS[a]}_{REGRESSORS[b]}"


def _minor(i: int, j: int) -> str:
    (a, b), (c, d) = [k for k in range(3) if k != i], [k for k in range(3) if k != j]
    sign = "" if (i + j) % 2 == 0 else "-"
    return f"{sign}({_entry(a, c)} * {_entry(b, d)} - {_entry(a, d)} * {_entry(b, c)})"


DETERMINANT = "(" + " + ".join(f"{_entry(0, j)} * {_minor(0, j)}" for j in range(3)) + ")"
PAST = f"past AS (SELECT * FROM monthly WHERE datetime < DATE '{fx.ORIGIN}')"

#: Delta method: the intercept is a / gap with a the regression's constant, gap = 1 - ar1.
FITS = [
    fx.MONTHLY,
    PAST,
    LAGGED.replace("monthly", "past"),
    regression(REGRESSORS, "lagged", "series_id"),
    f"""solved AS (
  SELECT *, m_y - b_lag1 * m_lag1 - b_x1 * m_x1 - b_x2 * m_x2 AS a, 1 - b_lag1 AS gap,
         {rss(REGRESSORS)} / (n - 4) AS sigma2, {", ".join(f"{_minor(i, j)} / {DETERMINANT} AS i{i}{j}" for i in range(3) for j in range(i, 3))}
  FROM slopes)""",
    """spreads AS (
  SELECT *, sigma2 * i00 AS c00, sigma2 * i01 AS c01, sigma2 * i02 AS c02, sigma2 * i11 AS c11, sigma2 * i12 AS c12, sigma2 * i22 AS c22,
         -sigma2 * (i00 * m_lag1 + i01 * m_x1 + i02 * m_x2) AS ca0, -sigma2 * (i01 * m_lag1 + i11 * m_x1 + i12 * m_x2) AS ca1,
         -sigma2 * (i02 * m_lag1 + i12 * m_x1 + i22 * m_x2) AS ca2,
         sigma2 * (1.0 / n + m_lag1 * (i00 * m_lag1 + i01 * m_x1 + i02 * m_x2) + m_x1 * (i01 * m_lag1 + i11 * m_x1 + i12 * m_x2)
                   + m_x2 * (i02 * m_lag1 + i12 * m_x1 + i22 * m_x2)) AS caa
  FROM solved)""",
    """vcov AS (
  SELECT *, c00 AS v11, u * c00 + ca0 / gap AS v21, u * u * c00 + 2 * u * ca0 / gap + caa / (gap * gap) AS v22,
         c01 AS v31, u * c01 + ca1 / gap AS v32, c11 AS v33, c02 AS v41, u * c02 + ca2 / gap AS v42, c12 AS v43, c22 AS v44
  FROM (SELECT *, a / (gap * gap) AS u FROM spreads))""",
]
_FACTOR_STEPS = [
    "factor1 AS (SELECT *, sqrt(v11) AS l11 FROM vcov)",
    "factor2 AS (SELECT *, v21 / l11 AS l21, v31 / l11 AS l31, v41 / l11 AS l41 FROM factor1)",
    "factor3 AS (SELECT *, sqrt(v22 - l21 * l21) AS l22 FROM factor2)",
    "factor4 AS (SELECT *, (v32 - l31 * l21) / l22 AS l32, (v42 - l41 * l21) / l22 AS l42 FROM factor3)",
    "factor5 AS (SELECT *, sqrt(v33 - l31 * l31 - l32 * l32) AS l33 FROM factor4)",
    "factor6 AS (SELECT *, (v43 - l41 * l31 - l42 * l32) / l33 AS l43 FROM factor5)",
    f"""fitted AS MATERIALIZED (
  SELECT series_id, b_lag1 AS ar1, a / gap AS intercept, b_x1, b_x2, sigma2,
         {", ".join(f"l{i}{j}" for i in range(1, 4) for j in range(1, i + 1))}, l41, l42, l43,
         sqrt(v44 - l41 * l41 - l42 * l42 - l43 * l43) AS l44 FROM factor6)""",
]

#: State at the origin: from the intercept six months before the last observation, its own values where observed.
LOOKBACK = 6
STATES = f"""months AS (
  SELECT f.series_id, t.k, m.y, m.x1, m.x2
  FROM fitted f CROSS JOIN range(1, {LOOKBACK + 2}) t(k) LEFT JOIN monthly m
    ON m.series_id = f.series_id
   AND m.datetime = CAST(DATE '{fx.ORIGIN}' + to_months(CAST(t.k AS INT) - {LOOKBACK + 1}) AS DATE)),
filled AS (SELECT series_id, k, y, coalesce(x1, avg(x1) OVER w) AS x1, coalesce(x2, avg(x2) OVER w) AS x2
  FROM months WINDOW w AS (PARTITION BY series_id)),
walk AS (
  SELECT series_id, CAST(0 AS BIGINT) AS k, 0.0::DOUBLE AS x FROM fitted
  UNION ALL
  SELECT w.series_id, w.k + 1,
         CASE WHEN w.k < {LOOKBACK} AND m.y IS NOT NULL THEN m.y - f.intercept
              ELSE f.ar1 * w.x + f.b_x1 * m.x1 + f.b_x2 * m.x2 END
  FROM walk w JOIN fitted f USING (series_id) JOIN filled m ON m.series_id = w.series_id AND m.k = w.k + 1),
states AS MATERIALIZED (
  SELECT series_id, x + intercept AS ic_mean, {HALF_WIDTH_68!r} * sqrt(sigma2) AS ic_sd
  FROM walk JOIN fitted USING (series_id) WHERE k = {LOOKBACK + 1})"""

SERIES = [*FITS, *_FACTOR_STEPS, STATES]

# -- designs and paths ------------------------------------------------------------------------------

KEYS = ("series_id", "sample_id")


def series_design(tag: str) -> str:
    columns = []
    for i, name in enumerate(NAMES):
        terms = [f"{name}"] + [f"l{i + 1}{j + 1} * {draw.normal(f'param:{tag}:{j}', *KEYS)}" for j in range(i + 1)]
        columns.append(f"{' + '.join(terms)} AS {name}")
    columns.append(f"ic_mean + ic_sd * {draw.normal(f'ic:{tag}:ic', *KEYS)} AS ic")
    columns.append(f"{draw.index(f'member:{tag}', fx.LINES, *KEYS)} AS member")
    noise = "sample_id" if tag == "a" else draw.index(f"noise_row:{tag}", fx.SERIES_SAMPLES, *KEYS)
    columns.append(f"{noise} AS noise_id")
    return (
        f"design_{tag} AS MATERIALIZED (SELECT series_id, sample_id, {', '.join(columns)} FROM ("
        f"SELECT * FROM fitted JOIN states USING (series_id) CROSS JOIN range(1, {fx.SERIES_SAMPLES + 1}) t(sample_id)))"
    )


SERIES_FORCING = f"""placed AS (
  SELECT (year(datetime) - year(DATE '{fx.FIRST_MONTH}')) * 12 + month(datetime) - month(DATE '{fx.FIRST_MONTH}') + 1 AS lead,
         row_number() OVER (PARTITION BY datetime ORDER BY parameter) AS member, x1, x2 FROM monthly_drivers),
picks AS (SELECT series_id, member, count(*) AS draws FROM (
  SELECT series_id, member FROM design_a UNION ALL SELECT series_id, member FROM design_b) GROUP BY 1, 2),
slots AS (SELECT series_id, member, draws, lead FROM picks, range(1, {fx.MONTHS + 1}) t(lead)),
forcing AS MATERIALIZED (
  SELECT series_id, member, lead, {", ".join(
      f"coalesce({v}, sum({v} * draws) OVER w / sum(CASE WHEN {v} IS NOT NULL THEN draws END) OVER w) AS {v}" for v in ("x1", "x2")
  )}
  FROM slots LEFT JOIN placed USING (member, lead) WINDOW w AS (PARTITION BY series_id, lead))"""

SERIES_NOISE = f"""noise AS MATERIALIZED (
  SELECT series_id, noise_id, lead, sqrt(sigma2) * {draw.normal("noise", "series_id", "noise_id", "lead")} AS eps
  FROM fitted, range(1, {fx.SERIES_SAMPLES + 1}) s(noise_id), range(1, {fx.MONTHS + 1}) t(lead))"""

INPUTS = [*NAMES, "ic", "member", "noise_id"]
BLOCKS = {**{n: [n] for n in [*NAMES, "ic"]}, "member": ["member"], "noise": ["noise_id"]}
LIVE = "1 AS live_met, 1 AS live_noise"


def sobol_variants() -> str:
    parts = [
        f"SELECT series_id, sample_id, '{t}' AS variant, {', '.join(INPUTS)}, {LIVE} FROM design_{t}" for t in ("a", "b")
    ]
    for block, columns in BLOCKS.items():
        picked = ", ".join(f"{'b' if c in columns else 'a'}.{c}" for c in INPUTS)
        parts.append(
            f"SELECT a.series_id, a.sample_id, 'ab_{block}', {picked}, {LIVE} "
            "FROM design_a a JOIN design_b b USING (series_id, sample_id)"
        )
    return "variants AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")"


def oat_variants() -> str:
    scalars = [*NAMES, "ic"]
    means = ", ".join(f"avg({c}) AS {c}" for c in scalars)
    parts = []
    for source in ["none", "all", *BLOCKS]:
        free = set(BLOCKS if source == "all" else [source])
        picked = ", ".join(f"{'d' if c in free else 'm'}.{c} AS {c}" for c in scalars)
        parts.append(
            f"SELECT d.series_id, d.sample_id, '{source}' AS variant, {picked}, d.member, d.noise_id, "
            f"{int('member' in free)} AS live_met, {int('noise' in free)} AS live_noise "
            "FROM design_a d JOIN means m USING (series_id)"
        )
    return f"means AS (SELECT series_id, {means} FROM design_a GROUP BY 1), variants AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")"


FROZEN = f"""frozen AS MATERIALIZED (
  SELECT avg(x1) AS x1, avg(x2) AS x2 FROM monthly_drivers WHERE datetime >= DATE '{fx.FIRST_MONTH}')"""

SERIES_PATH = f"""path AS (
  SELECT series_id, sample_id, variant, CAST(0 AS BIGINT) AS lead, ic - intercept AS x FROM variants
  UNION ALL
  SELECT p.series_id, p.sample_id, p.variant, p.lead + 1,
         d.ar1 * p.x + d.live_noise * e.eps + d.b_x1 * (CASE WHEN d.live_met = 1 THEN f.x1 ELSE z.x1 END)
           + d.b_x2 * (CASE WHEN d.live_met = 1 THEN f.x2 ELSE z.x2 END)
  FROM path p JOIN variants d ON p.series_id = d.series_id AND p.sample_id = d.sample_id AND p.variant = d.variant
  JOIN forcing f ON f.series_id = d.series_id AND f.member = d.member AND f.lead = p.lead + 1
  JOIN noise e ON e.series_id = d.series_id AND e.noise_id = d.noise_id AND e.lead = p.lead + 1, frozen z
  WHERE p.lead < {fx.MONTHS}),
forecast AS MATERIALIZED (
  SELECT series_id, sample_id, variant, p.lead, p.x + d.intercept AS y FROM path p JOIN variants d USING (series_id, sample_id, variant))"""

SERIES_PATHS = [*SERIES, fx.MONTHLY_DRIVERS, series_design("a"), series_design("b"), SERIES_FORCING, SERIES_NOISE, FROZEN]

SERIES_INDICES = """moments AS (SELECT series_id, lead, var_samp(y) AS v FROM forecast WHERE variant = 'a' GROUP BY 1, 2),
indices AS (
  SELECT s.series_id, s.lead, substr(s.variant, 4) AS input,
         1 - avg((b.y - s.y) * (b.y - s.y)) / (2 * m.v) AS first_order, avg((a.y - s.y) * (a.y - s.y)) / (2 * m.v) AS total_order
  FROM forecast s
  JOIN forecast a ON a.variant = 'a' AND a.series_id = s.series_id AND a.sample_id = s.sample_id AND a.lead = s.lead
  JOIN forecast b ON b.variant = 'b' AND b.series_id = s.series_id AND b.sample_id = s.sample_id AND b.lead = s.lead
  JOIN (SELECT series_id, lead, CASE WHEN v > 0 THEN v END AS v FROM moments) m ON m.series_id = s.series_id AND m.lead = s.lead
  WHERE s.variant LIKE 'ab%' GROUP BY s.series_id, s.lead, m.v, s.variant)"""

# -- three lags -----------------------------------------------------------------------------------


def _lower(cov: list[list[float]]) -> list[list[float]]:
    """Cholesky factor written out, so that the library's own isn't on both sides."""
    size = len(cov)
    out = [[0.0] * size for _ in range(size)]
    for i in range(size):
        for j in range(i + 1):
            rest = cov[i][j] - sum(out[i][k] * out[j][k] for k in range(j))
            out[i][j] = rest**0.5 if i == j else rest / out[j][j]
    return out


def lag_design(tag: str) -> str:
    columns, factor = [], _lower(fx.LAG_COV)
    for i, name in enumerate(fx.LAG_NAMES):
        terms = [f"{fx.LAG_MEAN[i]!r}::DOUBLE"]
        terms += [f"{factor[i][j]!r}::DOUBLE * {draw.normal(f'param:{tag}:{j}', 'sample_id')}" for j in range(i + 1) if factor[i][j]]
        columns.append(f"{' + '.join(terms)} AS {name}")
    for name, (mean, sd) in fx.LAG_IC.items():
        columns.append(f"{mean!r}::DOUBLE + {sd!r}::DOUBLE * {draw.normal(f'ic:{tag}:{name}', 'sample_id')} AS {name}")
    columns.append(f"{draw.index(f'member:{tag}', fx.MEMBERS, 'sample_id')} AS member")
    noise = "sample_id" if tag == "a" else draw.index(f"noise_row:{tag}", NOISE_ROWS, "sample_id")
    columns.append(f"{noise} AS noise_id")
    return (
        f"design_{tag} AS MATERIALIZED (SELECT sample_id, {', '.join(columns)} "
        "FROM (SELECT o_orderkey + 1 AS sample_id FROM orders))"
    )


LAG_BLOCKS = {**{n: [n] for n in [*fx.LAG_NAMES, *fx.LAG_IC]}, "member": ["member"], "noise": ["noise_id"]}
LAG_INPUTS = [*fx.LAG_NAMES, *fx.LAG_IC, "member", "noise_id"]


def lag_variants() -> str:
    parts = [f"SELECT sample_id, '{t}' AS variant, {', '.join(LAG_INPUTS)} FROM design_{t}" for t in ("a", "b")]
    for block, columns in LAG_BLOCKS.items():
        picked = ", ".join(f"{'b' if c in columns else 'a'}.{c}" for c in LAG_INPUTS)
        parts.append(f"SELECT sample_id, 'ab_{block}', {picked} FROM design_a a JOIN design_b b USING (sample_id)")
    return "variants AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")"


LAG_PATH = f"""path AS (
  SELECT sample_id, variant, 0 AS lead, dayof - intercept AS x, lag1 - intercept AS x1, lag2 - intercept AS x2 FROM variants
  UNION ALL
  SELECT p.sample_id, p.variant, p.lead + 1,
         d.ar1 * p.x + d.ar2 * p.x1 + d.ar3 * p.x2 + e.eps + d.b_air_temperature * f.air_temperature
           + d.b_relative_humidity * f.relative_humidity, p.x, p.x1
  FROM path p JOIN variants d ON p.sample_id = d.sample_id AND p.variant = d.variant
  JOIN forcing f ON f.member = d.member AND f.lead = p.lead + 1
  JOIN noise e ON e.noise_id = d.noise_id AND e.lead = p.lead + 1
  WHERE p.lead < {fx.STEPS}),
forecast AS MATERIALIZED (
  SELECT sample_id, variant, p.lead, p.x + d.intercept AS y FROM path p JOIN variants d USING (sample_id, variant))"""

# -- random effects, errors of observation, skill by site -----------------------------------------

TERMS = "terms AS (" + " UNION ALL ".join(
    f"SELECT series_id, '{name}' AS term, {value} AS coef, v{i}{i} AS variance FROM vcov"
    for i, (name, value) in enumerate(zip(NAMES, ["b_lag1", "a / gap", "b_x1", "b_x2"]), 1)
) + ")"
EFFECTS = """effects AS MATERIALIZED (
  SELECT term, count(*) AS n_series, avg(coef) AS mean, greatest(var_samp(coef) - avg(variance), 0) AS between_var, avg(variance) AS within
  FROM terms GROUP BY 1)"""


def population_design(tag: str) -> str:
    columns = []
    for i, name in enumerate(NAMES):
        of = f"(SELECT {{}} FROM effects WHERE term = '{name}')"
        mean, sd = of.format("mean"), of.format("sqrt((between_var + within) / n_series)")
        columns.append(f"{mean} + {sd} * {draw.normal(f'param:{tag}:{i}', 'sample_id')} AS {name}")
        columns.append(f"{of.format('sqrt(between_var)')} * {draw.normal(f'effect:{tag}:{name}', 'sample_id')} AS u_{name}")
    mean, sd = fx.MONTH_IC
    columns.append(f"{mean!r}::DOUBLE + {sd!r}::DOUBLE * {draw.normal(f'ic:{tag}:ic', 'sample_id')} AS ic")
    columns.append(f"{draw.index(f'member:{tag}', fx.LINES, 'sample_id')} AS member")
    for column, purpose in (("noise_id", "noise_row"), ("obs_id", "observation_row")):
        drawn = "sample_id" if tag == "a" else draw.index(f"{purpose}:{tag}", fx.SERIES_SAMPLES, "sample_id")
        columns.append(f"{drawn} AS {column}")
    return f"design_{tag} AS MATERIALIZED (SELECT sample_id, {', '.join(columns)} FROM range(1, {fx.SERIES_SAMPLES + 1}) t(sample_id))"


EFFECT_INPUTS = [*NAMES, *(f"u_{n}" for n in NAMES), "ic", "member", "noise_id", "obs_id"]
EFFECT_BLOCKS = {
    **{n: [n] for n in [*NAMES, "ic"]}, "random_effect": [f"u_{n}" for n in NAMES], "member": ["member"],
    "noise": ["noise_id"], "observation": ["obs_id"],
}


def effect_variants() -> str:
    parts = [f"SELECT sample_id, '{t}' AS variant, {', '.join(EFFECT_INPUTS)} FROM design_{t}" for t in ("a", "b")]
    for block, columns in EFFECT_BLOCKS.items():
        picked = ", ".join(f"{'b' if c in columns else 'a'}.{c}" for c in EFFECT_INPUTS)
        parts.append(f"SELECT sample_id, 'ab_{block}', {picked} FROM design_a a JOIN design_b b USING (sample_id)")
    return "variants AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")"


POPULATION_FORCING = SERIES_FORCING.replace("series_id, ", "").replace(
    "FROM monthly_drivers", f"FROM monthly_drivers WHERE datetime >= DATE '{fx.FIRST_MONTH}'"
).replace("GROUP BY 1, 2)", "GROUP BY 1)")


def errors(name: str, purpose: str, share: float) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT id, lead, sqrt({share} * (SELECT avg(sigma2) FROM solved)) * {draw.normal(purpose, "id", "lead")} AS eps
  FROM range(1, {fx.SERIES_SAMPLES + 1}) s(id), range(1, {fx.MONTHS + 1}) t(lead))"""


POPULATION_PATH = f"""path AS (
  SELECT sample_id, variant, CAST(0 AS BIGINT) AS lead, ic - intercept - u_intercept AS x FROM variants
  UNION ALL
  SELECT p.sample_id, p.variant, p.lead + 1,
         (d.ar1 + d.u_ar1) * p.x + e.eps + (d.b_x1 + d.u_b_x1) * f.x1 + (d.b_x2 + d.u_b_x2) * f.x2
  FROM path p JOIN variants d ON p.sample_id = d.sample_id AND p.variant = d.variant
  JOIN forcing f ON f.member = d.member AND f.lead = p.lead + 1
  JOIN noise e ON e.id = d.noise_id AND e.lead = p.lead + 1
  WHERE p.lead < {fx.MONTHS}),
forecast AS MATERIALIZED (
  SELECT p.sample_id, p.variant, p.lead, p.x + d.intercept + d.u_intercept + coalesce(o.eps, 0) AS y
  FROM path p JOIN variants d USING (sample_id, variant) LEFT JOIN observation o ON o.id = d.obs_id AND o.lead = p.lead)"""

SPLIT = f"""spans AS MATERIALIZED (
  SELECT p.series_id, min(datetime) AS first, max(datetime) AS last, avg(x1) AS m1, avg(x2) AS m2,
         any_value(f.ar1) AS ar1, any_value(f.intercept) AS c, any_value(f.b_x1) AS b1, any_value(f.b_x2) AS b2
  FROM past p JOIN fitted f USING (series_id) GROUP BY 1),
dates AS MATERIALIZED (
  SELECT s.series_id, row_number() OVER (PARTITION BY s.series_id ORDER BY d.at) AS k, p.y - s.c AS y,
         s.b1 * coalesce(p.x1, s.m1) + s.b2 * coalesce(p.x2, s.m2) AS drift
  FROM spans s, (SELECT DISTINCT datetime AS at FROM past) d LEFT JOIN past p ON p.series_id = s.series_id AND p.datetime = d.at
  WHERE d.at BETWEEN s.first AND s.last),
filter AS (
  SELECT series_id, CAST(i AS INT) AS pos, i / 10.0::DOUBLE AS r, CAST(0 AS BIGINT) AS k, 0.0::DOUBLE AS m,
         (1 - i / 10.0::DOUBLE) / greatest(1 - ar1 * ar1, 0.001) AS v, 0 AS n, 0.0::DOUBLE AS squares, 0.0::DOUBLE AS logs
  FROM spans, range(0, 10) t(i)
  UNION ALL
  SELECT series_id, pos, r, k, CASE WHEN e IS NULL THEN ahead ELSE ahead + spread / (spread + r) * e END,
         CASE WHEN e IS NULL THEN spread ELSE spread * r / (spread + r) END,
         n + CASE WHEN e IS NULL THEN 0 ELSE 1 END, squares + coalesce(e * e / (spread + r), 0),
         logs + CASE WHEN e IS NULL THEN 0 ELSE ln(spread + r) END
  FROM (
    SELECT f.series_id, f.pos, f.r, f.k + 1 AS k, f.n, f.squares, f.logs, s.ar1 * f.m + d.drift AS ahead,
           s.ar1 * s.ar1 * f.v + 1 - f.r AS spread, d.y - (s.ar1 * f.m + d.drift) AS e
    FROM filter f JOIN spans s USING (series_id) JOIN dates d ON d.series_id = f.series_id AND d.k = f.k + 1)),
rated AS (
  SELECT series_id, pos, r, n, squares / n AS scale, -0.5 * (n * (ln(squares / n) + 1 + ln(2 * pi())) + logs) AS log_likelihood
  FROM filter f JOIN (SELECT series_id, max(k) AS k FROM dates GROUP BY 1) USING (series_id, k)),
best AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY log_likelihood DESC, pos) AS place FROM rated)"""

SKILL = """rated AS (SELECT site_id, lead, crps, CASE WHEN lead % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS even FROM scores),
levels AS (SELECT site_id, avg(crps) AS my, avg(lead) AS ml, avg(even) AS me FROM rated WHERE crps IS NOT NULL GROUP BY 1),
moved AS (SELECT crps - my AS y, lead - ml AS l, even - me AS e FROM rated JOIN levels USING (site_id) WHERE crps IS NOT NULL),
sums AS (SELECT sum(l * l) AS ll, sum(l * e) AS le, sum(e * e) AS ee, sum(l * y) AS ly, sum(e * y) AS ey FROM moved),
slopes AS (SELECT (ly * ee - ey * le) / (ll * ee - le * le) AS bl, (ey * ll - ly * le) / (ll * ee - le * le) AS be FROM sums)"""

# -- leads by the calendar --------------------------------------------------------------------------


def calendar_forcing(offset: int) -> str:
    lead = f"CAST(datetime - DATE '{fx.FORECAST_DATE}' AS BIGINT) + {1 - offset}"
    kept = f"region_drivers WHERE datetime <> DATE '{fx.GAP_DAY}'"
    text = forcing("a").replace("dense_rank() OVER (ORDER BY datetime)", lead).replace("FROM region_drivers", f"FROM {kept}")
    return (
        "(" + with_(*BASE, design("a"), text)
        + f"SELECT member, lead, {rnd('air_temperature', 'air_temperature')}, "
        f"{rnd('relative_humidity', 'relative_humidity')}, {offset} AS driver_offset FROM forcing)"
    )


ORACLES: dict[str, str] = {
    "series_origin_states": with_(*SERIES, recursive=True)
    + f"SELECT series_id, 1 AS lags, {rnd('ic_mean', 'ic_mean')}, {rnd('ic_sd', 'ic_sd')} FROM states",
    "series_designs": with_(*FITS, *_FACTOR_STEPS)
    + "SELECT series_id, "
    + ", ".join(rnd(c, c) for c in [*NAMES, *(f"l{i}{j}" for i in range(1, 5) for j in range(1, i + 1))])
    + " FROM fitted",
    "series_forecasts": with_(
        *SERIES_PATHS,
        f"variants AS MATERIALIZED (SELECT series_id, sample_id, 'a' AS variant, {', '.join(INPUTS)}, {LIVE} FROM design_a)",
        SERIES_PATH, recursive=True,
    )
    + f"""SELECT series_id, CAST(lead AS INT) AS lead, count(y) AS n, {rnd("avg(y)", "mean", 5)}, {rnd("var_samp(y)", "variance", 5)}
      FROM forecast GROUP BY 1, 2""",
    "series_sobol": with_(*SERIES_PATHS, sobol_variants(), SERIES_PATH, SERIES_INDICES, recursive=True)
    + f"""SELECT series_id, CAST(lead AS INT) AS lead, input, {rnd("first_order", "first_order", 5)},
      {rnd("total_order", "total_order", 5)} FROM indices""",
    "series_one_at_a_time": with_(
        *SERIES_PATHS, oat_variants(), SERIES_PATH,
        "v AS (SELECT series_id, lead, variant AS source, var_samp(y) AS variance FROM forecast GROUP BY 1, 2, 3)",
        recursive=True,
    )
    + f"""SELECT v.series_id, CAST(v.lead AS INT) AS lead, v.source, {rnd("v.variance", "variance", 5)},
      {rnd("v.variance / CASE WHEN w.variance > 0 THEN w.variance END", "share", 5)}
      FROM v JOIN v w ON w.series_id = v.series_id AND w.lead = v.lead AND w.source = 'all'""",
    "three_lag_forecast": with_(
        *BASE, lag_design("a"), forcing("a"), NOISE,
        f"variants AS MATERIALIZED (SELECT sample_id, 'a' AS variant, {', '.join(LAG_INPUTS)} FROM design_a)",
        LAG_PATH, recursive=True,
    )
    + f"SELECT sample_id, lead, {rnd('y', 'y')} FROM forecast",
    "three_lag_sobol": with_(
        *BASE, lag_design("a"), lag_design("b"), forcing("a", "b"), NOISE, lag_variants(), LAG_PATH, INDICES, recursive=True
    )
    + f"""SELECT lead, input, {rnd("first_order", "first_order")}, {rnd("total_order", "total_order")} FROM indices""",
    "random_effect_variances": with_(*FITS, TERMS, EFFECTS)
    + f"""SELECT term, n_series, {rnd("mean", "mean")}, {rnd("between_var", "between")}, {rnd("within", "within")} FROM effects""",
    "shrunken_coefficients": with_(*FITS, TERMS, EFFECTS)
    + f"""SELECT series_id, term, {rnd("coef", "coef")}, {rnd("mean + w * (coef - mean)", "shrunken")}, {rnd("sqrt(w * variance)", "se")}
      FROM (SELECT *, coalesce(between_var / nullif(between_var + variance, 0), 1) AS w FROM terms JOIN effects USING (term))""",
    "random_effect_sobol": with_(
        *FITS, TERMS, EFFECTS, fx.MONTHLY_DRIVERS, population_design("a"), population_design("b"), POPULATION_FORCING,
        errors("noise", "noise", 0.8), errors("observation", "observation", 0.2), effect_variants(), POPULATION_PATH, INDICES,
        recursive=True,
    )
    + f"""SELECT CAST(lead AS INT) AS lead, input, {rnd("first_order", "first_order", 5)}, {rnd("total_order", "total_order", 5)} FROM indices""",
    "observation_error_split": with_(*FITS, *_FACTOR_STEPS, SPLIT, recursive=True)
    + f"""SELECT series_id, CAST(n AS BIGINT) AS n, {rnd("r", "ratio")}, {rnd("scale * (1 - r)", "process_sigma2")},
      {rnd("scale * r", "observation_sigma2")}, {rnd("log_likelihood", "log_likelihood")} FROM best WHERE place = 1""",
    "skill_by_site": with_(*SITE_SCORES, SKILL)
    + f"""SELECT site_id, lead, {rnd("crps", "crps")}, {rnd("my + bl * (lead - ml) + be * (even - me)", "smooth")}
      FROM rated LEFT JOIN levels USING (site_id), slopes""",
    "forcing_by_calendar": " UNION ALL ".join(calendar_forcing(o) for o in (-1, 0, 1)),
}
