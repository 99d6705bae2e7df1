"""SQL counterpart of the queries, run by DuckDB on the same tables."""

from __future__ import annotations

from checks import fixtures as fx
from checks import sqltext as draw
from foreunc.operators.design import cholesky

R = 6


def rnd(expr: str, name: str, digits: int = R) -> str:
    return f"round({expr}, {digits}) + 0.0::DOUBLE AS {name}"


def with_(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"


# -- pieces ----------------------------------------------------------------------------------------

L_FACTOR = cholesky(fx.COV)
NOISE_ROWS = "(SELECT max(o_orderkey) + 1 FROM orders)"


def _parameter(tag: str, i: int) -> str:
    terms = [f"{fx.MEAN[i]!r}::DOUBLE"]
    for j in range(i + 1):
        if L_FACTOR[i, j]:
            z = draw.normal(f"param:{tag}:{j}", "sample_id")
            terms.append(f"{float(L_FACTOR[i, j])!r}::DOUBLE * {z}")
    return " + ".join(terms)


def design(tag: str) -> str:
    columns = [f"{_parameter(tag, i)} AS {n}" for i, n in enumerate(fx.NAMES)]
    z = draw.normal(f"ic:{tag}:ic", "sample_id")
    columns.append(f"{fx.IC_MEAN!r}::DOUBLE + {fx.IC_SD!r}::DOUBLE * {z} AS ic")
    columns.append(f"{draw.index(f'member:{tag}', fx.MEMBERS, 'sample_id')} AS member")
    noise = "sample_id" if tag == "a" else draw.index(f"noise_row:{tag}", NOISE_ROWS, "sample_id")
    columns.append(f"{noise} AS noise_id")
    return (
        f"design_{tag} AS MATERIALIZED (SELECT sample_id, {', '.join(columns)} "
        "FROM (SELECT o_orderkey + 1 AS sample_id FROM orders))"
    )


def forcing(*tags: str) -> str:
    """Driver values per (member, lead), gaps filled by the mean over the sampled rows."""
    picked = " UNION ALL ".join(f"SELECT member FROM design_{t}" for t in tags)
    fill = ", ".join(
        f"coalesce({v}, sum({v} * draws) OVER (PARTITION BY lead) / "
        f"sum(CASE WHEN {v} IS NOT NULL THEN draws END) OVER (PARTITION BY lead)) AS {v}"
        for v in fx.USED
    )
    return f"""placed AS (
  SELECT dense_rank() OVER (ORDER BY datetime) AS lead,
         row_number() OVER (PARTITION BY datetime ORDER BY parameter) AS member,
         {", ".join(fx.USED)} FROM region_drivers),
picks AS (SELECT member, count(*) AS draws FROM ({picked}) GROUP BY 1),
slots AS (SELECT member, draws, lead FROM picks, range(1, {fx.STEPS + 1}) t(lead)),
forcing AS MATERIALIZED (
  SELECT member, lead, {fill} FROM slots LEFT JOIN placed USING (member, lead))"""


EPS = f"sqrt({fx.SIGMA2}::DOUBLE) * " + draw.normal("noise", "noise_id", "lead")
BASE = [fx.READINGS, fx.REGION_DRIVERS]

NOISE = f"""noise AS MATERIALIZED (
  SELECT noise_id, lead, {EPS} AS eps
  FROM (SELECT o_orderkey + 1 AS noise_id FROM orders), range(1, {fx.STEPS + 1}) t(lead))"""


def path(source: str, keys: str = "sample_id") -> str:
    """The recursion over leads for every row of ``source``."""
    on = " AND ".join(f"p.{k.strip()} = d.{k.strip()}" for k in keys.split(","))
    kept = ", ".join(f"p.{k.strip()}" for k in keys.split(","))
    return f"""path AS (
  SELECT {keys}, 0 AS lead, ic - intercept AS x FROM {source}
  UNION ALL
  SELECT {kept}, p.lead + 1,
         d.ar1 * p.x + e.eps + d.b_air_temperature * f.air_temperature
           + d.b_relative_humidity * f.relative_humidity
  FROM path p JOIN {source} d ON {on}
  JOIN forcing f ON f.member = d.member AND f.lead = p.lead + 1
  JOIN noise e ON e.noise_id = d.noise_id AND e.lead = p.lead + 1
  WHERE p.lead < {fx.STEPS}),
forecast AS (SELECT {kept}, p.lead, p.x + d.intercept AS y FROM path p JOIN {source} d ON {on})"""


FORECAST = [*BASE, design("a"), forcing("a"), NOISE, path("design_a")]

BLOCKS = {**{n: [n] for n in fx.NAMES}, "ic": ["ic"], "member": ["member"], "noise": ["noise_id"]}
INPUTS = [*fx.NAMES, "ic", "member", "noise_id"]


def variants() -> str:
    parts = []
    for tag in ("a", "b"):
        parts.append(
            f"SELECT sample_id, '{tag}' AS variant, {', '.join(f'{tag}.{c}' for c in INPUTS)} "
            f"FROM design_{tag} {tag}"
        )
    for block, columns in BLOCKS.items():
        picked = ", ".join(f"{'b' if c in columns else 'a'}.{c}" for c in INPUTS)
        parts.append(
            f"SELECT sample_id, 'ab_{block}', {picked} "
            "FROM design_a a JOIN design_b b USING (sample_id)"
        )
    return "variants AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")"


INDICES = """moments AS (SELECT lead, var_samp(y) AS v FROM forecast WHERE variant = 'a' GROUP BY 1),
indices AS (
  SELECT m.lead, substr(s.variant, 4) AS input,
         1 - avg((b.y - s.y) * (b.y - s.y)) / (2 * m.v) AS first_order,
         avg((a.y - s.y) * (a.y - s.y)) / (2 * m.v) AS total_order
  FROM forecast s
  JOIN forecast a ON a.variant = 'a' AND a.sample_id = s.sample_id AND a.lead = s.lead
  JOIN forecast b ON b.variant = 'b' AND b.sample_id = s.sample_id AND b.lead = s.lead
  JOIN (SELECT lead, CASE WHEN v > 0 THEN v END AS v FROM moments) m ON m.lead = s.lead
  WHERE s.variant LIKE 'ab%' GROUP BY m.lead, m.v, s.variant)"""

SOBOL_AR = [
    *BASE, design("a"), design("b"), forcing("a", "b"), NOISE, variants(),
    path("variants", "sample_id, variant"), INDICES,
]

MEMORYLESS = """forecast AS MATERIALIZED (
  SELECT {keys}, 0 AS lead, ic AS y FROM {source}
  UNION ALL
  SELECT {kept}, f.lead, d.intercept + d.b_air_temperature * f.air_temperature
         + d.b_relative_humidity * f.relative_humidity + e.eps
  FROM {source} d JOIN forcing f ON f.member = d.member
  JOIN noise e ON e.noise_id = d.noise_id AND e.lead = f.lead)"""


def oat(per_date: bool) -> list[str]:
    """Frozen rows: means of the design, driver means, no noise."""
    frozen_met = (
        "SELECT lead, avg(air_temperature) t, avg(relative_humidity) r FROM placed GROUP BY 1"
        if per_date
        else "SELECT s.lead, m.t, m.r FROM (SELECT DISTINCT lead FROM slots) s, "
        "(SELECT avg(air_temperature) t, avg(relative_humidity) r FROM region_drivers) m"
    )
    scalars = [*fx.NAMES, "ic"]
    means = "means AS (SELECT " + ", ".join(f"avg({c}) AS {c}" for c in scalars) + " FROM design_a)"
    parts = []
    for source in ["none", "all", *BLOCKS]:
        free = set(BLOCKS if source == "all" else [source])
        picked = ", ".join(f"{'d' if c in free else 'm'}.{c} AS {c}" for c in scalars)
        parts.append(
            f"SELECT sample_id, '{source}' AS variant, {picked}, d.member, d.noise_id, "
            f"{int('member' in free)} AS live_met, {int('noise' in free)} AS live_noise "
            "FROM design_a d, means m"
        )
    rows = "variants AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")"
    steps = f"""frozen_met AS MATERIALIZED ({frozen_met}),
path AS (
  SELECT sample_id, variant, 0 AS lead, ic - intercept AS x FROM variants
  UNION ALL
  SELECT p.sample_id, p.variant, p.lead + 1, d.ar1 * p.x + d.live_noise * e.eps
    + d.b_air_temperature * (CASE WHEN d.live_met = 1 THEN f.air_temperature ELSE z.t END)
    + d.b_relative_humidity * (CASE WHEN d.live_met = 1 THEN f.relative_humidity ELSE z.r END)
  FROM path p JOIN variants d ON p.sample_id = d.sample_id AND p.variant = d.variant
  JOIN forcing f ON f.member = d.member AND f.lead = p.lead + 1
  JOIN frozen_met z ON z.lead = p.lead + 1
  JOIN noise e ON e.noise_id = d.noise_id AND e.lead = p.lead + 1
  WHERE p.lead < {fx.STEPS}),
v AS (SELECT lead, variant AS source, var_samp(p.x + d.intercept) AS variance
      FROM path p JOIN variants d USING (sample_id, variant) GROUP BY 1, 2)"""
    return [*BASE, design("a"), forcing("a"), NOISE, means, rows, steps]


OAT_SELECT = (
    f"SELECT v.lead, v.source, {rnd('v.variance', 'variance')}, "
    f"{rnd('v.variance / CASE WHEN w.variance > 0 THEN w.variance END', 'share')} "
    "FROM v JOIN v w ON w.lead = v.lead AND w.source = 'all'"
)

REGION_OBS = f"""obs AS (
  SELECT datetime - DATE '{fx.FORECAST_DATE}' AS lead, observation AS obs FROM region_targets
  WHERE datetime BETWEEN DATE '{fx.FORECAST_DATE}'
    AND DATE '{fx.FORECAST_DATE}' + {fx.HORIZON + 1})"""

SITE_ENSEMBLE = f"""obs AS (
  SELECT site_id, datetime - DATE '2024-01-01' AS lead, observation AS obs FROM targets
  WHERE variable = '{fx.TARGET}'),
ens AS (
  SELECT 'S' || user_id AS site_id, CAST(ts AS DATE) - DATE '2024-01-01' AS lead, sqrt(value) AS y
  FROM events WHERE event_type <> '{fx.TARGET}')"""


def score_table(ensemble: str, keys: str) -> str:
    """Scores from the definition; the pairwise spread through ranks inside the group."""
    return f"""ranked AS (
  SELECT {keys}, y, row_number() OVER w AS r, count(*) OVER (PARTITION BY {keys}) AS n
  FROM {ensemble} WINDOW w AS (PARTITION BY {keys} ORDER BY y)),
scored AS (
  SELECT {keys}, any_value(obs) AS obs, max(n) AS n,
         quantile_cont(y, 0.025) AS q025, quantile_cont(y, 0.5) AS q500,
         quantile_cont(y, 0.975) AS q975,
         avg(CASE WHEN y <= obs THEN 1.0 ELSE 0.0 END) AS pit_all,
         avg(abs(y - obs)) - sum((2.0 * r - n - 1) * (y - obs)) / (max(n) * max(n)) AS crps
  FROM ranked LEFT JOIN obs USING ({keys}) GROUP BY {keys}),
scores AS (
  SELECT {keys}, obs, n, q025, q500, q975, q500 - obs AS resid,
         CASE WHEN obs IS NOT NULL THEN pit_all END AS pit, crps,
         CASE WHEN obs IS NOT NULL THEN obs BETWEEN q025 AND q975 END AS covered
  FROM scored
  UNION ALL BY NAME
  SELECT {keys}, obs, 0 AS n FROM obs ANTI JOIN scored USING ({keys}))"""


SCORE_COLUMNS = ", ".join(
    ["n", "covered"] + [rnd(c, c) for c in ("obs", "q025", "q500", "q975", "resid", "pit", "crps")]
)
SITE_SCORES = [fx.TARGETS, SITE_ENSEMBLE, score_table("ens", "site_id, lead")]


def daily(keys: str, mean: str) -> str:
    return (
        with_(fx.READINGS)
        + f"SELECT CAST(datetime AS DATE) AS datetime, {keys}, {rnd(mean, 'prediction')} "
        f"FROM readings GROUP BY CAST(datetime AS DATE), {keys}"
    )


STRICT = "CASE WHEN count(*) = count({x}) THEN avg({x}) END"


def wide(keys: str, names: list[str], strict: bool = False, shift: bool = False) -> str:
    columns = []
    for v in names:
        hit = f"FILTER (WHERE variable = '{v}')"
        value = f"avg(prediction) {hit}"
        if strict:
            value = f"CASE WHEN count(*) {hit} = count(prediction) {hit} THEN {value} END"
        if shift and v == "air_temperature":
            value = f"({value}) - {fx.KELVIN_OFFSET}"
        columns.append(f"{value} AS {v}")
    inside = ", ".join(f"'{v}'" for v in names)
    return (
        f"wide AS (SELECT CAST(datetime AS DATE) AS datetime, {keys}, {', '.join(columns)} "
        f"FROM readings WHERE variable IN ({inside}) GROUP BY CAST(datetime AS DATE), {keys})"
    )


def cells(value: str, names: list[str], prefix: str = "") -> str:
    return ", ".join(
        rnd(f"max({value}) FILTER (WHERE variable = '{v}')", prefix + v) for v in names
    )


USED_ROUNDED = ", ".join(rnd(v, v) for v in fx.USED)

# -- resampling designs ------------------------------------------------------------------------------

DAY = "(datetime - DATE '1970-01-01')"
SHUFFLED = [*fx.USED, "parameter_seed"]


def bootstrap(source: str, group: str, keys: list[str]) -> list[str]:
    """``DATE_SAMPLES`` rows of each group drawn with replacement; ``keys`` are the draws' group keys."""
    return [
        f"""rows_placed AS (SELECT {group}, {", ".join(fx.USED)},
     row_number() OVER (PARTITION BY {group} ORDER BY parameter) AS pos FROM {source})""",
        f"sizes AS (SELECT {group}, count(*) AS cnt FROM {source} GROUP BY {group})",
        f"""picks AS (SELECT {group}, draw, {draw.index("bootstrap", "cnt", *keys, "draw")} AS pos
     FROM sizes, range(1, {fx.DATE_SAMPLES + 1}) t(draw))""",
        f"""drawn AS MATERIALIZED (SELECT {group}, draw, {", ".join(fx.USED)}
     FROM picks JOIN rows_placed USING ({group}, pos))""",
    ]


def date_pair(source: str, group: str, keys: list[str]) -> list[str]:
    """Both halves of each group's draws, the columns of the second shuffled."""
    half = fx.DATE_SAMPLES // 2

    def shuffle(c: str) -> str:
        u = draw.uniform(f"shuffle:{c}", *keys, "parameter_seed")
        return f"""shuffled_{c} AS (SELECT {group}, CAST({c} AS DOUBLE) AS b_{c},
     row_number() OVER (PARTITION BY {group} ORDER BY {u}) AS sample_id
     FROM seeded WHERE parameter_seed > {half})"""

    return [
        *bootstrap(source, group, keys),
        f"""seeded AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {group}
     ORDER BY {draw.uniform("permutation", *keys, "draw")}) AS parameter_seed FROM drawn)""",
        *[shuffle(c) for c in SHUFFLED],
        f"pair AS MATERIALIZED (SELECT {group}, parameter_seed AS sample_id, "
        + ", ".join(f"CAST({c} AS DOUBLE) AS a_{c}" for c in SHUFFLED)
        + ", "
        + ", ".join(f"b_{c}" for c in SHUFFLED)
        + f" FROM (SELECT *, parameter_seed AS sample_id FROM seeded WHERE parameter_seed <= {half}) "
        + " ".join(f"JOIN shuffled_{c} USING ({group}, sample_id)" for c in SHUFFLED)
        + ")",
    ]


BOOTSTRAP = [*BASE, *bootstrap("region_drivers", "datetime", [DAY])]
PAIR = [*BASE, *date_pair("region_drivers", "datetime", [DAY])]


def _linear(choice: dict[str, str]) -> str:
    t = f"{choice['air_temperature']}_air_temperature"
    r = f"{choice['relative_humidity']}_relative_humidity"
    z = draw.normal("predictive", f"{choice['parameter_seed']}_parameter_seed")
    return f"{t} * 2.0::DOUBLE + {t} * {r} / 50.0::DOUBLE + {z}"


ZONE_DRIVERS = f"""zone_drivers AS (
  SELECT * FROM (
    SELECT CAST(substr(site_id, 2) AS INT) % {fx.ZONES} AS zone, CAST(datetime AS DATE) datetime, parameter,
           avg(CASE WHEN variable = 'air_temperature' THEN prediction END) - {fx.KELVIN_OFFSET} air_temperature,
           avg(CASE WHEN variable = 'relative_humidity' THEN prediction END) relative_humidity
    FROM readings WHERE CAST(datetime AS DATE) >= DATE '{fx.FORECAST_DATE}'
      AND variable IN ('air_temperature', 'relative_humidity') GROUP BY 1, 2, 3)
  WHERE air_temperature IS NOT NULL AND relative_humidity IS NOT NULL)"""


def sobol_rows(source: str, group: str, y: dict[str, str], blocks: list[str]) -> str:
    """Indices of a column model: ``y`` maps variant to expression."""
    columns = ", ".join(f"{e} AS y_{n}" for n, e in y.items())
    parts = " UNION ALL ".join(
        f"SELECT {group}, '{k}' AS input, "
        + rnd(f"1 - avg((y_b - y_ab_{k}) * (y_b - y_ab_{k})) / (2 * var_samp(y_a))", "first_order")
        + ", "
        + rnd(f"avg((y_a - y_ab_{k}) * (y_a - y_ab_{k})) / (2 * var_samp(y_a))", "total_order")
        + f" FROM outputs GROUP BY {group}"
        for k in blocks
    )
    return f"outputs AS MATERIALIZED (SELECT {group}, {columns} FROM {source}),\nfound AS ({parts})"


def _choices(blocks: dict[str, list[str]]) -> dict[str, dict[str, str]]:
    names = [c for cs in blocks.values() for c in cs]
    out = {"a": dict.fromkeys(names, "a"), "b": dict.fromkeys(names, "b")}
    for k, cs in blocks.items():
        out[f"ab_{k}"] = {c: "b" if c in cs else "a" for c in names}
    return out


_DATE_BLOCKS = {c: [c] for c in SHUFFLED}
_ORDER_BLOCKS = {"price": ["price"], "terms": ["discount", "quantity"]}


def _order_value(ch: dict[str, str]) -> str:
    p, d, q = (f"{ch[c]}_{c}" for c in ("price", "discount", "quantity"))
    return f"{p} * (1.0::DOUBLE - {d}) + {q} * {d}"


ORDER_PAIR = f"""parts AS (
  SELECT l_suppkey, l_orderkey, max(l_extendedprice) AS price, max(l_discount) AS discount,
         max(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2),
pair AS MATERIALIZED (
  SELECT l_suppkey % 10 AS grp, price / 1000 AS a_price, discount AS a_discount,
         quantity AS a_quantity,
         {draw.uniform("pair:p", "l_orderkey", "l_suppkey")} * 50.0 AS b_price,
         {draw.uniform("pair:d", "l_orderkey", "l_suppkey")} * 0.1 AS b_discount,
         {draw.uniform("pair:q", "l_orderkey", "l_suppkey")} * 50.0 AS b_quantity
  FROM parts)"""

# -- series fits -------------------------------------------------------------------------------------


def regression(columns: list[str], source: str, key: str) -> str:
    """Least squares on two or three centred regressors by Cramer's rule."""
    names = ["y", *columns]
    complete = " AND ".join(f"{c} IS NOT NULL" for c in names)
    means = ", ".join(f"avg({c}) AS m_{c}" for c in names)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = ", ".join(f"sum(({a} - m_{a}) * ({b} - m_{b})) AS s_{a}_{b}" for a, b in pairs)
    kept = ", ".join(f"any_value(m_{c}) AS m_{c}" for c in names)

    def s(a, b):
        return f"s_{a}_{b}" if (a, b) in pairs else f"s_{b}_{a}"

    def det(cols):
        rows = [[s(r, c) for c in cols] for r in columns]
        if len(columns) == 2:
            return f"({rows[0][0]} * {rows[1][1]} - {rows[0][1]} * {rows[1][0]})"
        (a, b, c), (d, e, f), (g, h, i) = rows
        return (
            f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g})"
            f" + {c} * ({d} * {h} - {e} * {g}))"
        )

    slopes = []
    for k, c in enumerate(columns):
        cols = [*columns[:k], "y", *columns[k + 1 :]]
        slopes.append(f"{det(cols)} / {det(columns)} AS b_{c}")
    return f"""centres AS (SELECT {key}, {means} FROM {source} WHERE {complete} GROUP BY 1),
sums AS (SELECT {key}, count(*) AS n, {sums}, {kept}
  FROM {source} JOIN centres USING ({key}) WHERE {complete} GROUP BY 1),
slopes AS (SELECT *, {", ".join(slopes)} FROM sums)"""


def rss(columns: list[str]) -> str:
    return "(s_y_y - " + " - ".join(f"b_{c} * s_y_{c}" for c in columns) + ")"


LAGGED = """lagged AS (
  SELECT a.series_id, a.datetime, a.y, a.x1, a.x2, b.y AS lag1
  FROM monthly a LEFT JOIN monthly b
    ON b.series_id = a.series_id AND b.datetime = CAST(a.datetime - INTERVAL 1 MONTH AS DATE))"""

TRAIN = """train AS (
  SELECT l_suppkey * 10000 + CAST(floor((CAST(date_trunc('month', l_shipdate) AS DATE)
           - DATE '1970-01-01') / 7.0) AS BIGINT) AS row_id,
         avg(sqrt(l_quantity)) AS quantity, avg(sqrt(l_discount)) AS discount,
         avg(sqrt(l_tax)) AS tax
  FROM lineitem GROUP BY l_suppkey, date_trunc('month', l_shipdate))"""

STANDARDISED = (
    with_(TRAIN)
    + "SELECT row_id, "
    + ", ".join(
        rnd(f"({p} - (SELECT avg({p}) FROM train)) / (SELECT stddev_samp({p}) FROM train)", p)
        for p in ("quantity", "discount", "tax")
    )
    + " FROM train"
)

PRICE = "(l_extendedprice / 1000)"

ORACLES: dict[str, str] = {
    # sources
    "read_targets": with_(fx.TARGETS)
    + f"SELECT datetime, site_id, variable, {rnd('observation', 'observation')} FROM targets",
    "read_half_hourly_targets": f"""SELECT CAST(hour(ts) AS INTEGER) AS hour,
      CAST(minute(ts) AS INTEGER) AS minute, 'S' || user_id AS site_id, event_type AS variable,
      {rnd("value", "observation")} FROM events""",
    "read_site_metadata": with_(fx.METADATA) + "SELECT * FROM metadata",
    "read_driver_forecast": with_(fx.READINGS)
    + f"""SELECT variable, parameter, count(prediction) AS n,
      {rnd("avg(prediction)", "mean_prediction")} FROM readings
      WHERE datetime >= DATE '{fx.FORECAST_DATE}' GROUP BY 1, 2""",
    "read_driver_history": with_(fx.READINGS)
    + f"""SELECT 'N' || c_nationkey AS site_id, variable, count(prediction) AS n,
      {rnd("avg(prediction)", "mean_prediction")}
      FROM readings JOIN customer ON CAST(substr(site_id, 2) AS BIGINT) = c_custkey
      WHERE datetime < DATE '{fx.FORECAST_DATE}'
        AND variable IN ('air_temperature', 'relative_humidity') GROUP BY 1, 2""",
    "cached_history": daily("site_id, variable", "avg(prediction)"),
    "summary_report_roundtrip": with_(fx.TARGETS)
    + f"SELECT variable, count(observation) AS n_obs, {rnd('avg(observation)', 'mean_obs')} "
    "FROM targets GROUP BY 1",
    # filters, columns, guards
    "target_history": with_(fx.TARGETS, fx.METADATA)
    + f"""SELECT site_id, datetime, variable, {rnd("observation", "observation")} FROM targets
      WHERE variable IN ('purchase', 'view') AND datetime < DATE '{fx.FORECAST_DATE}'
        AND site_id IN (SELECT field_site_id FROM metadata WHERE phenology = 1)""",
    "target_evaluation_window": with_(fx.TARGETS)
    + f"""SELECT site_id, datetime - DATE '{fx.FORECAST_DATE}' AS lead, datetime,
      {rnd("observation", "obs")} FROM targets WHERE variable = '{fx.TARGET}'
      AND datetime BETWEEN DATE '{fx.FORECAST_DATE}'
        AND DATE '{fx.FORECAST_DATE}' + {fx.HORIZON + 1}""",
    "sites_with_any_flag": with_(fx.METADATA)
    + "SELECT * FROM metadata WHERE terrestrial = 1 OR aquatics = 1",
    "sites_of_theme": with_(fx.METADATA)
    + "SELECT DISTINCT field_site_id AS site_id FROM metadata WHERE terrestrial = 1",
    "harmonised_targets": with_(fx.TARGETS)
    + f"""SELECT datetime, site_id, variable, {rnd("observation", "observation")},
      'events' AS source FROM targets""",
    "complete_targets": with_(fx.TARGETS)
    + f"""SELECT datetime, site_id, variable, {rnd("observation", "observation")}
      FROM targets WHERE observation IS NOT NULL""",
    "target_sufficiency": with_(
        fx.TARGETS,
        """w AS (SELECT site_id, datetime,
        max(observation) FILTER (WHERE variable = 'purchase') - 4 AS anomaly,
        max(observation) FILTER (WHERE variable = 'view') AS view_mean
        FROM targets WHERE variable IN ('purchase', 'view') GROUP BY 1, 2)""",
    )
    + """SELECT site_id, count(*) AS n_rows, count(anomaly) AS n_target,
      count_if(anomaly IS NOT NULL AND view_mean IS NOT NULL) AS n_overlap,
      count_if(anomaly < 0) AS n_negative,
      CASE WHEN count(anomaly) = 0 THEN 'no_target'
           WHEN count_if(anomaly IS NOT NULL AND view_mean IS NOT NULL) = 0 THEN 'no_overlap'
           ELSE 'ok' END AS status,
      count_if(anomaly < 0) > 0 AS has_negative FROM w GROUP BY 1""",
    # aggregation, reshape, joins
    "strict_daily_member_mean": daily(
        "site_id, parameter, variable", STRICT.format(x="prediction")
    ),
    "skipping_daily_mean": daily("site_id, variable, parameter", "avg(prediction)"),
    "daily_drivers_wide": with_(
        fx.READINGS, wide("site_id, parameter", fx.VARIABLES, strict=True, shift=True)
    )
    + f"SELECT datetime, site_id, parameter, {', '.join(rnd(v, v) for v in fx.VARIABLES)} "
    "FROM wide",
    "targets_wide": with_(fx.TARGETS)
    + f"""SELECT datetime, site_id, {cells("observation", ["purchase", "view", "error"], "obs_")}
      FROM targets WHERE variable IN ('purchase', 'view', 'error') GROUP BY 1, 2""",
    "frozen_drivers": with_(fx.READINGS, wide("parameter", fx.USED))
    + "SELECT datetime, parameter, "
    + ", ".join(rnd(f"(SELECT avg({v}) FROM wide)", v) for v in fx.USED)
    + " FROM wide",
    "targets_with_history": with_(fx.TARGETS, fx.READINGS, wide("site_id, parameter", fx.USED))
    + f"""SELECT datetime, site_id, variable, {rnd("observation", "observation")}, parameter,
      {USED_ROUNDED} FROM (SELECT * FROM targets WHERE variable = '{fx.TARGET}')
      LEFT JOIN wide USING (datetime, site_id)""",
    "drivers_with_targets": with_(fx.TARGETS, fx.READINGS, wide("site_id", fx.USED))
    + f"""SELECT datetime, site_id, variable, {rnd("observation", "observation")}, {USED_ROUNDED}
      FROM (SELECT * FROM targets WHERE variable = '{fx.TARGET}')
      RIGHT JOIN wide USING (datetime, site_id)""",
    "regular_time_grid": with_(
        fx.TARGETS,
        f"t AS (SELECT * FROM targets WHERE variable = '{fx.TARGET}')",
        """grid AS (SELECT site_id, CAST(d AS DATE) AS datetime
        FROM (SELECT DISTINCT site_id FROM t),
             (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS d
              FROM (SELECT min(datetime) AS lo, max(datetime) AS hi FROM t)))""",
    )
    + f"""SELECT site_id, datetime, {rnd("observation", "observation")}
      FROM grid LEFT JOIN t USING (site_id, datetime)""",
    "effective_horizon": with_(fx.TARGETS)
    + f"""SELECT site_id, variable, max(datetime) AS last_date,
      DATE '{fx.FORECAST_DATE}' - max(datetime) + {fx.HORIZON} AS h,
      DATE '{fx.FORECAST_DATE}' - 1 AS issued
      FROM targets WHERE observation IS NOT NULL GROUP BY 1, 2""",
    "first_observations": with_(fx.TARGETS)
    + f"""SELECT datetime, site_id, variable, {rnd("observation", "observation")}, position
      FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY datetime, variable)
              AS position FROM targets) WHERE position <= 3""",
    "appended_targets": with_(fx.TARGETS)
    + f"""SELECT datetime, site_id, variable, {rnd("observation", "observation")},
      CASE variable WHEN 'purchase' THEN 'a' ELSE 'b' END AS part
      FROM targets WHERE variable IN ('purchase', 'view') AND observation IS NOT NULL""",
    "registered_summaries": with_(fx.TARGETS)
    + """SELECT variable, site_id, count(observation) AS n_obs FROM targets
      WHERE variable IN ('purchase', 'view') GROUP BY 1, 2""",
    "box_cox_functions": f"""SELECT l_returnflag, l_linestatus,
      {rnd(f"avg((pow({PRICE}, 0.3) - 1) / 0.3)", "bc")},
      {rnd(f"avg(ln({PRICE}))", "bc_log")},
      {rnd("avg(pow(l_discount * 0.3 + 1, 1 / 0.3))", "inv")},
      {rnd("avg(pow(l_discount * 0.3 + 1, 1 / 0.3) - 1)", "inv_shift")},
      {rnd("avg(greatest(l_discount - 0.05, 0.0))", "clamped")}
      FROM lineitem GROUP BY 1, 2""",
    "price_quantiles": "SELECT l_returnflag, "
    + ", ".join(
        rnd(f"quantile_cont(l_extendedprice, {p})", n)
        for n, p in (("q025", 0.025), ("q500", 0.5), ("q975", 0.975))
    )
    + " FROM lineitem GROUP BY 1",
    # designs
    **{
        f"design_matrix_{t}": with_(design(t))
        + f"SELECT sample_id, {', '.join(rnd(c, c) for c in [*fx.NAMES, 'ic'])}, "
        f"member, noise_id FROM design_{t}"
        for t in ("a", "b")
    },
    "process_noise": with_(NOISE) + f"SELECT noise_id, lead, {rnd('eps', 'eps')} FROM noise",
    "bootstrapped_ensemble": with_(*BOOTSTRAP)
    + f"SELECT datetime, draw, {USED_ROUNDED} FROM drawn",
    "shuffled_halves": with_(*PAIR)
    + "SELECT datetime, sample_id, "
    + ", ".join(rnd(f"{s}_{c}", f"{s}_{c}") for s in ("a", "b") for c in SHUFFLED)
    + " FROM pair",
    "cross_validation_folds": "SELECT event_id, "
    + ", ".join(f"{draw.index(f'fold:{r}', 10, 'event_id')} - 1 AS fold_{r}" for r in range(1, 6))
    + " FROM events",
    "in_bag_counts": "SELECT event_id, "
    + ", ".join(f"{draw.poisson_one(f'bag:{b}', 'event_id')} AS bag_{b}" for b in range(3))
    + " FROM events",
    # propagation
    "member_forcing": with_(*BASE, design("a"), forcing("a"))
    + f"SELECT member, lead, {USED_ROUNDED} FROM forcing",
    "autoregressive_forecast": with_(*FORECAST, recursive=True)
    + f"SELECT sample_id, lead, {rnd('y', 'y')} FROM forecast",
    "memoryless_forecast": with_(
        *BASE, design("a"), forcing("a"), NOISE,
        MEMORYLESS.format(keys="sample_id", kept="d.sample_id", source="design_a"),
    )
    + f"SELECT sample_id, lead, {rnd('y', 'y')} FROM forecast",
    "forecast_lead_arrays": with_(*FORECAST, recursive=True)
    + f"""SELECT sample_id, {rnd(f"max(y) FILTER (WHERE lead = {fx.STEPS})", "last_y")},
      count(*) AS n_leads FROM forecast GROUP BY 1""",
    "forecast_variance_by_lead": with_(*FORECAST, recursive=True)
    + f"SELECT lead, {rnd('var_samp(y)', 'variance')}, count(y) AS n FROM forecast GROUP BY 1",
    # attribution
    "sobol_autoregressive": with_(*SOBOL_AR, recursive=True)
    + f"""SELECT lead, input, {rnd("first_order", "first_order")},
      {rnd("total_order", "total_order")} FROM indices""",
    "sobol_clamped_interaction": with_(
        *SOBOL_AR,
        """clamped AS (SELECT lead, input, greatest(first_order, 0) AS first_order,
           greatest(total_order, 0) AS total_order FROM indices)""",
        recursive=True,
    )
    + f"""SELECT lead, input, {rnd("first_order", "first_order")},
      {rnd("total_order", "total_order")}, {rnd("total_order - first_order", "interaction")}
      FROM clamped""",
    "sobol_memoryless": with_(
        *BASE, design("a"), design("b"), forcing("a", "b"), NOISE, variants(),
        MEMORYLESS.format(
            keys="sample_id, variant", kept="d.sample_id, d.variant", source="variants"
        ),
        INDICES,
    )
    + f"""SELECT lead, input, {rnd("first_order", "first_order")},
      {rnd("total_order", "total_order")} FROM indices""",
    "one_at_a_time_autoregressive": with_(*oat(False), recursive=True) + OAT_SELECT,
    "one_at_a_time_daily_signal": with_(*oat(True), recursive=True) + OAT_SELECT,
    "sobol_by_date_linear": with_(
        *PAIR,
        sobol_rows(
            "pair", "datetime", {n: _linear(c) for n, c in _choices(_DATE_BLOCKS).items()}, SHUFFLED
        ),
    )
    + """SELECT datetime,
      CASE input WHEN 'parameter_seed' THEN 'tree_uncertainty' ELSE input END AS input,
      first_order, total_order,
      CASE WHEN input = 'parameter_seed' THEN 1 ELSE 0 END AS input_order FROM found""",
    "sobol_by_site_and_date": with_(
        fx.READINGS, ZONE_DRIVERS, *date_pair("zone_drivers", "zone, datetime", ["zone", DAY]),
        sobol_rows("pair", "zone, datetime", {n: _linear(c) for n, c in _choices(_DATE_BLOCKS).items()}, SHUFFLED),
    )
    + """SELECT zone, datetime,
      CASE input WHEN 'parameter_seed' THEN 'tree_uncertainty' ELSE input END AS input,
      first_order, total_order,
      CASE WHEN input = 'parameter_seed' THEN 1 ELSE 0 END AS input_order FROM found""",
    "sobol_order_values": with_(
        ORDER_PAIR,
        sobol_rows(
            "pair", "grp", {n: _order_value(c) for n, c in _choices(_ORDER_BLOCKS).items()},
            list(_ORDER_BLOCKS),
        ),
    )
    + "SELECT * FROM found",
    # evaluation
    "forecast_scores": with_(
        *FORECAST, fx.REGION_TARGETS, REGION_OBS, score_table("forecast", "lead"), recursive=True
    )
    + f"SELECT lead, {SCORE_COLUMNS}, DATE '{fx.FORECAST_DATE}' + CAST(lead AS INT) AS datetime "
    "FROM scores",
    "predictive_quantile": with_(*FORECAST, fx.REGION_TARGETS, REGION_OBS, recursive=True)
    + f"""SELECT lead, {rnd("avg(CASE WHEN y <= obs THEN 1.0 ELSE 0.0 END)", "pit")}
      FROM forecast JOIN obs USING (lead) GROUP BY 1""",
    "site_scores": with_(*SITE_SCORES) + f"SELECT site_id, lead, {SCORE_COLUMNS} FROM scores",
    "pit_histogram": with_(*SITE_SCORES)
    + """SELECT CAST(b AS INT) AS bin, count(pit) AS n FROM range(1, 11) t(b)
      LEFT JOIN scores ON least(floor(pit * 10) + 1, 10) = b GROUP BY 1""",
    "rmse_by_lead": with_(*SITE_SCORES)
    + f"SELECT lead, {rnd('sqrt(avg(resid * resid))', 'rmse')} FROM scores GROUP BY 1",
    "coverage_by_lead": with_(*SITE_SCORES)
    + f"""SELECT lead, {rnd("avg(CAST(covered AS INT))", "coverage")},
      count(covered) AS n_obs FROM scores GROUP BY 1""",
    "skill_line": with_(
        *SITE_SCORES,
        "fit AS (SELECT regr_slope(crps, lead) AS b, regr_intercept(crps, lead) AS a FROM scores)",
    )
    + f"""SELECT lead, {rnd("any_value(a + b * lead)", "smooth")}, {rnd("avg(crps)", "crps")}
      FROM scores, fit GROUP BY 1""",
    "error_across_spread": with_(*SITE_SCORES)
    + f"""SELECT CAST(floor((q975 - q025) / 2) AS BIGINT) AS bin, count(resid) AS n,
      {rnd("avg(resid)", "bias")}, {rnd("avg(abs(resid))", "mae")},
      {rnd("sqrt(avg(resid * resid))", "rmse")} FROM scores GROUP BY 1""",
    # series fits
    "series_regression": with_(fx.MONTHLY, regression(["x1", "x2"], "monthly", "series_id"))
    + f"""SELECT series_id, n, {rnd("m_y - b_x1 * m_x1 - b_x2 * m_x2", "intercept")},
      {rnd("b_x1", "b_x1")}, {rnd("b_x2", "b_x2")},
      {rnd(f"{rss(['x1', 'x2'])} / (n - 3)", "sigma2")} FROM slopes""",
    "series_autoregression": with_(
        fx.MONTHLY, LAGGED, regression(["lag1", "x1", "x2"], "lagged", "series_id")
    )
    + f"""SELECT series_id, n, {rnd("b_lag1", "ar1")},
      {rnd("(m_y - b_lag1 * m_lag1 - b_x1 * m_x1 - b_x2 * m_x2) / (1 - b_lag1)", "intercept")},
      {rnd("b_x1", "b_x1")}, {rnd("b_x2", "b_x2")},
      {rnd(f"{rss(['lag1', 'x1', 'x2'])} / (n - 4)", "sigma2")} FROM slopes""",
    # forest
    "forest_model_roundtrip": with_(TRAIN) + "SELECT row_id, true AS same FROM train",
    "standardised_predictors": STANDARDISED,
    "standardised_by_pipeline": STANDARDISED,
    "predictive_draws": f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      {rnd(PRICE, "prediction")}, {rnd("l_discount", "se")}, l_orderkey AS parameter_seed,
      {rnd(f"{PRICE} + l_discount * {draw.normal('predictive', 'l_orderkey')}", "draw")}
      FROM lineitem""",
    "best_candidate": with_(fx.MONTHLY)
    + f"""SELECT series_id, {rnd("y", "y")}, datetime, {rnd("x1", "x1")} FROM (
      SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY y, datetime, x1) AS r
      FROM monthly) WHERE r = 1""",
    "in_sample_rmse": f"""SELECT l_returnflag,
      {rnd(f"sqrt(avg(pow(l_quantity * 1.5 - {PRICE}, 2)))", "rmse")} FROM lineitem GROUP BY 1""",
    "ordered_ensemble": with_(fx.READINGS, wide("site_id, parameter", ["air_temperature"]))
    + f"""SELECT datetime, site_id, parameter, {rnd("air_temperature", "air_temperature")},
      parameter AS tie, row_number() OVER (PARTITION BY site_id, datetime
        ORDER BY air_temperature, parameter) AS rank
      FROM wide WHERE air_temperature IS NOT NULL""",
}
