"""DuckDB SQL of the queries that SQL can express: the same rows from the same tables."""

from __future__ import annotations

from pricemill.config import Config
from pricemill.operators.attribution import CONSTRAINTS
from pricemill.operators.decisions import CODES
from pricemill.operators.service import EXPLANATIONS

_PANEL = """
mv AS (
  SELECT CAST(regexp_extract(p_brand, '#([0-9]+)', 1) AS BIGINT) AS upc, CAST(s_nationkey AS BIGINT) AS store,
         CAST(floor(date_diff('day', DATE '1995-01-02', CAST(l_shipdate AS DATE)) / 7.0) + 1 AS BIGINT) AS week,
         sum(l_quantity) AS move, floor(sum(l_extendedprice) / sum(l_quantity) / 1000 * 100 + 0.5) / 100.0::DOUBLE AS price,
         round(avg(l_discount), 6) AS discount, round(25 - 100 * avg(l_discount), 6) AS profit, CASE WHEN round(avg(l_tax), 6) < 0.005 THEN 0 ELSE 1 END AS ok
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3),
pn AS (
  SELECT upc, store, week, move, price AS p, price * move AS revenue, profit / 100 AS rate, price * (1 - profit / 100) AS aac, price * move * (profit / 100) AS gp,
         CASE WHEN discount >= 0.06 THEN 1 ELSE 0 END AS promo, CASE WHEN discount >= 0.08 THEN 'BONUS_BUY' WHEN discount >= 0.06 THEN 'SALE' ELSE 'NONE_RECORDED' END AS promo_type,
         DATE '1995-01-02' + CAST((week - 1) * 7 AS INTEGER) AS day
  FROM mv WHERE ok = 1 AND price >= 0.01 AND move >= 0)"""
_FEATURES = """,
ft AS (
  SELECT *, lag(move, 1) OVER w AS lag_move_1, lag(move, 2) OVER w AS lag_move_2, lag(move, 3) OVER w AS lag_move_3, lag(move, 4) OVER w AS lag_move_4,
         CASE WHEN count(move) OVER w4 >= 2 THEN avg(move) OVER w4 END AS roll_mean_move_4, CASE WHEN count(move) OVER w8 >= 2 THEN avg(move) OVER w8 END AS roll_mean_move_8,
         CASE WHEN count(move) OVER w13 >= 2 THEN avg(move) OVER w13 END AS roll_mean_move_13, stddev_samp(move) OVER w4 AS roll_std_move_4,
         lag(p, 1) OVER w AS lag_price_1, lag(p, 2) OVER w AS lag_price_2, avg(p) OVER w4 AS roll_mean_price_4, quantile_cont(p, 0.5) OVER past AS series_reference_price,
         lag(aac, 1) OVER w AS decision_time_unit_cost, CAST(lag(promo, 1) OVER w AS BIGINT) AS lag_promotion_1, row_number() OVER w - 1 AS series_age_weeks
  FROM pn WINDOW w AS (PARTITION BY upc, store ORDER BY week), w4 AS (PARTITION BY upc, store ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING),
    w8 AS (PARTITION BY upc, store ORDER BY week ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), w13 AS (PARTITION BY upc, store ORDER BY week ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING),
    past AS (PARTITION BY upc, store ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_SPLIT = """,
wk AS (SELECT DISTINCT week FROM pn), cuts AS (SELECT floor(count(*) * 0.7) AS a, floor(count(*) * (0.7 + 0.15)) AS b FROM wk),
rk AS (SELECT week, row_number() OVER (ORDER BY week) AS n FROM wk),
sp AS (SELECT week, CASE WHEN n <= a THEN 'train' WHEN n <= b THEN 'valid' ELSE 'test' END AS split FROM rk, cuts)"""
_STATS = """,
st AS (
  SELECT upc, store, count(*) AS n_obs, count(DISTINCT p) AS n_distinct_prices, min(p) AS price_min, max(p) AS price_max, stddev_samp(p) / nullif(avg(p), 0) AS price_cv
  FROM pn GROUP BY upc, store)"""
_CONTEXTS = """,
cx AS (
  SELECT upc, store, week, p AS current_price, CASE WHEN decision_time_unit_cost > 0 THEN decision_time_unit_cost END AS unit_cost,
         coalesce(roll_mean_move_4, lag_move_1, 0.0) AS base_units, n_obs, n_distinct_prices, price_cv, price_min, price_max
  FROM ft JOIN st USING (upc, store) WHERE week = (SELECT max(week) FROM pn)),
rl AS (
  SELECT *, CASE WHEN n_obs >= 150 AND n_distinct_prices >= 15 THEN 'LOW' WHEN n_obs >= 80 AND n_distinct_prices >= 8 THEN 'MEDIUM' ELSE 'HIGH' END AS risk
  FROM cx)"""
_POLICIES = {k: Config().policy(k) for k in ("conservative", "standard", "aggressive")}


def _bounds(profile: str = "standard", capped: bool = True, disabled: tuple[str, ...] = (), eps: float = -2.0) -> str:
    """Guardrails, grid and simulation of a profile, without the disabled guardrails."""
    o = _POLICIES[profile]
    tol, margin, change = o["extrapolation_tolerance_pct"], o["min_gross_margin_rate"], o["max_price_change_pct"]
    low = {"MAX_PRICE_CHANGE": "current_price * (1 - cap)", "MIN_PRICE": "0.01", "EXTRAPOLATION": f"price_min * (1 - {tol})", "COST_FLOOR": "unit_cost"}
    if margin > 0:
        low["MIN_MARGIN"] = f"unit_cost / (1 - {margin})"
    high = {"MAX_PRICE_CHANGE": "current_price * (1 + cap)", "EXTRAPOLATION": f"price_max * (1 + {tol})"}
    low, high = ({k: v for k, v in side.items() if k not in disabled} for side in (low, high))
    at = lambda v, edge: f"abs({v} - {edge}) <= 1e-9 * greatest(1.0, abs({edge}))"
    edges = [(k, v, "low") for k, v in low.items()] + [(k, v, "high") for k, v in high.items()]
    marks = ", ".join(f"CASE WHEN {at(v, edge)} THEN '{CODES[k]}' END" for k, v, edge in edges)
    names = ", ".join(f"CASE WHEN {at(v, edge)} THEN '{k}' END" for k, v, edge in edges)
    capped_at = min(change, o["medium_risk_max_price_change_pct"]) if capped and "RISK_GATE" not in disabled else change
    text = """,
bd AS (SELECT *, CASE WHEN risk = 'MEDIUM' THEN @CAPPED@ ELSE @CHANGE@ END AS cap FROM rl),
b2 AS (SELECT *, greatest(@LOW@) AS low, least(@HIGH@) AS high FROM bd),
b3 AS (SELECT *, list_sort(list_distinct(list_filter([@MARKS@], lambda x: x IS NOT NULL))) AS binding, list_filter([@NAMES@], lambda x: x IS NOT NULL) AS guards FROM b2),
gr AS (
  SELECT DISTINCT upc, store, week, price FROM (
    SELECT upc, store, week, low, high, round_even(raw / 0.01, 0) * 0.01 AS price, round_even(low / 0.01, 0) * 0.01 AS rl, round_even(high / 0.01, 0) * 0.01 AS rh
    FROM (SELECT upc, store, week, low, high, unnest(list_append(list_transform(range(0, CAST(floor((high - low) / 0.05) AS BIGINT) + 1), lambda i: low + 0.05::DOUBLE * i), current_price)) AS raw FROM b3 WHERE high >= low))
  WHERE price >= rl - 1e-9 AND price <= rh + 1e-9 AND price > 0 AND price >= low - 1e-9 AND price <= high + 1e-9),
sm AS (
  SELECT g.upc, g.store, g.week, g.price, greatest(base_units * pow(g.price / current_price, @EPS@), 0.0) AS units, (g.price - unit_cost) * greatest(base_units * pow(g.price / current_price, @EPS@), 0.0) AS value, current_price
  FROM gr g JOIN b3 USING (upc, store, week))"""
    for token, value in {"@CAPPED@": capped_at, "@CHANGE@": change, "@LOW@": ", ".join([*low.values(), "0.01"]), "@HIGH@": ", ".join([*high.values(), *list(high.values())[:1]]), "@MARKS@": marks, "@NAMES@": names, "@EPS@": eps}.items():
        text = text.replace(token, str(value))
    return text


def _decided(profile: str = "standard", disabled: tuple[str, ...] = ()) -> str:
    """The decisions of a profile, without the disabled guardrails."""
    o = _POLICIES[profile]
    action = o["high_risk_action"]
    text = """,
pick AS (
  SELECT upc, store, week, count(*) AS n_candidates, arg_max(struct_pack(price := price, units := units, value := value), struct_pack(a := value, b := -price)) AS best,
         arg_min(struct_pack(price := price, units := units, value := value), struct_pack(a := abs(price - current_price), b := price)) AS now
  FROM sm WHERE value IS NOT NULL GROUP BY upc, store, week),
mono AS (
  SELECT upc, store, week, bool_or(step > 1e-9) AS rising FROM (SELECT upc, store, week, units - lag(units) OVER (PARTITION BY upc, store, week ORDER BY price) AS step FROM sm) GROUP BY ALL),
dd AS (
  SELECT b3.*, pick.best AS best, pick.now AS now, coalesce(n_candidates, 0) AS n_candidates, coalesce(rising, false) AS rising,
         list_filter([CASE WHEN @SUPPORT@ AND n_obs < 40 THEN 'INSUFFICIENT_HISTORY' END, CASE WHEN @SUPPORT@ AND (n_distinct_prices < 5 OR coalesce(price_cv, 1) < 0.05) THEN 'INSUFFICIENT_PRICE_VARIATION' END, CASE WHEN unit_cost IS NULL THEN 'COST_UNAVAILABLE' END], lambda x: x IS NOT NULL) AS screened
  FROM b3 LEFT JOIN pick USING (upc, store, week) LEFT JOIN mono USING (upc, store, week)),
d2 AS (
  SELECT *, CASE WHEN len(screened) > 0 THEN 'screened' @STOP@ WHEN n_candidates = 0 THEN 'infeasible' END AS stop,
         (best.value - now.value) / nullif(abs(now.value), 0) AS uplift, best.price / current_price - 1 AS change,
         CASE WHEN best.price < price_min THEN (price_min - best.price) / price_min WHEN best.price > price_max THEN (best.price - price_max) / price_max ELSE 0 END AS away
  FROM dd),
d3 AS (
  SELECT *, CASE WHEN stop IS NOT NULL THEN risk WHEN n_obs >= 150 AND n_distinct_prices >= 15 AND away <= 0.02 THEN 'LOW' WHEN n_obs >= 80 AND n_distinct_prices >= 8 AND away <= 0.05 THEN 'MEDIUM' ELSE 'HIGH' END AS final_risk
  FROM d2),
d4 AS (
  SELECT *, CASE WHEN stop IS NOT NULL THEN stop WHEN abs(change) < 1e-9 THEN 'same' WHEN uplift IS NULL OR uplift < @MATERIAL@ THEN 'small' @HIGH@ ELSE 'change' END AS outcome
  FROM d3),
rec AS (
  SELECT upc, store, week, CASE outcome WHEN 'change' THEN 'RECOMMEND_CHANGE' WHEN 'review' THEN 'REVIEW_REQUIRED' ELSE 'KEEP_CURRENT' END AS decision, final_risk AS risk_level, current_price,
         CASE WHEN outcome IN ('change', 'review') THEN best.price ELSE current_price END AS proposed_price, CASE WHEN outcome = 'change' THEN best.price ELSE current_price END AS recommended_price,
         low, high, guards, price_min, price_max, stop, base_units, CASE WHEN stop IS NULL THEN best.price END AS copt, CASE WHEN stop IS NULL THEN n_candidates ELSE 0 END AS n_candidates, unit_cost, outcome,
         CASE WHEN stop IS NULL THEN now.units ELSE base_units END AS units_current,
         CASE WHEN outcome IN ('change', 'review') THEN best.units WHEN stop IS NULL THEN now.units ELSE base_units END AS units_proposed,
         list_filter(list_concat(list_concat(screened, CASE WHEN @GATED@ AND risk = 'MEDIUM' AND coalesce(stop, '') <> 'screened' THEN ['MEDIUM_RISK_CONSERVATIVE'] ELSE [] END),
           list_concat(CASE WHEN stop IS NULL THEN binding ELSE [] END, [
             CASE WHEN stop IS NULL AND rising THEN 'DEMAND_CURVE_NOT_DECREASING' END, CASE WHEN outcome = 'infeasible' THEN 'NO_FEASIBLE_PRICE' END, CASE WHEN outcome = 'small' THEN 'NON_MATERIAL_UPLIFT' END,
             CASE WHEN outcome IN ('change', 'review', 'risky') AND stop IS NULL THEN 'PROFIT_UPLIFT_POSITIVE' END, CASE WHEN outcome = 'risky' THEN 'HIGH_RISK_KEEP_CURRENT' END,
             CASE WHEN outcome = 'review' THEN 'HIGH_RISK_REVIEW_REQUIRED' END, CASE WHEN outcome IN ('review', 'risky') THEN 'LOW_CONFIDENCE' END,
             CASE WHEN outcome NOT IN ('change', 'review') THEN 'KEEP_CURRENT_OPTIMAL' END])), lambda x: x IS NOT NULL) AS codes
  FROM d4),
rec2 AS (SELECT *, (current_price - unit_cost) * units_current AS profit_current, (proposed_price - unit_cost) * units_proposed AS profit_proposed FROM rec)"""
    gated, support = "RISK_GATE" not in disabled, "HISTORICAL_SUPPORT" not in disabled
    stop = "WHEN risk = 'HIGH' THEN 'risky'" if action == "keep_current" and gated else ""
    high = "" if action == "recommend" or not gated else f"WHEN final_risk = 'HIGH' THEN '{'risky' if action == 'keep_current' else 'review'}'"
    material = 0.0 if "MATERIALITY" in disabled else o["materiality_threshold_pct"]
    for token, value in {"@STOP@": stop, "@HIGH@": high, "@MATERIAL@": material, "@GATED@": gated, "@SUPPORT@": support}.items():
        text = text.replace(token, str(value))
    return text


def _recommended(profile: str = "standard", disabled: tuple[str, ...] = (), eps: float = -2.0) -> tuple[str, ...]:
    return (*_ALL, _bounds(profile, True, disabled, eps), _decided(profile, disabled))


def _r(*names: str) -> str:
    return ", ".join(f"round(CAST({n} AS DOUBLE), 6) AS {n}" for n in names)


def _with(select: str, *parts: str) -> str:
    return f"WITH {_PANEL}{''.join(parts)}\n{select}"


_ALL = (_FEATURES, _STATS, _CONTEXTS)
_FREE = _bounds(capped=False)
_VARIATION = """
SELECT {keys}, n_obs, n_weeks, n_distinct_prices, round(price_min, 6) AS price_min, round(price_max, 6) AS price_max, round(price_mean, 6) AS price_mean, round(price_std, 6) AS price_std,
       round(total_units, 6) AS total_units, round(price_std / nullif(price_mean, 0), 6) AS price_cv, round((price_max - price_min) / nullif(price_mean, 0), 6) AS price_range_pct,
       n_price_changes, round(n_price_changes / greatest(n_obs, 1), 6) AS price_change_rate
FROM (
  SELECT {keys}, count(*) AS n_obs, count(DISTINCT week) AS n_weeks, count(DISTINCT p) AS n_distinct_prices, min(p) AS price_min, max(p) AS price_max, avg(p) AS price_mean,
         stddev_samp(p) AS price_std, sum(move) AS total_units, count(*) FILTER (WHERE abs(p - before) > 1e-9) AS n_price_changes
  FROM (SELECT *, lag(p) OVER (PARTITION BY {keys} ORDER BY {order}) AS before FROM pn) GROUP BY {keys})"""
_ARC = """,
pr AS (SELECT *, lag(p) OVER w AS pp, lag(move) OVER w AS pm, lag(week) OVER w AS pw FROM pn WINDOW w AS (PARTITION BY upc, store ORDER BY week)),
nx AS (SELECT * FROM pr WHERE week - pw = 1),
ar AS (SELECT * FROM (SELECT *, CASE WHEN (pp + p) / 2 > 0 AND (pm + move) / 2 > 0 AND pm >= 0 AND move >= 0 AND abs((p - pp) / ((pp + p) / 2)) >= 1e-4
              THEN ((move - pm) / ((pm + move) / 2)) / ((p - pp) / ((pp + p) / 2)) END AS arc FROM nx) WHERE arc IS NOT NULL)"""
_LL = ", ll AS (SELECT upc, store, week, ln(p) AS x, ln(move) AS y FROM pn WHERE p > 0 AND move > 0)"


def _within(keys: str) -> str:
    return _LL + f", wi AS (SELECT upc, store, week, x - avg(x) OVER (PARTITION BY {keys}) AS x, y - avg(y) OVER (PARTITION BY {keys}) AS y FROM ll)"


_SLOPES = """,
sb AS (SELECT upc, count(*) AS n_obs, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy, sum(x * y) / sum(x * x) AS estimate FROM wi GROUP BY upc HAVING sum(x * x) > 0 AND count(*) > 2),
sc AS (SELECT wi.*, wi.x * (wi.y - estimate * wi.x) AS s FROM wi JOIN sb USING (upc)),
m0 AS (SELECT upc, sum(s * s) AS m FROM sc GROUP BY upc),
m1 AS (SELECT upc, count(*) AS g, sum(s * s) AS m FROM (SELECT upc, store, sum(s) AS s FROM sc GROUP BY upc, store) GROUP BY upc),
m2 AS (SELECT upc, count(*) AS g, sum(s * s) AS m FROM (SELECT upc, week, sum(s) AS s FROM sc GROUP BY upc, week) GROUP BY upc),
se AS (SELECT sb.*, sqrt(m0.m * n_obs / (n_obs - 1)) / sxx AS h, CASE WHEN m1.g > 1 THEN sqrt(m1.m * m1.g / (m1.g - 1) * (n_obs - 1) / (n_obs - 1)) / sxx END AS a,
       CASE WHEN m2.g > 1 THEN sqrt(m2.m * m2.g / (m2.g - 1) * (n_obs - 1) / (n_obs - 1)) / sxx END AS b FROM sb JOIN m0 USING (upc) JOIN m1 USING (upc) JOIN m2 USING (upc))"""
_ERRORS = ([
    "estimate", *(f"std_error_{k}" for k in ("hc1", "store", "week", "clustered")), *(f"ratio_{k}" for k in ("store", "week", "clustered")), "significant_hc1", "significant_clustered",
], """,
er AS (
  SELECT *, std_error_store / nullif(std_error_hc1, 0) AS ratio_store, std_error_week / nullif(std_error_hc1, 0) AS ratio_week, std_error_clustered / nullif(std_error_hc1, 0) AS ratio_clustered,
         CAST(abs(estimate) / nullif(std_error_hc1, 0) > 1.96 AS DOUBLE) AS significant_hc1, CAST(abs(estimate) / nullif(std_error_clustered, 0) > 1.96 AS DOUBLE) AS significant_clustered
  FROM (SELECT upc, n_obs, estimate, h AS std_error_hc1, a AS std_error_store, b AS std_error_week, greatest(a, b) AS std_error_clustered FROM se))""")  # fmt: skip
_BASE = """,
tr AS (SELECT ft.*, split FROM ft JOIN sp USING (week) WHERE move IS NOT NULL AND lag_move_1 IS NOT NULL AND lag_price_1 IS NOT NULL),
mn AS (SELECT upc, store, avg(move) AS m FROM tr WHERE split = 'train' GROUP BY upc, store), ov AS (SELECT avg(move) AS o FROM tr WHERE split = 'train'),
fc AS (
  SELECT t.upc, t.store, t.week, t.day, t.move AS actual, greatest(coalesce(t.lag_move_1, 0), 0) AS last_week, greatest(coalesce(t.roll_mean_move_4, t.lag_move_1, 0), 0) AS rolling_mean_4,
         greatest(coalesce(m, o, 0), 0) AS series_mean, greatest(coalesce(b.move, t.roll_mean_move_4, t.lag_move_1, 0), 0) AS seasonal_naive
  FROM tr t LEFT JOIN mn USING (upc, store) LEFT JOIN tr b ON b.upc = t.upc AND b.store = t.store AND b.week = t.week - 52, ov WHERE t.split = 'test'),
lf AS (SELECT * FROM (UNPIVOT fc ON last_week, rolling_mean_4, series_mean, seasonal_naive INTO NAME model VALUE predicted))"""
_METRICS = """count(actual) AS n, round(avg(abs(predicted - actual)), 6) AS mae, round(sqrt(avg((predicted - actual) * (predicted - actual))), 6) AS rmse,
  round(sum(abs(predicted - actual)) / nullif(sum(abs(actual)), 0), 6) AS wape, round(avg(predicted - actual), 6) AS bias,
  round(avg(CASE WHEN abs(actual) + abs(predicted) > 0 THEN 2 * abs(predicted - actual) / (abs(actual) + abs(predicted)) END), 6) AS smape"""
_LONG = """,
lo AS (
  SELECT split, unnest(['move', 'effective_unit_price', 'roll_mean_move_4']) AS feature, unnest([move, p, roll_mean_move_4]) AS value FROM ft JOIN sp USING (week) WHERE split <> 'valid'),
lv AS (SELECT * FROM lo WHERE value IS NOT NULL)"""

_LAYERS = ["MAX_PRICE_CHANGE", "EXTRAPOLATION", "COST_FLOOR", "MIN_MARGIN"]


#: What each guardrail of the standard profile allows by itself.
_INTERVALS = {
    "MAX_PRICE_CHANGE": ("current_price * 0.9", "current_price * 1.1"), "MIN_PRICE": ("0.01::DOUBLE", "NULL"), "MAX_PRICE": ("NULL", "NULL"), "EXTRAPOLATION": ("price_min * 0.95", "price_max * 1.05"),
    "COST_FLOOR": ("unit_cost", "NULL"), "MIN_MARGIN": ("unit_cost / 0.95::DOUBLE", "NULL"),
}
_RESEARCH = """,
rw AS (SELECT *, greatest(0.01, current_price * 0.2) AS wl, current_price * 5.0 AS wh FROM cx),
rg AS (
  SELECT DISTINCT upc, store, week, price FROM (
    SELECT upc, store, week, wl, wh, round_even(raw / 0.01, 0) * 0.01 AS price, round_even(wl / 0.01, 0) * 0.01 AS rl, round_even(wh / 0.01, 0) * 0.01 AS rh
    FROM (SELECT upc, store, week, wl, wh, unnest(list_append(list_transform(range(0, CAST(floor((wh - wl) / 0.05) AS BIGINT) + 1), lambda i: wl + 0.05::DOUBLE * i), current_price)) AS raw FROM rw))
  WHERE price >= rl - 1e-9 AND price <= rh + 1e-9 AND price > 0 AND price >= wl - 1e-9 AND price <= wh + 1e-9),
rv AS (
  SELECT g.upc, g.store, g.week, g.price, current_price, unit_cost, price_min, price_max, (g.price - unit_cost) * greatest(base_units * pow(g.price / current_price, -2.0), 0.0) AS value
  FROM rg g JOIN cx USING (upc, store, week)),
un AS (SELECT upc, store, week, arg_max(price, struct_pack(a := value, b := -price)) AS best FROM rv WHERE value IS NOT NULL GROUP BY ALL)"""
_FINE = """,
fg AS (SELECT upc, store, week, unnest(list_transform(range(0, CAST(ceil((high + 1e-9 - low) / 0.01) AS BIGINT)), lambda i: low + i * 0.01::DOUBLE)) AS price FROM rec WHERE n_candidates > 0 AND high >= low),
fo AS (
  SELECT upc, store, week, arg_max(price, struct_pack(a := value, b := -price)) AS fine FROM (
    SELECT f.upc, f.store, f.week, f.price, (f.price - unit_cost) * greatest(base_units * pow(f.price / current_price, -2.0), 0.0) AS value FROM fg f JOIN cx USING (upc, store, week)) GROUP BY ALL)"""


def _first(side: int, edge: str) -> str:
    whens = " ".join(f"WHEN abs({v[side]} - {edge}) < 1e-6 THEN '{k}'" for k, v in _INTERVALS.items() if v[side] != "NULL")
    return f"CASE {whens} ELSE '' END"


def _has(*codes: str) -> str:
    return "(" + " OR ".join(f"list_contains(codes, '{c}')" for c in codes) + ")"


def _attribution() -> str:
    """The table of constraints: each leave-one-out against the decision with all guardrails."""
    base = _with("SELECT r.*, fine, abs(fine - copt) AS distance FROM rec2 r LEFT JOIN fo USING (upc, store, week)", *_recommended(), _FINE)
    left = " UNION ALL ".join(f"SELECT '{k}' AS name, * FROM (" + _with("SELECT upc, store, week, decision, recommended_price FROM rec2", *_recommended(disabled=(k,))) + ")" for k in CONSTRAINTS)
    outside = lambda lo, hi: f"coalesce(price < {lo} - 1e-9, false) OR coalesce(price > {hi} + 1e-9, false)"
    removed = " UNION ALL ".join(f"SELECT '{k}' AS name, upc, store, week, count(*) FILTER (WHERE {outside(*v)}) AS removed FROM wide GROUP BY ALL" for k, v in _INTERVALS.items())
    there = " ".join(f"WHEN name = '{k}' THEN {' OR '.join(f'{x} IS NOT NULL' for x in v)}" for k, v in _INTERVALS.items())
    return f"""WITH base AS MATERIALIZED ({base}), lo AS ({left}), wide AS MATERIALIZED ({_with('SELECT * FROM rv', *_ALL, _RESEARCH)}), rm AS ({removed}),
    al AS (
      SELECT l.name, CASE {there} ELSE true END AS present, coalesce(removed, 0) AS removed, coalesce(distance > 0.011, false) AS coarse,
        CASE name WHEN 'MATERIALITY' THEN {_has('NON_MATERIAL_UPLIFT')} WHEN 'RISK_GATE' THEN {_has('HIGH_RISK_REVIEW_REQUIRED', 'HIGH_RISK_KEEP_CURRENT', 'MEDIUM_RISK_CONSERVATIVE')}
          WHEN 'HISTORICAL_SUPPORT' THEN {_has('INSUFFICIENT_HISTORY', 'INSUFFICIENT_PRICE_VARIATION')} WHEN 'ROUNDING' THEN coalesce(distance > 0.011, false)
          ELSE n_candidates > 0 AND list_contains(guards, name) END AS binding,
        l.decision <> b.decision AS dec, abs(l.recommended_price - b.recommended_price) > 1e-9 AS pri
      FROM lo l JOIN base b USING (upc, store, week) LEFT JOIN rm USING (name, upc, store, week))
    SELECT name AS "constraint", count(*) FILTER (WHERE present) AS present, count(*) FILTER (WHERE removed > 0) AS removing, round(coalesce(quantile_cont(CASE WHEN removed > 0 THEN removed::DOUBLE END, 0.5), 0.0::DOUBLE), 6) AS median_removed,
      count(*) FILTER (WHERE binding) AS binding, count(*) FILTER (WHERE dec) AS changed_decision, count(*) FILTER (WHERE CASE WHEN name = 'ROUNDING' THEN coarse ELSE pri END) AS changed_price FROM al GROUP BY name"""


_BY_CONTEXT = f"""SELECT upc, store, week, decision, risk_level, round(best, 6) AS unconstrained_optimum, round(unit_cost * 2.0::DOUBLE, 6) AS analytic_optimum, round(copt, 6) AS constrained_optimum,
  round(proposed_price, 6) AS proposed_price, round(recommended_price, 6) AS recommended_price,
  CASE WHEN best IS NULL THEN '' WHEN {_has('INSUFFICIENT_HISTORY', 'INSUFFICIENT_PRICE_VARIATION')} THEN 'HISTORICAL_SUPPORT' WHEN {_has('HIGH_RISK_KEEP_CURRENT')} THEN 'RISK_GATE' WHEN NOT bounded THEN ''
    WHEN best > high + 1e-9 THEN {_first(1, 'high')} WHEN best < low - 1e-9 THEN {_first(0, 'low')} WHEN {_has('NON_MATERIAL_UPLIFT')} THEN 'MATERIALITY'
    WHEN {_has('HIGH_RISK_REVIEW_REQUIRED')} THEN 'RISK_GATE' ELSE 'NONE' END AS first_binding,
  inside AS optimum_inside, coalesce(abs(best - proposed_price) <= 0.05 + 1e-9, false) AS proposal_matches, coalesce(abs(best - recommended_price) <= 0.05 + 1e-9, false) AS optimum_survives,
  CASE WHEN {_has('INSUFFICIENT_HISTORY', 'INSUFFICIENT_PRICE_VARIATION', 'COST_UNAVAILABLE', 'NO_FEASIBLE_PRICE')} THEN 'screened' WHEN {_has('HIGH_RISK_KEEP_CURRENT')} THEN 'high_risk' WHEN decision = 'REVIEW_REQUIRED' THEN 'review'
    WHEN {_has('NON_MATERIAL_UPLIFT')} THEN 'materiality' WHEN NOT inside THEN 'guardrail_corner' ELSE 'learned_signal' END AS determinant
FROM (SELECT *, coalesce(bounded AND best >= low - 1e-9 AND best <= high + 1e-9, false) AS inside FROM (
  SELECT r.*, best, n_candidates > 0 OR {_has('NO_FEASIBLE_PRICE')} AS bounded FROM rec2 r LEFT JOIN un USING (upc, store, week)))"""


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)


SQL = {
    "policy_comparison": _union([_with(f"""SELECT upc, store, week, '{k}' AS policy_profile, round(current_price, 6) AS current_price, decision, round(recommended_price, 6) AS recommended_price,
      round(100 * (recommended_price / current_price - 1), 6) AS price_change_percent, risk_level, round(100 * ((profit_proposed - profit_current) / nullif(abs(profit_current), 0)), 6) AS uplift_percent,
      array_to_string(codes, '|') AS reason_codes FROM rec2""", *_recommended(k)) for k in _POLICIES]),
    "model_info": _with("""SELECT 'fixed' AS price_response_method, '1' AS model_version, -2.0::DOUBLE AS pooled_elasticity, min(week) AS first_week, max(week) AS last_week, count(DISTINCT upc) AS n_products,
      count(DISTINCT store) AS n_stores, count(*) AS n_contexts FROM cx""", *_ALL),
    "decision_records": _union([_with(f"""SELECT upc, store, week, decision, risk_level, round(recommended_price, 6) AS recommended_price, '{k}' AS policy_profile, 'gross_profit' AS objective,
      'fixed' AS price_response_method, '1' AS model_version FROM rec2 WHERE store % 2 = {odd}""", *_recommended(k)) for k, odd in (("aggressive", 0), ("conservative", 1))]),
    "product_requests": _with("""SELECT r.request, r.store, r.upc, r.product, coalesce(c.upc, CASE WHEN lo = hi THEN lo END) AS resolved_upc,
      CASE WHEN r.store NOT IN (SELECT store FROM cx) THEN 'STORE_NOT_SERVED' WHEN c.upc IS NOT NULL THEN NULL WHEN r.product IS NULL AND r.upc IS NULL THEN 'NO_CODE_OR_NAME' WHEN lo IS NULL THEN 'NO_MATCH'
           WHEN lo < hi THEN 'SEVERAL_MATCHES' END AS problem
      FROM rq r LEFT JOIN cx c ON r.store = c.store AND r.upc = c.upc LEFT JOIN nm ON r.request = nm.request AND c.upc IS NULL""", *_ALL, """,
rq AS (
  SELECT p_partkey AS request, CAST(p_size % 30 AS BIGINT) AS store, CASE WHEN p_partkey % 4 <> 0 THEN CAST(regexp_extract(p_brand, '#([0-9]+)', 1) AS BIGINT) + CASE WHEN p_partkey % 3 = 0 THEN 100 ELSE 0 END END AS upc,
         CASE WHEN p_partkey % 5 <> 0 THEN lower(p_brand[1:6 + p_partkey % 3]) END AS product FROM part),
nm AS (SELECT rq.request, min(cx.upc) AS lo, max(cx.upc) AS hi FROM rq JOIN cx ON rq.store = cx.store AND contains(lower('Brand#' || cx.upc), rq.product) GROUP BY 1)"""),
    "decision_mix": _union([_with(f"SELECT '{k}' AS profile, decision, risk_level, count(*) AS n FROM rec2 GROUP BY 2, 3", *_recommended(k)) for k in _POLICIES]),
    "constraint_attribution": "WITH a AS (" + _union([_with(f"SELECT '{k}' AS left_out, upc, store, week, proposed_price FROM rec2", *_recommended(disabled=(k,))) for k in ("baseline", *CONSTRAINTS)])
    + ") SELECT a.left_out, count(*) AS n, count(*) FILTER (WHERE abs(a.proposed_price - b.proposed_price) > 1e-9) AS n_changed, round(avg(a.proposed_price), 6) AS mean_price FROM a JOIN a b ON a.upc = b.upc AND a.store = b.store AND a.week = b.week AND b.left_out = 'baseline' GROUP BY a.left_out",
    "constraint_intervals": _union([_with(f"SELECT upc, store, week, '{k}' AS \"constraint\", round(CAST({lo} AS DOUBLE), 6) AS low, round(CAST({hi} AS DOUBLE), 6) AS high FROM cx", *_ALL) for k, (lo, hi) in _INTERVALS.items()]),
    "attribution_table": _attribution(),
    "attribution_contexts": _with(_BY_CONTEXT, *_recommended(), _RESEARCH),
    "determinants": "SELECT determinant, first_binding, count(*) AS n FROM (" + _with(_BY_CONTEXT, *_recommended(), _RESEARCH) + ") GROUP BY 1, 2",
    "guardrail_ablation": _union([_with(f"SELECT '{i}_{_LAYERS[i - 1]}' AS layer, count(*) AS n, count(*) FILTER (WHERE decision <> 'KEEP_CURRENT') AS n_changes, round(avg(proposed_price), 6) AS mean_price, round(sum(profit_proposed), 6) AS profit FROM rec2", *_recommended(disabled=tuple(_LAYERS[i:]))) for i in range(1, 5)]),
    "elasticity_scenarios": _union([_with(f"SELECT {e}::DOUBLE AS elasticity, count(*) AS n, count(*) FILTER (WHERE decision <> 'KEEP_CURRENT') AS n_changes, round(avg(proposed_price / current_price - 1), 6) AS mean_change FROM rec2", *_recommended(eps=e)) for e in (-1.5, -1.9, -2.4, -3.1)]),
    "policy_totals": _with("""SELECT policy, n_contexts, round(revenue, 6) AS revenue, round(profit, 6) AS profit, round(profit / nullif(max(CASE WHEN policy = 'historical' THEN profit END) OVER (), 0) - 1, 6) AS profit_vs_historical FROM (
      SELECT policy, count(*) AS n_contexts, sum(price * units) AS revenue, sum((price - unit_cost) * units) AS profit FROM (
        SELECT *, greatest(base_units * pow(price / current_price, -2.0), 0) AS units FROM (
          SELECT c.*, unnest(['historical', 'simple_margin', 'elasticity_baseline', 'optimised']) AS policy, unnest([current_price, CASE WHEN h >= l THEN least(greatest(unit_cost / 0.8::DOUBLE, l), h) ELSE current_price END,
            CASE WHEN h >= l THEN least(greatest(unit_cost * 2.0::DOUBLE, l), h) ELSE current_price END, recommended_price]) AS price
          FROM (SELECT cx.*, r.recommended_price, greatest(0.01, cx.current_price * 0.9, cx.unit_cost, cx.price_min * 0.95) AS l, least(cx.current_price * 1.1, cx.price_max * 1.05) AS h FROM cx JOIN rec2 r USING (upc, store, week) WHERE cx.unit_cost IS NOT NULL) c)) GROUP BY policy)""", *_recommended()),
    "serving_slice": _with(f"SELECT upc, store, week, round(p, 6) AS effective_unit_price, {_r('lag_price_1')} FROM ft WHERE week > (SELECT max(week) FROM pn) - 8 AND lag_move_1 IS NOT NULL AND lag_price_1 IS NOT NULL", _FEATURES),
    "portfolio_summary": _with("SELECT count(*) AS n_contexts, count(*) FILTER (WHERE outcome = 'change') AS n_change, count(*) FILTER (WHERE outcome = 'review') AS n_review, count(*) FILTER (WHERE outcome NOT IN ('change', 'review')) AS n_keep, round(coalesce(sum(CASE WHEN outcome = 'change' THEN profit_proposed - profit_current END), 0.0), 6) AS model_internal_gain, round(avg(CASE WHEN outcome = 'change' THEN recommended_price / current_price - 1 END), 6) AS mean_change FROM rec2", *_recommended()),
    "validation_checks": _with("""SELECT name AS "check", round(value, 6) AS value, value <= 1e-6 AS passed FROM (SELECT
      unnest(['revenue_formula', 'aac_formula', 'gross_profit_formula', 'unit_price_formula', 'negative_units', 'non_positive_price', 'null_keys', 'promotion_flag_range', 'duplicate_grain',
        'margin_rate_formula', 'non_positive_qty', 'infinite_unit_price', 'not_ok_rows', 'empty_panel', 'implausible_dates', 'dates_by_week']) AS name,
      unnest([max(abs(revenue - p * move)), max(abs(aac - p * (1 - rate))), max(abs(gp - revenue * rate)), 0.0::DOUBLE, count(*) FILTER (WHERE move < 0), count(*) FILTER (WHERE p <= 0),
        count(*) FILTER (WHERE upc IS NULL OR store IS NULL OR week IS NULL), count(*) FILTER (WHERE promo NOT IN (0, 1)), count(*) - count(DISTINCT (upc, store, week)),
        0, 0, 0, 0, CASE WHEN count(*) = 0 THEN 1 ELSE 0 END, count(*) FILTER (WHERE day NOT BETWEEN DATE '1989-01-01' AND DATE '2009-12-31'), count(DISTINCT (week, day)) - count(DISTINCT week)]) AS value FROM pn)"""),
    "explained_codes": "SELECT code, explanation, n FROM (" + _with("SELECT code, count(*) AS n FROM (SELECT unnest(codes) AS code FROM rec2) GROUP BY code", *_recommended()) + ") JOIN (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in EXPLANATIONS.items()) + ") AS v(c, explanation) ON c = code",
    "review_queue": _with("SELECT CASE decision WHEN 'RECOMMEND_CHANGE' THEN 'REVIEWED' ELSE 'GENERATED' END AS state, decision, count(*) AS n FROM rec2 WHERE decision <> 'KEEP_CURRENT' GROUP BY 1, 2", *_recommended()),
    "panel_canonical": _with(f"SELECT upc, store, week, {_r('move')}, round(p, 6) AS effective_unit_price, {_r('revenue')}, round(rate, 6) AS gross_margin_rate, round(aac, 6) AS estimated_unit_aac, round(gp, 6) AS gross_profit, CAST(promo AS BIGINT) AS recorded_promotion_flag, promo_type AS recorded_promotion_type, year(day) AS year, month(day) AS month, quarter(day) AS quarter, week(day) AS week_of_year FROM pn"),
    "exclusion_counts": _with("SELECT CASE WHEN ok = 0 THEN 'ok_flag_zero' WHEN price < 0.01 THEN 'non_positive_price' WHEN move < 0 THEN 'negative_move' ELSE 'kept' END AS rule, count(*) AS n_rows FROM mv GROUP BY 1"),
    "scale_summary": _with(f"SELECT count(*) AS n_rows, count(DISTINCT upc) AS n_upcs, count(DISTINCT store) AS n_stores, count(DISTINCT week) AS n_weeks, min(week) AS first_week, max(week) AS last_week, round(sum(move), 6) AS units, round(sum(revenue), 6) AS revenue, round(sum(gp), 6) AS gross_profit FROM pn"),
    "numeric_profile": _with("SELECT feature, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, round(quantile_cont(value, 0.01), 6) AS p01, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.99), 6) AS p99, count(*) FILTER (WHERE value = 0) AS n_zero, count(*) FILTER (WHERE value < 0) AS n_negative FROM (SELECT unnest(['move', 'effective_unit_price', 'gross_margin_rate']) AS feature, unnest([move, p, rate]) AS value FROM pn) GROUP BY feature"),
    "promo_rollup": _with("SELECT promo_type AS recorded_promotion_type, count(*) AS n_rows, round(sum(move), 6) AS units, round(sum(revenue), 6) AS revenue, round(avg(p), 6) AS mean_price FROM pn GROUP BY 1"),
    "weekly_rollup": _with("SELECT week, count(*) AS n_rows, round(sum(move), 6) AS units, round(sum(revenue), 6) AS revenue, round(avg(promo), 6) AS promotion_share FROM pn GROUP BY week"),
    "upc_concentration": _with("SELECT upc, round(units, 6) AS units, round(revenue, 6) AS revenue, n_obs, round(revenue / sum(revenue) OVER (), 6) AS revenue_share, row_number() OVER o AS revenue_rank, round(sum(revenue) OVER (ORDER BY revenue DESC, upc ROWS UNBOUNDED PRECEDING) / sum(revenue) OVER (), 6) AS cumulative_share FROM (SELECT upc, sum(move) AS units, sum(revenue) AS revenue, count(*) AS n_obs FROM pn GROUP BY upc) WINDOW o AS (ORDER BY revenue DESC, upc)"),
    "product_roles": _with("SELECT upc, round(units, 6) AS units, round(revenue, 6) AS revenue, revenue_rank, CASE WHEN cum - share < 0.5 THEN 'core' WHEN cum - share < 0.8 THEN 'support' ELSE 'tail' END AS role FROM (SELECT upc, units, revenue, row_number() OVER (ORDER BY revenue DESC, upc) AS revenue_rank, revenue / sum(revenue) OVER () AS share, sum(revenue) OVER (ORDER BY revenue DESC, upc ROWS UNBOUNDED PRECEDING) / sum(revenue) OVER () AS cum FROM (SELECT upc, sum(move) AS units, sum(revenue) AS revenue FROM pn WHERE week > (SELECT max(week) FROM pn) - 52 GROUP BY upc))"),
    "store_dispersion": _with("SELECT upc, count(*) AS n_stores, round(min(m), 6) AS lowest, round(max(m), 6) AS highest, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS std FROM (SELECT upc, store, avg(p) AS m FROM pn GROUP BY upc, store) GROUP BY upc"),
    "price_variation_upc": _with(_VARIATION.format(keys="upc", order="week, store")),
    "price_variation_series": _with(_VARIATION.format(keys="upc, store", order="week")),
    "eligible_series": _with("SELECT upc, store, coalesce(n_obs >= 40 AND n_distinct_prices >= 5 AND price_cv >= 0.05, false) AS eligible FROM st", _STATS),
    "lag_features": _with(f"SELECT upc, store, week, {_r('lag_move_1', 'lag_move_2', 'lag_move_3', 'lag_move_4', 'lag_price_1', 'lag_price_2', 'lag_promotion_1')} FROM ft", _FEATURES),
    "rolling_features": _with(f"SELECT upc, store, week, {_r('roll_mean_move_4', 'roll_mean_move_8', 'roll_mean_move_13', 'roll_std_move_4', 'roll_mean_price_4')} FROM ft", _FEATURES),
    "reference_price_median": _with(f"SELECT upc, store, week, {_r('series_reference_price')} FROM ft", _FEATURES),
    "decision_cost": _with(f"SELECT upc, store, week, {_r('decision_time_unit_cost')} FROM ft", _FEATURES),
    "series_age": _with("SELECT upc, store, week, series_age_weeks FROM ft", _FEATURES),
    "price_features": _with("SELECT upc, store, week, round(ln(p), 6) AS log_price, round(p / lag_price_1 - 1, 6) + 0.0::DOUBLE AS price_vs_lag, round(p / series_reference_price - 1, 6) + 0.0::DOUBLE AS price_vs_reference, round(p / roll_mean_price_4 - 1, 6) + 0.0::DOUBLE AS price_vs_roll_mean FROM ft", _FEATURES),
    "temporal_split_counts": _with("SELECT split, count(*) AS n_rows, min(week) AS first_week, max(week) AS last_week FROM pn JOIN sp USING (week) GROUP BY split", _SPLIT),
    "arc_pairs": _with("SELECT upc, store, week, round(arc, 6) + 0.0::DOUBLE AS arc FROM ar", _ARC),
    "arc_summary": _with("SELECT count(*) AS n, round(quantile_cont(arc, 0.25), 6) AS p25, round(quantile_cont(arc, 0.5), 6) AS median, round(quantile_cont(arc, 0.75), 6) AS p75, round(avg(arc) FILTER (WHERE arc BETWEEN lo AND hi), 6) AS trimmed_mean, round(avg(CASE WHEN arc < 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_negative FROM ar, (SELECT quantile_cont(arc, 0.01) AS lo, quantile_cont(arc, 0.99) AS hi FROM ar)", _ARC),
    "price_change_events": _with("SELECT upc, count(*) AS n_pairs, count(*) FILTER (WHERE abs(p / pp - 1) > 1e-9) AS n_changes, count(*) FILTER (WHERE abs(p / pp - 1) > 0.5) AS n_jumps, round(avg(CASE WHEN p / pp - 1 < 0 THEN move / nullif(pm, 0) - 1 END), 6) AS units_after_cut FROM nx WHERE pp > 0 GROUP BY upc", _ARC),
    "episodes": _with("SELECT upc, store, week, round(pp, 6) AS prev_price, round(p, 6) AS effective_unit_price, round(pm, 6) AS prev_move, round(move, 6) AS move, round(p / pp - 1, 6) AS change FROM nx WHERE pp > 0 AND p > 0 AND pm > 0 AND move > 0 AND abs(p / pp - 1) BETWEEN 0.05 AND 0.60", _ARC),
    "history_stats_pit": _with("SELECT upc, store, week, count(p) OVER past AS hist_n_obs, coalesce(CAST(sum(f) OVER past AS BIGINT), 0) AS hist_n_prices, round(avg(p) OVER past, 10) AS hist_mean, round(stddev_samp(p) OVER past, 6) AS hist_std, round(min(p) OVER past, 6) AS hist_min, round(max(p) OVER past, 6) AS hist_max FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY upc, store, p ORDER BY week) = 1 THEN 1 ELSE 0 END AS f FROM pn) WINDOW past AS (PARTITION BY upc, store ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"),
    "loglog_pooled": _with("SELECT count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r_squared FROM ll", _LL),
    "loglog_upc_fe": _with("SELECT count(*) AS n, round(sum(x * y) / sum(x * x), 6) AS slope FROM wi", _within("upc")),
    "loglog_upc_store_fe": _with("SELECT count(*) AS n, round(sum(x * y) / sum(x * x), 6) AS slope FROM wi", _within("upc, store")),
    "error_ratios": _with(f"SELECT upc, n_obs, {_r(*_ERRORS[0])} FROM er", _within("upc, store"), _SLOPES, _ERRORS[1]),
    "error_summary": _with("""SELECT statistic, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90
      FROM (UNPIVOT er ON COLUMNS('^(std_error|ratio|significant)_') INTO NAME statistic VALUE value) GROUP BY 1""", _within("upc, store"), _SLOPES, _ERRORS[1]),
    "elasticity_by_upc": _with("SELECT upc, n_obs, round(estimate, 6) AS estimate, round(h, 6) AS std_error_hc1, round(a, 6) AS std_error_store, round(b, 6) AS std_error_week, round(greatest(h, a, b), 6) AS std_error, round(sxy * sxy / (sxx * nullif(syy, 0)), 6) AS r_squared FROM se", _within("upc, store"), _SLOPES),
    "forecast_metrics": _with(f"SELECT model, {_METRICS} FROM lf GROUP BY model", _FEATURES, _SPLIT, _BASE),
    "metrics_by_segment": _with(f"SELECT store, {_METRICS} FROM lf WHERE model = 'rolling_mean_4' GROUP BY store", _FEATURES, _SPLIT, _BASE),
    "performance_by_quarter": _with(f"SELECT year(day) || 'Q' || quarter(day) AS period, {_METRICS} FROM lf WHERE model = 'rolling_mean_4' GROUP BY 1", _FEATURES, _SPLIT, _BASE),
    "psi_by_feature": _with("""SELECT feature, round(CASE WHEN max(ne) >= 3 THEN sum((c - r) * ln(c / r)) ELSE 0 END, 6) AS psi FROM (
      SELECT feature, ne, greatest(c / sum(c) OVER (PARTITION BY feature), 1e-6) AS c, greatest(r / sum(r) OVER (PARTITION BY feature), 1e-6) AS r FROM (
        SELECT feature, len(list_filter(e[2:len(e) - 1], lambda x: value > x)) AS bin, len(e) AS ne, count(*) FILTER (WHERE split = 'train') AS r, count(*) FILTER (WHERE split = 'test') AS c
        FROM lv JOIN (SELECT feature, list_sort(list_distinct(quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM lv WHERE split = 'train' GROUP BY feature) USING (feature) GROUP BY ALL)) GROUP BY feature""", _FEATURES, _SPLIT, _LONG),
    "ks_statistic": _with("""SELECT feature, round(max(abs(a - b)), 6) AS ks FROM (
      SELECT feature, sum(r) OVER (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING) / sum(r) OVER (PARTITION BY feature) AS a, sum(c) OVER (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING) / sum(c) OVER (PARTITION BY feature) AS b FROM (
        SELECT feature, value, count(*) FILTER (WHERE split = 'train') AS r, count(*) FILTER (WHERE split = 'test') AS c FROM lv GROUP BY feature, value)) GROUP BY feature""", _FEATURES, _SPLIT, _LONG),
    "guardrail_bounds": _with(f"SELECT upc, store, week, {_r('low', 'high')}, array_to_string(binding, '|') AS binding FROM b3", *_ALL, _FREE),
    "simulate_grid": _with("SELECT upc, store, week, round(price, 6) AS price, round(units, 6) AS units, round(value, 6) AS profit FROM sm", *_ALL, _FREE),
    "price_grid": _with("SELECT upc, store, week, n_prices, round(lowest, 6) AS lowest, round(highest, 6) AS highest FROM (SELECT b3.upc, b3.store, b3.week, count(price) AS n_prices, min(price) AS lowest, max(price) AS highest FROM b3 LEFT JOIN gr USING (upc, store, week) GROUP BY ALL)", *_ALL, _FREE),
    "curve_diagnostics": _with("""SELECT upc, store, week, count(price) AS n_candidates, CASE WHEN bool_or(high >= low) THEN round(count(*) FILTER (WHERE step > 1e-9) / nullif(count(step), 0), 6) END AS share_rising, CASE WHEN bool_or(high >= low) THEN coalesce(bool_and(step <= 1e-9), true) END AS monotone,
      round((max(units) - min(units)) / nullif(max(units), 0), 6) AS relative_span, (max(units) - min(units)) / nullif(max(units), 0) < 0.01 AS flat FROM (SELECT b3.upc, b3.store, b3.week, low, high, sm.price, units, units - lag(units) OVER (PARTITION BY b3.upc, b3.store, b3.week ORDER BY sm.price) AS step FROM b3 LEFT JOIN sm USING (upc, store, week)) GROUP BY upc, store, week""", *_ALL, _FREE),
    "risk_levels": _with("SELECT upc, store, week, risk AS risk_level FROM rl", *_ALL),
    "recommendations": _with(f"SELECT upc, store, week, decision, risk_level, {_r('current_price', 'proposed_price', 'recommended_price')}, n_candidates, {_r('units_current', 'units_proposed', 'profit_current', 'profit_proposed')}, round(CASE WHEN outcome = 'change' THEN (profit_proposed - profit_current) / nullif(abs(profit_current), 0) ELSE 0 END, 6) AS realisable_uplift, array_to_string(codes, '|') AS reason_codes FROM rec2", *_recommended()),
    "reason_code_counts": _with("SELECT code, count(*) AS n FROM (SELECT unnest(codes) AS code FROM rec2) GROUP BY code", *_recommended()),
    "optimal_prices": _with("SELECT upc, store, week, round(unit_cost * -2.0 / (1 + -2.0), 6) AS best_price FROM cx WHERE unit_cost > 0", *_ALL),
    "value_scenarios": _with("SELECT s AS scenario, round(gain * f, 6) AS weekly, round(gain * f * 52, 6) AS annual FROM (SELECT coalesce(sum(CASE WHEN outcome = 'change' THEN profit_proposed - profit_current END), 0.0) AS gain FROM rec2), (VALUES ('low', 0.25::DOUBLE), ('middle', 0.5::DOUBLE), ('high', 1.0::DOUBLE)) AS v(s, f)", *_recommended()),
    "modal_price": _with("SELECT m.upc, round(modal, 6) AS modal_price, round(median_margin, 6) AS median_margin FROM (SELECT upc, arg_max(price, struct_pack(n := n, q := -price)) AS modal FROM (SELECT upc, round(p, 2) AS price, count(*) AS n FROM pn GROUP BY 1, 2) GROUP BY upc) m JOIN (SELECT upc, quantile_cont(rate, 0.5) AS median_margin FROM pn GROUP BY upc) q USING (upc)"),
    "episode_scores": _with("""SELECT method, count(*) AS n, round(sum(abs(move - pred)) / nullif(sum(abs(move)), 0), 6) AS wape, round(avg(abs(move - pred)), 6) AS mae, round(avg(pred - move), 6) AS bias,
      round(avg(CASE WHEN abs(dp) > 1e-9 THEN CASE WHEN sign(dp) = sign(dq) THEN 1.0::DOUBLE ELSE 0 END END), 6) AS sign_accuracy, round(quantile_cont(abs(dp - dq), 0.5), 6) AS median_log_error
      FROM (SELECT method, move, pred, ln(greatest(pred, 1e-9) / base) AS dp, ln(greatest(move, 1e-9) / base) AS dq FROM (
        SELECT method, e.move, base, base * pow(e.p / e.pp, eps) AS pred FROM (SELECT nx.*, coalesce(roll_mean_move_4, lag_move_1) AS base FROM nx JOIN ft USING (upc, store, week)) e, (VALUES ('null', 0.0::DOUBLE), ('fixed', -2.0::DOUBLE), ('unit', -1.0::DOUBLE)) AS v(method, eps)
        WHERE pp > 0 AND e.p > 0 AND pm > 0 AND e.move > 0 AND abs(e.p / pp - 1) BETWEEN 0.05 AND 0.60 AND base > 0)) GROUP BY method""", _FEATURES, _ARC),
    "episode_rank_correlation": _with("""SELECT round(corr(a, b), 6) AS spearman FROM (SELECT avg(ra) OVER (PARTITION BY c) AS a, avg(rb) OVER (PARTITION BY r) AS b FROM (
      SELECT c, r, row_number() OVER (ORDER BY c) AS ra, row_number() OVER (ORDER BY r) AS rb FROM (SELECT p / pp - 1 AS c, ln(move / pm) AS r FROM nx WHERE pp > 0 AND p > 0 AND pm > 0 AND move > 0 AND abs(p / pp - 1) BETWEEN 0.05 AND 0.60)))""", _ARC),
    "excluded_positions": _with("""SELECT CASE WHEN f IS NULL THEN 'no_valid_week' WHEN week < f THEN 'leading' WHEN week > l THEN 'trailing' ELSE 'interior' END AS position, count(*) AS n FROM (
      SELECT week, ok, min(CASE WHEN ok = 1 THEN week END) OVER s AS f, max(CASE WHEN ok = 1 THEN week END) OVER s AS l FROM mv WINDOW s AS (PARTITION BY upc, store)) WHERE ok = 0 GROUP BY 1"""),
    "latest_state": _with("SELECT upc, store, week, round(move, 6) AS move, round(p, 6) AS effective_unit_price FROM (SELECT *, row_number() OVER (PARTITION BY upc, store ORDER BY week DESC) AS n FROM pn) WHERE n = 1"),
}


_RUNS = """,
zp AS (SELECT *, ok = 0 OR price <= 0 AS z FROM mv),
zn AS (SELECT *, row_number() OVER (PARTITION BY upc, store ORDER BY week) - row_number() OVER (PARTITION BY upc, store, z ORDER BY week) AS island,
         min(CASE WHEN NOT z THEN week END) OVER (PARTITION BY upc, store) AS f, max(CASE WHEN NOT z THEN week END) OVER (PARTITION BY upc, store) AS l FROM zp),
zr AS (SELECT upc, store, CASE WHEN min(f) IS NULL THEN 'never_priced' WHEN max(week) < min(f) THEN 'leading' WHEN min(week) > min(l) THEN 'trailing' ELSE 'interior' END AS kind,
         min(week) AS first_week, max(week) AS last_week, count(*) AS n_weeks, count(*) FILTER (WHERE move > 0) AS n_sold FROM zn WHERE z GROUP BY upc, store, island),
zd AS (SELECT dimension, key, count(*) AS n_rows, count(*) FILTER (WHERE z) AS n_zero, count(*) FILTER (WHERE z AND move > 0) AS n_zero_sold, count(*) FILTER (WHERE z) / count(*) AS share_zero
         FROM (SELECT z, move, unnest(['week', 'upc', 'store']) AS dimension, unnest([week, upc, store]) AS key FROM zp) GROUP BY dimension, key)"""
_TRAIN = _SPLIT + ", tn AS (SELECT pn.* FROM pn JOIN sp USING (week) WHERE split = 'train')"
_MOVED = "*, CASE WHEN discount >= 0.08 THEN 'B' WHEN discount >= 0.06 THEN 'S' END AS sale, 1.0 AS qty"
_COLUMNS = ("upc", "store", "week", "move", "qty", "price", "sale", "profit", "ok")
_ROLES = """,
rc AS (SELECT upc, sum(move) AS units, sum(revenue) AS revenue, sum(gp) AS gp, count(DISTINCT store) AS stores FROM pn WHERE week > (SELECT max(week) FROM pn) - 52 GROUP BY upc),
al AS (SELECT count(DISTINCT store) AS ns, (SELECT sum(revenue) FROM rc) AS nr, (SELECT count(*) FROM rc) AS np FROM pn WHERE week > (SELECT max(week) FROM pn) - 52),
rk1 AS (
  SELECT rc.*, -(1.5::DOUBLE + upc % 8 / 8.0::DOUBLE) AS elasticity, gp / nullif(revenue, 0) AS rate, stores / ns AS coverage, row_number() OVER (ORDER BY units DESC, upc) / np AS rank_share,
         (sum(revenue) OVER (ORDER BY revenue DESC, upc ROWS UNBOUNDED PRECEDING) - revenue) / nr AS before FROM rc, al),
rk2 AS (SELECT *, CASE WHEN rank_share <= 0.2 AND coverage >= 0.75 THEN 'traffic driver' WHEN before >= 1 - 0.05 THEN 'tail' ELSE 'rest' END AS kind FROM rk1),
pro AS (
  SELECT upc, units, revenue, rate, coverage, elasticity, CASE WHEN kind <> 'rest' THEN kind WHEN rate > mr AND abs(elasticity) < me THEN 'margin builder' ELSE 'core' END AS role
  FROM rk2, (SELECT quantile_cont(rate, 0.5) AS mr, quantile_cont(abs(elasticity), 0.5) AS me FROM rk2 WHERE kind = 'rest'))"""
_GAINED = """,
rr AS (SELECT r.*, coalesce(role, 'tail') AS role, (current_price - unit_cost) * base_units AS base FROM rec2 r LEFT JOIN pro USING (upc)),
gn AS (
  SELECT *, (recommended_price - unit_cost) * greatest(base_units * pow(recommended_price / current_price, -2.0), 0) - base AS gain,
         CASE WHEN role = 'traffic driver' THEN least(recommended_price, current_price * 1.02) ELSE recommended_price END AS capped_price FROM rr)"""
_DRIFTED = """,
de AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM lv WHERE split = 'train' GROUP BY feature),
ds AS (
  SELECT feature, round(CASE WHEN max(ne) >= 3 THEN sum((c - r) * ln(c / r)) ELSE 0 END, 6) AS psi FROM (
    SELECT feature, ne, greatest(c / sum(c) OVER (PARTITION BY feature), 1e-6) AS c, greatest(r / sum(r) OVER (PARTITION BY feature), 1e-6) AS r FROM (
      SELECT feature, len(list_filter(e[2:len(e) - 1], lambda x: value > x)) AS bin, len(e) AS ne, count(*) FILTER (WHERE split = 'train') AS r, count(*) FILTER (WHERE split = 'test') AS c
      FROM lv JOIN de USING (feature) GROUP BY ALL)) GROUP BY feature),
dk AS (
  SELECT feature, round(max(abs(a - b)), 6) AS ks FROM (
    SELECT feature, sum(r) OVER o / sum(r) OVER w AS a, sum(c) OVER o / sum(c) OVER w AS b FROM (
      SELECT feature, value, count(*) FILTER (WHERE split = 'train') AS r, count(*) FILTER (WHERE split = 'test') AS c FROM lv GROUP BY feature, value)
    WINDOW o AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY feature)) GROUP BY feature),
dm AS (SELECT feature, round(avg(value) FILTER (WHERE split = 'train'), 6) AS reference_mean, round(avg(value) FILTER (WHERE split = 'test'), 6) AS current_mean FROM lv GROUP BY feature),
dr AS (SELECT *, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'moderate' ELSE 'large' END AS band FROM ds JOIN dk USING (feature) JOIN dm USING (feature))"""
_PREDICTED = """,
pq AS (SELECT t.*, split FROM ft t JOIN sp USING (week) WHERE move IS NOT NULL AND lag_move_1 IS NOT NULL AND lag_price_1 IS NOT NULL AND split <> 'valid'),
lv AS (SELECT split, 'predicted' AS feature, greatest(coalesce(roll_mean_move_4, lag_move_1), 0) AS value FROM pq)"""
_SWEEP = """,
sg AS (
  SELECT DISTINCT upc, store, week, current_price, unit_cost, base_units, price_min, price_max, floor(raw * 100 + 0.5) / 100.0::DOUBLE AS price FROM (
    SELECT *, unnest(list_transform(range(0, 25), lambda i: current_price * (0.7::DOUBLE + i * (0.6::DOUBLE / 24)))) AS raw FROM cx)),
sv AS (SELECT *, greatest(base_units * pow(price / current_price, -2.0), 0.0) AS units FROM sg WHERE price > 0),
sl AS (
  SELECT *, (ln(units + 1e-9) - ln(lag(units) OVER w + 1e-9)) / nullif(ln(price) - ln(lag(price) OVER w), 0) AS local, units - lag(units) OVER w AS step
  FROM sv WINDOW w AS (PARTITION BY upc, store, week ORDER BY price)),
sw AS (
  SELECT upc, store, week, any_value(current_price) AS current_price, arg_max(price, struct_pack(a := (price - unit_cost) * units, b := -price)) FILTER (WHERE unit_cost IS NOT NULL) AS profit_optimum,
         arg_max(price, struct_pack(a := price * units, b := -price)) AS revenue_optimum, coalesce(bool_and(step <= 1e-9), true) AS monotone, count(*) FILTER (WHERE step > 1e-9) AS rises,
         min(price) < any_value(price_min) AS low_outside, max(price) > any_value(price_max) AS high_outside, quantile_cont(local, 0.5) AS local_elasticity,
         (max(units) - min(units)) / nullif(max(units), 0) AS span FROM sl GROUP BY upc, store, week)"""
_ALERTED = """SELECT 'psi' AS kind, feature AS subject, psi AS value, 0.01::DOUBLE AS threshold FROM ds WHERE psi >= 0.01 UNION ALL
  SELECT kind, period, value, threshold FROM (
    SELECT period, unnest(['wape', 'bias']) AS kind, unnest([wape, abs(bias)]) AS value, unnest([0.2::DOUBLE, 1.0::DOUBLE]) AS threshold
    FROM (SELECT year(day) || 'Q' || quarter(day) AS period, """ + _METRICS + """ FROM lf WHERE model = 'rolling_mean_4' GROUP BY 1)) WHERE value >= threshold"""
_TOO_FEW = "n_obs < 200 OR n_distinct_prices < 10"
_CATEGORY = """,
cl AS (SELECT *, CAST(floor(upc / 10.0) AS BIGINT) AS category FROM pn),
cw AS (SELECT CAST(floor(upc / 10.0) AS BIGINT) AS category, sum(x * y) / sum(x * x) AS slope FROM wi GROUP BY 1)"""

_HISTORY = """,
hs AS (
  SELECT upc, store, week, count(p) OVER past AS n_obs, coalesce(CAST(sum(f) OVER past AS BIGINT), 0) AS n_distinct_prices, stddev_samp(p) OVER past / nullif(avg(p) OVER past, 0) AS price_cv, min(p) OVER past AS price_min, max(p) OVER past AS price_max
  FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY upc, store, p ORDER BY week) = 1 THEN 1 ELSE 0 END AS f FROM pn)
  WINDOW past AS (PARTITION BY upc, store ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cx AS (
  SELECT upc, store, week, lag_price_1 AS current_price, CASE WHEN decision_time_unit_cost > 0 THEN decision_time_unit_cost END AS unit_cost, coalesce(roll_mean_move_4, lag_move_1, 0.0) AS base_units, n_obs, n_distinct_prices, price_cv, price_min, price_max
  FROM ft JOIN hs USING (upc, store, week) WHERE week > (SELECT max(week) FROM pn) - 10 AND lag_price_1 IS NOT NULL),
rl AS (
  SELECT * EXCLUDE (away), CASE WHEN n_obs >= 150 AND n_distinct_prices >= 15 AND away <= 0.02 THEN 'LOW' WHEN n_obs >= 80 AND n_distinct_prices >= 8 AND away <= 0.05 THEN 'MEDIUM' ELSE 'HIGH' END AS risk FROM (
    SELECT *, CASE WHEN current_price < price_min THEN (price_min - current_price) / price_min WHEN current_price > price_max THEN (current_price - price_max) / price_max ELSE 0 END AS away FROM cx))"""
_WINDOWED = """,
ws AS (SELECT min(week) AS a, (max(week) - min(week) + 1) / 3.0::DOUBLE AS len FROM ll),
lw AS (SELECT 'W' || i AS wn, l.* FROM ll l, ws, (SELECT unnest([1, 2, 3]) AS i) WHERE week BETWEEN a + floor(len * (i - 1)) AND a + floor(len * i) - 1),
wi AS (SELECT wn, upc, store, week, x - avg(x) OVER s AS x, y - avg(y) OVER s AS y FROM lw WINDOW s AS (PARTITION BY wn, upc, store))""" + _SLOPES.replace("upc", "wn, upc")
# Targets of the rule-only policies.
_RULES = {
    "R0_keep": "current_price", "R1_hold_margin": "unit_cost / (1 - least(greatest(median_margin, 0.0), 0.8))", "R2_cost_plus": "unit_cost * 1.25", "R3_modal_price": "modal_price", "R4_max_increase": "current_price * 10.0",
}


def _backtested() -> tuple[str, ...]:
    return (_FEATURES, _HISTORY, _bounds(), _decided())


def _ruled(target: str) -> tuple[str, ...]:
    """Decisions that move to a target, kept within the bounds, instead of to the best price."""
    bounds = _bounds()
    begin, end = bounds.index("gr AS ("), bounds.index("sm AS (")
    grid = f"""gr AS (
  SELECT DISTINCT upc, store, week, price FROM (
    SELECT upc, store, week, unnest([round_even(least(greatest({target}, low), high) / 0.01, 0) * 0.01, least(greatest(current_price, low), high)]) AS price FROM b3 JOIN mg USING (upc, store) WHERE high >= low)
  WHERE price IS NOT NULL),
"""
    own = bounds[:begin] + grid + bounds[end:]
    decided = _decided().replace("arg_max(struct_pack(price := price, units := units, value := value), struct_pack(a := value, b := -price)) AS best", f"arg_min(struct_pack(price := price, units := units, value := value), struct_pack(a := abs(price - least(greatest({target}, low), high)), b := price)) AS best")
    decided = decided.replace("FROM sm WHERE value IS NOT NULL GROUP BY upc, store, week)", "FROM (SELECT sm.*, low, high, unit_cost, median_margin, modal_price FROM sm JOIN b3 USING (upc, store, week) JOIN mg USING (upc, store)) GROUP BY upc, store, week)")
    decided = decided.replace("WHEN uplift IS NULL OR uplift < 0.01 THEN 'small'", "WHEN abs(change) < 0.01 THEN 'small'")
    margins = """, mo AS (SELECT upc, store, arg_max(price, struct_pack(n := n, q := -price)) AS modal_price FROM (SELECT upc, store, round(p, 2) AS price, count(*) AS n FROM pn GROUP BY 1, 2, 3) GROUP BY 1, 2),
mg AS (SELECT mo.*, median_margin FROM mo JOIN (SELECT upc, store, quantile_cont(rate, 0.5) AS median_margin FROM pn GROUP BY 1, 2) USING (upc, store))"""
    return (*_ALL, margins, own, decided)


SQL |= {
    "raw_audit": _with(
        f"SELECT * FROM (UNPIVOT (SELECT count(*) AS rows, {', '.join(f'count(*) FILTER (WHERE {c} IS NULL) AS null_{c}' for c in _COLUMNS)}, count(DISTINCT upc) AS n_upc, count(DISTINCT store) AS n_store, "
        f"count(DISTINCT week) AS n_week, min(week) AS week_min, max(week) AS week_max, count(*) - count(DISTINCT ({', '.join(_COLUMNS)})) AS exact_duplicates, count(*) - count(DISTINCT (upc, store, week)) AS grain_duplicates "
        f"FROM (SELECT {_MOVED} FROM mv)) ON COLUMNS(*) INTO NAME measure VALUE value) UNION ALL SELECT 'ok=' || ok, count(*) FROM mv GROUP BY 1 UNION ALL SELECT 'sale=' || coalesce(sale, 'null'), count(*) FROM (SELECT {_MOVED} FROM mv) GROUP BY 1"
    ),
    "demand_prior": _with("SELECT upc, round((sum(ln(1 + move)) + 50 * any_value(g)) / (count(*) + 50), 6) AS upc_demand_prior FROM tn, (SELECT avg(ln(1 + move)) AS g FROM tn) GROUP BY upc", _TRAIN),
    "product_history": _with(
        f"SELECT *, {_TOO_FEW} AS too_little FROM (SELECT upc, count(*) AS n_obs, count(DISTINCT p) AS n_distinct_prices, count(DISTINCT store) AS n_stores, count(DISTINCT week) AS n_weeks, "
        "round(stddev_samp(p) / avg(p), 6) AS price_cv, round(min(p), 6) AS price_min, round(max(p), 6) AS price_max FROM tn WHERE p > 0 AND move > 0 GROUP BY upc)", _TRAIN,
    ),
    "promotion_risk": _with(
        "SELECT CASE WHEN n_obs >= 150 AND n_distinct_prices >= 15 AND share <= 0.5 THEN 'LOW' WHEN (n_obs >= 150 AND n_distinct_prices >= 15) OR (n_obs >= 80 AND n_distinct_prices >= 8) THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level, "
        "share > 0.5 AS promoted, count(*) AS n FROM cx JOIN (SELECT upc, store, avg(promo) AS share FROM pn GROUP BY upc, store) USING (upc, store) GROUP BY 1, 2", *_ALL,
    ),
    "feature_drift": _with("SELECT *, row_number() OVER (ORDER BY psi DESC, feature) AS drift_rank FROM dr", _FEATURES, _SPLIT, _LONG, _DRIFTED),
    "prediction_drift": _with(
        "SELECT dr.*, reference_p95, current_p95, reference_share_zero, current_share_zero FROM dr JOIN (SELECT feature, round(quantile_cont(CASE WHEN split = 'train' THEN value END, 0.95), 6) AS reference_p95, "
        "round(quantile_cont(CASE WHEN split = 'test' THEN value END, 0.95), 6) AS current_p95, round(avg(CASE WHEN value <= 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE split = 'train'), 6) AS reference_share_zero, "
        "round(avg(CASE WHEN value <= 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE split = 'test'), 6) AS current_share_zero FROM lv GROUP BY feature) USING (feature)", _FEATURES, _SPLIT, _PREDICTED, _DRIFTED,
    ),
    "schema_checks": _with("""SELECT "column", found_type, passed, null_share FROM (SELECT unnest(['upc', 'store', 'week', 'move', 'effective_unit_price', 'package']) AS "column",
      unnest(['bigint', 'bigint', 'bigint', 'double', 'double', NULL]) AS found_type, unnest([true, true, true, true, true, false]) AS passed,
      unnest([count(*) FILTER (WHERE upc IS NULL) / count(*), count(*) FILTER (WHERE store IS NULL) / count(*), count(*) FILTER (WHERE week IS NULL) / count(*), count(*) FILTER (WHERE move IS NULL) / count(*), count(*) FILTER (WHERE p IS NULL) / count(*), NULL]) AS null_share FROM pn)"""),
    "strict_alerts": _with(_ALERTED, _FEATURES, _SPLIT, _LONG, _DRIFTED, _BASE),
    "alerts": _with(_ALERTED.replace("0.01", "0.25").replace("0.2::", "0.7::").replace("1.0::DOUBLE]", "10.0::DOUBLE]"), _FEATURES, _SPLIT, _LONG, _DRIFTED, _BASE),
    "refitted_baselines": _with(f"SELECT model, {_METRICS} FROM lf GROUP BY model", _FEATURES, _SPLIT, _BASE.replace("WHERE split = 'train'", "WHERE split <> 'test'")),
    "worst_stores": _with("SELECT store, n, wape FROM (SELECT store, count(actual) AS n, round(sum(abs(predicted - actual)) / nullif(sum(abs(actual)), 0), 6) AS wape FROM lf WHERE model = 'rolling_mean_4' GROUP BY store) ORDER BY wape DESC, store LIMIT 10", _FEATURES, _SPLIT, _BASE),
    "top_products": _with("SELECT upc, round(sum(revenue), 6) AS revenue, round(sum(move), 6) AS units FROM pn GROUP BY upc ORDER BY sum(revenue) DESC, upc LIMIT 10"),
    "decision_crosstab": _with("SELECT risk_level, " + ", ".join(f"count(*) FILTER (WHERE decision = '{k}') AS {k}" for k in ("KEEP_CURRENT", "RECOMMEND_CHANGE", "REVIEW_REQUIRED")) + " FROM rec2 GROUP BY risk_level", *_recommended()),
    "reason_code_flags": _with("SELECT upc, store, week, " + ", ".join(f"len(list_filter(codes, lambda c: c = '{k}')) AS {k}" for k in EXPLANATIONS) + " FROM rec2", *_recommended()),
    "tiled_decisions": _with("SELECT decision, 20 * count(*) AS n, 20 * count(DISTINCT store) AS n_stores FROM rec2 GROUP BY decision", *_recommended()),
    "zero_price_audit": _with("""SELECT upc, count(*) AS n_rows, count(*) FILTER (WHERE z) AS n_zero, count(*) FILTER (WHERE z AND move > 0) AS n_zero_sold, min(CASE WHEN z THEN week END) AS first_zero_week,
      max(CASE WHEN z THEN week END) AS last_zero_week, round(count(*) FILTER (WHERE z) / count(*), 6) AS share_zero FROM (SELECT *, ok = 0 OR price <= 0 AS z FROM mv) GROUP BY upc"""),
    "product_shares": _with("""SELECT upc, 'Brand#' || upc AS descrip, round(count(*) / sum(count(*)) OVER (), 6) AS row_share, round(sum(move) / sum(sum(move)) OVER (), 6) AS unit_share, round(avg(promo), 6) AS promotion_share FROM pn GROUP BY upc"""),
    "price_indices": _with("SELECT upc, store, week, round(p / nullif(series_reference_price, 0), 6) AS price_index FROM ft", _FEATURES),
    "priced_roles": _with("SELECT upc, round(units, 6) AS units, round(revenue, 6) AS revenue, round(rate, 6) AS gross_margin_rate, round(coverage, 6) AS store_coverage, round(elasticity, 6) AS elasticity, role FROM pro", _ROLES),
    "role_summary": _with("""SELECT role, count(*) AS contexts, round(avg(CASE WHEN decision = 'RECOMMEND_CHANGE' THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_actionable, round(avg(CASE WHEN decision = 'REVIEW_REQUIRED' THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_review,
      round(avg(CASE WHEN decision = 'RECOMMEND_CHANGE' THEN CASE WHEN recommended_price > current_price THEN 1.0::DOUBLE ELSE 0 END END), 6) AS share_increases, round(quantile_cont(CASE WHEN decision = 'RECOMMEND_CHANGE' THEN recommended_price / current_price - 1 END, 0.5), 6) AS median_change,
      round(sum(gain) / nullif(any_value(t), 0), 6) AS share_of_gain FROM gn, (SELECT sum(gain) AS t FROM gn) GROUP BY role""", *_recommended(), _ROLES, _GAINED),
    "traffic_cap": _with("""SELECT 0.02::DOUBLE AS cap, round(sum(gain) / nullif(sum(base), 0), 6) AS uplift_full, round(sum(cg) / nullif(sum(base), 0), 6) AS uplift_capped, round(1 - sum(cg) / nullif(sum(gain), 0), 6) AS share_given_up,
      count(*) FILTER (WHERE role = 'traffic driver' AND recommended_price > current_price * 1.02 + 1e-9) AS affected
      FROM (SELECT *, (capped_price - unit_cost) * greatest(base_units * pow(capped_price / current_price, -2.0), 0) - base AS cg FROM gn)""", *_recommended(), _ROLES, _GAINED),
    "price_response_sweep": _with("SELECT upc, store, week, round(profit_optimum, 6) AS profit_optimum, round(revenue_optimum, 6) AS revenue_optimum, monotone, low_outside, high_outside, round(local_elasticity, 6) AS local_elasticity FROM sw", *_ALL, _SWEEP),
    "sweep_summary": _with("""SELECT count(*) AS n_contexts, round(avg(CASE WHEN monotone THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_monotone, round(avg(CASE WHEN rises > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_with_rise,
      round(avg(CASE WHEN span < 0.01 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_flat, round(quantile_cont(local_elasticity, 0.5), 6) AS median_local_elasticity, round(quantile_cont(span, 0.5), 6) AS median_span,
      round(avg(CASE WHEN profit_optimum < current_price THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_profit_below,
      round(avg(CASE WHEN profit_optimum <= current_price * 0.7 + 0.005 + 1e-6 OR profit_optimum >= current_price * 1.3 - 0.005 - 1e-6 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_profit_at_edge,
      round(avg(CASE WHEN revenue_optimum < current_price THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_revenue_below FROM sw""", *_ALL, _SWEEP),
    "category_comparison": _with("""SELECT category, count(*) AS n, count(DISTINCT upc) AS n_upcs, round(sum(revenue), 6) AS revenue, round(avg(p), 6) AS mean_price, round(stddev_samp(p) / avg(p), 6) AS price_cv,
      round(avg(promo), 6) AS promotion_share, round(sum(gp) / sum(revenue), 6) AS margin_rate, round(any_value(slope), 6) AS slope FROM cl JOIN cw USING (category) GROUP BY category""", _within("upc, store"), _CATEGORY),
    "cost_leakage": _with("SELECT count(*) FILTER (WHERE week <= l - 1) AS n_early, 0 AS n_leaked, count(*) FILTER (WHERE week > l - 1) AS n_late, count(*) FILTER (WHERE week > l - 1 AND before = l - 1) AS n_reacting FROM (SELECT week, lag(week) OVER (PARTITION BY upc, store ORDER BY week) AS before, (SELECT max(week) FROM pn) AS l FROM pn)"),
    "policy_backtest": "SELECT policy, n_contexts, round(revenue, 6) AS revenue, round(profit, 6) AS profit, round(profit / nullif(max(CASE WHEN policy = 'historical' THEN profit END) OVER (), 0) - 1, 6) AS profit_vs_historical FROM ("
    + _with("""SELECT policy, count(*) AS n_contexts, sum(price * units) AS revenue, sum((price - unit_cost) * units) AS profit FROM (
        SELECT *, greatest(base_units * pow(price / current_price, -2.0), 0) AS units FROM (
          SELECT c.*, unnest(['historical', 'simple_margin', 'elasticity_baseline', 'optimised']) AS policy, unnest([current_price, CASE WHEN h >= l THEN least(greatest(unit_cost / 0.8::DOUBLE, l), h) ELSE current_price END,
            CASE WHEN h >= l THEN least(greatest(unit_cost * 2.0::DOUBLE, l), h) ELSE current_price END, recommended_price]) AS price
          FROM (SELECT cx.*, r.recommended_price, greatest(0.01, cx.current_price * 0.9, cx.unit_cost, cx.price_min * 0.95) AS l, least(cx.current_price * 1.1, cx.price_max * 1.05) AS h FROM cx JOIN rec2 r USING (upc, store, week) WHERE cx.unit_cost IS NOT NULL) c)) GROUP BY policy""", *_backtested()) + ")",
    "recommendation_stability": "SELECT count(*) AS n, round(avg(CASE WHEN m > 1e-9 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_moved, round(avg(m), 6) AS mean_move, round(quantile_cont(m, 0.9), 6) AS p90_move FROM (SELECT abs(recommended_price / before - 1) AS m FROM ("
    + _with("SELECT recommended_price, lag(recommended_price) OVER (PARTITION BY upc, store ORDER BY week) AS before FROM rec2", *_backtested()) + ") WHERE before IS NOT NULL)",
    "elasticity_windows": _with("SELECT wn AS window, upc, n_obs, round(estimate, 6) AS estimate, round(greatest(h, coalesce(a, h), coalesce(b, h)), 6) AS std_error FROM se", _LL, _WINDOWED),
    "elasticity_stability": "WITH f AS (" + _with("SELECT wn AS window, upc, round(estimate, 6) AS estimate, round(greatest(h, coalesce(a, h), coalesce(b, h)), 6) AS std_error FROM se", _LL, _WINDOWED) + """)
      SELECT a.window AS window_a, b.window AS window_b, count(*) AS n, round(corr(a.estimate, b.estimate), 6) AS correlation, round(avg(CASE WHEN sign(a.estimate) = sign(b.estimate) THEN 1.0::DOUBLE ELSE 0 END), 6) AS same_sign,
        round(avg(CASE WHEN abs(a.estimate - b.estimate) / sqrt(a.std_error * a.std_error + b.std_error * b.std_error) > 1.96 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_different
      FROM f a JOIN f b ON a.upc = b.upc AND a.window < b.window GROUP BY 1, 2""",
    "rule_policies": _union([_with(f"SELECT '{name}' AS rule, decision, count(*) AS n, round(sum(profit_proposed), 6) AS profit FROM rec2 GROUP BY 2", *_ruled(target)) for name, target in _RULES.items()]),
    "elasticity_all_windows": "SELECT upc, count(*) AS n_windows, round(min(e), 6) AS least, round(max(e), 6) AS most, round(max(e) - min(e), 6) AS spread, count(DISTINCT sign(e)) = 1 AS same_sign FROM ("
    + _with("SELECT upc, round(estimate, 6) AS e FROM se", _LL, _WINDOWED) + ") GROUP BY upc HAVING count(*) = 3",
    "log_documents": _with("SELECT upc, store, week, decision, round(recommended_price, 6) AS recommended_price, array_to_string(codes, '|') AS reason_codes FROM rec2", *_recommended()),
    "risk_factors": _with("""SELECT factor, level, count(*) AS n, round(sum(abs(predicted - actual)) / nullif(sum(abs(actual)), 0), 6) AS wape, round(avg(predicted - actual), 6) AS bias FROM (
      SELECT actual, predicted, unnest(['risk_level', 'history', 'prices', 'inside_support']) AS factor, unnest([
        CASE WHEN n_obs >= 150 AND n_distinct_prices >= 15 AND away <= 0.02 THEN 'LOW' WHEN n_obs >= 80 AND n_distinct_prices >= 8 AND away <= 0.05 THEN 'MEDIUM' ELSE 'HIGH' END,
        CASE WHEN n_obs >= 150 THEN 'long' WHEN n_obs >= 80 THEN 'middle' ELSE 'short' END, CASE WHEN n_distinct_prices >= 15 THEN 'many' WHEN n_distinct_prices >= 8 THEN 'some' ELSE 'few' END,
        coalesce(p BETWEEN price_min AND price_max, false)::VARCHAR]) AS level
      FROM (SELECT t.move AS actual, coalesce(roll_mean_move_4, lag_move_1) AS predicted, t.p, h.*, CASE WHEN t.p < price_min THEN (price_min - t.p) / price_min WHEN t.p > price_max THEN (t.p - price_max) / price_max WHEN price_min IS NOT NULL THEN 0 END AS away
        FROM tr t JOIN hp h USING (upc, store, week) WHERE split = 'test')) GROUP BY 1, 2""", _FEATURES, _SPLIT, """,
tr AS (SELECT ft.*, split FROM ft JOIN sp USING (week) WHERE move IS NOT NULL AND lag_move_1 IS NOT NULL AND lag_price_1 IS NOT NULL),
hp AS (
  SELECT upc, store, week, count(p) OVER past AS n_obs, coalesce(CAST(sum(f) OVER past AS BIGINT), 0) AS n_distinct_prices, min(p) OVER past AS price_min, max(p) OVER past AS price_max
  FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY upc, store, p ORDER BY week) = 1 THEN 1 ELSE 0 END AS f FROM tr)
  WINDOW past AS (PARTITION BY upc, store ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""),
    "late_outcomes": _with(f"SELECT week, {_METRICS} FROM lf WHERE model = 'rolling_mean_4' GROUP BY week", _FEATURES, _SPLIT, _BASE),
    "lifecycle_steps": _with("""SELECT rec_id, hour, CASE WHEN known THEN old END AS from_state, to_state, actor, known AND now = to_state AND old <> to_state AS accepted,
      CASE WHEN NOT known THEN 'unknown' WHEN now <> to_state OR old = to_state THEN 'illegal' END AS reason FROM (
      SELECT *, CASE WHEN (old = 'GENERATED' AND to_state = 'REVIEWED') OR (old = 'REVIEWED' AND to_state IN ('APPROVED', 'REJECTED')) OR (old = 'APPROVED' AND to_state = 'PUBLISHED') THEN to_state ELSE old END AS now FROM (
        SELECT *, list_reduce(list_prepend('GENERATED', coalesce(before, [])), lambda acc, x: CASE WHEN (acc = 'GENERATED' AND x = 'REVIEWED') OR (acc = 'REVIEWED' AND x IN ('APPROVED', 'REJECTED'))
          OR (acc = 'APPROVED' AND x = 'PUBLISHED') THEN x ELSE acc END) AS old FROM (
          SELECT *, list(to_state) OVER (PARTITION BY rec_id ORDER BY hour, to_state, actor ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (
            SELECT DISTINCT CASE WHEN upc % 10 = 0 THEN 'x' ELSE '' END || upc || '-' || store || '-' || week AS rec_id, upc % 10 <> 0 AS known, (upc * 11 + store * 5 + k * 37) % 97 AS hour,
              ['GENERATED', 'REVIEWED', 'APPROVED', 'REJECTED', 'PUBLISHED'][CAST((upc * 7 + store * 3 + k * k) % 5 + 1 AS INTEGER)] AS to_state, 'a' || (k % 2) AS actor
            FROM cx, (SELECT unnest(range(1, 7)) AS k)))))""", *_ALL),
    "appended_features": _with("SELECT upc, store, week, " + _r("lag_move_1", "lag_move_4", "lag_price_2", "roll_mean_move_4", "roll_mean_move_13", "roll_std_move_4", "roll_mean_price_4", "series_reference_price", "decision_time_unit_cost")
      + ", series_age_weeks, round(p / CASE WHEN series_reference_price > 0 THEN series_reference_price END - 1, 6) AS price_vs_reference FROM ft WHERE week > (SELECT max(week) FROM pn) - 4", _FEATURES),
    "zero_price_runs": _with("SELECT * FROM zr", _RUNS),
    "zero_price_kinds": _with("""SELECT kind, count(*) AS n_runs, sum(n_weeks) AS n_rows, sum(n_sold) AS n_sold, round(avg(n_weeks), 6) AS mean_length, max(n_weeks) AS longest,
      round(sum(n_weeks) / sum(sum(n_weeks)) OVER (), 6) AS share FROM zr GROUP BY kind""", _RUNS),
    "zero_price_dimensions": _with("SELECT dimension, key, n_rows, n_zero, n_zero_sold, round(share_zero, 6) AS share_zero FROM zd", _RUNS),
    "zero_price_spread": _with("""SELECT dimension, count(*) AS n, round(avg(share_zero), 6) AS mean_share, round(stddev_samp(share_zero), 6) AS std_share, round(min(share_zero), 6) AS min_share, round(max(share_zero), 6) AS max_share,
      count(*) FILTER (WHERE share_zero > 0.5) AS n_above_half, count(*) FILTER (WHERE share_zero > 0.8) AS n_above_80, count(*) FILTER (WHERE share_zero < 0.05) AS n_below_5 FROM zd GROUP BY dimension""", _RUNS),
    "zero_price_selection": _with("""SELECT CASE WHEN share > 0.5 THEN 'heavy' WHEN share <= 0.1 THEN 'light' ELSE 'middle' END AS series, count(*) AS n, round(avg(price), 6) AS mean_price, round(avg(units), 6) AS mean_units FROM (
      SELECT upc, store, avg(CASE WHEN z THEN 1.0::DOUBLE ELSE 0 END) AS share, avg(CASE WHEN NOT z THEN price END) AS price, avg(move) AS units FROM zp GROUP BY upc, store) GROUP BY 1""", _RUNS),
    "log_generations": _with("""SELECT upc, store, week, decision, CASE upc % 3 WHEN 1 THEN n_candidates WHEN 2 THEN round(n_candidates / 2.0::DOUBLE, 6) END AS n_candidates,
      CASE WHEN upc % 3 = 2 THEN round(recommended_price, 6) END AS recommended_price, CASE WHEN upc % 3 > 0 AND store % 2 = 0 THEN 'REVIEWED' ELSE 'GENERATED' END AS state FROM rec2""", *_recommended()),
}
