"""DuckDB SQL that gives the same rows as :mod:`panelforge.plans.evidence`."""

from panelforge.functions.features import NAMES
from panelforge.functions.formula_space import BY_ARITY
from panelforge.plans.research_sql import _SCHEDULE, FINDS
from panelforge.plans.sql import BARS, DAYS, FEATURES, ORACLES as ENGINE, SCORED, ST, rank_of

_LIST = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
_PAIRS = " UNION ALL ".join(f"SELECT trade_date, ts_code, '{x}' AS a, '{y}' AS b, round({x}, 8) AS x, round({y}, 8) AS y FROM feat WHERE {x} IS NOT NULL AND {y} IS NOT NULL" for i, x in enumerate(NAMES) for y in NAMES[i + 1 :])
_CLUSTERS = f"""WITH RECURSIVE {FEATURES}, p0 AS ({_PAIRS}), o AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY trade_date, ts_code) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY a, b) // 20000) AS step FROM p0), p AS (SELECT * FROM o WHERE i % step = 0 AND i // step < 20000),
r AS (SELECT a, b, {rank_of('x', 'a', 'b')} AS rx, {rank_of('y', 'a', 'b')} AS ry FROM p), pc AS MATERIALIZED (SELECT a, b, round(corr(rx, ry), 6) AS correlation FROM r GROUP BY a, b),
near AS MATERIALIZED (SELECT a AS x, b AS y, correlation AS c FROM pc WHERE abs(correlation) >= 0.6 UNION ALL SELECT b, a, correlation FROM pc WHERE abs(correlation) >= 0.6),
hits AS MATERIALIZED (SELECT n AS name, list(y) AS ys FROM (SELECT unnest({_LIST}) AS n) LEFT JOIN near ON x = n GROUP BY n),
g AS (SELECT 0 AS i, CAST([] AS VARCHAR[]) AS kept, CAST(NULL AS VARCHAR) AS representative, CAST(NULL AS VARCHAR) AS member
  UNION ALL SELECT i + 1, CASE WHEN r IS NULL THEN list_append(kept, name) ELSE kept END, coalesce(r, name), name FROM (SELECT i, kept, name, list_filter(kept, lambda k: list_contains(ys, k))[1] AS r FROM g JOIN hits ON name = {_LIST}[i + 1] WHERE i < {len(NAMES)}))
SELECT representative, member, CASE WHEN representative = member THEN 1.0 ELSE c END AS correlation FROM g LEFT JOIN near ON x = member AND y = representative WHERE i > 0"""

_HARD = {
    "low_vol": "-RET_STD20", "reversal": "-RET5", "momentum": "RET20", "busy": "CASE WHEN c = 20 AND sd > 1e-15 THEN (VOL_RATIO20 - mu) / sd END",
    "empty": "CAST(NULL AS DOUBLE)", "level": "RET1 - RET1", "weak": "CAST(sign(RET120) AS DOUBLE)", "wild": "CASE WHEN RET5 <= 0.05 AND RET5 >= -0.05 THEN RET5 END"}
_HEAD, _TAIL = SCORED.split("wide AS (")[0], SCORED[SCORED.index("ok AS ("):]
_HARD_SCORED = (
    _HEAD + "wide AS (SELECT trade_date, ts_code, round(fr, 8) AS forward_return, " + ", ".join(f"round({x}, 8) AS {n}" for n, x in _HARD.items()) + " FROM z),\nscored AS ("
    + " UNION ALL ".join(f"SELECT trade_date, ts_code, forward_return, '{n}' AS formula, {n} AS factor_value FROM wide" for n in _HARD) + "),\n" + _TAIL)
_VERDICTS = (
    ENGINE["fast_screen_summary"].replace(SCORED, _HARD_SCORED).replace("coverage < 0.1", "coverage < 0.3").replace("disp < 0 ", "disp < 0.0005 ").replace("WHEN m IS NULL THEN", "WHEN m IS NULL OR abs(m) < 0.01 THEN"))

_F, _U, _B = ("[" + ", ".join(f"'{t}'" for t in some) + "]" for some in BY_ARITY)
_NF, _NU = len(BY_ARITY[0]), len(BY_ARITY[1])
_TWO = _NU * _NF
_DRAWS = f"""WITH a AS (SELECT p_partkey, (p_partkey * 7919 + p_size * 104729) % {_NF + _TWO + _NU * _TWO + len(BY_ARITY[2]) * _NF * _NF} AS number FROM part),
b AS (SELECT *, number - {_NF} AS two, number - {_NF + _TWO} AS three, number - {_NF + _TWO + _NU * _TWO} AS pair FROM a),
c AS (SELECT *, {_B}[pair // {_NF * _NF} + 1] AS op, {_F}[pair // {_NF} % {_NF} + 1] AS x, {_F}[pair % {_NF} + 1] AS y FROM b),
d AS (SELECT p_partkey, pair >= 0 AND op = 'SUB' AND x = y AS trivial, CASE WHEN two < 0 THEN {_F}[number + 1] WHEN three < 0 THEN {_U}[two // {_NF} + 1] || '(' || {_F}[two % {_NF} + 1] || ')'
  WHEN pair < 0 THEN {_U}[three // {_TWO} + 1] || '(' || {_U}[three % {_TWO} // {_NF} + 1] || '(' || {_F}[three % {_NF} + 1] || '))'
  ELSE op || '(' || CASE WHEN op IN ('ADD', 'MUL') AND x > y THEN y || ',' || x ELSE x || ',' || y END || ')' END AS t FROM c)
SELECT sha256(t) AS formula_hash, t AS formula_text, min(p_partkey) AS first_attempt, count(*) AS attempts FROM d WHERE NOT trivial GROUP BY t"""

_AT = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
_Q = ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 6) AS q{i}" for i, p in enumerate(_AT))
_DAY = "strptime({}, '%Y%m%d')"
_TIMELINE = f"""WITH {BARS}, {ST}, p AS (SELECT ts_code, CAST({_DAY.format('start_date')} AS DATE) AS s, CAST({_DAY.format('end_date')} AS DATE) AS e, v FROM st),
c AS (SELECT DISTINCT ts_code, a FROM (SELECT ts_code, s AS a FROM p UNION ALL SELECT ts_code, e + 1 FROM p)),
t AS (SELECT ts_code, a, lead(a) OVER (PARTITION BY ts_code ORDER BY a) - 1 AS until FROM c),
h AS (SELECT t.ts_code, a, until, arg_max(v, (s, e, v)) AS v FROM t JOIN p ON p.ts_code = t.ts_code AND p.s <= t.until AND p.e >= t.a GROUP BY ALL),
n AS (SELECT *, CASE WHEN a = lag(until) OVER w + 1 AND v = lag(v) OVER w THEN 0 ELSE 1 END AS new FROM h WINDOW w AS (PARTITION BY ts_code ORDER BY a)),
r AS (SELECT *, sum(new) OVER (PARTITION BY ts_code ORDER BY a) AS run FROM n)
SELECT ts_code, strftime(min(a), '%Y%m%d') AS start_date, strftime(max(until), '%Y%m%d') AS end_date, CAST(min(v) AS INT) AS historical_is_st FROM r GROUP BY ts_code, run"""


def _hit(a, d):
    return f"(CAST(ts_code AS INT) % {a} = 0 AND CAST(substr(trade_date, 7, 2) AS INT) = {d})"


_BROKEN = f"""bk AS (SELECT CASE WHEN {_hit(9, 7)} THEN substr(trade_date, 1, 6) || '99' ELSE trade_date END AS trade_date, ts_code, CASE WHEN {_hit(3, 1)} THEN -raw_close WHEN {_hit(5, 2)} THEN NULL ELSE raw_close END AS raw_close,
  CASE WHEN {_hit(4, 3)} THEN raw_low - 1 ELSE raw_high END AS raw_high, raw_low, CASE WHEN {_hit(7, 4)} THEN raw_high + 5 ELSE raw_open END AS raw_open, CASE WHEN {_hit(2, 5)} THEN 0 ELSE volume END AS volume, {_hit(6, 6)} AS infinite, pre_close FROM bars)"""
_RULES = (
    ("close_missing", "prices", "raw_close IS NULL"), ("close_not_positive", "prices", "raw_close <= 0"), ("high_below_low", "prices", "raw_high < raw_low"), ("open_out_of_range", "prices", "raw_open > raw_high OR raw_open < raw_low"),
    ("first_bar", "prices", "pre_close IS NULL"), ("move_over_limit", "limits", "abs(raw_open - pre_close) > 0.1005 * pre_close"), ("no_volume", "volumes", "volume <= 0"), ("amount_not_finite", "volumes", "infinite"),
    ("no_date", "keys", "try_strptime(trade_date, '%Y%m%d') IS NULL"), ("code_not_six_digits", "keys", "NOT regexp_full_match(ts_code, '[0-9]{6}')"))
_PLACE = "ts_code || ':' || trade_date"

_SEEDS = """sd AS (SELECT 'part_' || CAST(p_partkey AS VARCHAR) AS record, CASE WHEN p_size % 11 = 0 THEN 'requires_new_data' WHEN p_size % 13 = 0 THEN 'partial_source_candidate' END AS kind, CASE WHEN p_partkey % 17 <> 0 THEN p_brand END AS title,
  CASE WHEN p_partkey % 34 = 0 THEN '' WHEN p_partkey % 5 <> 0 THEN p_name END AS url, p_partkey % 19 <> 0 AND p_size % 7 <> 0 AS verified, p_size = 50 AS operator, p_partkey % 23 = 0 AS data, floor(p_retailprice) % 5 <> 0 AS suggested FROM part)"""
_SEED_RULES = (
    ("seed_factor_requires_new_data", "kind = 'requires_new_data'"), ("seed_factor_source_not_verified", "NOT verified"), ("seed_factor_not_suggested_for_second_batch", "NOT suggested"), ("seed_factor_requires_new_external_data", "data"),
    ("seed_factor_unverified_computability", "kind = 'partial_source_candidate'"), ("seed_factor_no_source", "coalesce(title, '') = '' AND coalesce(url, '') = ''"), ("seed_factor_requires_external_data", "data"), ("seed_factor_requires_new_operator", "operator"))
_SEGMENT = "CASE WHEN trade_date BETWEEN '19920101' AND '19941231' THEN 'train' WHEN trade_date BETWEEN '19950101' AND '19971231' THEN 'validation' WHEN trade_date BETWEEN '19980101' AND '20051231' THEN 'blind' END"

ORACLES = {
    "asof_events": """WITH b AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'), s AS (SELECT user_id, event_id AS seen_id, ts AS seen_ts, event_type AS seen_type FROM events WHERE event_type IN ('view', 'click')),
j AS (SELECT b.*, s.seen_id, s.seen_ts, s.seen_type, b.ts - s.seen_ts <= INTERVAL 6 HOUR AS near FROM b ASOF LEFT JOIN s ON b.user_id = s.user_id AND b.ts >= s.seen_ts)
SELECT user_id, event_id, ts, CASE WHEN near THEN seen_id END AS seen_id, CASE WHEN near THEN seen_ts END AS seen_ts, CASE WHEN near THEN seen_type END AS seen_type FROM j""",
    "scan_basic": f"WITH {BARS}, d AS (SELECT strftime(l_shipdate, '%Y%m%d') AS trade_date, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS ts_code, sum(l_quantity) / 1000 AS turnover_rate FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2 HAVING max(l_quantity) >= 10) SELECT trade_date, ts_code, raw_close, volume, turnover_rate FROM bars LEFT JOIN d USING (trade_date, ts_code) WHERE trade_date BETWEEN '19950101' AND '19951231'",
    "seed_gate": f"WITH {_SEEDS} " + " UNION ALL ".join(f"SELECT '{n}' AS rule, record FROM sd WHERE {c}" for n, c in _SEED_RULES),
    "run_equivalence": """SELECT 'account' AS section, count(*) = 0 AS equal, 2 * count(*) AS difference_count FROM customer WHERE c_custkey % 100 = 0 UNION ALL SELECT 'noise', true, 0 UNION ALL SELECT 'orders', count(*) = 0, count(*) FROM orders WHERE o_custkey % 10 = 3
UNION ALL SELECT 'names', false, 1 UNION ALL SELECT 'regions', false, count(*) FROM nation""",
    "frozen_validation": f"""WITH {SCORED}, w AS (SELECT formula, round(avg(ic) FILTER (g = 'train'), 6) AS train, round(avg(ic) FILTER (g = 'validation'), 6) AS validation, round(avg(ic) FILTER (g = 'blind'), 6) AS blind FROM (SELECT *, {_SEGMENT} AS g FROM days) GROUP BY formula),
p AS (SELECT *, CAST(row_number() OVER (ORDER BY abs(coalesce(train, 0)) DESC, formula) AS INT) AS place, CAST(row_number() OVER (ORDER BY abs(coalesce(blind, 0)) DESC, formula) AS INT) AS place_after FROM w)
SELECT *, round(abs(coalesce(train, 0)) - abs(coalesce(blind, 0)), 6) + 0 AS decay, coalesce(sign(train) = sign(blind), false) AS sign_held, round(1 - 6 * sum((place - place_after) ** 2) OVER () / (count(*) OVER () * (count(*) OVER () * count(*) OVER () - 1)), 6) AS rank_agreement FROM p""",
    "rewards_described": f"WITH {FINDS} SELECT count(*) AS count, count(train_reward) AS finite_count, round(avg(train_reward), 6) AS mean, round(stddev_pop(train_reward), 6) AS std, min(train_reward) AS min, max(train_reward) AS max, count(*) FILTER (train_reward > 0) AS positive, count(*) FILTER (train_reward < 0) AS negative, count(*) FILTER (train_reward = 0) AS zero, "
    "round(quantile_cont(train_reward, 0.1), 6) AS p10, round(quantile_cont(train_reward, 0.5), 6) AS p50, round(quantile_cont(train_reward, 0.9), 6) AS p90 FROM finds",
    "feature_clusters": _CLUSTERS,
    "screen_verdicts": _VERDICTS,
    "finite_validity": f"WITH {FEATURES}, a AS (SELECT round(RET5, 8) AS x FROM feat), w AS (SELECT x > 0.05 OR x < -0.05 AS odd, CASE WHEN x <= 0.05 AND x >= -0.05 THEN x END AS x FROM a) SELECT count(*) AS total_rows, count(x) AS valid_rows, count(*) FILTER (odd) AS inf_rows, count(DISTINCT x) AS unique_values, round(stddev_pop(x), 6) AS std, 'inf_values' AS failure_reason FROM w",
    "factor_store_screen": f"SELECT *, formula <> 'busy' AS from_store FROM ({ENGINE['fast_screen_summary']})",
    "registry_versions": "SELECT c_custkey, c_acctbal, c_mktsegment, 1 AS version FROM customer UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN round(c_acctbal + 100, 2) ELSE c_acctbal END, c_mktsegment, 3 FROM customer WHERE NOT (c_mktsegment = 'BUILDING' AND c_custkey % 5 = 0)",
    "run_outputs": "SELECT 'orders' AS name, 1 AS version, count(*) AS n FROM orders UNION ALL SELECT 'orders', 2, count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'lines', 1, count(*) FROM lineitem UNION ALL SELECT 'lines', 2, count(*) FROM lineitem SEMI JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON l_orderkey = o_orderkey",
    "formula_draws": _DRAWS,
    "exact_quantiles": f"SELECT 'all' AS l_returnflag, count(l_extendedprice) AS n, {_Q} FROM lineitem UNION ALL SELECT l_returnflag, count(l_extendedprice), {_Q} FROM lineitem GROUP BY l_returnflag",
    "interval_pairs": f"""WITH {BARS}, {ST}, q AS (SELECT ts_code, substr(trade_date, 1, 4) || CAST((CAST(substr(trade_date, 5, 2) AS INT) - 1) // 3 AS VARCHAR) AS quarter, min(trade_date) AS first_date, max(trade_date) AS last_date FROM bars GROUP BY 1, 2)
SELECT q.ts_code, quarter, first_date, last_date, start_date, end_date, CAST(v AS INT) AS historical_is_st FROM q JOIN st ON st.ts_code = q.ts_code AND first_date <= end_date AND start_date <= last_date""",
    "st_timeline": _TIMELINE,
    "unmatched_rows": """WITH l AS (SELECT c_nationkey, c_mktsegment, round(c_acctbal, 4) AS x, count(*) AS n FROM customer GROUP BY ALL), r AS (SELECT c_nationkey, c_mktsegment, round(c_acctbal + CASE WHEN c_custkey % 29 = 0 THEN 0.004 ELSE 0 END, 4) AS x, count(*) AS n FROM customer WHERE c_custkey % 41 <> 0 GROUP BY ALL),
j AS (SELECT coalesce(l.c_nationkey, r.c_nationkey) AS c_nationkey, coalesce(l.c_mktsegment, r.c_mktsegment) AS c_mktsegment, coalesce(l.x, r.x) AS c_acctbal, coalesce(l.n, 0) - coalesce(r.n, 0) AS d FROM l FULL JOIN r ON l.c_nationkey = r.c_nationkey AND l.c_mktsegment = r.c_mktsegment AND l.x = r.x)
SELECT c_nationkey, c_mktsegment, c_acctbal, greatest(d, 0) AS left, greatest(-d, 0) AS right FROM j WHERE d <> 0""".replace("AS left", 'AS "left"').replace("AS right", 'AS "right"'),
    "panel_rules": f"WITH {BARS}, {_BROKEN} " + " UNION ALL ".join(f"SELECT '{n}' AS rule, '{g}' AS rule_group, count(*) FILTER ({v}) AS violations, min({_PLACE}) FILTER ({v}) AS first, max({_PLACE}) FILTER ({v}) AS last FROM bk" for n, g, v in _RULES),
    "broken_schedule": f"""WITH {BARS}, {DAYS}, {_SCHEDULE}, b AS (SELECT signal_date, CASE WHEN CAST(substr(signal_date, 7, 2) AS INT) % 9 = 0 THEN signal_date ELSE entry_date END AS entry_date, CASE WHEN CAST(substr(signal_date, 7, 2) AS INT) % 11 = 0 THEN entry_date ELSE exit_date END AS exit_date FROM wk)
SELECT * FROM b WHERE NOT (signal_date < entry_date AND entry_date < exit_date) ORDER BY ALL LIMIT 3""",
}
