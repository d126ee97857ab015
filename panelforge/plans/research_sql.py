"""DuckDB SQL that gives the same rows as :mod:`panelforge.plans.research`."""

from panelforge.functions.features import NAMES
from panelforge.plans.sql import BARS, DAYS, FEATURES, LIMITED, ORACLES as ENGINE, SCORED, ST
from panelforge.sources.candidates import SHAPES

_LIST = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
_SHAPES = "[" + ", ".join(f"'{s}'" for s in SHAPES) + "]"
FINDS = f"""f0 AS (SELECT *, p_partkey // 3 AS number, CAST(round(p_retailprice * 100) AS BIGINT) + 7 * p_partkey * p_size AS c FROM part),
finds AS (SELECT sha256('F' || CAST(number AS VARCHAR)) AS formula_hash, replace({_SHAPES}[number % {len(SHAPES)} + 1], '{{}}', {_LIST}[number % {len(NAMES)} + 1]) AS formula_text, CASE WHEN p_size % 2 = 0 THEN 'policy' ELSE 'uniform' END AS generator,
  CAST(p_partkey % 5 AS INT) AS seed, p_partkey AS discovery_order, CASE WHEN c % 13 <> 0 THEN ((c // 3) % 4001 - 2000) / 1000.0 END AS train_reward, c FROM f0)"""


def _part(by, size, low):
    return f"((c // {by}) % {size} + {low}) / 1000.0"


CAND = f"""{FINDS}, m0 AS (SELECT formula_hash, min(formula_text) AS formula_text, CAST(sum(c) AS BIGINT) AS c, max(train_reward) AS train_sortino FROM finds GROUP BY 1),
cand AS (SELECT formula_hash, formula_text, train_sortino, {_part(2, 121, -60)} AS rank_ic_mean, {_part(5, 1001, 0)} AS coverage, CASE WHEN {_part(5, 1001, 0)} < 0.3 THEN 'rejected' ELSE 'passed' END AS fast_screen_status, {_part(7, 1001, -300)} AS total_return, {_part(11, 600, -600)} AS max_drawdown,
  CASE WHEN c % 13 <> 0 THEN {_part(3, 4001, -2000)} END AS sortino, c % 40 AS trade_count, CASE WHEN c % 17 = 0 THEN 'insufficient_data' ELSE 'ok' END AS status, CASE WHEN c % 17 = 0 THEN 'failed' ELSE 'passed' END AS full_backtest_status, c % 9 * 30 AS daily_count, c % 5 AS negative_count,
  CASE WHEN c % 23 <> 0 THEN {_part(19, 4001, -2000)} END AS validation_sortino, CASE WHEN c % 29 = 0 THEN 'failed' ELSE 'completed' END AS validation_status, c % 31 = 0 AS no1, c % 37 = 0 AS no2, c % 41 = 0 AS no3, c % 43 = 0 AS no4,
  {_part(10, 801, -300)} AS stability_total_return, {_part(12, 121, -60)} AS stability_rank_ic_mean FROM m0),
graded AS (SELECT *, CASE WHEN total_return > 0 THEN 1.0 ELSE 0.0 END AS positive_period_ratio, CASE WHEN full_backtest_status = 'passed' AND total_return > 0 THEN 'passed' ELSE 'rejected' END AS robustness_status,
  CASE WHEN full_backtest_status <> 'passed' OR total_return <= 0 THEN 'Rejected' WHEN abs(rank_ic_mean) >= 0.03 AND abs(max_drawdown) <= 0.35 THEN 'A' WHEN abs(rank_ic_mean) >= 0.015 THEN 'B' ELSE 'C' END AS grade FROM cand)"""
_VERDICT = "CASE WHEN status = 'insufficient_data' THEN 'insufficient_data' WHEN trade_count < 5 THEN 'insufficient_trade_count' WHEN sortino IS NULL THEN 'sortino_unavailable' END"
_ORDER = "abs(rank_ic_mean) DESC, coverage DESC, length(formula_text), formula_hash"
_BEST = "train_reward DESC NULLS LAST, formula_hash"
_STATUS = f"""{CAND}, ch AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS place FROM cand WHERE fast_screen_status = 'passed' QUALIFY row_number() OVER (ORDER BY {_ORDER}) <= 400),
cl AS (SELECT *, row_number() OVER (PARTITION BY rank_ic_mean ORDER BY place) AS nth FROM ch), kp AS (SELECT formula_hash, row_number() OVER (ORDER BY place) AS p FROM cl WHERE nth = 1),
st0 AS (SELECT cand.formula_hash, cand.fast_screen_status, CASE WHEN cl.formula_hash IS NULL THEN 'excluded_by_correlation_budget' WHEN nth > 1 THEN 'deduplicated_by_correlation' WHEN p <= 50 THEN 'selected_for_full_backtest' ELSE 'excluded_by_full_backtest_budget' END AS last, cl.formula_hash IS NOT NULL AS c FROM cand LEFT JOIN cl USING (formula_hash) LEFT JOIN kp USING (formula_hash)),
state AS (SELECT formula_hash, CASE WHEN fast_screen_status = 'passed' THEN last ELSE fast_screen_status END AS pipeline_status, CASE WHEN fast_screen_status <> 'passed' THEN '' WHEN c THEN 'selected_for_correlation>' || last ELSE last END AS status_history,
  fast_screen_status = 'passed' AND last IN ('excluded_by_correlation_budget', 'excluded_by_full_backtest_budget') AS budget_excluded, fast_screen_status <> 'passed' AS rejected FROM st0)"""
_VIEWS = "vw AS (SELECT formula_hash, CASE WHEN count(DISTINCT generator) > 1 THEN 'overlap' ELSE min(generator) || '_only' END AS view FROM finds GROUP BY 1)"
_SCHEDULE = ENGINE["weekly_schedule"].split("SELECT * FROM s")[0].replace(f"WITH {BARS}, {DAYS}, ", "").rstrip() + ", wk AS (SELECT * FROM s WHERE exit_date IS NOT NULL)"
_ZERO = "round({}, 8) + 0"
_COMPOSITE = f"""{FEATURES}, {DAYS}, {_SCHEDULE}, c0 AS (SELECT trade_date, ts_code, entry_date, exit_date, round(-RET_STD20, 8) AS f0, round(-RET5, 8) AS f1, round(RET60, 8) AS f2, round(TREND20, 8) AS f3, round(VOL_RATIO20, 8) AS f4 FROM feat JOIN wk ON trade_date = signal_date),
c1 AS (SELECT * FROM c0 WHERE f0 IS NOT NULL AND f1 IS NOT NULL AND f2 IS NOT NULL AND f3 IS NOT NULL AND f4 IS NOT NULL),
c2 AS (SELECT *, round((""" + " + ".join(f"cume_dist() OVER (PARTITION BY trade_date ORDER BY f{i})" for i in range(5)) + """) / 5, 10) AS score FROM c1),
tg AS (SELECT trade_date || ':' || ts_code AS window_id, trade_date AS signal_date, entry_date, exit_date, ts_code, CAST(0.2 AS DOUBLE) AS weight, CAST(row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, ts_code) AS INT) AS rank, round(score, 6) AS score FROM c2 QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, ts_code) <= 5)"""
_TRADES = """tr AS (SELECT l_orderkey AS window_id, l_linenumber * 1000000 + l_partkey AS seq, l_linenumber % 2 = 1 AS entry, l_returnflag <> 'R' AS filled, strftime(l_shipdate, '%Y%m%d') AS d, CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS DOUBLE) AS notional, CAST(CAST(round(l_tax * 100) AS BIGINT) AS DOUBLE) AS cost FROM lineitem),
tw AS (SELECT window_id, arg_min({'d': d, 'n': notional, 'c': cost}, seq) FILTER (entry AND filled) AS e, arg_max({'d': d, 'n': notional, 'c': cost}, seq) FILTER (NOT entry AND filled) AS x, count(*) FILTER (entry AND NOT filled) AS ue, count(*) FILTER (NOT entry AND NOT filled) AS ux,
  arg_min(d, seq) FILTER (entry AND NOT filled) AS we, arg_min(d, seq) FILTER (NOT entry AND NOT filled) AS wx FROM tr GROUP BY 1),
ws AS (SELECT o_orderkey AS window_id, CASE WHEN e IS NOT NULL AND x IS NOT NULL THEN 'completed' WHEN e IS NOT NULL THEN 'entry_filled_exit_incomplete' WHEN ue > 0 THEN 'entry_unfilled' ELSE 'missing_execution_status' END AS status,
  CASE WHEN e IS NOT NULL AND x IS NOT NULL THEN NULL WHEN e IS NOT NULL THEN coalesce(wx, 'missing_exit_execution') WHEN ue > 0 THEN we END AS failure_reason, coalesce(ux > 0 AND x IS NOT NULL, false) AS delayed_exit,
  CASE WHEN e IS NOT NULL AND x IS NOT NULL AND e.n + e.c <> 0 THEN round((x.n - x.c - (e.n + e.c)) / (e.n + e.c), 8) + 0 END AS net_return, CASE WHEN e IS NOT NULL AND x IS NOT NULL THEN e.d END AS actual_entry_date, CASE WHEN e IS NOT NULL AND x IS NOT NULL THEN x.d END AS actual_exit_date
  FROM orders LEFT JOIN tw ON o_orderkey = window_id)"""
_SNIPPET = "CASE WHEN length({0}) <= {1} THEN {0} ELSE regexp_replace(substr({0}, 1, {1}), ' [^ ]*$', '') || '...' END"

ORACLES = {
    "reward_verdict": f"WITH {CAND}, v AS (SELECT *, {_VERDICT} AS why FROM cand) SELECT formula_hash, CASE WHEN why IS NULL THEN sortino ELSE -1.0 END AS reward, CASE WHEN why IS NULL THEN 'valid' ELSE 'failed' END AS validity_status, why AS failure_reason FROM v",
    "sortino_diagnosis": f"WITH {CAND} SELECT formula_hash, CASE WHEN sortino IS NULL THEN 'unavailable' ELSE 'available' END AS sortino_status, CASE WHEN sortino IS NOT NULL THEN NULL WHEN daily_count = 0 THEN 'returns_sequence_empty' WHEN negative_count = 0 THEN 'no_negative_return_observation' WHEN trade_count = 0 THEN 'trade_count_zero' ELSE status END AS sortino_reason FROM cand",
    "robust_grade": f"WITH {CAND} SELECT formula_hash, CAST(positive_period_ratio AS DOUBLE) AS positive_period_ratio, robustness_status, grade FROM graded",
    "segment_grade": f"""WITH {CAND}, a AS (SELECT *, list_filter([CASE WHEN no1 THEN 'selection_trade_win_rate_missing' END, CASE WHEN no2 THEN 'selection_profit_loss_ratio_missing' END, CASE WHEN no3 THEN 'stability_trade_win_rate_missing' END, CASE WHEN no4 THEN 'stability_profit_loss_ratio_missing' END], lambda x: x IS NOT NULL) AS ab,
  no1 OR no2 OR no3 OR no4 AS gap FROM graded), b AS (SELECT *, CASE WHEN fast_screen_status <> 'passed' THEN 'fast_screen_not_passed' WHEN gap THEN NULL WHEN robustness_status <> 'passed' THEN 'robustness_not_passed' WHEN stability_total_return <= 0 THEN 'stability_total_return_non_positive' END AS why FROM a)
SELECT formula_hash, CASE WHEN fast_screen_status <> 'passed' THEN CASE WHEN NOT gap AND robustness_status = 'passed' THEN 'C' ELSE 'Rejected' END WHEN gap OR robustness_status <> 'passed' THEN 'Rejected' WHEN stability_total_return <= 0 THEN 'C' WHEN abs(rank_ic_mean) >= 0.015 AND abs(stability_rank_ic_mean) >= 0.015 THEN 'B' ELSE 'C' END AS final_grade,
  coalesce(array_to_string(list_filter(list_append(ab, why), lambda x: x IS NOT NULL), ';'), '') AS reasons, coalesce(array_to_string(list_transform(ab, lambda x: regexp_replace(regexp_replace(x, '^(selection|stability)_', ''), '_missing$', '')), ';'), '') AS missing FROM b""",
    "candidate_order": f"WITH {CAND} SELECT CAST(row_number() OVER (ORDER BY {_ORDER}) AS INT) AS place, formula_hash, rank_ic_mean, coverage, formula_text FROM cand QUALIFY place <= 500",
    "pipeline_status": f"WITH {_STATUS} SELECT * FROM state",
    "run_diagnostics": f"WITH {_STATUS}, v AS (SELECT formula_hash, {_VERDICT} AS why FROM cand) SELECT pipeline_status, grade, coalesce(why, 'none') AS reason, count(*) AS n FROM state JOIN graded USING (formula_hash) JOIN v USING (formula_hash) GROUP BY ALL",
    "bounded_pool": f"WITH {FINDS}, a AS (SELECT formula_hash, train_reward, discovery_order FROM finds QUALIFY row_number() OVER (PARTITION BY formula_hash ORDER BY discovery_order) = 1) SELECT CAST(row_number() OVER (ORDER BY {_BEST}) AS INT) AS place, * FROM a QUALIFY place <= 200",
    "shortlist": f"WITH {CAND} SELECT CAST(row_number() OVER (ORDER BY validation_sortino DESC, train_sortino DESC NULLS LAST, formula_hash) AS INT) AS place, formula_hash, validation_sortino, train_sortino FROM cand WHERE validation_status = 'completed' AND validation_sortino > 0 QUALIFY place <= 30",
    "decay_signs": f"WITH {CAND} SELECT formula_hash, round(train_sortino - validation_sortino, 6) + 0 AS train_validation_decay, coalesce(train_sortino > 0 AND validation_sortino > 0, false) AS positive_sign_preserved FROM cand",
    "view_statistics": f"""WITH {CAND}, {_VIEWS}, a AS (SELECT *, validation_sortino AS v, train_sortino AS t, validation_sortino IS NOT NULL AND train_sortino IS NOT NULL AS b FROM cand JOIN vw USING (formula_hash)),
r AS (SELECT *, row_number() OVER (PARTITION BY view ORDER BY v DESC NULLS LAST, formula_hash) AS vn, count(v) OVER (PARTITION BY view) AS n, row_number() OVER (PARTITION BY view, b ORDER BY t DESC, formula_hash DESC) AS tr, row_number() OVER (PARTITION BY view, b ORDER BY v DESC, formula_hash DESC) AS vr,
  greatest(1, ceil(count(*) FILTER (b) OVER (PARTITION BY view) * 0.2)) AS k FROM a)
SELECT view, count(*) AS candidate_count, count(*) FILTER (validation_status = 'completed') AS completed_count, round(median(v), 6) AS validation_median, round(avg(v), 6) AS validation_mean, round(avg(v) FILTER (vn <= greatest(1, n // 10)), 6) AS validation_top_10_mean, round(avg(CAST(v > 0 AS INT)), 6) AS validation_positive_ratio,
  max(v) AS validation_best, min(v) AS validation_worst, round(stddev_pop(v), 6) AS validation_std, round(avg(t - v), 6) AS decay, round(count(*) FILTER (b AND t > 0 AND v > 0) / nullif(count(*) FILTER (b AND t > 0), 0), 6) AS sign_preservation,
  CASE WHEN count(*) FILTER (b) >= 2 THEN round(count(*) FILTER (b AND tr <= k AND vr <= k) / max(k), 6) END AS rank_retention FROM r GROUP BY view""",
    "formula_views": f"WITH {FINDS}, {_VIEWS} SELECT * FROM vw",
    "keep_best_sets": f"""WITH {FINDS} SELECT formula_hash, arg_max(generator, (coalesce(train_reward, -1e99), -discovery_order)) AS generator, arg_max(seed, (coalesce(train_reward, -1e99), -discovery_order)) AS best_source_seed, max(train_reward) AS train_reward,
  array_to_string(list_sort(list(DISTINCT seed)), ',') AS source_seeds, array_to_string(list_sort(list(DISTINCT generator)), ',') AS source_generators, string_agg(CAST(discovery_order AS VARCHAR), ',' ORDER BY seed, discovery_order) AS orders FROM finds GROUP BY 1""",
    "searchers_compared": f"""WITH {FINDS}, a AS (SELECT seed, max(train_reward) FILTER (generator = 'policy') AS policy, max(train_reward) FILTER (generator = 'uniform') AS uniform FROM finds GROUP BY 1),
w AS (SELECT *, CASE WHEN coalesce(policy, -1e99) > coalesce(uniform, -1e99) THEN 'policy' WHEN coalesce(uniform, -1e99) > coalesce(policy, -1e99) THEN 'uniform' ELSE 'tie' END AS winner FROM a)
SELECT *, CASE WHEN count(*) FILTER (winner = 'policy') OVER () > count(*) FILTER (winner = 'uniform') OVER () THEN 'policy' WHEN count(*) FILTER (winner = 'uniform') OVER () > count(*) FILTER (winner = 'policy') OVER () THEN 'uniform' ELSE 'inconclusive' END AS majority FROM w""",
    "search_summary": f"""WITH {FINDS}, r AS (SELECT *, row_number() OVER (PARTITION BY generator, seed ORDER BY train_reward DESC NULLS LAST, discovery_order) AS p, count(train_reward) OVER (PARTITION BY generator, seed) AS n FROM finds)
SELECT generator, seed, count(*) AS attempts, count(DISTINCT formula_hash) AS unique_formulas, count(train_reward) AS valid, max(train_reward) AS best, round(median(train_reward), 6) AS median, round(avg(train_reward) FILTER (p <= greatest(1, n // 10)), 6) AS top_10_mean,
  min(discovery_order) FILTER (train_reward > 0) AS first_positive, min(discovery_order) FILTER (p = 1) AS best_at FROM r GROUP BY 1, 2""",
    "freeze_candidates": f"WITH {FINDS}, a AS (SELECT generator, formula_hash, max(train_reward) AS train_reward FROM finds GROUP BY 1, 2 HAVING max(train_reward) IS NOT NULL), c AS (SELECT *, CAST(row_number() OVER (PARTITION BY generator ORDER BY {_BEST}) AS INT) AS place FROM a QUALIFY place <= 20) SELECT *, count(*) OVER (PARTITION BY formula_hash) > 1 AS overlap FROM c",
    "merge_first_wins": f"WITH {FINDS} SELECT formula_hash, generator, seed, discovery_order FROM finds QUALIFY row_number() OVER (PARTITION BY formula_hash ORDER BY generator, discovery_order) = 1",
    "labelled_formulas": f"WITH {FINDS} SELECT discovery_order, formula_text, replace(replace(replace(replace(formula_text, 'RET1', '[r1]'), 'RET120', '[r120]'), 'NEG', 'minus'), 'VOL_RATIO20', '[volume]') AS label FROM finds",
    "scan_window": f"WITH {BARS}, {LIMITED} SELECT trade_date, ts_code, raw_open, raw_close, pre_close, limit_up, limit_down, limit_status FROM limited WHERE trade_date BETWEEN '19950101' AND '19961231'",
    "symbols_lookup": f"WITH {BARS}, names AS ({{watch}}) SELECT trade_date, ts_code, raw_close FROM bars WHERE ts_code IN (SELECT ts_code FROM names)",
    "interval_semi": f"WITH {BARS}, {ST} SELECT trade_date, ts_code FROM bars b WHERE EXISTS (SELECT 1 FROM st WHERE st.ts_code = b.ts_code AND b.trade_date BETWEEN start_date AND end_date)",
    "interval_overlap": f"WITH {BARS}, {ST} SELECT ts_code, start_date, end_date, CAST(v AS INT) AS historical_is_st FROM st WHERE start_date <= '19951231' AND end_date >= '19950701'",
    "next_weekly_signal": f"WITH {BARS}, {DAYS}, k AS (SELECT trade_date, year(strptime(trade_date, '%Y%m%d')) * 100 + weekofyear(strptime(trade_date, '%Y%m%d')) AS k FROM cal), l AS (SELECT k, max(trade_date) AS signal_date FROM k GROUP BY 1), m AS (SELECT trade_date AS activation_date, min(k) OVER (ORDER BY trade_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS k FROM k) SELECT activation_date, signal_date FROM m JOIN l USING (k)",
    "warm_up_days": f"WITH {BARS}, {DAYS} SELECT trade_date, coalesce(lag(trade_date, 120) OVER (ORDER BY trade_date), min(trade_date) OVER ()) AS start_date FROM cal",
    "warm_up_context": f"WITH {BARS}, {DAYS}, w AS (SELECT coalesce(min(trade_date), '19950101') AS warm FROM (SELECT trade_date FROM cal WHERE trade_date < '19950101' ORDER BY trade_date DESC LIMIT 120)) SELECT trade_date, count(*) AS n, trade_date >= '19950101' AS inside FROM bars, w WHERE trade_date >= warm AND trade_date <= '19951231' GROUP BY trade_date",
    "range_return": f"WITH {BARS} SELECT ts_code, CASE WHEN count(*) >= 2 THEN round(arg_max(close, trade_date) / arg_min(close, trade_date) - 1, 8) + 0 END AS range_return, min(trade_date) AS first_date, max(trade_date) AS last_date FROM bars GROUP BY 1",
    "quintile_spread": f"WITH {SCORED}, n AS (SELECT *, ntile(5) OVER (PARTITION BY formula, trade_date ORDER BY factor_value, ts_code) AS k FROM ok), m AS (SELECT formula, k, avg(forward_return) AS m, count(*) AS n FROM n GROUP BY 1, 2) SELECT formula, CAST(sum(n) AS BIGINT) AS n, round(max(m) FILTER (k = 5) - max(m) FILTER (k = 1), 8) + 0 AS spread FROM m GROUP BY 1",
    "weekly_targets": f"WITH {_COMPOSITE} SELECT * FROM tg",
    "signal_snapshots": f"""WITH {_COMPOSITE}, sg AS (SELECT signal_date, string_agg(ts_code, ',' ORDER BY rank) AS codes FROM tg GROUP BY 1) SELECT signal_date, codes, sha256('{{"codes":"' || codes || '","signal_date":"' || signal_date || '"}}') AS snapshot_sha256 FROM sg""",
    "schedule_violations": f"WITH {BARS}, {DAYS}, {_SCHEDULE} SELECT * FROM wk WHERE NOT (signal_date < entry_date AND entry_date < exit_date) ORDER BY ALL LIMIT 3",
    "window_status": f"WITH {_TRADES} SELECT * FROM ws",
    "window_status_summary": f"""WITH {_TRADES} SELECT substr(actual_exit_date, 1, 4) AS y, count(*) AS target_window_count, count(*) FILTER (status = 'completed') AS completed_window_count, count(*) FILTER (status = 'entry_unfilled') AS entry_unfilled_count, count(*) FILTER (status = 'entry_filled_exit_incomplete') AS incomplete_exit_count,
  count(*) FILTER (status = 'missing_execution_status') AS missing_status_count, count(*) FILTER (delayed_exit) AS delayed_exit_count, count(*) FILTER (net_return > 0) AS positive_count, count(*) FILTER (net_return < 0) AS negative_count FROM ws GROUP BY 1""",
    "due_events": f"""WITH {BARS}, {DAYS}, {_SCHEDULE}, a AS (SELECT *, row_number() OVER (ORDER BY signal_date) AS i, lag(signal_date) OVER (ORDER BY signal_date) AS before FROM wk),
t AS (SELECT *, CASE WHEN i % 5 = 0 THEN before WHEN i % 5 = 1 THEN entry_date ELSE signal_date END AS today, CASE WHEN i % 7 = 0 THEN NULL WHEN i % 3 = 0 THEN before ELSE signal_date END AS ready FROM a)
SELECT signal_date, CASE WHEN i % 11 = 0 THEN 'signal_already_generated' WHEN today < signal_date THEN 'not_due_yet' WHEN ready IS NULL OR ready < signal_date THEN 'daily_bar_not_ready' WHEN today > signal_date THEN 'missed_signal_cycle' ELSE 'signal_due' END AS reason FROM t""",
    "forward_tick": "SELECT CAST(event_id AS VARCHAR) AS event_id, strftime(ts, '%Y%m%d') AS trade_date, sha256(props) AS payload, event_type FROM events WHERE event_type = 'click' OR strftime(ts, '%Y%m%d') <= '20240120'",
    "active_records": "SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'error'",
    "resume_tasks": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'F'",
    "json_flatten": f"""WITH i AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS url, event_type AS title, json_extract_string(props, '$.k') AS text FROM events UNION ALL SELECT 'e' || CAST(event_id AS VARCHAR), event_type, json_extract_string(props, '$.k') FROM events WHERE event_id % 5 <> 4)
SELECT DISTINCT url, title, coalesce(text, '') AS text, 'review_' || substr(sha256(url || chr(10) || title || chr(10) || coalesce(text, '')), 1, 16) AS record_id FROM i""",
    "text_snippets": "WITH a AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS t FROM documents) SELECT doc_id, " + _SNIPPET.format("t", 360) + " AS snippet FROM a",
    "source_match": "WITH a AS (SELECT p_partkey, list_filter(list_distinct(string_split(upper(p_type), ' ')), lambda x: x IN ('STEEL', 'BRASS', 'COPPER', 'ANODIZED')) AS h, string_split(upper(p_type), ' ') AS w FROM part) SELECT p_partkey, coalesce(array_to_string(list_filter(w, lambda x: x IN ('STEEL', 'BRASS', 'COPPER', 'ANODIZED')), ';'), '') AS matched, CASE WHEN len(h) > 0 THEN 'verified' ELSE 'unverified' END AS verification FROM a",
    "curation_counts": "WITH a AS (SELECT *, trim(coalesce(p_name, '')) <> '' AND trim(coalesce(p_brand, '')) <> '' AND trim(coalesce(p_type, '')) <> '' AS ok FROM part) SELECT p_brand, count(*) AS n, count(*) FILTER (ok) AS complete, count(*) FILTER (ok AND p_size IN (1, 2, 3, 5, 8, 13)) AS accepted FROM a GROUP BY 1",
    "preferred_sources": "WITH a AS (SELECT n_name, n_nationkey, coalesce(list_position(['JAPAN', 'CANADA', 'NOWHERE', 'BRAZIL'], n_name), 5) AS p FROM nation) SELECT n_name, n_nationkey, CAST(row_number() OVER (ORDER BY CASE WHEN p = 0 THEN 5 ELSE p END, n_nationkey) AS INT) AS place FROM a QUALIFY place <= 10",
    "json_row_hash": """SELECT o_orderkey, sha256('{"o_custkey":' || CAST(o_custkey AS VARCHAR) || ',"o_orderkey":' || CAST(o_orderkey AS VARCHAR) || ',"o_orderstatus":"' || o_orderstatus || '"}') AS sha256 FROM orders""",
    "metrics_of_accounts": f"""WITH {BARS}, a AS (SELECT trade_date, round(avg(raw_close), 6) AS e, count(*) AS c FROM bars GROUP BY 1), r AS (SELECT *, round(coalesce(e / lag(e) OVER (ORDER BY trade_date) - 1, 0), 8) AS r, row_number() OVER (ORDER BY trade_date) / 100.0 AS paid, e / max(e) OVER (ORDER BY trade_date) - 1 AS dd FROM a),
m AS (SELECT count(*) AS n, arg_max(e, trade_date) / arg_min(e, trade_date) - 1 AS tr, stddev_pop(r) AS sd, stddev_pop(r) FILTER (r < 0) AS dsd, min(dd) AS dd, sum(c / 1000.0) AS turnover, product(1 + r) - 1 AS comp, max(paid) AS paid, avg(round(e / 4, 6) / e) AS cash_ratio FROM r),
y AS (SELECT *, pow(1 + tr, 252.0 / n) - 1 AS ar FROM m), t AS (SELECT count(*) FILTER (l_returnflag <> 'R') AS f, count(*) FILTER (l_returnflag = 'R' AND l_linenumber % 2 = 1) AS ub, count(*) FILTER (l_returnflag = 'R' AND l_linenumber % 2 = 0) AS us FROM lineitem)
SELECT 'held' AS formula, round(tr, 5) AS total_return, round(dd, 5) AS max_drawdown, round(turnover, 5) AS turnover, round(comp, 5) AS gross_return, round(comp, 5) AS net_return, round(paid, 5) AS cumulative_cost, round(cash_ratio, 5) AS cash_ratio, round(ar, 5) AS annualized_return, round(sd * sqrt(252), 5) AS annualized_volatility,
  round(ar / (sd * sqrt(252)), 5) AS sharpe, round(ar / (dsd * sqrt(252)), 5) AS sortino, round(ar / abs(dd), 5) AS calmar, 'ok' AS status, f AS trade_count, ub AS unfilled_buy_count, us AS unfilled_sell_count FROM y, t""",
    "split_funnel": f"""WITH {SCORED}, s AS (SELECT formula, CASE WHEN trade_date < '19950101' THEN 'train' WHEN trade_date < '19980101' THEN 'validation' ELSE 'blind' END AS split, ic FROM days),
i AS (SELECT formula, round(avg(ic) FILTER (split = 'train'), 6) AS train, round(avg(ic) FILTER (split = 'validation'), 6) AS v0, round(avg(ic) FILTER (split = 'blind'), 6) AS b0 FROM s GROUP BY 1),
p AS (SELECT *, CAST(row_number() OVER (ORDER BY abs(coalesce(train, 0)) DESC, formula) AS INT) AS train_place FROM i), v AS (SELECT *, CASE WHEN train_place <= 3 THEN v0 END AS validation FROM p),
w AS (SELECT *, CASE WHEN train_place <= 3 THEN CAST(row_number() OVER (ORDER BY abs(coalesce(validation, 0)) DESC, formula) AS DOUBLE) END AS validation_place FROM v) SELECT formula, train, train_place, validation, validation_place, CASE WHEN validation_place <= 2 THEN b0 END AS blind FROM w""",
}
ORACLES["symbols_lookup"] = ORACLES["symbols_lookup"].replace("{watch}", ENGINE["observation_watchlist"])
