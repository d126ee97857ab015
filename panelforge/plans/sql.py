"""DuckDB SQL that gives the same rows as :mod:`panelforge.plans.queries`."""

BARS = """
a0 AS (SELECT date_trunc('day', l_shipdate) AS day, l_suppkey, sum(l_quantity) AS volume, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2),
a1 AS (SELECT *, CAST(floor(100000 * exp(CAST(sum(cents % 401 - 200) OVER (PARTITION BY l_suppkey ORDER BY day) AS DOUBLE) / 10000.0)) AS BIGINT) AS c FROM a0),
a2 AS (SELECT *, lag(c) OVER (PARTITION BY l_suppkey ORDER BY day) AS pre FROM a1),
a3 AS (SELECT *, coalesce((pre * (10000 + CASE WHEN cents % 97 = 0 THEN 1000 WHEN cents % 97 = 1 THEN -1000 ELSE (cents // 97) % 301 - 150 END) + 5000) // 10000, c) AS o FROM a2),
bars AS (SELECT strftime(day, '%Y%m%d') AS trade_date, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS ts_code, o / 10000.0 AS open, greatest(o, c) / 10000.0 AS high, least(o, c) / 10000.0 AS low, c / 10000.0 AS close,
  o / 10000.0 AS raw_open, greatest(o, c) / 10000.0 AS raw_high, least(o, c) / 10000.0 AS raw_low, c / 10000.0 AS raw_close, volume, c * volume / 10000.0 AS amount, pre / 10000.0 AS pre_close FROM a3)"""
_W = "PARTITION BY ts_code ORDER BY trade_date"


def _frame(n):
    return f"({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(x, n, value):
    return f"CASE WHEN count({x}) OVER {_frame(n)} = {n} THEN {value} END"


def _mean(x, n):
    return _full(x, n, f"avg({x}) OVER {_frame(n)}")


def _std(x, n):
    return _full(x, n, f"stddev_pop({x}) OVER {_frame(n)}")


_ONE = ", ".join(f"close / lag(close, {k}) OVER ({_W}) - 1 AS RET{k}" for k in (1, 5, 20, 60, 120)) + f", volume / {_mean('volume', 20).replace('CASE', '(CASE', 1)}) - 1 AS VOL_RATIO20"
_DOWN = "CASE WHEN RET1 < 0 THEN RET1 WHEN RET1 IS NOT NULL THEN 0.0 END"
_TWO = ", ".join(
    ["RET1 * (VOL_RATIO20 + 1) AS VOLUME_WEIGHTED_RET"] + [f"{_std('RET1', n)} AS RET_STD{n}" for n in (20, 60)] + [f"{_std('down', n)} AS DOWNSIDE_RET_STD{n}" for n in (20, 60)]
    + [f"close / ({_mean('close', n)}) - 1 AS TREND{n}" for n in (20, 60, 120)] + [f"{_mean('amount', n)} AS AMOUNT_MA{n}" for n in (20, 60)])
FEATURES = f"{BARS},\nf1 AS (SELECT *, {_ONE} FROM bars), f2 AS (SELECT *, {_DOWN} AS down FROM f1),\nfeat AS (SELECT *, {_TWO} FROM f2)"
DAYS = "cal AS (SELECT DISTINCT trade_date FROM bars)"
SNAPS = "snap AS (SELECT b.trade_date AS snapshot_date, ts_code FROM bars b JOIN (SELECT substr(trade_date, 1, 6) AS m, min(trade_date) AS d FROM bars GROUP BY 1) s ON b.trade_date = s.d)"
MEMBERS = f"{DAYS}, {SNAPS}, asd AS (SELECT cal.trade_date, max(s.snapshot_date) AS snapshot_date FROM cal JOIN (SELECT DISTINCT snapshot_date FROM snap) s ON s.snapshot_date <= cal.trade_date GROUP BY 1), mem AS (SELECT asd.trade_date, asd.snapshot_date, snap.ts_code FROM asd JOIN snap USING (snapshot_date))"
ST = """st AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS ts_code, CAST(1992 + s_suppkey % 5 AS VARCHAR) || '0101' AS start_date, CAST(1994 + s_suppkey % 5 AS VARCHAR) || '1231' AS end_date, 1 AS v FROM supplier WHERE s_acctbal < 0
  UNION ALL SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0'), CAST(1993 + s_suppkey % 5 AS VARCHAR) || '0401', CAST(1993 + s_suppkey % 5 AS VARCHAR) || '0930', 0 FROM supplier WHERE s_acctbal < 0 AND s_suppkey % 2 = 0),
sd AS (SELECT b.trade_date, b.ts_code, arg_max(v, start_date) AS is_st FROM bars b JOIN st ON st.ts_code = b.ts_code AND b.trade_date BETWEEN st.start_date AND st.end_date GROUP BY 1, 2)"""
LIMITS = "lim AS (SELECT trade_date, ts_code, ((CAST(round(pre_close * 10000) AS BIGINT) * 110 + 50) // 100) / 10000.0 AS limit_up, ((CAST(round(pre_close * 10000) AS BIGINT) * 90 + 50) // 100) / 10000.0 AS limit_down, CASE WHEN pre_close IS NULL THEN 'missing_input' WHEN CAST(ts_code AS INT) % 11 = 0 THEN 'special_case_unknown' ELSE 'verified_rule' END AS limit_status FROM bars)"
#: Bars with their limits as columns of the same row: each row has exactly one, so nothing is joined.
LIMITED = LIMITS.replace("lim AS (SELECT trade_date, ts_code,", "limited AS MATERIALIZED (SELECT *,")
MARKET = f"{LIMITS}, mkt AS (SELECT b.trade_date, b.ts_code, limit_status, CASE WHEN raw_open IS NULL OR raw_open <= 0 THEN 'missing_or_invalid_raw_open' WHEN limit_status <> 'verified_rule' THEN limit_status WHEN raw_open >= limit_up - 0.005 THEN 'limit_up_open' END AS buy_block, CASE WHEN raw_open IS NULL OR raw_open <= 0 THEN 'missing_or_invalid_raw_open' WHEN limit_status <> 'verified_rule' THEN limit_status WHEN raw_open <= limit_down + 0.005 THEN 'limit_down_open' END AS sell_block FROM bars b JOIN lim USING (trade_date, ts_code))"
_BLOCKS = MARKET[MARKET.index("CASE WHEN raw_open IS NULL"):MARKET.index(" FROM bars b JOIN lim")]


def rank_of(x, *by):
    by = ", ".join(by)
    return f"rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0"


SCORED = f"""{FEATURES},
z AS (SELECT *, stddev_pop(VOL_RATIO20) OVER {_frame(20)} AS sd, avg(VOL_RATIO20) OVER {_frame(20)} AS mu, count(VOL_RATIO20) OVER {_frame(20)} AS c, lead(raw_close, 5) OVER ({_W}) / raw_close - 1 AS fr FROM feat),
wide AS (SELECT trade_date, ts_code, round(fr, 8) AS forward_return, round(-RET_STD20, 8) AS low_vol, round(-RET5, 8) AS reversal, round(RET20, 8) AS momentum, round(CASE WHEN c = 20 AND sd > 1e-15 THEN (VOL_RATIO20 - mu) / sd END, 8) AS busy FROM z),
scored AS (SELECT trade_date, ts_code, forward_return, 'low_vol' AS formula, low_vol AS factor_value FROM wide UNION ALL SELECT trade_date, ts_code, forward_return, 'reversal', reversal FROM wide UNION ALL SELECT trade_date, ts_code, forward_return, 'momentum', momentum FROM wide UNION ALL SELECT trade_date, ts_code, forward_return, 'busy', busy FROM wide),
ok AS (SELECT * FROM scored WHERE factor_value IS NOT NULL AND forward_return IS NOT NULL),
r AS (SELECT *, count(*) OVER (PARTITION BY formula, trade_date) AS n, min(factor_value) OVER (PARTITION BY formula, trade_date) AS lo, max(factor_value) OVER (PARTITION BY formula, trade_date) AS hi,
  {rank_of('factor_value', 'formula', 'trade_date')} AS rf, {rank_of('forward_return', 'formula', 'trade_date')} AS rr,
  row_number() OVER (PARTITION BY formula, trade_date ORDER BY factor_value DESC, ts_code) AS up, row_number() OVER (PARTITION BY formula, trade_date ORDER BY factor_value, ts_code DESC) AS down FROM ok),
q AS (SELECT *, least(5, greatest(1, n // 5)) AS q FROM r WHERE n >= 5 AND lo < hi),
days AS (SELECT formula, trade_date, CASE WHEN stddev_pop(rr) > 0 THEN corr(rf, rr) END AS ic, stddev_pop(factor_value) AS dispersion, avg(forward_return) FILTER (up <= q) - avg(forward_return) FILTER (down <= q) AS spread, list(ts_code) FILTER (up <= q) AS top_set FROM q GROUP BY ALL),
turn AS (SELECT formula, avg(1 - len(list_intersect(top_set, before)) / greatest(1, len(list_distinct(list_concat(top_set, before))))) FILTER (before IS NOT NULL) AS turnover_proxy FROM (SELECT *, lag(top_set) OVER (PARTITION BY formula ORDER BY trade_date) AS before FROM days) GROUP BY formula),
e AS (SELECT formula, trade_date, list_sort(list_distinct(quantile_cont(factor_value, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS edges FROM ok GROUP BY ALL HAVING count(*) >= 10),
bk AS (SELECT formula, trade_date, len(list_filter(list_slice(edges, 2, len(edges) - 1), lambda x: x < factor_value)) AS bucket, forward_return FROM ok JOIN e USING (formula, trade_date) WHERE len(edges) > 1),
bm AS (SELECT formula, trade_date, bucket, avg(forward_return) AS m FROM bk GROUP BY ALL),
br AS (SELECT *, {rank_of('m', 'formula', 'trade_date')} AS r, row_number() OVER (PARTITION BY formula, trade_date ORDER BY bucket) AS k, count(*) OVER (PARTITION BY formula, trade_date) AS c FROM bm),
mono AS (SELECT formula, avg(s) AS monotonicity_score FROM (SELECT formula, trade_date, CASE WHEN stddev_pop(r) > 0 THEN corr(r, k) END AS s FROM br WHERE c >= 3 GROUP BY ALL) GROUP BY formula)"""
_DAILY = f"{FEATURES}, dr AS (SELECT trade_date, round(avg(RET1), 8) AS r, 'all' AS index_name FROM feat GROUP BY trade_date)"
_TRADES = """t0 AS (SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS ts_code, strftime(l_shipdate, '%Y%m%d') AS trade_date, l_orderkey * 100 + l_linenumber AS seq, CASE WHEN l_linenumber % 2 = 1 THEN 'buy' ELSE 'sell' END AS side, l_extendedprice / l_quantity AS price, l_partkey FROM lineitem WHERE l_quantity > 0),
t1 AS (SELECT * FROM t0 QUALIFY row_number() OVER (PARTITION BY ts_code, trade_date, seq ORDER BY l_partkey, price) = 1),
t2 AS (SELECT *, coalesce(sum(CASE WHEN side = 'sell' THEN 1 ELSE 0 END) OVER (PARTITION BY ts_code ORDER BY trade_date, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM t1),
t3 AS (SELECT *, last_value(CASE WHEN side = 'buy' THEN trade_date END IGNORE NULLS) OVER w AS entry_date, last_value(CASE WHEN side = 'buy' THEN price END IGNORE NULLS) OVER w AS entry_price FROM t2 WINDOW w AS (PARTITION BY ts_code, island ORDER BY trade_date, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
paired AS (SELECT ts_code, entry_date, trade_date AS exit_date, round(price / entry_price - 1, 6) AS trade_return FROM t3 WHERE side = 'sell' AND entry_date IS NOT NULL)"""


_PATH = f"""{FEATURES}, {MEMBERS}, lv AS (SELECT trade_date, round(avg(raw_close), 6) AS level FROM bars GROUP BY 1),
sig AS (SELECT trade_date, coalesce(lag(above) OVER (ORDER BY trade_date), false) AS regime_on FROM (SELECT *, level > round(avg(level) OVER (ORDER BY trade_date ROWS BETWEEN 119 PRECEDING AND CURRENT ROW), 6) AS above FROM lv)),
hd AS (SELECT *, (row_number() OVER (ORDER BY trade_date) - 1) % 5 = 0 AS is_rebalance, count(*) FILTER (NOT regime_on) OVER (ORDER BY trade_date) AS stretch FROM sig),
hf AS (SELECT *, max(CASE WHEN regime_on AND is_rebalance THEN trade_date END) OVER (PARTITION BY stretch ORDER BY trade_date) AS held_from FROM hd),
pk AS (SELECT trade_date, ts_code FROM feat SEMI JOIN mem USING (trade_date, ts_code) WHERE RET_STD20 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY round(-RET_STD20, 8) DESC, ts_code) <= 20),
hr AS (SELECT hf.trade_date, count(*) AS n, sum(coalesce(round(b.close / b.pre_close - 1, 8), 0)) / 20 AS gross FROM hf JOIN pk ON pk.trade_date = hf.held_from
  LEFT JOIN (SELECT * FROM bars SEMI JOIN mem USING (trade_date, ts_code)) b ON b.trade_date = hf.trade_date AND b.ts_code = pk.ts_code GROUP BY 1),
pc AS (SELECT trade_date, regime_on, is_rebalance, coalesce(n, 0) AS holdings_count, coalesce(gross, 0) AS gross, CASE WHEN is_rebalance AND n > 0 THEN 0.004 ELSE 0.0 END AS cost FROM hf LEFT JOIN hr USING (trade_date)),
path AS (SELECT trade_date, regime_on, is_rebalance, holdings_count, round(gross - cost, 10) AS portfolio_return, CAST(cost AS DOUBLE) AS cost FROM pc)"""


def _metrics(source, columns, by=""):
    """Metrics of the paths in ``source`` (trade_date, regime_on, r), one for each value of ``by``."""
    over = f"PARTITION BY {by or 'true'} ORDER BY trade_date"
    lead, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""WITH {_PATH}, s0 AS ({source}), s1 AS (SELECT *, exp(sum(ln(1 + r)) OVER ({over})) AS equity, regime_on IS DISTINCT FROM lag(regime_on) OVER ({over}) AS switched FROM s0),
s2 AS (SELECT *, max(equity) OVER ({over}) AS peak FROM s1),
s3 AS (SELECT {lead}count(*) AS days, arg_max(equity, trade_date) - 1 AS total_return, min(equity / peak - 1) AS max_drawdown, count(*) FILTER (regime_on) AS risk_on_days, count(*) FILTER (switched) AS switch_count,
  avg(CAST(r > 0 AS INT)) AS win_rate, avg(r) AS mu, stddev_samp(r) AS sd, stddev_samp(CASE WHEN r < 0 THEN r END) AS dsd FROM s2 {group}),
s4 AS (SELECT *, pow(1 + total_return, 252.0 / days) - 1 AS annualized_return, CASE WHEN sd > 0 THEN mu / sd * sqrt(252) ELSE 0 END AS sharpe, CASE WHEN dsd > 0 THEN mu / dsd * sqrt(252) ELSE 0 END AS sortino FROM s3),
s5 AS (SELECT *, CASE WHEN max_drawdown <> 0 THEN annualized_return / abs(max_drawdown) ELSE 0 END AS calmar FROM s4)
SELECT {lead}""" + ", ".join(c if c in _WHOLE else f"round({c}, 5) AS {c}" for c in columns.split()) + " FROM s5"


_WHOLE = ("days", "risk_on_days", "switch_count")
_SPLIT = "CASE WHEN trade_date < '19980101' THEN 'train' WHEN trade_date < '20000101' THEN 'validation' ELSE 'test' END"
_STATUS = "CASE WHEN l_returnflag = 'N' THEN 'completed' WHEN l_returnflag = 'A' THEN 'entry_unfilled' WHEN l_linenumber % 2 = 0 THEN 'entry_filled_exit_incomplete' ELSE 'missing_execution_status' END"
_WINDOWS = f"w AS (SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS ts_code, {_STATUS} AS status, l_linenumber > 4 AS delayed_exit, round(l_discount - l_tax, 4) AS x FROM lineitem), n AS (SELECT *, CASE WHEN status = 'completed' THEN x END AS net FROM w)"


def _features(*names):
    return f"WITH {FEATURES} SELECT trade_date, ts_code, " + ", ".join(f"round({n}, 8) + 0 AS {n}" for n in names) + " FROM feat"


def _formula(expression, source="feat"):
    return f"WITH {FEATURES} SELECT trade_date, ts_code, round({expression}, 6) + 0 AS factor_value FROM {source}"


_DECAY = " + ".join((f"lag(RET5, {20 - i}) OVER ({_W})" if i < 20 else "RET5") + f" * {i / 210!r}" for i in range(1, 21))
ORACLES = {
    "bars_daily": f"WITH {BARS} SELECT * FROM bars",
    "feat_returns": _features("RET1", "RET5", "RET20", "RET60", "RET120", "VOLUME_WEIGHTED_RET"),
    "feat_rolling_mean": _features("VOL_RATIO20", "TREND20", "TREND60", "TREND120", "AMOUNT_MA20", "AMOUNT_MA60"),
    "feat_rolling_std": _features("RET_STD20", "RET_STD60", "DOWNSIDE_RET_STD20", "DOWNSIDE_RET_STD60"),
    "feat_robust_z": f"WITH {FEATURES}, a AS (SELECT trade_date, ts_code, round(RET5, 6) AS x FROM feat), m AS (SELECT *, median(x) OVER (PARTITION BY trade_date) AS m FROM a), s AS (SELECT *, 1.4826 * median(abs(x - m)) OVER (PARTITION BY trade_date) AS s, count(x) OVER (PARTITION BY trade_date) AS n FROM m) SELECT trade_date, ts_code, round(CASE WHEN n >= 5 AND s > 0 AND x IS NOT NULL THEN greatest(-5.0, least(5.0, (x - m) / s)) END, 6) AS RET5_z FROM s",
    "formula_arith": _formula("abs(RET1 - RET5) + -TREND20"),
    "formula_div_safe": _formula("CASE WHEN abs(VOL_RATIO20) > 1e-12 THEN RET1 / VOL_RATIO20 END"),
    "formula_delta5": _formula(f"RET20 - lag(RET20, 5) OVER ({_W})"),
    "formula_decay20": _formula(_DECAY),
    "formula_zscore20": f"WITH {FEATURES}, g AS (SELECT *, stddev_pop(RET1) OVER {_frame(20)} AS sd, avg(RET1) OVER {_frame(20)} AS mu, count(RET1) OVER {_frame(20)} AS c FROM feat) SELECT trade_date, ts_code, round(CASE WHEN c = 20 AND sd > 1e-15 THEN (RET1 - mu) / sd END, 6) AS factor_value FROM g",
    "formula_nested": f"WITH {FEATURES}, d AS (SELECT *, RET5 - lag(RET5, 5) OVER ({_W}) AS x FROM feat), g AS (SELECT *, stddev_pop(x) OVER {_frame(20)} AS sd, avg(x) OVER {_frame(20)} AS mu, count(x) OVER {_frame(20)} AS c FROM d) SELECT trade_date, ts_code, round(CASE WHEN c = 20 AND sd > 1e-15 THEN (x - mu) / sd END, 6) AS factor_value FROM g",
    "formula_validity": f"WITH {FEATURES}, a AS (SELECT round(RET1, 8) AS x FROM feat) SELECT count(*) AS total_rows, count(x) AS valid_rows, CAST(0 AS BIGINT) AS inf_rows, count(DISTINCT x) AS unique_values, round(stddev_pop(x), 6) AS std, CASE WHEN count(x) < 20 THEN 'insufficient_valid_rows' WHEN count(DISTINCT x) <= 1 THEN 'constant_or_all_missing' END AS failure_reason FROM a",
    "forward_return": f"WITH {BARS} SELECT trade_date, ts_code, round(lead(raw_close, 5) OVER ({_W}) / raw_close - 1, 8) AS forward_return FROM bars",
    "rank_ic_by_date": f"WITH {SCORED} SELECT formula, trade_date, round(ic, 6) + 0 AS ic, round(dispersion, 6) AS dispersion, round(spread, 10) + 0 AS spread FROM days",
    "turnover_jaccard": f"WITH {SCORED} SELECT formula, round(turnover_proxy, 6) AS turnover_proxy FROM turn",
    "monotonicity_qcut": f"WITH {SCORED} SELECT formula, round(monotonicity_score, 6) AS monotonicity_score FROM mono",
    "fast_screen_summary": f"WITH {SCORED}, cover AS (SELECT formula, count(*) FILTER (factor_value IS NOT NULL AND forward_return IS NOT NULL) / greatest(1, count(*)) AS coverage FROM scored GROUP BY formula), ics AS (SELECT formula, avg(ic) AS m, stddev_pop(ic) AS s, avg(CASE WHEN ic > 1e-12 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END) AS pos, avg(CASE WHEN ic < -1e-12 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END) AS neg, avg(spread) AS spread, avg(dispersion) AS disp FROM days GROUP BY formula), v AS (SELECT *, CASE WHEN coverage < 0.1 THEN 'low_coverage' WHEN disp IS NULL OR disp < 0 THEN 'low_dispersion' WHEN m IS NULL THEN 'weak_rank_ic' END AS why FROM cover LEFT JOIN ics USING (formula) LEFT JOIN turn USING (formula) LEFT JOIN mono USING (formula)) SELECT formula, round(coverage, 6) AS coverage, round(m, 6) AS rank_ic_mean, round(s, 6) AS rank_ic_std, round(pos, 6) AS positive_period_ratio, round(neg, 6) AS negative_period_ratio, round(spread, 6) AS top_bottom_spread, round(turnover_proxy, 6) AS turnover_proxy, round(monotonicity_score, 6) AS monotonicity_score, round(CASE WHEN s > 0 THEN m / s END, 6) AS rank_ic_ir, round(1 - turnover_proxy, 6) AS signal_stability, why AS rejection_reason, CASE WHEN why IS NULL THEN 'passed' ELSE 'rejected' END AS fast_screen_status FROM v",
    "percentile_composite": f"WITH {FEATURES}, a AS (SELECT trade_date, ts_code, round(RET5, 8) AS x, round(VOL_RATIO20, 8) AS y FROM feat), p AS (SELECT *, CASE WHEN x IS NOT NULL THEN cume_dist() OVER (PARTITION BY trade_date, x IS NULL ORDER BY x) END AS px, CASE WHEN y IS NOT NULL THEN cume_dist() OVER (PARTITION BY trade_date, y IS NULL ORDER BY y) END AS py FROM a) SELECT trade_date, ts_code, round((px + py) / 2, 6) AS score FROM p",
    "topn_by_date": f"WITH {FEATURES}, a AS (SELECT trade_date, ts_code, round(-RET_STD20, 8) AS factor_value FROM feat) SELECT trade_date, ts_code, factor_value, CAST(row_number() OVER (PARTITION BY trade_date ORDER BY factor_value DESC, ts_code) AS INT) AS rank FROM a WHERE factor_value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY factor_value DESC, ts_code) <= 20",
    "corr_pairs": f"WITH {FEATURES}, a AS (SELECT trade_date, ts_code, round(RET5, 8) AS RET5, round(RET20, 8) AS RET20, round(RET_STD20, 8) AS RET_STD20, round(TREND20, 8) AS TREND20 FROM feat), p0 AS (" + " UNION ALL ".join(f"SELECT trade_date, ts_code, '{x}' AS a, '{y}' AS b, {x} AS x, {y} AS y FROM a WHERE {x} IS NOT NULL AND {y} IS NOT NULL" for i, x in enumerate(("RET5", "RET20", "RET_STD20", "TREND20")) for y in ("RET5", "RET20", "RET_STD20", "TREND20")[i + 1 :]) + f"), o AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY trade_date, ts_code) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY a, b) // 20000) AS step FROM p0), p AS (SELECT * FROM o WHERE i % step = 0 AND i // step < 20000), r AS (SELECT a, b, {rank_of('x', 'a', 'b')} AS rx, {rank_of('y', 'a', 'b')} AS ry FROM p) SELECT a, b, round(corr(rx, ry), 6) AS correlation FROM r GROUP BY a, b",
    "weekly_schedule": f"WITH {BARS}, {DAYS}, k AS (SELECT trade_date, year(strptime(trade_date, '%Y%m%d')) * 100 + weekofyear(strptime(trade_date, '%Y%m%d')) AS k FROM cal), n AS (SELECT trade_date, CASE WHEN k = lag(k) OVER (ORDER BY trade_date) THEN 0 ELSE 1 END AS new FROM k), r AS (SELECT trade_date, sum(new) OVER (ORDER BY trade_date) AS run FROM n), g AS (SELECT run, max(trade_date) AS signal_date, min(trade_date) AS f FROM r GROUP BY run), s AS (SELECT signal_date, lead(f, 1) OVER (ORDER BY run) AS entry_date, lead(f, 2) OVER (ORDER BY run) AS exit_date FROM g) SELECT * FROM s WHERE exit_date IS NOT NULL",
    "rebalance_dates": f"WITH {BARS}, {DAYS}, n AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS i, lead(trade_date) OVER (ORDER BY trade_date) AS next_date FROM cal) SELECT trade_date, next_date FROM n WHERE i % 5 = 0",
    "asof_members": f"WITH {BARS}, {MEMBERS} SELECT trade_date, snapshot_date, ts_code FROM mem",
    "interval_st": f"WITH {BARS}, {ST} SELECT trade_date, ts_code, CAST(coalesce(is_st, 0) AS INT) AS historical_is_st FROM bars LEFT JOIN sd USING (trade_date, ts_code)",
    "lifecycle_filter": f"WITH {BARS}, life AS (SELECT ts_code, min(trade_date) AS list_date, CASE WHEN CAST(ts_code AS INT) % 7 = 0 THEN max(trade_date) END AS delist_date FROM bars GROUP BY ts_code) SELECT trade_date, count(*) AS n_active FROM bars JOIN life USING (ts_code) WHERE list_date <= trade_date AND (delist_date IS NULL OR delist_date >= trade_date) GROUP BY trade_date",
    "semi_members": f"WITH {BARS}, {MEMBERS} SELECT trade_date, ts_code, raw_close FROM bars WHERE EXISTS (SELECT 1 FROM mem WHERE mem.trade_date = bars.trade_date AND mem.ts_code = bars.ts_code)",
    "anti_members": f"WITH {BARS}, {MEMBERS} SELECT trade_date, ts_code, raw_close FROM bars WHERE NOT EXISTS (SELECT 1 FROM mem WHERE mem.trade_date = bars.trade_date AND mem.ts_code = bars.ts_code)",
    "limit_left_join": f"WITH {BARS}, {LIMITED} SELECT trade_date, ts_code, raw_close, CASE WHEN limit_status = 'verified_rule' THEN limit_up END AS limit_up, CASE WHEN limit_status = 'verified_rule' THEN limit_down END AS limit_down, CASE WHEN limit_status = 'verified_rule' THEN limit_status END AS limit_status FROM limited",
    "tradability_case": f"WITH {BARS}, {LIMITED} SELECT trade_date, ts_code, {_BLOCKS} FROM limited",
    "monthly_returns": f"WITH {_DAILY} SELECT index_name, substr(trade_date, 1, 6) AS month, round(product(1 + r) - 1, 6) AS month_return FROM dr GROUP BY ALL",
    "drawdown": f"WITH {_DAILY}, q AS (SELECT trade_date, exp(sum(ln(1 + coalesce(r, 0))) OVER (ORDER BY trade_date)) AS equity FROM dr) SELECT trade_date, round(equity, 5) AS equity, round(equity / max(equity) OVER (ORDER BY trade_date) - 1, 5) + 0 AS drawdown FROM q",
    "regime_signal": f"WITH {BARS}, d AS (SELECT trade_date, round(avg(raw_close), 6) AS level FROM bars GROUP BY 1), a AS (SELECT trade_date, level > round(avg(level) OVER (ORDER BY trade_date ROWS BETWEEN 119 PRECEDING AND CURRENT ROW), 6) AS above FROM d) SELECT trade_date, coalesce(lag(above) OVER (ORDER BY trade_date), false) AS regime_on FROM a",
    "dist_summary": f"WITH {FEATURES}, a AS (SELECT ts_code, round(RET1, 8) AS x FROM feat) SELECT ts_code, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max, round(quantile_cont(x, 0.1), 6) AS p10, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.9), 6) AS p90 FROM a GROUP BY ts_code",
    "entry_exit_pairing": f"WITH {_TRADES} SELECT * FROM paired",
    "trade_stats": f"WITH {_TRADES} SELECT ts_code, count(*) AS n, round(avg(CASE WHEN trade_return > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(avg(trade_return), 6) AS mean_return, round(avg(trade_return) FILTER (trade_return > 0), 6) AS mean_win, round(avg(trade_return) FILTER (trade_return <= 0), 6) AS mean_loss, round(median(trade_return), 6) AS median_return FROM paired GROUP BY ts_code",
    "keep_best_agg": "SELECT e.event_type, m.event_id AS best_event, max(e.value) AS best_value, count(DISTINCT e.user_id) AS users FROM events e JOIN (SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC NULLS LAST, event_id DESC) = 1) m ON e.event_type = m.event_type GROUP BY ALL",
    "status_counts": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL",
    "pivot_compare": "SELECT strftime(o_orderdate, '%Y') AS y, " + ", ".join(f"count(*) FILTER (o_orderstatus = '{c}') AS n_{c.lower()}" for c in "FOP") + " FROM orders GROUP BY 1",
    "overlap_sets": "WITH s AS (SELECT DISTINCT event_type, user_id FROM events) SELECT a.event_type AS left_type, b.event_type AS right_type, count(*) AS n_both FROM s a JOIN s b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY ALL",
    "registry_upsert": "WITH n AS (SELECT c_custkey + 1 AS c_custkey, round(c_acctbal + 1, 2) AS c_acctbal FROM customer WHERE c_custkey % 3 = 0) SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n) UNION ALL SELECT * FROM n",
    "event_dedup": "SELECT event_id, user_id, event_type FROM events",
    "diff_tables": "WITH j AS (SELECT a.c_custkey % 50 = 0 AS gone, a.c_custkey % 10 = 0 AS moved FROM customer a) SELECT 'c_acctbal' AS column_name, count(*) FILTER (gone OR moved) AS mismatches FROM j UNION ALL SELECT 'c_nationkey', count(*) FILTER (gone) FROM j",
    "text_keywords": "SELECT p_partkey, array_to_string(list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(p_type), '{w}')" for w in ws) + f" THEN '{g}' END" for g, ws in {"size": ["small", "large", "medium"], "metal": ["steel", "brass", "tin"], "plain": ["standard", "economy"]}.items()) + "], lambda x: x IS NOT NULL), ',') AS groups, 'part_' || substr(sha256(p_name || chr(10) || p_brand), 1, 16) AS stable_id FROM part",
    "event_windows": "SELECT strftime(date_trunc('day', ts), '%Y%m%d') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "observation_watchlist": f"""WITH {FEATURES}, {MEMBERS}, {MARKET}, {ST}, a AS (SELECT trade_date, ts_code, raw_close, round(-RET_STD20, 8) AS factor_value FROM feat SEMI JOIN mem USING (trade_date, ts_code) WHERE trade_date = (SELECT max(trade_date) FROM bars WHERE trade_date IN (SELECT trade_date FROM feat SEMI JOIN mem USING (trade_date, ts_code) WHERE RET_STD20 IS NOT NULL))),
t AS (SELECT *, CAST(row_number() OVER (ORDER BY factor_value DESC, ts_code) AS INT) AS rank FROM a WHERE factor_value IS NOT NULL QUALIFY row_number() OVER (ORDER BY factor_value DESC, ts_code) <= 20)
SELECT t.trade_date, t.ts_code, rank, factor_value, CAST(coalesce(is_st, 0) AS INT) AS is_st, lim.limit_status, raw_close >= limit_up - 1e-6 AS hit_limit_up, raw_close <= limit_down + 1e-6 AS hit_limit_down, true AS tradable, round(1.0 / count(*) OVER (), 8) AS weight
FROM t JOIN lim USING (trade_date, ts_code) LEFT JOIN sd USING (trade_date, ts_code)""",
    "regime_path": f"WITH {_PATH} SELECT * FROM path",
    "regime_metrics": _metrics("SELECT trade_date, regime_on, portfolio_return AS r FROM path", "days total_return max_drawdown risk_on_days switch_count win_rate annualized_return sharpe sortino calmar"),
    "cost_grid": _metrics("SELECT trade_date, regime_on, portfolio_return + cost - cost * cost_bps / 20 AS r, cost_bps FROM path, (SELECT CAST(unnest([0, 10, 20, 50]) AS DOUBLE) AS cost_bps)", "days total_return max_drawdown sharpe", "cost_bps"),
    "split_metrics": _metrics(f"SELECT trade_date, regime_on, portfolio_return AS r, {_SPLIT} AS split FROM path", "days total_return max_drawdown sharpe switch_count", "split"),
    "window_stats": f"WITH {_WINDOWS} SELECT ts_code, count(*) AS target_window_count, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {n}" for s, n in (
        ("completed", "completed_window_count"), ("entry_unfilled", "entry_unfilled_count"), ("entry_filled_exit_incomplete", "incomplete_exit_count"), ("missing_execution_status", "missing_status_count")))
    + ", count(*) FILTER (delayed_exit) AS delayed_exit_count, count(net) AS net_return_count, count(*) FILTER (net > 0) AS positive_count, count(*) FILTER (net < 0) AS negative_count, count(*) FILTER (net = 0) AS zero_count, "
    "round(avg(net), 6) AS mean_net_return, round(median(net), 6) AS median_net_return FROM n GROUP BY ts_code",
    "histogram_tokens": "SELECT token, count(*) AS n FROM (SELECT unnest(string_split(lower(p_type), ' ')) AS token FROM part) WHERE token <> '' GROUP BY token",
}
_ORDER = "['RET5', 'RET20', 'RET_STD20', 'TREND20']"
ORACLES["corr_clusters"] = "WITH RECURSIVE pc AS (" + ORACLES["corr_pairs"] + f"""),
near AS (SELECT a AS x, b AS y, correlation AS c FROM pc WHERE abs(correlation) >= 0.7 UNION ALL SELECT b, a, correlation FROM pc WHERE abs(correlation) >= 0.7),
hits AS (SELECT n AS name, list(y) AS ys FROM (SELECT unnest({_ORDER}) AS n) LEFT JOIN near ON x = n GROUP BY n),
g AS (SELECT 0 AS i, CAST([] AS VARCHAR[]) AS kept, CAST(NULL AS VARCHAR) AS representative, CAST(NULL AS VARCHAR) AS member
  UNION ALL SELECT i + 1, CASE WHEN r IS NULL THEN list_append(kept, name) ELSE kept END, coalesce(r, name), name FROM (SELECT i, kept, name, list_filter(kept, lambda k: list_contains(ys, k))[1] AS r FROM g JOIN hits ON name = {_ORDER}[i + 1] WHERE i < 4))
SELECT representative, member, CASE WHEN representative = member THEN 1.0 ELSE c END AS correlation FROM g LEFT JOIN near ON x = member AND y = representative WHERE i > 0"""
