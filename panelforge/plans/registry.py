"""All queries of the engine by name, and the SQL that gives the same rows."""

from . import queries as q
from . import evidence, evidence_sql, research, research_sql
from .sql import ORACLES as _ENGINE

_NAMED = (
    "bars_daily feat_robust_z formula_validity rank_ic_by_date fast_screen_summary turnover_jaccard monotonicity_qcut forward_return percentile_composite topn_by_date corr_pairs corr_clusters "
    "weekly_schedule rebalance_dates asof_members interval_st lifecycle_filter semi_members anti_members limit_left_join tradability_case backtest_accounts backtest_metrics monthly_returns drawdown "
    "regime_signal dist_summary entry_exit_pairing trade_stats keep_best_agg status_counts pivot_compare overlap_sets registry_upsert event_dedup diff_tables text_keywords event_windows observation_watchlist "
    "regime_path regime_metrics cost_grid split_metrics window_stats histogram_tokens"
).split()
QUERIES = {n: getattr(q, n) for n in _NAMED} | {
    "feat_returns": q._features(["RET1", "RET5", "RET20", "RET60", "RET120", "VOLUME_WEIGHTED_RET"]),
    "feat_rolling_mean": q._features(["VOL_RATIO20", "TREND20", "TREND60", "TREND120", "AMOUNT_MA20", "AMOUNT_MA60"]),
    "feat_rolling_std": q._features(["RET_STD20", "RET_STD60", "DOWNSIDE_RET_STD20", "DOWNSIDE_RET_STD60"]),
    "formula_arith": q._formula("ADD(ABS(SUB(RET1,RET5)),NEG(TREND20))"),
    "formula_div_safe": q._formula("DIV(RET1,VOL_RATIO20)"),
    "formula_delta5": q._formula("DELTA5(RET20)"),
    "formula_decay20": q._formula("DECAY_LINEAR20(RET5)"),
    "formula_zscore20": q._formula("ZSCORE20(RET1)"),
    "formula_nested": q._formula("ZSCORE20(DELTA5(RET5))"),
}
QUERIES |= research.QUERIES | evidence.QUERIES
ORACLES = _ENGINE | research_sql.ORACLES | evidence_sql.ORACLES
