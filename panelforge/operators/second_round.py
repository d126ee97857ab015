"""Whether a second search round may be prepared: settings that are fixed, and seed records judged in one pass.

The settings are one small mapping and are looked at as such. Seeds and strategy references are
tables of records; each rule over them is a condition, all are judged together, and every record
that breaks one is named.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, functions as F

from panelforge.functions.features import NAMES
from panelforge.functions.formula import OPERATORS
from panelforge.operators.checks import Rule

#: Settings that must be there and have exactly this value, and the reason's beginning if they don't.
CONTROLS = {
    "execution_control_blocked": {"run_enabled": False, "formula_generation_enabled": False, "backtest_enabled": False, "search_enabled": False},
    "boundary_blocked": {"forward_data_access_allowed": False, "external_data_allowed": False, "operator_extension_allowed": False},
    "threshold_change_blocked": {"threshold_change_allowed": False},
    "rating_rule_change_blocked": {"rating_rule_change_allowed": False},
}
MISSING = {"execution_control_blocked": "missing_execution_control:{}", "boundary_blocked": "missing_boundary_control:{}", "threshold_change_blocked": "missing_threshold_change_control", "rating_rule_change_blocked": "missing_rating_rule_control"}
#: Thresholds that a draft may repeat but not change.
LOCKED = {
    "screening": {"min_valid_rows": 20, "min_coverage": 0.30, "min_abs_rank_ic_mean": 0.001, "min_cross_sectional_dispersion": 0.000001},
    "correlation": {"output_correlation_threshold": 0.95, "max_correlation_rows": 2000},
    "rating": {"min_positive_period_ratio": 0.45, "grade_a_min_abs_ic": 0.03, "grade_a_max_drawdown": 0.35, "grade_b_min_abs_ic": 0.015},
}
DRAFT = "draft_not_approved"
#: Features of the first round; the second one adds all others.
ORIGINAL = ("RET1", "RET5", "VOL_RATIO20", "VOLUME_WEIGHTED_RET", "TREND60")
SEED = (
    "seed_factor_id string, computability_class string, source_title string, source_url_or_path string, source_verified_by_firecrawl boolean, requires_new_operator boolean, "
    "requires_new_external_data boolean, suggested_for_second_batch_minimal_experiment boolean")
STRATEGY = "strategy_id string, simulatability_class string"


def settings(config: Mapping) -> list[str]:
    """What is wrong with the settings: state, controls, boundaries, locked thresholds, features and operators."""
    status = config.get("status", "")
    bad = [] if status == DRAFT else [f"status_is_{status}" if status in ("approved", "executable") else f"status_not_explicitly_draft:{status}"]
    for reason, fixed in CONTROLS.items():
        bad += [MISSING[reason].format(k) if config.get(k) is None else f"{reason}:{k}={config[k]}" for k, v in fixed.items() if config.get(k) is None or config[k] != v]
    for section, fixed in LOCKED.items():
        given = (config.get("locked_thresholds") or {}).get(section) or {}
        what = "rating_rule_deviation" if section == "rating" else "threshold_deviation"
        bad += [f"{what}:{section}.{k}={given[k]} (expected {v})" for k, v in fixed.items() if given.get(k) is not None and given[k] != v]
    features = config.get("allowed_features") or {}
    for name, wanted in (("original", ORIGINAL), ("second_batch_approved", [n for n in NAMES if n not in ORIGINAL])):
        given = features.get(name) or []
        if given and set(given) != set(wanted):
            bad.append(f"allowed_features.{name}_mismatch")
    unknown = {x for given in features.values() for x in given or []} - set(NAMES)
    bad += [f"undefined_features:{','.join(sorted(unknown))}"] if unknown else []
    operators = config.get("allowed_operators")
    if operators is not None:
        extra, gone = set(operators) - OPERATORS.keys(), OPERATORS.keys() - set(operators)
        bad += [f"unapproved_operators:{','.join(sorted(extra))}"] * bool(extra) + [f"missing_operators:{','.join(sorted(gone))}"] * bool(gone)
    return bad


def scale(config: Mapping, seeds: int) -> list[str]:
    """Sections that ask for more than a draft may: candidates for each seed, full backtests. Mere references don't ask."""
    section = lambda name: s if isinstance(s := config.get(name), Mapping) and not {"status", "draft", "reference_only"} & s.keys() else {}
    bad, wanted, tests = [], section("generation").get("candidate_count"), section("full_backtest").get("limit")
    if seeds and wanted is not None:
        bad += [f"{name}:{wanted}" for name, times in (("large_scale_search_detected", 10), ("candidate_count_too_large", 20)) if wanted > times * seeds]
    return bad + ([f"large_backtest_limit:{tests}"] if isinstance(tests, (int, float)) and tests > 10 else [])


def seed_rules() -> list[Rule]:
    """When a seed record may not be used; a flag that is missing counts as not given."""
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    empty = lambda name: F.coalesce(F.col(name), F.lit("")) == ""
    kind = F.col("computability_class")
    return [
        Rule("seed_factor_requires_new_data", kind == "requires_new_data", "seed"), Rule("seed_factor_source_not_verified", ~flag("source_verified_by_firecrawl"), "seed"),
        Rule("seed_factor_not_suggested_for_second_batch", ~flag("suggested_for_second_batch_minimal_experiment"), "seed"), Rule("seed_factor_requires_new_external_data", flag("requires_new_external_data"), "seed"),
        Rule("seed_factor_unverified_computability", kind.isin("partial_source_candidate", "needs_source_verification"), "seed"), Rule("seed_factor_no_source", empty("source_title") & empty("source_url_or_path"), "seed"),
        Rule("seed_factor_requires_external_data", flag("requires_new_external_data"), "data"), Rule("seed_factor_requires_new_operator", flag("requires_new_operator"), "data"),
    ]


def strategy_rules() -> list[Rule]:
    return [Rule("operation_strategy_requires_new_engine", F.col("simulatability_class") == "requires_new_engine", "strategy")]


def breaches(records: DataFrame, rules: Iterable[Rule], name: str) -> DataFrame:
    """``rule`` and ``record``: every record under every rule that it breaks."""
    broken = F.array_compact(F.array(*[F.when(r.violated, F.lit(r.name)) for r in rules]))
    return records.select(F.coalesce(name, F.lit("unknown")).alias("record"), F.explode(broken).alias("rule")).select("rule", "record")


def failures(config: Mapping, seeds: DataFrame, strategies: DataFrame | None = None, most: int = 1000) -> list[str]:
    """All reasons against a round; of broken records ``most`` by name, and how many more there are."""
    n = seeds.filter("coalesce(seed_factor_id, '') <> ''").count()
    bad = settings(config) + scale(config, n) + (["seed_manifest_empty_or_unreadable"] if not n else [])
    found = breaches(seeds, seed_rules(), "seed_factor_id")
    if strategies is not None:
        found = found.unionByName(breaches(strategies, strategy_rules(), "strategy_id"))
    some = found.orderBy("rule", "record").limit(most + 1).collect()
    return bad + [f"{r['rule']}:{r['record']}" for r in some[:most]] + (["more_broken_records"] if len(some) > most else [])
