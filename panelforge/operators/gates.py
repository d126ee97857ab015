"""Checks before a run: each returns what is wrong as a list of short reasons, none if all is well."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from panelforge.functions.formula import parse


def differences(name: str, wanted: Iterable, given: Iterable) -> list[str]:
    """Entries that are missing or extra."""
    wanted, given = set(wanted), set(given)
    return [f"{name}_missing:{x}" for x in sorted(wanted - given)] + [f"{name}_extra:{x}" for x in sorted(given - wanted)]


def dates_in_order(*bounds: tuple[str, str | None]) -> list[str]:
    """Named dates that must follow one another strictly; a missing one is a reason of its own."""
    bad = [f"{n}_missing" for n, d in bounds if not d]
    known = [(n, d) for n, d in bounds if d]
    return bad + [f"{b}_not_after_{a}" for (a, x), (b, y) in zip(known, known[1:], strict=False) if not x < y]


def splits(config: Mapping[str, Mapping[str, str]]) -> list[str]:
    """Train, validation and blind segments, each a range, one after the other without overlap."""
    return dates_in_order(*[(f"{s}_{e}", config.get(s, {}).get(e)) for s in ("train", "validation", "blind") for e in ("start", "end")])


def formulas(texts: Iterable[str], allowed_features: Iterable[str] | None = None, most: int | None = None) -> list[str]:
    """Formulas that can't be read, use other features, or are too many or twice the same."""
    texts, bad, seen = list(texts), [], set()
    if most is not None and len(texts) > most:
        bad.append(f"too_many_formulas:{len(texts)}")
    for text in texts:
        try:
            f = parse(text)
        except ValueError as error:
            bad.append(f"unreadable_formula:{text}:{error}")
            continue
        if allowed_features is not None:
            bad += [f"feature_not_allowed:{x}" for x in f.features() if x not in set(allowed_features)]
        key = f.canonical().text()
        if key in seen:
            bad.append(f"repeated_formula:{text}")
        seen.add(key)
    return bad


def ranges(config: Mapping, limits: Mapping[str, tuple[float, float]]) -> list[str]:
    """Numbers that are missing or outside their closed range."""
    bad = []
    for name, (low, high) in limits.items():
        value = config.get(name)
        if not isinstance(value, (int, float)) or isinstance(value, bool):
            bad.append(f"{name}_missing")
        elif not low <= value <= high:
            bad.append(f"{name}_out_of_range:{value}")
    return bad


def guardrails(config: Mapping, fixed: Mapping) -> list[str]:
    """Settings that must have exactly one value."""
    return [f"{k}_must_be:{v}" for k, v in fixed.items() if config.get(k) != v]


#: Limits of a research run's numbers, and settings that are not up to the caller.
LIMITS = {"rebalance_days": (1, 60), "top_n": (1, 200), "cost_bps": (0, 100), "cash": (1, 1e12)}
FIXED = {"unknown_limit_policy": "reject_trade"}


def research_run(config: Mapping) -> list[str]:
    """All reasons why a research run may not start."""
    known = {*LIMITS, *FIXED, "formulas", "features", "max_formulas", "splits", "seed"}
    return [
        *[f"unknown_setting:{k}" for k in sorted(set(config) - known)], *ranges(config, LIMITS), *guardrails(config, FIXED),
        *formulas(config.get("formulas", []), config.get("features"), config.get("max_formulas")), *(splits(config["splits"]) if "splits" in config else ["splits_missing"]),
    ]


def frozen(shortlist: list[dict], want_id: str, count: int, make_id) -> list[str]:
    """A frozen shortlist: its id, how many it holds, and that none is there twice."""
    hashes = [x["formula_hash"] for x in shortlist]
    bad = [] if make_id(shortlist) == want_id else ["shortlist_id_mismatch"]
    if len(hashes) != count:
        bad.append(f"shortlist_count:{len(hashes)}")
    return bad + (["shortlist_repeats"] if len(set(hashes)) < len(hashes) else [])
