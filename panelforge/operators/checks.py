"""Many rules over one table, judged in a single pass.

Each rule says when a row violates it. One aggregate counts the violations of all rules and keeps
the first and the last violator of each. What was read and how long it took is observed on the side.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F


@dataclass(frozen=True)
class Rule:
    """``violated`` is true for rows that break the rule; null counts as kept. ``group`` says what the rule is about."""

    name: str
    violated: Column
    group: str = ""


def judged(rows: DataFrame, rules: list[Rule], sample: list[str]) -> DataFrame:
    """``rule``, ``rule_group``, ``violations``, ``first``, ``last``: for every rule, with the first and last violator (as text of ``sample``)."""
    place = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sample])
    own = rows.select(place.alias("_at"), *[F.coalesce(r.violated, F.lit(False)).alias(f"_r{i}") for i, r in enumerate(rules)])
    at = lambda i: F.when(F.col(f"_r{i}"), F.col("_at"))
    one = own.agg(*[f(x).alias(f"_{k}{i}") for i in range(len(rules)) for k, f, x in (("n", F.count_if, F.col(f"_r{i}")), ("a", F.min, at(i)), ("b", F.max, at(i)))])
    each = [F.struct(F.lit(r.name).alias("rule"), F.lit(r.group).alias("rule_group"), F.col(f"_n{i}").alias("violations"), F.col(f"_a{i}").alias("first"), F.col(f"_b{i}").alias("last")) for i, r in enumerate(rules)]
    return one.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def profiled(df: DataFrame, action: Callable[[DataFrame], object]) -> tuple[object, dict]:
    """What ``action`` makes of ``df``, and the rows that passed and the seconds it took."""
    seen = Observation()
    began = time.monotonic()
    out = action(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return out, {"rows": seen.get["rows"], "seconds": time.monotonic() - began}


def first_failures(found: DataFrame) -> list[str]:
    """``rule:violations:first`` of the rules that are broken; one row a rule."""
    return [f"{r['rule']}:{r['violations']}:{r['first']}" for r in found.filter("violations > 0").orderBy("rule").collect()]
