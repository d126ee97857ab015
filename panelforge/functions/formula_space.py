"""All formulas up to a number of tokens, numbered: counts of completions, formulas of numbers and back.

A formula is a sequence of tokens that opens and closes places: an operator of k arguments closes
one and opens k. How many sequences of a length close so many places follows by recursion, and
these counts turn a number into a formula without walking over those before it. So attempts are a
column of numbers, and drawing, writing and deduplicating formulas are a scan and a shuffle.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .features import NAMES
from .formula import MAX_TOKENS, OPERATORS, Formula

#: Tokens by their number of arguments, then as the language lists them.
BY_ARITY = [list(NAMES), *[[o.name for o in OPERATORS.values() if o.arity == k] for k in (1, 2)]]
TOKENS = [t for some in BY_ARITY for t in some]
ARITY = np.array([k for k, some in enumerate(BY_ARITY) for _ in some])
_FIRST = np.cumsum([0, *map(len, BY_ARITY)])


@cache
def completions(cap: int = MAX_TOKENS) -> np.ndarray:
    """[places, tokens]: how many sequences of exactly so many tokens close so many places."""
    out = np.zeros((cap + 3, cap + 1), np.int64)
    out[0, 0] = 1
    for n in range(1, cap + 1):
        for places in range(1, cap + 1):
            out[places, n] = sum(len(some) * out[places - 1 + k, n - 1] for k, some in enumerate(BY_ARITY))
    return out


def size(cap: int = MAX_TOKENS) -> int:
    """How many formulas have at most ``cap`` tokens."""
    return int(completions(cap)[1].sum())


def formulas_at(numbers: np.ndarray, cap: int = MAX_TOKENS) -> np.ndarray:
    """[number, place] of token indices, -1 behind a formula's end; shorter formulas have smaller numbers."""
    count = completions(cap)
    ends = np.cumsum(count[1])
    left = np.searchsorted(ends, numbers, "right")  # tokens still to come
    rest = numbers - (ends[left] - count[1, left])
    places = np.ones(len(numbers), np.int64)
    out = np.full((len(numbers), cap), -1, np.int64)
    for at in range(cap):
        todo = left > 0
        for k, some in enumerate(BY_ARITY):
            each = count[places - 1 + k, left - 1]
            here = todo & (rest < len(some) * each)
            out[here, at] = _FIRST[k] + rest[here] // each[here]
            rest = np.where(here, rest % np.maximum(each, 1), np.where(todo, rest - len(some) * each, rest))
            places, left = np.where(here, places - 1 + k, places), np.where(here, left - 1, left)
            todo &= ~here
    return out


def number_of(tokens: tuple[str, ...], cap: int = MAX_TOKENS) -> int:
    """The number of a formula: the inverse of :func:`formulas_at`."""
    count, places, left = completions(cap), 1, len(tokens)
    out = int(count[1, :left].sum())
    for t in tokens:
        i = TOKENS.index(t)
        k = int(ARITY[i])
        out += sum(len(some) * int(count[places - 1 + j, left - 1]) for j, some in enumerate(BY_ARITY[:k])) + (i - int(_FIRST[k])) * int(count[places - 1 + k, left - 1])
        places, left = places - 1 + k, left - 1
    return out


def formulas(numbered: DataFrame, number: str, cap: int = MAX_TOKENS) -> DataFrame:
    """``numbered`` with the formula of each number: ``formula_text`` (canonical), ``formula_hash``, ``trivial``.

    Numbers run from 0 to :func:`size`; others and null give nulls.
    """
    most = size(cap)

    def run(batches):
        for b in batches:
            given = b.column(b.schema.get_field_index(number)).to_pylist()
            ok = [i for i, x in enumerate(given) if x is not None and 0 <= x < most]
            columns = [[None] * len(given) for _ in range(3)]
            for i, row in zip(ok, formulas_at(np.array([given[i] for i in ok], np.int64), cap), strict=True):
                f = Formula(tuple(TOKENS[t] for t in row if t >= 0)).canonical()
                columns[0][i], columns[1][i], columns[2][i] = f.text(), f.sha256(), f.trivial()
            kinds = (pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], [*b.schema.names, "formula_text", "formula_hash", "trivial"])

    schema = ", ".join(f"`{n}` {t}" for n, t in numbered.dtypes)
    return numbered.mapInArrow(run, f"{schema}, formula_text string, formula_hash string, trivial boolean")


def drawn_number(attempt: Column, seed: int, cap: int = MAX_TOKENS) -> Column:
    """The number that an attempt draws: equally likely over all formulas, the same on every run."""
    return F.pmod(F.xxhash64(attempt, F.lit(seed)), F.lit(size(cap)))


def distinct_formulas(attempts: DataFrame, attempt: str, number: str, cap: int = MAX_TOKENS) -> DataFrame:
    """Each formula that attempts draw, once: ``formula_hash``, ``formula_text``, ``first_attempt``, ``attempts``; trivial ones left out."""
    made = formulas(attempts.select(attempt, number), number, cap).filter("not trivial")
    return made.groupBy("formula_hash").agg(F.min("formula_text").alias("formula_text"), F.min(attempt).alias("first_attempt"), F.count("*").alias("attempts"))
