"""The factor language: prefix formulas over features, compiled to one column each.

``parse`` reads ``ADD(RET1,NEG(RET5))``; ``Formula`` checks, prints, hashes and canonicalises;
``columns`` compiles many formulas together, giving equal sub-formulas one column.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .features import NAMES, by_code, mean, std

MAX_TOKENS = 8
TINY = 1e-12


@dataclass(frozen=True)
class Operator:
    """A named function of columns; adding one to :data:`OPERATORS` extends the language."""

    name: str
    arity: int
    history: int
    build: Callable[..., Column]
    commutes: bool = False


def _decay(x: Column) -> Column:
    total = sum(range(1, 21))
    return sum((F.lag(x, 20 - i).over(by_code()) if i < 20 else x) * F.lit(i / total) for i in range(1, 21))


def _zscore(x: Column) -> Column:
    s = std(x, 20)
    return F.when(s > 1e-15, (x - mean(x, 20)) / s)


#: Names that formulas are written with.
OPERATORS = {o.name: o for o in (
    Operator("ADD", 2, 0, lambda a, b: a + b, True), Operator("SUB", 2, 0, lambda a, b: a - b), Operator("MUL", 2, 0, lambda a, b: a * b, True),
    Operator("DIV", 2, 0, lambda a, b: F.when(F.abs(b) > TINY, a / b)), Operator("NEG", 1, 0, lambda a: -a), Operator("ABS", 1, 0, F.abs), Operator("SIGN", 1, 0, F.signum),
    Operator("DELTA5", 1, 5, lambda a: a - F.lag(a, 5).over(by_code())), Operator("DECAY_LINEAR20", 1, 20, _decay), Operator("ZSCORE20", 1, 20, _zscore),
)}


@dataclass(frozen=True)
class Formula:
    tokens: tuple[str, ...]

    def problem(self) -> str | None:
        """Why the formula is not valid, or None."""
        if not self.tokens:
            return "empty_formula"
        if len(self.tokens) > MAX_TOKENS:
            return "formula_too_long"
        need = 1  # open places
        for t in self.tokens:
            if not need:
                return "trailing_tokens"
            if t not in OPERATORS and t not in NAMES:
                return f"unknown_token:{t}"
            need += OPERATORS[t].arity - 1 if t in OPERATORS else -1
        return "unexpected_end" if need else None

    def tree(self):
        """Nested (token, *arguments)."""
        rest = iter(self.tokens)

        def node():
            t = next(rest)
            return (t, *[node() for _ in range(OPERATORS[t].arity)]) if t in OPERATORS else (t,)

        return node()

    def text(self) -> str:
        why = self.problem()
        return f"INVALID:{why}:{' '.join(self.tokens)}" if why else _show(self.tree())

    def sha256(self) -> str:
        return hashlib.sha256(self.text().encode()).hexdigest()

    def features(self) -> list[str]:
        return sorted({t for t in self.tokens if t in NAMES})

    def canonical(self) -> Formula:
        """Arguments of ADD and MUL in the order of their text."""
        def sort(n):
            args = [sort(a) for a in n[1:]]
            if n[0] in OPERATORS and OPERATORS[n[0]].commutes:
                args.sort(key=_show)
            return (n[0], *args)

        return Formula(tuple(_flat(sort(self.tree()))))

    def trivial(self) -> bool:
        """SUB of a feature and itself."""
        return len(self.tokens) == 3 and self.tokens[0] == "SUB" and self.tokens[1] == self.tokens[2]


def _show(n) -> str:
    return n[0] + (f"({','.join(map(_show, n[1:]))})" if len(n) > 1 else "")


def _flat(n):
    yield n[0]
    for a in n[1:]:
        yield from _flat(a)


def parse(text: str) -> Formula:
    """Read ``NAME`` or ``NAME(argument, ...)``; raises ValueError at the first thing out of place."""
    words = re.findall(r"[A-Za-z_0-9]+|\S", text)
    out, at = [], 0

    def take(expected: str | None = None) -> str:
        nonlocal at
        word = words[at] if at < len(words) else ""
        if expected and word != expected or not word:
            raise ValueError(f"expected {expected or 'a name'} at {at}, found {word or 'the end'}")
        at += 1
        return word

    def expression() -> None:
        name = take()
        if name not in OPERATORS and name not in NAMES:
            raise ValueError(f"unknown_token:{name}")
        out.append(name)
        for i in range(OPERATORS[name].arity if name in OPERATORS else 0):
            take("," if i else "(")
            expression()
        if name in OPERATORS:
            take(")")

    expression()
    if at != len(words):
        raise ValueError("trailing_tokens")
    return Formula(tuple(out))


def compile_one(f: Formula) -> Column:
    why = f.problem()
    if why:
        raise ValueError(why)
    return _column(f.tree())


def _column(n) -> Column:
    return OPERATORS[n[0]].build(*map(_column, n[1:])) if n[0] in OPERATORS else F.col(n[0])


def columns(df: DataFrame, formulas: dict[str, Formula], given: dict[tuple, str] | None = None) -> DataFrame:
    """``df`` with a column for each formula. A sub-formula that several use is computed once.

    ``given``: trees whose values ``df`` has already, under these names.
    """
    given = given or {}
    seen: dict[tuple, int] = {}

    def count(n) -> None:
        seen[n] = seen.get(n, 0) + 1
        if seen[n] == 1 and n not in given:
            for a in n[1:]:
                count(a)

    trees = {k: f.tree() for k, f in formulas.items()}
    for t in trees.values():
        count(t)
    made: dict[tuple, str] = dict(given)

    def column(n) -> Column:
        if n in made:
            return F.col(made[n])
        return OPERATORS[n[0]].build(*map(column, n[1:])) if n[0] in OPERATORS else F.col(n[0])

    depth = lambda n: 1 + max(map(depth, n[1:]), default=0)
    kept = df.columns
    for n in sorted((n for n, c in seen.items() if c > 1 and len(n) > 1 and n not in given), key=lambda n: (depth(n), _show(n))):
        name = f"_shared_{len(made)}"  # no two trees share a number
        df = df.withColumn(name, column(n))
        made[n] = name
    return df.withColumns({k: column(t) for k, t in trees.items()}).select(*kept, *formulas)


def next_tokens(prefix: tuple[str, ...], cap: int = MAX_TOKENS) -> list[str]:
    """Tokens that can follow so that the formula can still be closed within ``cap`` tokens."""
    need = 1
    for t in prefix:
        need += OPERATORS[t].arity - 1 if t in OPERATORS else -1
    left = cap - len(prefix)
    if not need:
        return []
    return [t for t in (*NAMES, *OPERATORS) if need + (OPERATORS[t].arity - 1 if t in OPERATORS else -1) <= left - 1]


def draw(seed: int, n: int, cap: int = MAX_TOKENS) -> list[Formula]:
    """``n`` distinct random formulas, canonical, no trivial ones; the same for the same seed."""
    pick, out = random.Random(seed), {}
    while len(out) < n:
        tokens: tuple[str, ...] = ()
        while options := next_tokens(tokens, cap):
            tokens += (pick.choice(options),)
        f = Formula(tokens).canonical()
        if not f.trivial():
            out[f.text()] = f
    return list(out.values())


def mutate(parent: Formula, seed: int) -> Formula:
    """One token replaced by another of the same arity."""
    pick = random.Random(seed)
    at = pick.randrange(len(parent.tokens))
    t = parent.tokens[at]
    same = [x for x in (NAMES if t in NAMES else [o.name for o in OPERATORS.values() if o.arity == OPERATORS[t].arity]) if x != t]
    return Formula((*parent.tokens[:at], pick.choice(same), *parent.tokens[at + 1 :])).canonical()


def shallow() -> list[Formula]:
    """All features, one-argument operators of one and two-argument operators of two, without trivial and repeated ones."""
    out = {}
    for tokens in [*((n,) for n in NAMES), *((o.name, n) for o in OPERATORS.values() if o.arity == 1 for n in NAMES), *((o.name, a, b) for o in OPERATORS.values() if o.arity == 2 for a in NAMES for b in NAMES)]:
        f = Formula(tokens).canonical()
        if not f.trivial():
            out[f.text()] = f
    return list(out.values())
