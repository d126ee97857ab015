"""Factor values and results that are kept under what they were computed from.

A value is named by the hash of its formula's canonical text and the hash of the panel's content,
a result also by the settings it was computed with. So the same formula is found again by any later
plan or run, however it was written, and a panel that has changed finds nothing. Sub-formulas that
look back over days are kept like formulas and spare their windows in formulas around them.

Values that are computed together are one table with a row a key and a column a formula: a key is
stored and shuffled once, not once a formula, and a reader scans only the columns it asks for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelforge.functions import features
from panelforge.functions.formula import OPERATORS, Formula, columns
from panelforge.lineage import own_shuffles
from panelforge.schema import KEY
from panelforge.sources.sinks import content_hash, stable_hash
from panelforge.sources.versions import Versions

#: What a formula can be computed from.
INPUTS = ("close", "volume", "amount")
#: Rows of a key and formula that a task should get.
TASK_ROWS = 250_000
_VALUES = "formula string, trade_date string, ts_code string, factor_value double"


def named(f: Formula) -> str:
    """The hash under which a formula's values are kept: of the canonical text."""
    return f.canonical().sha256()


def _column(h: str) -> str:
    return f"f_{h}"


def _long(wide: DataFrame, names: dict[str, str], carry: tuple[str, ...], deal: str | None, rows: int | None = None) -> DataFrame:
    """A row a key and formula, of columns by hash; ``names``: the hash of each formula.

    Of ``rows`` keys as many are dealt to a task as become :data:`TASK_ROWS`, so that sorts behind
    don't spill: by the bytes that are shuffled a task would get too many.
    """
    if deal and rows is None:
        wide = wide.repartition(deal)
    elif deal:
        wide = wide.repartition(max(wide.sparkSession.sparkContext.defaultParallelism, -(-rows * len(names) // TASK_ROWS)), deal)
    pairs = F.array(*[F.struct(F.lit(k).alias("formula"), F.col(_column(h)).alias("factor_value")) for k, h in names.items()])
    return wide.select(*KEY, *carry, F.explode(pairs).alias("x")).select("x.formula", *KEY, "x.factor_value", *carry)


def looks_back(f: Formula) -> list[Formula]:
    """Sub-formulas, the formula itself left out, whose operator needs earlier days."""
    out, seen = [], set()

    def walk(n) -> list[str]:
        tokens = [n[0], *[t for a in n[1:] for t in walk(a)]]
        part = Formula(tuple(tokens))
        if n is not top and n[0] in OPERATORS and OPERATORS[n[0]].history and part.text() not in seen:
            seen.add(part.text())
            out.append(part)
        return tokens

    top = f.canonical().tree()
    walk(top)
    return out


class FactorStore(Versions):
    """Values and results of formulas over panels of daily bars (trade_date, ts_code, close, volume, amount)."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder)
        #: what the last call found and what it computed: names of formulas (and of parts)
        self.found: list[str] = []
        self.computed: list[str] = []

    @staticmethod
    def panel_hash(bars: DataFrame) -> str:
        """Of what formulas can see; rows in any order. One scan."""
        with own_shuffles(bars.sparkSession):
            return content_hash(bars.select(*KEY, *INPUTS))

    def _kept(self, kind: str, panel: str) -> dict[str, dict]:
        return {k.removeprefix(f"{panel}/"): v for k, v in self.manifest().get(kind, {}).items() if k.startswith(f"{panel}/")}

    def _keep(self, kind: str, panel: str, hashes: list[str], df: DataFrame, by: str | None = None) -> str:
        """One staged table for all ``hashes``, and its path; of a hash that another writer has kept meanwhile, that writer's stays."""
        with own_shuffles(self.spark):
            entry, used = self.stage(df, by), False

        def make(parent: int):
            nonlocal used
            before = self.manifest(parent)
            own = before.get(kind, {})
            fresh = {k: entry for h in hashes if (k := f"{panel}/{h}") not in own}
            used = bool(fresh)
            return (before | {kind: own | fresh}, []) if fresh else None  # staged once for all tries

        try:
            self.change(make)
        except BaseException:
            used = False
            raise
        finally:
            if not used:
                self.abort([entry])
        return entry["path"]

    def _read(self, kept: dict[str, dict], hashes: list[str], schema: str) -> DataFrame:
        """Rows of these hashes: only their folders are read."""
        by_path: dict[str, list[str]] = {}
        for h in hashes:
            by_path.setdefault(kept[h]["path"], []).append(h)
        out = self.spark.createDataFrame([], schema)
        for path, some in by_path.items():
            out = out.unionByName(self.spark.read.schema(schema).parquet(path).filter(F.col("formula_hash").isin(some)))
        return out

    def _computed(self, bars: DataFrame, made: dict[str, Formula], given: dict[str, Formula], kept: dict[str, dict], carry: tuple[str, ...] = ()) -> DataFrame:
        """A column for each of the formulas ``made``, in one plan; ``given`` are kept parts of theirs, ``carry`` columns of ``bars`` that go along."""
        needed = sorted({n for f in made.values() for n in f.features()})
        panel = features.compute(bars.select(*KEY, *INPUTS, *carry), needed).drop(*INPUTS)
        for h in given:
            own = self.spark.read.parquet(kept[h]["path"]).select(*KEY, F.col(_column(h)).alias(f"p_{h}"))
            panel = panel.join(own, KEY, "left")
        wide = columns(panel, {_column(h): f for h, f in made.items()}, {p.tree(): f"p_{h}" for h, p in given.items()})
        return wide.select(*KEY, *carry, *[F.col(_column(h)).cast("double").alias(_column(h)) for h in made])

    def values(self, bars: DataFrame, formulas: dict[str, Formula], panel: str | None = None, parts: bool = True, carry: tuple[str, ...] = (), deal: str | None = None) -> DataFrame:
        """``formula``, ``trade_date``, ``ts_code``, ``factor_value``: read where kept, else computed in one plan and kept.

        ``panel``: the panel's hash, if known. ``parts``: whether sub-formulas are kept too. ``carry``:
        columns of ``bars`` that go along; they lie beside what is computed now, what was kept before
        is joined with ``bars``. ``deal``: a column by which keys are dealt out before they become a
        row a formula.
        """
        panel = panel or self.panel_hash(bars)
        kept = self._kept("columns", panel)
        hashes = {k: named(f) for k, f in formulas.items()}
        wanted = {named(f): f.canonical() for f in formulas.values()}
        new = {h: f for h, f in wanted.items() if h not in kept}
        inner = {named(p): p for f in new.values() for p in looks_back(f)} if parts else {}
        given = {h: p for h, p in inner.items() if h in kept}
        made = new | {h: p for h, p in inner.items() if h not in kept}
        self.found = sorted(f.text() for h, f in wanted.items() if h in kept) + sorted(p.text() for p in given.values())
        self.computed = sorted(f.text() for f in made.values())
        fresh = None
        if made:
            fresh = self._keep("columns", panel, list(made), self._computed(bars, made, given, kept, carry))
            kept = self._kept("columns", panel)
        by_path: dict[str, dict[str, str]] = {}
        for k, h in hashes.items():
            by_path.setdefault(kept[h]["path"], {})[k] = h
        out = None
        for path, names in by_path.items():
            wide = self.spark.read.parquet(path).select(*KEY, *(carry if path == fresh else ()), *map(_column, sorted(set(names.values()))))
            if carry and path != fresh:
                wide = wide.join(bars.select(*KEY, *carry), KEY)
            some = _long(wide, names, carry, deal, next(kept[h]["rows"] for h in names.values()))
            out = some if out is None else out.unionByName(some)
        return self.spark.createDataFrame([], _VALUES).join(bars.select(*KEY, *carry), KEY) if out is None else out

    def results(
        self, bars: DataFrame, formulas: dict[str, Formula], settings: dict, evaluate: Callable[[DataFrame], DataFrame], panel: str | None = None, carry: tuple[str, ...] | None = None,
        keep: bool = False, deal: str | None = None,
    ) -> DataFrame:
        """What ``evaluate`` says about each formula, with ``from_store``: whether it was known before.

        ``evaluate`` takes the values of the formulas that aren't known and returns rows with their
        ``formula``; it is called once for all of them, and not at all if all are known. ``settings``
        are what its answer depends on besides. With ``carry`` these columns of ``bars`` go along with
        the values, which aren't kept then unless ``keep`` says so. ``deal``: as in :meth:`values`.
        """
        panel = panel or self.panel_hash(bars)
        own = f"{panel}/{stable_hash(settings)}"
        kept = self._kept("results", own)
        hashes = {k: named(f) for k, f in formulas.items()}
        first = {h: k for k, h in reversed(hashes.items())}
        new = {k: formulas[k] for h, k in first.items() if h not in kept}
        known = sorted(h for h in first if h in kept)
        if new:
            labels = self.spark.createDataFrame([(k, hashes[k]) for k in new], "formula string, formula_hash string")
            if carry is None or keep:
                values = self.values(bars, new, panel, carry=carry or (), deal=deal)
            else:
                self.computed = sorted(f.canonical().text() for f in new.values())
                wide = self._computed(bars, {hashes[k]: f.canonical() for k, f in new.items()}, {}, {}, carry)
                values = _long(wide, {k: hashes[k] for k in new}, carry, deal)
            rows = evaluate(values).join(F.broadcast(labels), "formula").drop("formula")  # one row a formula
            self._keep("results", own, [hashes[k] for k in new], rows, "formula_hash")
            kept = self._kept("results", own)
        else:
            self.computed = []
        self.found = sorted(k for k, h in hashes.items() if h in known)
        schema = self.spark.read.parquet(kept[next(iter(first))]["path"]).schema
        labels = self.spark.createDataFrame([(k, h, h in known) for k, h in hashes.items()], "formula string, formula_hash string, from_store boolean")
        out = self._read(kept, list(first), schema)
        return out.join(F.broadcast(labels), "formula_hash").drop("formula_hash")  # one row a formula
