"""The sixteen rolling features of an instrument, as columns over one window.

All share ``partition by ts_code order by trade_date``: one shuffle and one sort, whatever is asked
for, and unused ones are pruned. A rolling value is null until its frame is full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelforge.schema import require_columns

def by_code():
    """The window that all features share; made on demand, as it needs a session."""
    return Window.partitionBy("ts_code").orderBy("trade_date")


def frame(n: int):
    """The row and the ``n - 1`` before it."""
    return by_code().rowsBetween(-(n - 1), 0)


def full(x: Column, n: int, value: Column) -> Column:
    """``value`` where all ``n`` rows of the frame have ``x``."""
    return F.when(F.count(x).over(frame(n)) == n, value)


def mean(x: Column, n: int) -> Column:
    return full(x, n, F.avg(x).over(frame(n)))


def std(x: Column, n: int) -> Column:
    return full(x, n, F.stddev_pop(x).over(frame(n)))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def returns(k: int) -> Column:
    c = F.last("close", ignorenulls=True).over(by_code().rowsBetween(Window.unboundedPreceding, 0))
    return ratio(c, F.lag(c, k).over(by_code())) - 1


def _downside() -> Column:
    r = F.col("RET1")
    return F.when(r < 0, r).when(r.isNotNull(), 0.0)


def first_step() -> dict[str, Column]:
    out = {f"RET{k}": returns(k) for k in (1, 5, 20, 60, 120)}
    return out | {"VOL_RATIO20": ratio(F.col("volume"), mean(F.col("volume"), 20)) - 1}


def second_step() -> dict[str, Column]:
    """What starts from RET1 and VOL_RATIO20, and the moving averages."""
    out = {"VOLUME_WEIGHTED_RET": F.col("RET1") * (F.col("VOL_RATIO20") + 1)}
    out |= {f"RET_STD{n}": std(F.col("RET1"), n) for n in (20, 60)} | {f"DOWNSIDE_RET_STD{n}": std(_downside(), n) for n in (20, 60)}
    out |= {f"TREND{n}": ratio(F.col("close"), mean(F.col("close"), n)) - 1 for n in (20, 60, 120)}
    return out | {f"AMOUNT_MA{n}": mean(F.col("amount"), n) for n in (20, 60)}


#: Names that formulas are written with.
NAMES = ("RET1", "RET5", "RET20", "RET60", "RET120", "VOL_RATIO20", "VOLUME_WEIGHTED_RET", "RET_STD20", "RET_STD60", "DOWNSIDE_RET_STD20", "DOWNSIDE_RET_STD60", "TREND20", "TREND60", "TREND120", "AMOUNT_MA20", "AMOUNT_MA60")


def compute(bars: DataFrame, names=NAMES) -> DataFrame:
    """``bars`` with the named features."""
    require_columns(bars, ["trade_date", "ts_code", "close", "volume", "amount"])
    return bars.withColumns(first_step()).withColumns(second_step()).select(*bars.columns, *names)


def robust_z(df: DataFrame, names, min_count: int = 5, clip: float = 5.0) -> DataFrame:
    """Per date: (x - median) / (1.4826 MAD), clipped; null below ``min_count`` values or without spread."""
    day = Window.partitionBy("trade_date")
    df = df.withColumns({f"_m_{n}": F.median(n).over(day) for n in names})
    df = df.withColumns({f"_s_{n}": 1.4826 * F.median(F.abs(F.col(n) - F.col(f"_m_{n}"))).over(day) for n in names})
    z = {n: F.when((F.count(n).over(day) >= min_count) & (F.col(f"_s_{n}") > 0) & F.col(n).isNotNull(), F.greatest(F.lit(-clip), F.least(F.lit(clip), F.try_divide(F.col(n) - F.col(f"_m_{n}"), F.col(f"_s_{n}"))))) for n in names}
    return df.withColumns({f"{n}_z": c for n, c in z.items()}).drop(*[f"_{k}_{n}" for k in "ms" for n in names])
