"""Schemas and the rules for missing values: null means missing, NaN is never stored."""

from pyspark.sql import Column, DataFrame, functions as F

BAR = "trade_date string, ts_code string, open double, high double, low double, close double, raw_open double, raw_high double, raw_low double, raw_close double, pre_close double, volume double, amount double"
KEY = ["trade_date", "ts_code"]


def require_columns(df: DataFrame, names) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")


def finite(c: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
