"""What a research run reads, behind one interface, and the same kept in memory."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame

from . import bars as src


class Provider(Protocol):
    """Sources of a run; dates are closed ranges of yyyyMMdd."""

    def bars(self, start: str, end: str) -> DataFrame: ...

    def calendar(self, start: str, end: str) -> DataFrame: ...

    def limits(self, start: str, end: str) -> DataFrame: ...


class Tables:
    """The provider over a directory of the star-schema tables."""

    def __init__(self, spark, sf_dir: str):
        self._panel = src.bars(spark, sf_dir)

    def bars(self, start: str, end: str) -> DataFrame:
        return src.scan_bars(self._panel, start, end)

    def calendar(self, start: str, end: str) -> DataFrame:
        return src.calendar(self.bars(start, end))

    def limits(self, start: str, end: str) -> DataFrame:
        return src.limits(self.bars(start, end))


class Cached(Tables):
    """One range of another provider, loaded once; narrower ranges are cut from it."""

    def __init__(self, provider: Provider, start: str, end: str):
        self.start, self.end = start, end
        self._panel = provider.bars(start, end).persist()

    def bars(self, start: str, end: str) -> DataFrame:
        if start < self.start or end > self.end:
            raise ValueError(f"{start}-{end} is not within {self.start}-{self.end}")
        return super().bars(start, end)

    def close(self) -> None:
        self._panel.unpersist()
