"""SQLite tables as a Spark data source: ranges of a key are read in parallel, filters reach the database.

    spark.dataSource.register(SqliteRanges)
    spark.read.format("sqlite_ranges").option("path", file).option("table", "daily_price").option("key", "trade_date").load()

The file must be at ``path`` on every executor, or in a folder that all share, and is opened
read-only. Other options: ``parts`` (8), ``batch`` (rows at a time, 10,000), ``progress`` (a shared
folder in which every finished part leaves its rows and their hash).
"""

from __future__ import annotations

import hashlib
import json
import os
import sqlite3
import uuid
from contextlib import closing
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

#: What a declared type's name holds, and the Spark type it stands for, in the database's order of looking.
_AFFINITY = (("INT", "long"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"))
_COMPARE = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}
_ARROW = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary()}


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"{Path(path).absolute().as_uri()}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _spark_type(declared: str) -> str:
    return next((kind for part, kind in _AFFINITY if part in declared.upper()), "double" if declared else "binary")


def row_hash(row: tuple) -> int:
    """128 bits of a row; the sum over rows doesn't depend on their order."""
    return int.from_bytes(hashlib.sha256(json.dumps(row, default=lambda b: b.hex(), separators=(",", ":")).encode()).digest()[:16], "big")


@dataclass
class KeyRange(ds.InputPartition):
    """Rows with ``low`` <= key < ``high``; no bound is open, and the first range has the rows without a key."""

    number: int
    low: object
    high: object

    def __post_init__(self):
        super().__init__(self.number)


class SqliteReader(ds.DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.path, self.table, self.key = options["path"], options["table"], options.get("key", "rowid")
        self.parts, self.batch, self.progress = int(options.get("parts", 8)), int(options.get("batch", 10_000)), options.get("progress")
        self.fields = [(f.name, f.dataType.simpleString()) for f in schema.fields]
        self.conditions: list[str] = []
        self.values: list = []

    def pushFilters(self, filters):
        """Comparisons of a column with a value of its kind, lists of such values and null checks are the database's."""
        kinds = dict(self.fields)
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            kind = kinds.get(name)
            fits = lambda v, kind=kind: isinstance(v, str) if kind == "string" else isinstance(v, (int, float)) and not isinstance(v, bool) and kind in ("bigint", "int", "double")
            if kind is None:
                yield f
            elif type(f) in _COMPARE and fits(f.value):
                self.conditions.append(f"{_quoted(name)} {_COMPARE[type(f)]} ?")
                self.values.append(f.value)
            elif isinstance(f, ds.In) and f.value and all(map(fits, f.value)):
                self.conditions.append(f"{_quoted(name)} IN ({', '.join('?' * len(f.value))})")
                self.values += f.value
            elif isinstance(f, (ds.IsNull, ds.IsNotNull)):
                self.conditions.append(f"{_quoted(name)} IS {'NOT ' * isinstance(f, ds.IsNotNull)}NULL")
            else:
                yield f

    def _where(self, *more: str) -> str:
        every = [*self.conditions, *more]
        return f" WHERE {' AND '.join(every)}" if every else ""

    def _key(self) -> str:
        return "rowid" if self.key == "rowid" else _quoted(self.key)

    def partitions(self):
        """Bounds at equal numbers of the rows that pass the filters; few different keys make fewer parts."""
        key, where = self._key(), self._where(f"{self._key()} IS NOT NULL")
        with closing(_open(self.path)) as con:
            n = con.execute(f"SELECT count(*) FROM {_quoted(self.table)}{where}", self.values).fetchone()[0]
            at = sorted({n * i // self.parts for i in range(1, self.parts)} - {0})
            found = [con.execute(f"SELECT {key} FROM {_quoted(self.table)}{where} ORDER BY {key} LIMIT 1 OFFSET ?", [*self.values, i]).fetchone()[0] for i in at]
        bounds = sorted(set(found))
        return [KeyRange(i, low, high) for i, (low, high) in enumerate(zip([None, *bounds], [*bounds, None], strict=True))]

    def read(self, partition: KeyRange):
        key, more, values = self._key(), [], list(self.values)
        if partition.low is not None:
            more.append(f"{key} >= ?")
            values.append(partition.low)
        if partition.high is not None:
            more.append(f"{key} < ?" if partition.low is not None else f"({key} < ? OR {key} IS NULL)")
            values.append(partition.high)
        rows = total = 0
        names, kinds = [n for n, _ in self.fields], [_ARROW[k] for _, k in self.fields]
        with closing(_open(self.path)) as con:
            cursor = con.execute(f"SELECT {', '.join(map(_quoted, names)) or '1'} FROM {_quoted(self.table)}{self._where(*more)}", values)
            while some := cursor.fetchmany(self.batch):
                rows += len(some)
                if self.progress:
                    total += sum(map(row_hash, some))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names)
        if self.progress:
            self._done(partition.number, {"rows": rows, "hash": f"{total % (1 << 128):032x}"})

    def _done(self, number: int, what: dict) -> None:
        """A file for the part, replaced as a whole: a task that runs again says the same."""
        own = Path(self.progress) / f".{uuid.uuid4().hex}"
        own.parent.mkdir(parents=True, exist_ok=True)
        own.write_text(json.dumps(what))
        os.replace(own, own.with_name(f"part-{number}.json"))


class SqliteRanges(ds.DataSource):
    @classmethod
    def name(cls):
        return "sqlite_ranges"

    def schema(self):
        with closing(_open(self.options["path"])) as con:
            found = con.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not found:
            raise ValueError(f"no table {self.options['table']}")
        return ", ".join(f"`{name}` {_spark_type(kind)}" for _, name, kind, *_ in found)

    def reader(self, schema):
        return SqliteReader(schema, dict(self.options))


def read(spark: SparkSession, path: str, table: str, schema: str | None = None, **options) -> DataFrame:
    """The table; only the columns of ``schema`` (all, if none is given) are asked for, and filters on it reach the database."""
    spark.dataSource.register(SqliteRanges)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("sqlite_ranges").option("path", path).option("table", table)
    return (reader.schema(schema) if schema else reader).options(**options).load()


def progress(folder: str) -> dict:
    """Parts that have finished, their rows, and the hash of all rows."""
    done = [json.loads(p.read_text()) for p in Path(folder).glob("part-*.json")]
    return {"parts": len(done), "rows": sum(d["rows"] for d in done), "hash": f"{sum(int(d['hash'], 16) for d in done) % (1 << 128):032x}"}
