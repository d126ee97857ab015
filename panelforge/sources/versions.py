"""Versions of tables in a folder: data is staged, and a version is one manifest that appears at once.

``data/<id>`` holds Parquet tables, ``versions/<n>.json`` says which of them make up version n. A
reader sees the newest manifest or an older one it asks for. A writer stages its data first, under
names of its own, and then creates the next manifest, which only one writer can: the others start
anew from what has become the newest version. A job that is killed before its commit leaves the old
version as it was, and some staged data that :meth:`Versions.sweep` removes.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelforge.operators import tables


class Conflict(RuntimeError):
    """Another writer was faster every time."""


class Versions:
    """Manifests of one folder, on any file system that Spark knows.

    Creating a manifest needs a file system whose rename doesn't replace a file (HDFS) or links
    (local and network disks); a plain object store has neither.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        for name in ("data", "versions"):
            self.fs.mkdirs(self._path(f"{self.folder}/{name}"))

    def numbers(self) -> list[int]:
        """All versions, oldest first."""
        found = self.fs.listStatus(self._path(f"{self.folder}/versions"))
        return sorted(int(n[:-5]) for s in found if (n := s.getPath().getName()).endswith(".json") and n[:-5].isdigit())

    def newest(self) -> int:
        return max(self.numbers(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """What version ``version`` (the newest) is made of; version 0 is empty."""
        version = self.newest() if version is None else version
        if not version:
            return {}
        stream = self.fs.open(self._path(f"{self.folder}/versions/{version}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def stage(self, df: DataFrame, by: str | None = None) -> dict:
        """Write ``df`` where no version refers to yet: its ``path``, ``bytes`` and ``rows``. Nothing stays of a write that fails."""
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        try:
            (df.write.partitionBy(by) if by else df.write).parquet(path)
        except BaseException:
            self.fs.delete(self._path(path), True)
            raise
        size = self.fs.getContentSummary(self._path(path)).getLength()
        return {"path": path, "bytes": size, "rows": self.spark.read.parquet(path).count()}

    def abort(self, staged: list[dict]) -> None:
        for entry in staged:
            self.fs.delete(self._path(entry["path"]), True)

    def commit(self, parent: int, manifest: dict) -> bool:
        """Make ``manifest`` the version behind ``parent``; false if another writer has made that one."""
        text = json.dumps(manifest | {"version": parent + 1, "parent": parent}, sort_keys=True)
        own, final = f"{self.folder}/versions/.{uuid.uuid4().hex}", f"{self.folder}/versions/{parent + 1}.json"
        stream = self.fs.create(self._path(own), False)
        stream.write(bytearray(text.encode()))
        stream.hsync()
        stream.close()
        try:
            if self.fs.getUri().getScheme() == "file":
                os.link(self._local(own), self._local(final))
                return True
            return not self.fs.exists(self._path(final)) and self.fs.rename(self._path(own), self._path(final))
        except FileExistsError:
            return False
        finally:
            self.fs.delete(self._path(own), False)

    @staticmethod
    def _local(path: str) -> str:
        return unquote(urlparse(path).path) if path.startswith("file:") else path

    def change(self, make: Callable[[int], tuple[dict, list[dict]] | None], tries: int = 30) -> int:
        """Commit what ``make`` stages for a version: (manifest, staged), or None if nothing changes. Returns the newest version.

        A writer that comes too late drops what it staged and asks ``make`` again.
        """
        for turn in range(tries):
            parent = self.newest()
            made = make(parent)
            if made is None:
                return parent
            manifest, staged = made
            if self.commit(parent, manifest):
                return parent + 1
            self.abort(staged)
            time.sleep(0.05 * turn)
        raise Conflict(f"{self.folder}: {tries} times another version came first")

    def sweep(self, older_than_s: float = 86_400.0) -> int:
        """Delete data that no version refers to and that is older than any running writer; returns how many tables."""
        named = {p for n in self.numbers() for p in _paths(self.manifest(n))}
        now, gone = time.time() * 1000, 0
        for s in self.fs.listStatus(self._path(f"{self.folder}/data")):
            name = s.getPath().getName()
            if not any(p.endswith(f"/{name}") for p in named) and now - s.getModificationTime() >= older_than_s * 1000:
                gone += bool(self.fs.delete(s.getPath(), True))
        return gone


def _paths(value) -> list[str]:
    """All values under the key ``path``."""
    if isinstance(value, dict):
        return [v for k, v in value.items() if k == "path"] + [p for v in value.values() for p in _paths(v)]
    return [p for v in value for p in _paths(v)] if isinstance(value, list) else []


class Table(Versions):
    """A keyed table of layers: rows added, rows that replace those of their keys, keys that are hidden.

    A change writes only its own rows. ``compact`` writes one layer again.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], schema: str):
        super().__init__(spark, folder)
        self.keys, self.schema = keys, schema

    def read(self, version: int | None = None) -> DataFrame:
        out = self.spark.createDataFrame([], self.schema)
        for layer in self.manifest(version).get("layers", []):
            rows = self.spark.read.schema(self.schema).parquet(layer["path"])
            if layer["kind"] == "hide":
                out = out.join(rows.select(*self.keys), self.keys, "left_anti")
            elif layer["kind"] == "replace":
                out = tables.upsert(out, rows, self.keys)
            else:
                out = out.unionByName(rows)
        return out

    def _layer(self, kind: str, what: str, rows: Callable[[DataFrame], DataFrame], fresh: bool = False) -> int:
        """A version with one more layer, made from what is the newest when it is committed; none without rows."""

        def make(parent: int):
            entry = self.stage(rows(self.read(parent)))
            if not entry["rows"]:
                self.abort([entry])
                return None
            before = [] if fresh else self.manifest(parent).get("layers", [])
            return {"layers": [*before, entry | {"kind": kind}], "what": what}, [entry]

        return self.change(make)

    def _own(self, new: DataFrame) -> DataFrame:
        return new.select(*self.spark.createDataFrame([], self.schema).columns)

    def insert_missing(self, new: DataFrame) -> int:
        """Rows whose key isn't there; of a key that comes several times the first row in order of all columns."""
        rows = tables.first_of(self._own(new), self.keys, self._own(new).columns)
        return self._layer("add", "insert", lambda old: rows.join(old, self.keys, "left_anti"))

    def append_unique(self, new: DataFrame, payload: str) -> int:
        """As :meth:`insert_missing`, but a key that has come with another payload fails the change."""
        return self._layer("add", "append", lambda old: tables.new_rows(old, self._own(new), self.keys, payload))

    def upsert(self, new: DataFrame) -> int:
        """Rows replace those of their keys; rows that are there as they are make no version."""
        rows = tables.first_of(self._own(new), self.keys, self._own(new).columns)
        return self._layer("replace", "upsert", lambda old: rows.exceptAll(old.join(rows.select(*self.keys), self.keys, "left_semi")))

    def quarantine(self, keys: DataFrame) -> int:
        """Rows of these keys are in no later version, until they are written again."""
        return self._layer("hide", "quarantine", lambda old: old.join(keys.select(*self.keys).distinct(), self.keys, "left_semi"))

    def compact(self) -> int:
        """The same rows as one layer; only if there are several."""
        if len(self.manifest().get("layers", [])) < 2:
            return self.newest()
        return self._layer("add", "compact", lambda old: old, fresh=True)

    def history(self) -> list[dict]:
        """Version, what was done, and rows written, oldest first."""
        made = [(n, self.manifest(n)) for n in self.numbers()]
        return [{"version": n, "what": m["what"], "rows": m["layers"][-1]["rows"]} for n, m in made]


class Tasks(Table):
    """Tasks of a run that several drivers share: each task is claimed by one of them, and its state outlives all of them."""

    #: States of a task.
    STATES = ("pending", "running", "completed", "failed", "interrupted")

    def __init__(self, spark: SparkSession, folder: str, config: str):
        super().__init__(spark, folder, ["task"], "task string, state string, owner string, detail string, config string")
        self.config = config
        other = self.read().filter(F.col("config") != config).limit(1).collect()
        if other:
            raise ValueError(f"{folder} belongs to another configuration")

    def add(self, tasks: DataFrame) -> int:
        """Tasks (``task``) that aren't there yet are pending."""
        none = F.lit(None).cast("string")
        return self.insert_missing(tasks.select("task", F.lit("pending").alias("state"), none.alias("owner"), none.alias("detail"), F.lit(self.config).alias("config")))

    def claim(self, owner: str, most: int = 1) -> list[str]:
        """Up to ``most`` tasks that nobody has, in order of their names: from now on running, of ``owner``."""
        before = self.newest()
        free = lambda old: old.filter(F.col("state").isin("pending", "interrupted")).orderBy("task").limit(most).withColumns({"state": F.lit("running"), "owner": F.lit(owner)})
        version = self._layer("replace", f"claim:{owner}", free)
        if version == before:
            return []
        path = self.manifest(version)["layers"][-1]["path"]
        return sorted(r["task"] for r in self.spark.read.schema(self.schema).parquet(path).select("task").collect() if self.manifest(version)["what"] == f"claim:{owner}")

    def finish(self, task: str, state: str, detail: str | None = None) -> int:
        """The end of a running task, or that it was interrupted."""
        if state not in self.STATES:
            raise ValueError(f"unknown state: {state}")
        end = lambda old: old.filter((F.col("task") == task) & (F.col("state") == "running")).withColumns({"state": F.lit(state), "detail": F.lit(detail).cast("string")})
        return self._layer("replace", f"{state}:{task}", end)

    def release(self, owner: str) -> int:
        """What an owner that is gone was running may be claimed again."""
        return self._layer("replace", f"release:{owner}", lambda old: old.filter((F.col("owner") == owner) & (F.col("state") == "running")).withColumn("state", F.lit("interrupted")))

    def run(self, owner: str, work: Callable[[str], str | None], most: int = 1) -> None:
        """Claim and do tasks until none is free; one that fails is marked and the others go on."""
        while some := self.claim(owner, most):
            for task in some:
                try:
                    detail = work(task)
                except Exception as error:  # a task's failure is its result
                    self.finish(task, "failed", f"{type(error).__name__}: {error}")
                else:
                    self.finish(task, "completed", detail)


class Run(Versions):
    """Several tables of one run that become visible together."""

    def publish(self, made: dict[str, DataFrame], most_bytes: int | None = None, spare: float = 1.1, notes: dict | None = None) -> int:
        """Stage all tables, then commit them as the next version.

        Before anything is written the file system must have ``spare`` times ``most_bytes`` left;
        tables that together have more than ``most_bytes`` are deleted again, as they are if one of
        them fails, and the version before stays.
        """
        if most_bytes is not None and self.fs.getStatus(self._path(self.folder)).getRemaining() < spare * most_bytes:
            raise OSError(f"{self.folder}: less than {spare * most_bytes:.0f} bytes left")
        staged: dict[str, dict] = {}
        try:
            for name, df in made.items():
                staged[name] = self.stage(df)
                total = sum(e["bytes"] for e in staged.values())
                if most_bytes is not None and total > most_bytes:
                    raise ValueError(f"{self.folder}: {total} bytes, more than {most_bytes}")
        except BaseException:
            self.abort(list(staged.values()))
            raise
        for _ in range(1000):
            parent = self.newest()
            if self.commit(parent, {"tables": staged, "notes": notes or {}}):
                return parent + 1
        raise Conflict(self.folder)

    def table(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.manifest(version)["tables"][name]["path"])
