"""Sinks: staged tables, atomic small files, a backtest's outputs, Markdown reports, sealed folders.

Tables are written by Spark to any file system it knows. Small files (``atomic_text``, reports,
seals) are the driver's, in a folder of its own.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

FORMATS = ("parquet", "json", "csv")
MANIFEST = "manifest.json"


def write(df: DataFrame, path: str, kind: str = "parquet", most_bytes: int | None = None) -> int:
    """Write a table beside ``path`` and rename it there when it is whole; returns its bytes.

    A table over ``most_bytes`` is deleted again and an error raised; what was at ``path`` stays
    until the new table is whole, and comes back if it can't be replaced. For readers that must
    never meet a moment without a table, or several tables, see :class:`panelforge.sources.versions.Run`.
    """
    if kind not in FORMATS:
        raise ValueError(f"unknown format: {kind}")
    spark = df.sparkSession
    stage, old = f"{path}.staging-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    writer = df.write.option("header", True) if kind == "csv" else df.write
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = lambda p: hadoop.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        writer.format(kind).save(stage)
        size = fs.getContentSummary(at(stage)).getLength()
        if most_bytes is not None and size > most_bytes:
            raise ValueError(f"{path}: {size} bytes, more than {most_bytes}")
        there = fs.exists(at(path))
        if there and not fs.rename(at(path), at(old)):
            raise OSError(f"can't rename {path}")
        if not fs.rename(at(stage), at(path)):
            if there:
                fs.rename(at(old), at(path))
            raise OSError(f"can't rename {stage}")
    except BaseException:
        fs.delete(at(stage), True)
        raise
    if there:
        fs.delete(at(old), True)
    return size


def atomic_text(path: str | Path, text: str) -> None:
    """A small file of the driver, replaced as a whole and flushed to the disk."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    own = path.with_name(f"{path.name}.{uuid.uuid4().hex}")
    with own.open("w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(own, path)


def canonical(value) -> str:
    """Compact JSON with names in order; equal values have equal texts."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def stable_hash(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def content_hash(df: DataFrame) -> str:
    """A hash of the table's rows as a bag: the same for any order and partitioning."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.sum(F.conv(F.substring(row, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)"))
    got = df.agg(F.count("*"), *[part(i) for i in range(5)]).first()
    return hashlib.sha256(canonical([str(x) for x in got]).encode()).hexdigest()


def markdown(title: str, rows: list[dict], notes: list[str] = ()) -> str:
    """A report: a heading, notes, and a table of the rows."""
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    names = list(rows[0]) if rows else []
    table = [f"| {' | '.join(names)} |", f"|{'-|' * len(names)}", *[f"| {' | '.join(cell(r.get(n)) for n in names)} |" for r in rows]] if rows else ["No rows."]
    return "\n".join([f"# {title}", "", *notes, *([""] if notes else []), *table, ""])


def backtest_outputs(out: DataFrame, metrics: DataFrame, folder: str) -> None:
    """A fold's results: tables ``accounts``, ``trades``, ``unfilled`` and ``failed``, the driver's ``metrics.json`` and ``report.md``."""
    kinds = {"accounts": "kind = 'account'", "trades": "kind = 'trade' and status = 'filled'", "unfilled": "kind = 'trade' and status = 'unfilled'", "failed": "kind = 'failed'"}
    for name, condition in kinds.items():
        write(out.filter(condition).drop("kind"), f"{folder}/{name}", "csv")
    rows = [r.asDict() for r in metrics.collect()]  # one row a formula
    atomic_text(f"{folder}/metrics.json", json.dumps(rows, indent=1, sort_keys=True))
    atomic_text(f"{folder}/report.md", markdown("Backtest", rows))


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """``name`` (below the folder), ``sha256``, ``bytes`` of every file, hashed where Spark reads them; the manifest is left out."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    base = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.expr(f"substring(path, {len(base) + 1})") if base.startswith("file:///") else F.substring_index("path", base.split("://")[-1].split(":", 1)[-1], -1)
    return files.select(name.alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes")).filter(F.col("name") != MANIFEST)


def seal(folder: str | Path, spark: SparkSession | None = None) -> str:
    """Write a manifest of all files' hashes, take write permission away, return the manifest's hash.

    With a session the files are read by its executors, who see the folder under the same name.
    """
    folder = Path(folder)
    files = _hashes(folder, spark)
    atomic_text(folder / MANIFEST, canonical(files))
    for p in folder.rglob("*"):
        if p.is_file():
            p.chmod(0o444)
    return stable_hash(files)


def _hashes(folder: Path, spark: SparkSession | None) -> dict[str, str]:
    if spark is not None:
        return {unquote(r["name"]): r["sha256"] for r in file_hashes(spark, str(folder)).select("name", "sha256").collect()}  # a row a file
    return {str(p.relative_to(folder)): hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(folder.rglob("*")) if p.is_file() and p.name != MANIFEST}


def broken(folder: str | Path, spark: SparkSession | None = None) -> list[str]:
    """Files of a sealed folder that are missing, changed, new or writable; none if it is intact."""
    folder = Path(folder)
    want, have = json.loads((folder / MANIFEST).read_text()), _hashes(folder, spark)
    bad = [f"missing: {n}" for n in want if n not in have] + [f"new: {n}" for n in have if n not in want]
    for n in sorted(want.keys() & have.keys()):
        if have[n] != want[n]:
            bad.append(f"changed: {n}")
        elif (folder / n).stat().st_mode & 0o222:
            bad.append(f"writable: {n}")
    return sorted(bad)
