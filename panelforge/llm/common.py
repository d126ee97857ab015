"""Helpers shared by the operators: sizing, checkpoints, compact byte blobs, file access."""

from __future__ import annotations

import ctypes
import tempfile
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

#: A plan estimate above this is Spark's "unknown".
_UNKNOWN = 1 << 55


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def estimated_bytes(df: DataFrame) -> int:
    """Bytes of ``df`` as the optimizer estimates them; counted when it can't tell."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < _UNKNOWN:
        return size
    width = F.lit(0).cast("long")
    for name, kind in df.dtypes:
        width = width + (F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0)) if kind in ("string", "binary") else F.lit(16))
    return df.agg(F.sum(width).alias("n")).first()["n"] or 0


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it, so that no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pieces(df: DataFrame, piece_bytes: int) -> int:
    """How many pieces of about ``piece_bytes`` the input makes; grows with the input."""
    return max(1, -(-estimated_bytes(df) // piece_bytes))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, a temporary one, which only a local master may have."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return named or tempfile.mkdtemp(prefix="panelforge-")


def pack(a: np.ndarray) -> bytes:
    """An array as a compressed blob: bytes of equal significance together, then zstd."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(-1, a.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob, max_output_size=1 << 31), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)


@cache
def _allocator():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def trim() -> None:
    """Give freed memory back to the machine: Python workers wait idle beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    _allocator()(0)


def squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def expand(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob, max_output_size=1 << 31)


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(32))) * _M2
    x = (x ^ (x >> np.uint64(29))) * _M1
    return x ^ (x >> np.uint64(32))


def join_names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of the concatenation of what ``a`` and ``b`` name (not commutative)."""
    return mix(a * _M1 + (b ^ (b >> np.uint64(31))) * _M2 + np.uint64(0x1234567))


def crc_mod(column, modulus: int):
    """crc32 of the column as text, modulo ``modulus``; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)
