"""Keyed upserts, idempotent appends, set algebra, table differences and hashed identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with their key."""
    return old.join(new, keys, "left_anti").unionByName(new)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key ``old`` lacks are added."""
    return old.unionByName(new.join(old, keys, "left_anti"))


def new_rows(old: DataFrame, new: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """The rows of ``new`` that ``old`` lacks, once each; a key with two payloads fails the job.

    A payload that is null is one like any other. Of rows with the same key and payload the first in
    order of all columns is taken.
    """
    row = F.min(F.struct(*new.columns))
    once = new.groupBy(*keys).agg(row.alias("_r"), F.count_distinct(F.struct(F.coalesce(F.col(payload).cast("string"), F.lit("")), F.col(payload).isNull())).alias("_n"))
    known = old.select(*keys, F.col(payload).alias("_known"), F.lit(True).alias("_there"))
    there = F.coalesce("_there", F.lit(False))
    clash = (F.col("_n") > 1) | there & ~F.col("_known").eqNullSafe(F.col(f"_r.{payload}"))
    name = F.concat_ws(",", *[F.col(f"_r.{k}").cast("string") for k in keys])
    checked = once.join(known, keys, "left").withColumn("_new", F.when(clash, F.raise_error(F.concat(F.lit("integrity conflict: "), name)).cast("boolean")).otherwise(~there))
    return checked.filter("_new").select("_r.*")


def append_unique(old: DataFrame, new: DataFrame, key: str, payload: str) -> DataFrame:
    """As :func:`insert_missing`; an id that comes with another payload, now or before, fails the job."""
    return old.unionByName(new_rows(old, new, [key], payload))


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key under a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def differences(a: DataFrame, b: DataFrame, keys: list[str], tolerance: dict[str, float]) -> DataFrame:
    """Per column: rows only in one side or further apart than the tolerance."""
    left, right = a.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in tolerance], F.lit(True).alias("_ia")), b.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in tolerance], F.lit(True).alias("_ib"))
    j = left.join(right, keys, "full")
    bad = {c: F.count_if(F.col("_ia").isNull() | F.col("_ib").isNull() | (F.col(f"_a_{c}").isNull() != F.col(f"_b_{c}").isNull()) | (F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}")) > t)) for c, t in tolerance.items()}
    one = j.agg(*[e.alias(c) for c, e in bad.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("mismatches")) for c in tolerance])).alias("s")).select("s.*")


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, 16))


def keyword_groups(text: Column, groups: dict[str, list[str]]) -> Column:
    """Names of the groups of which the text, in lower case, has a word."""
    low = F.lower(text)
    hits = []
    for name, words in groups.items():
        any_of = F.lit(False)
        for w in words:
            any_of = any_of | low.contains(w)
        hits.append(F.when(any_of, F.lit(name)))
    return F.array_compact(F.array(*hits))


#: White space that is collapsed.
SPACE = r"[ \t\n\r\f\x0B]+"


def snippet(text: Column, most: int) -> Column:
    """White space as single spaces; if longer than ``most`` characters, cut before the last space inside them (if any) and ``...``."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))
    head = F.substring(flat, 1, most)
    return F.when(F.char_length(flat) <= most, flat).otherwise(F.concat(F.regexp_replace(head, " [^ ]*$", ""), F.lit("...")))


def listed(text: Column, wanted: list[str], separator: str = ";") -> Column:
    """The entries of a separated list, trimmed, that are in ``wanted``."""
    return F.array_intersect(F.transform(F.split(text, separator), F.trim), F.array(*map(F.lit, wanted)))


def active_records(log: DataFrame, quarantine: DataFrame, key: str) -> DataFrame:
    """The log without events that are quarantined."""
    return log.join(quarantine.select(key), key, "left_anti")


def remaining(tasks: DataFrame, progress: DataFrame, key: str) -> DataFrame:
    """Tasks that no completed row of the progress table names: what a resumed run has to do."""
    return tasks.join(progress.filter("status = 'completed'").select(key), key, "left_anti")
