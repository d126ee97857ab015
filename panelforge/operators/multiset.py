"""Differences of two tables without keys, with tolerances.

Equal rows are counted on both sides. Rows can only be partners within a run: the same exact
columns, and no gap over the tolerance between the sorted values of any tolerant column. A run of
one distinct row cancels by its counts; in the others as many partners as possible are found.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F


def _in_order(values: list[float], left: list[int], right: list[int], start: int, end: int, most: float) -> None:
    """:func:`most_partners` of the rows from ``start`` to ``end``, whose one column is sorted, in place."""
    i = j = start
    while i < end and j < end:
        if not left[i]:
            i += 1
        elif not right[j]:
            j += 1
        elif abs(gap := values[i] - values[j]) <= most:
            n = min(left[i], right[j])
            left[i] -= n
            right[j] -= n
        elif gap < 0:
            i += 1
        else:
            j += 1


def most_partners(values: np.ndarray, left: np.ndarray, right: np.ndarray, tolerance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many rows of each distinct value stay without a partner on the left and on the right.

    ``values``: [row, column], NaN for null, which is only close to null. One column is walked in
    order; with more, flow is augmented along shortest paths until there is none.
    """
    left, right = left.astype(np.int64), right.astype(np.int64)
    if values.shape[1] == 1 and not np.isnan(values).any():
        at = np.argsort(values[:, 0], kind="stable")
        one, other = left[at].tolist(), right[at].tolist()
        _in_order(values[at, 0].tolist(), one, other, 0, len(at), float(tolerance[0]))
        left[at], right[at] = one, other
        return left, right
    apart = np.abs(values[:, None, :] - values[None, :, :])
    both = np.isnan(values[:, None, :]) & np.isnan(values[None, :, :])
    near = ((apart <= tolerance) | both).all(axis=2)
    flow = np.zeros((len(values), len(values)), np.int64)
    while True:
        # from rows on the left that are alone, over close rows on the right, back over partners
        seen_l, seen_r = {int(i): None for i in np.flatnonzero(left)}, {}
        queue, end = deque(seen_l), None
        while queue and end is None:
            i = queue.popleft()
            for j in np.flatnonzero(near[i]).tolist():
                if j in seen_r:
                    continue
                seen_r[j] = i
                if right[j]:
                    end = j
                    break
                for k in np.flatnonzero(flow[:, j]).tolist():
                    if k not in seen_l:
                        seen_l[k] = j
                        queue.append(k)
        if end is None:
            return left, right
        path, j = [], end
        while j is not None:
            i = seen_r[j]
            path.append((i, j))
            j = seen_l[i]
        n = min(right[end], left[path[-1][0]], *[flow[i, j] for (i, _), (_, j) in zip(path, path[1:], strict=False)])
        for (i, j), after in zip(path, [*path[1:], None], strict=True):
            flow[i, j] += n
            if after:
                flow[i, after[1]] -= n
        right[end] -= n
        left[path[-1][0]] -= n


def unmatched(a: DataFrame, b: DataFrame, exact: list[str], tolerance: dict[str, float]) -> DataFrame:
    """Rows of either table that find no partner in the other: ``exact``, the tolerant columns, ``left``, ``right`` (how many).

    Partners have equal exact columns and tolerant ones at most the tolerance apart; null goes with
    null, NaN counts as null. Each row has one partner at most, and as many rows as possible have
    one. A task takes its runs one by one; with tolerances of rounding errors they hold a few rows.
    """
    loose = list(tolerance)
    clean = lambda df: df.select(*exact, *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in loose])
    both = clean(a).withColumn("_l", F.lit(1)).unionByName(clean(b).withColumn("_l", F.lit(0)))
    rows = both.groupBy(*exact, *loose).agg(F.sum("_l").alias("left"), F.sum(1 - F.col("_l")).alias("right"))
    run = []
    for i, (c, most) in enumerate(tolerance.items()):
        w = Window.partitionBy(*exact, *run).orderBy(c)
        gap = F.col(c) - F.lag(c).over(w)
        new = F.when(F.col(c).isNull(), 0).when(F.lag(c).over(w).isNull() | (gap > most), 1).otherwise(0)
        rows = rows.withColumn(f"_new{i}", new).withColumn(f"_run{i}", F.sum(f"_new{i}").over(w)).drop(f"_new{i}")
        run.append(f"_run{i}")
    key = [*exact, *run]
    rows = rows.withColumn("_size", F.count("*").over(Window.partitionBy(*key)))
    least = F.least("left", "right")
    single = rows.filter("_size = 1").select(*exact, *loose, (F.col("left") - least).alias("left"), (F.col("right") - least).alias("right"))
    limits = np.array(list(tolerance.values()))

    def solved(parts: list[pa.RecordBatch]):
        """Rows of whole runs that have no partner."""
        t = pa.Table.from_batches(parts)
        edges = [*np.flatnonzero(t["_start"].to_numpy()).tolist(), len(t)]
        values = np.column_stack([t[c].to_numpy().astype(float) for c in loose])
        left, right = t["left"].to_numpy(), t["right"].to_numpy()
        if values.shape[1] == 1 and not np.isnan(values).any():
            v, left, right, most = values[:, 0].tolist(), left.tolist(), right.tolist(), float(limits[0])
            for i, j in zip(edges, edges[1:], strict=False):
                _in_order(v, left, right, i, j, most)
            left, right = np.array(left, np.int64), np.array(right, np.int64)
        else:
            runs = [most_partners(values[i:j], left[i:j], right[i:j], limits) for i, j in zip(edges, edges[1:], strict=False)]
            left, right = (np.concatenate(x) for x in zip(*runs, strict=True))
        out = t.select([*exact, *loose]).append_column("left", pa.array(left)).append_column("right", pa.array(right))
        yield from out.filter(pa.array((left > 0) | (right > 0))).combine_chunks().to_batches()

    def matched(batches):
        parts: list[pa.RecordBatch] = []  # rows of a run that may go on
        for b in batches:
            starts = np.flatnonzero(b.column("_start").to_numpy(zero_copy_only=False))
            if len(starts):
                parts.append(b.slice(0, starts[-1]))
                if any(p.num_rows for p in parts):
                    yield from solved(parts)
                parts, b = [], b.slice(starts[-1])
            parts.append(b)
        if any(p.num_rows for p in parts):
            yield from solved(parts)

    out = single
    if loose:
        # tasks take their runs one behind the other, so a run of two rows costs no group of its own
        w = Window.partitionBy(*key).orderBy(*loose)
        many = rows.filter("_size > 1").repartition(*key).withColumn("_start", F.row_number().over(w) == 1).sortWithinPartitions(*key, *loose)
        schema = ", ".join(f"`{n}` {t}" for n, t in single.dtypes)
        out = single.unionByName(many.select(*exact, *loose, "left", "right", "_start").mapInArrow(matched, schema))
    return out.filter("left > 0 or right > 0")
