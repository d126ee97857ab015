"""Approximate nearest neighbours by cosine with an inverted multi-index.

The halves of the unit vectors are quantised separately; a cell is a pair of centroids. A query
walks cells by summed distance with a heap until it has seen enough vectors, and entries are
reranked by their exact cosine. Equal vectors are one entry that keeps the smallest ids a result
can need. How many vectors a query must see is measured: a fixed number of queries is searched
by brute force, and the walk is made long enough to meet the wanted share of their neighbours.
Codebooks are fitted on a bounded sample; every row is indexed.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import checkpointed, table

#: Rows that the codebooks are fitted on, and queries that the length of the walk is measured with, at most.
SAMPLE_ROWS, SAMPLE_QUERIES = 20_000, 64
#: Share of the sampled queries' nearest (a sampled query itself is one of them) that the walk must meet.
WANTED = 0.97
#: Entries, and queries, that one task takes: cells are grouped to so many entries, larger ones split.
CELL_ROWS, QUERY_ROWS = 20_000, 2_000
#: Entries a cell holds on average, until there are 256 centroids a half.
CELL_MEAN = 8
#: Products of unit vectors may be off by so much; the exact score decides among what lies closer.
_TOLERANCE = 1e-12


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``v`` (doubles) of the rows that take part.

    Null, empty and zero vectors and those with null or non-finite components don't; nor do vectors
    of another length than most have (of equally many, the longer ones stay).
    """
    v = F.col(f"`{vector_col}`").cast("array<double>")
    own = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    own = own.filter(fine)
    sizes = own.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return own.filter(F.size("v") == (sizes["d"] if sizes else 0))


def entries(own: DataFrame, keep: int) -> DataFrame:
    """Distinct vectors ``v`` with ``ids``, their ``keep`` smallest ids, and ``id``, the least."""
    # the limit on the row number is applied before the shuffle too, so copies don't pile up
    w = Window.partitionBy("v").orderBy("id")
    few = own.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= keep)
    return few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("id", F.col("ids")[0])


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None], 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    centres = x[np.sort(np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        of = _distances(x, centres).argmin(axis=1)
        many = np.bincount(of, minlength=len(centres))
        total = np.stack([np.bincount(of, x[:, j], len(centres)) for j in range(x.shape[1])], axis=1)
        centres[many > 0] = total[many > 0] / many[many > 0, None]
    return centres


class Index:
    """Two codebooks and how many entries each cell holds (as many numbers as cells)."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.left, self.right = left, right
        self.sizes = np.zeros(len(left) * len(right), np.int64)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        d = self.left.shape[1]
        return _distances(unit[:, :d], self.left).argmin(axis=1) * len(self.right) + _distances(unit[:, d:], self.right).argmin(axis=1)

    def walk(self, unit: np.ndarray):
        """Cells in order of the sum of both halves' distances, lazily."""
        d = self.left.shape[1]
        a, b = _distances(unit[None, :d], self.left)[0], _distances(unit[None, d:], self.right)[0]
        ia, ib = a.argsort(kind="stable"), b.argsort(kind="stable")
        a, b = a[ia], b[ib]
        heap = [(float(a[0] + b[0]), 0, 0)]
        while heap:
            _, i, j = heapq.heappop(heap)
            yield int(ia[i]) * len(self.right) + int(ib[j])
            if j + 1 < len(b):
                heapq.heappush(heap, (float(a[i] + b[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (float(a[i + 1] + b[0]), i + 1, 0))

    def visited(self, unit: np.ndarray, seen: int) -> list[int]:
        """The cells with entries that a query looks into until it has met ``seen`` of them."""
        out, total = [], 0
        for cell in self.walk(unit):
            if self.sizes[cell]:
                out.append(cell)
                total += int(self.sizes[cell])
                if total >= seen:
                    break
        return out


def build(found: DataFrame, cells_per_half: int | None = None) -> tuple[Index, DataFrame]:
    """The index and the entries with their ``cell``. More entries, more cells, to 256 a half."""
    n = found.count()
    k = cells_per_half or int(min(256, max(8, 2 ** int(np.log2(max(n / CELL_MEAN, 1) ** 0.5)))))
    sample = found.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).toArrow()
    x = _unit(_matrix(sample["v"])) if sample.num_rows else np.ones((1, 2))
    half = max(1, x.shape[1] // 2)
    index = Index(kmeans(x[:, :half], k), kmeans(x[:, half:], k) if x.shape[1] > half else np.zeros((1, 0)))

    def assign(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(index.cells(_unit(_matrix(b.column(1)))) if b.num_rows else [], pa.int64())], ["id", "v", "ids", "cell"])

    placed = checkpointed(found.select("id", "v", "ids").mapInArrow(assign, "id long, v array<double>, ids array<long>, cell long"))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect():  # one row a cell
        index.sizes[r["cell"]] = r["n"]
    return index, placed


def _best(q: np.ndarray, v: np.ndarray, v_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the ``k`` best of a block by exact score, ties to the smaller id: rows of (query, entry, score).

    The product picks candidates; all within its error of the ``k``-th take part, however many.
    """
    near = _unit(q) @ _unit(v).T
    take = min(k, len(v))
    least = np.partition(near, len(v) - take, axis=1)[:, len(v) - take] - _TOLERANCE
    many = (near >= least[:, None]).sum(axis=1)
    rows, cols, scores = [], [], []
    # rows without crowded ties in one step, the others one by one, so that no more than a block is held
    plain = np.flatnonzero(many <= take + 8)
    i, j = np.nonzero(near[plain] >= least[plain, None])
    steps = [(plain[i], j)] + [(np.full(many[r], r), np.flatnonzero(near[r] >= least[r])) for r in np.flatnonzero(many > take + 8).tolist()]
    for row, col in steps:
        score = _cosine(q[row], v[col])
        order = np.lexsort((v_ids[col], -score, row))
        row = row[order]
        order, row = order[(nth := np.arange(len(row)) - np.searchsorted(row, row, "left")) < k], row[nth < k]
        rows.append(row), cols.append(col[order]), scores.append(score[order])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)


def _seen_for(index: Index, placed: DataFrame, queries: DataFrame, k: int, wanted: float) -> int:
    """Entries that queries must see to meet the wanted share of true neighbours, from a sample's brute force."""
    sample = queries.orderBy(F.xxhash64("rep", F.lit(3)), "rep").limit(SAMPLE_QUERIES).toArrow()
    total = int(index.sizes.sum())
    if not sample.num_rows or not total:
        return total
    q, ids = _matrix(sample["v"]), sample["rep"].to_numpy()

    def search(batches):
        for b in batches:
            if b.num_rows:
                row, col, score = _best(q, _matrix(b.column(1)), b.column(0).to_numpy(), k)
                yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(b.column(2).to_numpy()[col]), pa.array(score), pa.array(b.column(0).to_numpy()[col])], ["q", "cell", "score", "id"])

    top = placed.select("id", "v", "cell").mapInArrow(search, "q int, cell long, score double, id long")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    true = top.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k).select("q", "cell").collect()  # k rows a sampled query
    units, need = _unit(q), []
    for i in range(len(q)):
        rank, met = {}, 0
        for cell in index.walk(units[i]):
            met += int(index.sizes[cell])
            rank[cell] = met
        need += [rank[r["cell"]] for r in true if r["q"] == i]
    return int(np.quantile(need, wanted, method="higher")) if need else total


def groups(sizes: np.ndarray, most: int = CELL_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """For each cell the number of its parts and its first group: neighbouring cells share a group, a cell over ``most`` has its own."""
    parts = np.maximum(1, -(-sizes // most))
    base, group, filled = np.zeros(len(sizes), np.int64), 0, 0
    for c, n in enumerate(sizes.tolist()):
        if filled and (filled + n > most):
            group, filled = group + 1, 0
        base[c] = group
        if parts[c] > 1:
            group, filled = group + int(parts[c]), 0
        else:
            filled += n
    return parts, base


def _spread(x: int, n: int) -> int:
    """An id's place among ``n``."""
    return ((x * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 33) % n


def search(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", wanted: float = WANTED,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` (exact cosine): each query's ``k`` nearest found.

    ``is_query`` is a condition on the column ``id``. A query is not its own neighbour; equal scores
    go to the smaller id, also among vectors that only differ in length. Rows that take no part (see
    :func:`usable`) have no results; an empty table gives an empty result. An id that occurs twice
    with different vectors is two candidates, equal rows are one. Other columns are ignored. A
    query travels once per group of cells that it visits; a task holds ``CELL_ROWS`` entries and
    ``QUERY_ROWS`` queries.
    """
    own = checkpointed(usable(vectors, id_col, vector_col))
    found = checkpointed(entries(own, k + 1))
    index, placed = build(found)
    asked = own.filter(is_query)
    queries = checkpointed(asked.groupBy("v").agg(F.min("id").alias("rep")))
    seen = _seen_for(index, placed, queries, k + 1, wanted)
    parts, base = groups(index.sizes)
    blocks = max(1, -(-queries.count() // QUERY_ROWS))

    def requests(batches):
        for b in batches:
            rep, which, group, cells = [], [], [], []
            units = _unit(_matrix(b.column(1))) if b.num_rows else []
            for i, (r, u) in enumerate(zip(b.column(0).to_pylist(), units, strict=True)):
                cell = np.sort(np.array(index.visited(u, seen), np.int64))
                at = np.repeat(base[cell] - (np.cumsum(parts[cell]) - parts[cell]), parts[cell]) + np.arange(parts[cell].sum())
                cell = np.repeat(cell, parts[cell])
                cell = cell[order := np.argsort(at, kind="stable")]
                at = at[order]
                for g, mine in zip(np.unique(at).tolist(), np.split(cell, np.flatnonzero(np.diff(at)) + 1), strict=False):
                    rep.append(r), which.append(i), group.append(g), cells.append(mine)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rep, pa.int64()), b.column(1).take(pa.array(which, pa.int64())), pa.array(group, pa.int64()), pa.array(cells, pa.list_(pa.int64())), pa.array([_spread(r, blocks) for r in rep], pa.int64())], ["rep", "v", "group", "cells", "block"])

    wants = queries.select("rep", "v").repartition(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rep").mapInArrow(requests, "rep long, v array<double>, group long, cells array<long>, block long")

    def split(batches):
        for b in batches:
            cell, ident = b.column(3).to_numpy(), b.column(0).to_pylist()
            part = np.array([_spread(x, int(n)) for x, n in zip(ident, parts[cell].tolist(), strict=True)], np.int64) if b.num_rows else cell
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(base[cell] + part, pa.int64())], [*b.schema.names, "group"])

    dealt = placed.mapInArrow(split, "id long, v array<double>, ids array<long>, cell long, group long").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"rep": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return none
        right = right.sort_by("cell")
        v, v_ids, cell = _matrix(right["v"]), right["id"].to_numpy(), right["cell"].to_numpy()
        q, q_ids, lists = _matrix(left["v"]), left["rep"].to_numpy(), left["cells"].combine_chunks()
        asked, by = lists.flatten().to_numpy(), np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy())
        order = np.argsort(asked, kind="stable")
        asked, by = asked[order], by[order]
        found = []
        for c in np.unique(cell).tolist():
            a, b = np.searchsorted(cell, (c, c + 1))
            mine = by[slice(*np.searchsorted(asked, (c, c + 1)))]
            for i in range(0, len(mine), 512):
                row, col, score = _best(q[mine[i : i + 512]], v[a:b], v_ids[a:b], k + 1)
                found.append((mine[i : i + 512][row], col + a, score))
        if not found:
            return none
        row, col, score = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((v_ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row, "left") <= k
        return pa.table({"rep": pa.array(q_ids[row[keep]]), "ids": right["ids"].combine_chunks().take(pa.array(col[keep])), "score": pa.array(score[keep])})

    near = wants.groupBy("group", "block").cogroup(dealt.groupBy("group", "block")).applyInArrow(rerank, "rep long, ids array<long>, score double")
    w = Window.partitionBy("rep").orderBy(F.desc("score"), F.col("ids")[0])
    best = near.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k + 1)
    best = best.select("rep", "score", F.explode("ids").alias("vec_id"))
    best = best.withColumn("nth", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id"))).filter(F.col("nth") <= k + 1)
    lists = best.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("top"))  # k + 1 at most
    named = asked.join(queries, "v").select("id", "rep").join(lists, "rep")
    others = F.slice(F.filter("top", lambda t: t["vec_id"] != F.col("id")), 1, k)
    out = named.select(F.col("id").alias("query_id"), F.posexplode(others).alias("p", "t"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), (-F.col("t.far")).alias("score"))


def op8_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
