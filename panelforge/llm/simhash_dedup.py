"""SimHash near-duplicates by meet-in-the-middle ball hashing, and connected components.

Two fingerprints that differ in at most ``2 r`` bits have a common variant within ``r`` bits of
both. Emitting the whole ball of radius 2 in 64 bits costs 2081 rows a fingerprint, 16 times the
input here, so the ball is hashed on projections first: of three bit blocks, the two with the
fewest differences hold at most half of four differences, so fingerprints within four bits share
a variant within ONE bit on one of three 42- or 43-bit projections (131 rows a fingerprint).
Neighbours in a bucket are compared directly; members of buckets that are too large for that and
not connected by then go on to the whole 64-bit ball, where a bucket needs no comparison (all its
members are within four bits) and a link to the first one loses nothing. Only distinct fingerprints take
part, so copies never meet in a bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from xxhash import xxh64_intdigest

from .common import checkpointed, unused

SEED = 42
#: How many neighbours in a bucket each fingerprint is compared with: at first, and where components meet.
NEAR, WIDE = 8, 1024
#: A node or fingerprint with more than this part of all rows is hot; so there are fewer hot ones than this.
HOT = 2000
_LAST = (1 << 63) - 1


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """The 64-bit SimHash of the lower-cased text's word shingles (ASCII case and white space)."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first = np.concatenate([[0], ends[:-1]])[:n].tolist()
    last = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    hashes = np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(first, last, strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for a in range(0, n, 1 << 14):
        ones += np.unpackbits(hashes[a : a + (1 << 14), None].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, with_hash: bool = False) -> DataFrame:
    """id and fp (a signed long with the fingerprint's bits) of every row; on demand also a hash of the text."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), *b.columns[2:]], ["id", "fp", *b.schema.names[2:]])

    text = F.col(f"`{text_col}`")
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"), *[F.xxhash64(text, F.lit(1)).alias("hash")] * with_hash)
    return own.mapInArrow(run, "id long, fp long" + ", hash long" * with_hash)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _projections() -> list[tuple[int, list[int]]]:
    """Masks of two of three blocks, each with the single-bit flips inside (and none)."""
    blocks = [range(0, 22), range(22, 43), range(43, 64)]
    out = []
    for left in range(3):
        bits = [b for i, block in enumerate(blocks) if i != left for b in block]
        out.append((_signed(sum(1 << b for b in bits)), [0, *(_signed(1 << b) for b in bits)]))
    return out


def _variants(fps: DataFrame, flips: list[int]) -> DataFrame:
    return fps.withColumn("flip", F.explode(F.array(*[F.lit(f).cast("long") for f in flips])))


def connected(fps: DataFrame, near: int = NEAR, wide: int = WIDE) -> DataFrame:
    """(node, root) for the distinct fingerprints ``fp`` that link; the root is the smallest of its component.

    In a bucket, each fingerprint is compared with the ``near`` before it. In a larger bucket,
    pairs further apart may be missed, which matters only if they aren't connected by then. So
    buckets that hold several components are looked at again, each member with the ``wide`` before
    it; members of still larger ones that still hold several go on to the whole ball.
    """
    parts = []
    for k, (mask, flips) in enumerate(_projections()):
        parts.append(_variants(fps, flips).select("fp", F.lit(k).cast("byte").alias("k"), F.col("fp").bitwiseAND(F.lit(mask)).bitwiseXOR(F.col("flip")).alias("key")))
    spread = parts[0].unionByName(parts[1]).unionByName(parts[2])
    w = Window.partitionBy("k", "key").orderBy("fp")
    larger = lambda n: F.lag("fp", n + 1).over(w).isNotNull() | F.lead("fp", n + 1).over(w).isNotNull()
    seen = spread.select("fp", "k", "key", F.array(*[F.lag("fp", i).over(w) for i in range(1, near + 1)]).alias("others"), larger(near).alias("crowded"))
    close = F.filter("others", lambda o: o.isNotNull() & (F.bit_count(o.bitwiseXOR(F.col("fp"))) <= 4))
    seen = checkpointed(seen.withColumn("others", close).filter(F.col("crowded") | (F.size("others") > 0)))
    found = checkpointed(components(seen.select(F.explode("others").alias("a"), F.col("fp").alias("b")).distinct()))
    mixed = _mixed(seen.filter("crowded"), found)
    if mixed.isEmpty():
        return found
    before = F.collect_list(F.struct("fp", "root")).over(w.rowsBetween(-wide, -1))
    again = mixed.select("fp", "k", "key", "root", before.alias("others"), larger(wide).alias("crowded"))
    close = F.filter("others", lambda o: (o["root"] != F.col("root")) & (F.bit_count(o["fp"].bitwiseXOR(F.col("fp"))) <= 4))
    again = checkpointed(again.select("fp", "k", "key", "root", "crowded", F.array_distinct(F.transform(close, lambda o: o["root"])).alias("others")))
    known = found.select(F.col("node").alias("a"), F.col("root").alias("b"))
    found = checkpointed(components(again.select(F.explode("others").alias("a"), F.col("root").alias("b")).distinct().unionByName(known)))
    apart = checkpointed(_mixed(again.filter("crowded"), found).select("fp").distinct())
    if apart.isEmpty():
        return found
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # else they'd be coalesced before the ball spreads them
    ball = [0, *(_signed(1 << i) for i in range(64)), *(_signed(1 << i | 1 << j) for i in range(64) for j in range(i))]
    star = _variants(apart.repartition(tasks, "fp"), ball).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("key"))
    star = star.select(F.first("fp").over(Window.partitionBy("key").orderBy("fp")).alias("a"), F.col("fp").alias("b"))
    return components(star.filter("a <> b").distinct().unionByName(found.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def _mixed(crowd: DataFrame, found: DataFrame) -> DataFrame:
    """Members (k, key, fp, root) of the buckets that hold more than one component."""
    crowd = crowd.select("k", "key", "fp").join(found, F.col("fp") == F.col("node"), "left").select("k", "key", "fp", F.coalesce("root", "fp").alias("root"))
    crowd = checkpointed(crowd)
    split = crowd.groupBy("k", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
    return checkpointed(crowd.join(split, ["k", "key"], "left_semi"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the component's smallest node.

    Rounds of large-star and small-star: every node links its larger neighbours, then its smaller
    ones, to its smallest; each round is checkpointed and the rounds grow with the logarithm of
    the longest path. A node's neighbours are grouped by aggregates and joins only, and those of
    a hub (a large component's smallest node) are spread over the join's tasks.
    """
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    mark, total = None, 2 * edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("uses")).withColumn("m", F.least("u", "m"))
        large = _looked_up(both, least, "u", "m", total, F.xxhash64("v")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.filter("u <> v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("uses"))
        small = _looked_up(down, least, "u", "m", total, F.xxhash64("v")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        now = edges.agg(F.count("*").alias("n"), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))")).first()
        total = 2 * now["n"]
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root"))
            ).distinct()
        mark = now


def _looked_up(rows: DataFrame, one: DataFrame, key: str, value: str, total: int, salt) -> DataFrame:
    """``rows`` with ``value`` of their ``key`` in ``one``, which has a row for every key, with its ``uses`` among at most ``total`` rows.

    Keys with more than ``total / HOT`` rows are fewer than ``HOT``, so they are broadcast; their
    rows go through the shuffle by ``salt``, and whatever they meet there counts for nothing.
    """
    hot = F.broadcast(one.filter(F.col("uses") * HOT > total).select(F.col(key).alias("hot_key"), F.col(value).alias("hot_value")))
    rest = one.select(F.col(key).alias("join_key"), F.col(value).alias("join_value"))
    spread = rows.join(hot, F.col(key) == F.col("hot_key"), "left").withColumn("spread_key", F.when(F.col("hot_key").isNull(), F.col(key)).otherwise(salt))
    met = spread.join(rest, F.col("spread_key") == F.col("join_key"), "left")
    picked = F.when(F.col("hot_key").isNull(), F.col("join_value")).otherwise(F.col("hot_value"))
    return met.select(*rows.columns, picked.alias(value))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, near: int = NEAR) -> DataFrame:
    """One row per input row: ``id``, ``fp`` (signed long) and ``component``.

    Documents link when their fingerprints differ in at most four of 64 bits; the component is the
    smallest id reachable. Null and empty texts have fingerprint zero and link like any other.
    Rows with a null id link others but name no component while another id can; a component of
    null ids only is null. Repeated rows are as many rows; an empty table gives an empty result;
    texts of any length are read whole; other columns are ignored.
    """
    marked = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    groups = checkpointed(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("uses")))
    found = checkpointed(connected(groups.select("fp"), near))
    roots = found.join(groups, found["node"] == groups["fp"]).groupBy("root").agg(F.min("least").alias("component"))
    linked = found.join(roots, "root").select(F.col("node").alias("fp"), "component")
    named = checkpointed(groups.join(linked, "fp", "left").select("fp", F.coalesce("component", "least").alias("component"), "uses"))
    total = named.agg(F.sum("uses")).first()[0] or 0
    # the salt is the row's place, which a checkpoint keeps: ids may be null or repeated
    placed = marked.withColumn("place", F.monotonically_increasing_id())
    return _looked_up(placed, named, "fp", "component", total, F.xxhash64("place")).select("id", "fp", "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, near: int = NEAR) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one with the smallest id.

    Of rows with that id (null last) the one whose text has the smallest hash stays, of equal rows one.
    """
    marked = checkpointed(fingerprints(docs, id_col, text_col, shingle, with_hash=True))
    one, two = unused(docs, "panelforge_id"), unused(docs, "panelforge_hash")
    place = F.struct(F.coalesce("id", F.lit(_LAST)).alias(one), F.col("hash").alias(two))
    groups = checkpointed(marked.groupBy("fp").agg(F.min(place).alias("s")))
    found = checkpointed(connected(groups.select("fp"), near))
    rooted = groups.join(found, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    stay = rooted.groupBy("root").agg(F.min("s").alias("s")).select("s.*")
    keyed = docs.withColumns({one: F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LAST)), two: F.xxhash64(F.col(f"`{text_col}`"), F.lit(1))})
    return keyed.join(stay, [one, two], "left_semi").dropDuplicates([one, two]).drop(one, two)


def op10_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
