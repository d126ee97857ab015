"""Greedy clusters over a graph in parallel rounds.

Walking names in order, a name is kept unless it is close to one kept before. Which names are kept
depends only on earlier neighbours, so all names whose earlier neighbours are settled are settled
at once:

* a name with a kept earlier neighbour is a member;
* a name whose earlier neighbours are all members is kept.

On orders that have nothing to do with the graph this takes a number of rounds in the logarithm of
the names. Chains, the one shape on which it would crawl, are followed by doubling: a name that
waits for a single neighbour is kept exactly if that one isn't, so of two such steps in a row one
can be made that skips a name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelforge.lineage import checkpointed


def _settled_by_chains(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, name, kept) of names that hang on a kept one by single waits; ``edges``: by, name, earlier.

    A name with one open earlier neighbour points to it. A pointer that skips a name remembers
    whether its end is kept if the name is (``same``). Names without open earlier neighbours, which
    the caller's round keeps, are the ends.
    """
    key = [*by, "name"]
    waits = edges.groupBy(*key).agg(F.count("*").alias("n"), F.min("earlier").alias("to"))
    pointers = checkpointed(waits.filter("n = 1").select(*key, "to", F.lit(False).alias("same"), F.lit(True).alias("moved")))
    while pointers.filter("moved").limit(1).count():
        # an end that waits for one name itself is skipped
        after = pointers.select(*by, F.col("name").alias("to"), F.col("to").alias("next"), F.col("same").alias("next_same"))
        longer = pointers.drop("moved").join(after, [*by, "to"], "left")
        same = F.when(F.col("next").isNull(), F.col("same")).otherwise(F.col("same") == F.col("next_same"))
        pointers = checkpointed(longer.select(*key, F.coalesce("next", "to").alias("to"), same.alias("same"), F.col("next").isNotNull().alias("moved")))
    # an end that waits for several names settles nothing yet
    return pointers.join(waits.select(*by, F.col("name").alias("to")), [*by, "to"], "left_anti").select(*key, F.col("same").alias("kept"))


def kept_names(names: DataFrame, close: DataFrame, by: list[str] = (), report: list | None = None) -> DataFrame:
    """The names that the greedy walk keeps: ``by``, ``name``, ``place``.

    ``names``: by, name, place (the walk's order, no ties within a graph); ``close``: by, a, b, in
    either direction, repeated or not. Edges to names that aren't listed don't count. ``report``
    gets the number of open edges before each round. Chains are followed where a round has left
    more than half of the edges.
    """
    by = list(by)
    key = [*by, "name"]
    own = names.select(*key, "place")
    ends = lambda c, p: own.withColumnsRenamed({"name": c, "place": p})
    both = close.select(*by, "a", "b").filter("a <> b").join(ends("a", "pa"), [*by, "a"]).join(ends("b", "pb"), [*by, "b"])
    later = F.col("pa") > F.col("pb")
    edges = checkpointed(both.select(*by, F.when(later, F.col("a")).otherwise(F.col("b")).alias("name"), F.when(later, F.col("b")).otherwise(F.col("a")).alias("earlier")).distinct())
    state, before, n = own.withColumn("kept", F.lit(None).cast("boolean")), None, edges.count()
    while n:
        if report is not None:
            report.append(n)
        settled = state.filter("kept is null").select(*key).join(edges.select(*key).distinct(), key, "left_anti").withColumn("kept", F.lit(True))
        if before is not None and 2 * n > before:
            settled = checkpointed(settled.unionByName(_settled_by_chains(edges, by)))
        member = edges.join(settled.filter("kept").select(*by, F.col("name").alias("earlier")), [*by, "earlier"], "left_semi").select(*key).withColumn("kept", F.lit(False))
        news = settled.unionByName(member).groupBy(*key).agg(F.max("kept").alias("news"))
        state = checkpointed(state.join(news, key, "left").select(*key, "place", F.coalesce("kept", "news").alias("kept")))
        gone = state.filter("kept is not null")
        edges = checkpointed(edges.join(gone.select(*key), key, "left_anti").join(gone.select(*by, F.col("name").alias("earlier")), [*by, "earlier"], "left_anti"))
        before, n = n, edges.count()
    if report is not None:
        report.append(0)
    return state.filter("coalesce(kept, true)").select(*key, "place")


def greedy_clusters(names: DataFrame, pairs: DataFrame, threshold: float, by: list[str] = ()) -> DataFrame:
    """``by``, ``representative``, ``member``, ``correlation``: each kept name for itself (1.0), each other with the first kept one it is close to.

    ``names`` as for :func:`kept_names`; ``pairs``: by, a, b, correlation, close where its size
    reaches ``threshold``; null correlations aren't close.
    """
    by = list(by)
    close = checkpointed(pairs.filter(F.abs("correlation") >= threshold).select(*by, "a", "b", "correlation"))
    kept = checkpointed(kept_names(names, close, by))
    first = kept.withColumnsRenamed({"name": "representative", "place": "first"})
    both = close.select(*by, F.col("a").alias("member"), F.col("b").alias("representative"), "correlation").unionByName(close.select(*by, F.col("b").alias("member"), F.col("a").alias("representative"), "correlation"))
    rest = names.select(*by, F.col("name").alias("member")).join(kept.select(*by, F.col("name").alias("member")), [*by, "member"], "left_anti")
    chosen = both.join(rest, [*by, "member"], "left_semi").join(first, [*by, "representative"])
    members = chosen.groupBy(*by, "member").agg(F.min_by(F.struct("representative", "correlation"), F.struct("first", "correlation")).alias("r"))
    alone = kept.select(*by, F.col("name").alias("representative"), F.col("name").alias("member"), F.lit(1.0).alias("correlation"))
    return alone.unionByName(members.select(*by, "r.representative", "member", "r.correlation"))
