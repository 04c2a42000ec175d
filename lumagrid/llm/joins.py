"""Joins and connected components that survive hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Staging

#: Hot keys that are broadcast at most.
HOT_ROWS = 10_000
#: Links of a node from which its links are not joined in one task.
HOT_NODE = 100_000


def join_hot(many: DataFrame, few: DataFrame, keys: list[str], weight: Column, total: int, how: str = "inner") -> DataFrame:
    """many join few on keys, where few has one row per key and ``weight`` says how many rows of many it meets.

    Keys that meet at least total / HOT_ROWS rows (so HOT_ROWS keys at most) are broadcast; the others,
    none of which is large, are joined by an exchange. Only inner and left joins. few should be staged.
    """
    least = max(1000, -(-total // HOT_ROWS))
    hot = few.filter(weight >= least).withColumn("__hot", F.lit(True))
    values = [c for c in few.columns if c not in keys]
    tagged = many.join(F.broadcast(hot), keys, "left")
    done = tagged.filter(F.col("__hot")).drop("__hot")
    rest = tagged.filter(F.col("__hot").isNull()).drop("__hot", *values)
    return done.unionByName(rest.join(few.filter(weight < least), keys, how), allowMissingColumns=False)


def _lowest(edges: DataFrame, store: Staging, size: int) -> DataFrame:
    """(v, u) -> (v, u, m): m is the smallest u of v; minima are combined before the exchange, hot v are broadcast.

    size is the number of edges at most: with fewer than HOT_NODE no node can be hot.
    """
    low = edges.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("__links"))
    if size >= HOT_NODE:
        most, total = edges.groupBy("v").count().agg(F.max("count"), F.sum("count")).first()
        if most >= HOT_NODE:
            return join_hot(edges, store.put(low), ["v"], F.col("__links"), total).drop("__links")
    return edges.join(low.drop("__links"), "v")


def components(links: DataFrame, store: Staging, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(a, b) -> (node, component): the smallest node reachable, for every node that has a link.

    Alternates large-star and small-star steps: each hangs the neighbours of a node on the smallest of them,
    as minima by node (combined before the exchange) and one join, until no edge changes; a node of HOT_NODE links or
    more is joined by a broadcast. Every round is written to the shared folder and the one before it deleted.
    """
    edges = store.put(
        links.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u"))
        .distinct()
    )
    nodes = edges
    # Two sets of edges are the same if their number, sum and exclusive or of hashes are.
    h = F.xxhash64("v", "u")
    print_of = lambda e: tuple(e.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h), F.bit_xor(F.hash("v", "u"))).first())
    known = print_of(edges)
    if known[0] == 0:
        return edges.select(F.col("v").alias("node"), F.col("u").alias("component"))
    for _ in range(rounds):
        both = edges.select("v", "u").union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        # Large star: neighbours above v hang on the smallest of v and its neighbours.
        large = _lowest(both, store, 2 * known[0]).filter(F.col("u") > F.col("v")).select(F.col("u").alias("v"), F.least("v", "m").alias("u")).filter("v != u").distinct()
        # Small star: v and its neighbours below hang on the smallest of them.
        mid = store.put(large)
        small = (
            _lowest(mid, store, known[0])
            .select(F.explode(F.array(F.struct(F.col("v").alias("v"), F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e"))
            .select("e.v", "e.u")
            .filter("v != u")
            .distinct()
        )
        following = store.put(small)
        before, known = known, print_of(following)
        store.drop(mid)
        if edges is not nodes:
            store.drop(edges)
        edges = following
        if known == before:
            break
    else:
        raise RuntimeError("the components have not settled")
    # By now every edge is (node, smallest node of its component).
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).union(edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
