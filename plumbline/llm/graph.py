"""Connected components with DataFrame operations only.

Rounds of contraction: every node points to the neighbour (or itself) of least
priority, a hash that changes each round, and the graph shrinks to the nodes
pointed to.  On a path about half the nodes remain, on a star one, so the rounds
are few.  Afterwards the pointers are followed back and every component is named
by its least node.  Per node only a minimum is aggregated, which combines before
the shuffle; a hub's edges are never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.cluster import Scratch, if_few, is_empty


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges`` has longs ``a`` and ``b``; the result each node's ``id`` and ``component``, its component's least node."""
    left = scratch.cut(edges.where("a <> b").select("a", "b").distinct())
    trail: list[DataFrame] = []
    while not is_empty(left):
        salt = F.lit(len(trail))
        both = left.union(left.select("b", "a"))
        order = lambda c: F.struct(F.xxhash64(salt, c).alias("p"), c.alias("v"))
        points = scratch.cut(both.groupBy(F.col("a").alias("id")).agg(F.min(order(F.col("b"))).alias("m")).select("id", F.least("m", order(F.col("id")))["v"].alias("to")))
        trail.append(points)
        at = lambda n: points.select(F.col("id").alias(n), F.col("to").alias(f"{n}_to"))  # noqa: E731, B023
        left, old = scratch.cut(left.join(at("a"), "a").join(at("b"), "b").where("a_to <> b_to").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct()), left
        scratch.drop(old)
    if not trail:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = trail[-1]
    for points in reversed(trail[:-1]):
        later = roots.select(F.col("id").alias("to"), F.col("to").alias("root"))
        roots = points.join(later, "to", "left").select("id", F.coalesce("root", "to").alias("to"))
    roots = scratch.cut(roots)
    names = roots.groupBy("to").agg(F.min("id").alias("component"))
    return scratch.cut(roots.join(names, "to").select("id", "component"))


def merged(known: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """The components after more links, found between the components so far."""
    of = lambda n: known.select(F.col("id").alias(n), F.col("component").alias(f"{n}_group"))
    both = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    over = components(both.select(F.coalesce("a_group", "a").alias("a"), F.coalesce("b_group", "b").alias("b")), scratch)
    every = known.unionByName(over.join(known, "id", "left_anti").select("id", F.col("id").alias("component")))
    named = over.select(F.col("id").alias("component"), F.col("component").alias("now"))
    return scratch.cut(every.join(named, "component", "left").select("id", F.coalesce("now", "component").alias("component")))


def blocks(members: DataFrame, key: str, size: int, scratch: Scratch) -> DataFrame:
    """(key, main, apart, last) of the buckets of several components (``key`` and ``g``), to be dealt in blocks of ``size``.

    ``last`` is the number of the last block.  Of a bucket beyond one block, ``main`` is
    the component of the most members: they have the blocks from ``apart`` on to
    themselves, the others those before.
    """
    mixed = scratch.cut(members.groupBy(key).agg(F.min("g").alias("least"), F.max("g").alias("most"), F.count("*").alias("all")).where("least <> most").select(key, "all"))
    large = scratch.cut(mixed.where(F.col("all") > size).select(key))
    mains = scratch.cut(members.join(if_few(large), key, "left_semi").groupBy(key, "g").agg(F.count("*").alias("n")).groupBy(key).agg(F.max(F.struct("n", "g")).alias("m")).select(key, "m.n", F.col("m.g").alias("main")))
    n = F.coalesce("n", F.lit(0))
    many = lambda rows: F.ceil(rows / size).cast("int")
    return scratch.cut(mixed.join(if_few(mains), key, "left").select(key, "main", many(F.col("all") - n).alias("apart"), (many(F.col("all") - n) + many(n) - 1).alias("last")))


def dealt(members: DataFrame, key: str, node: str) -> DataFrame:
    """Members of buckets (with their ``blocks``) once for each block they meet: ``own``, and ``other``.

    Members of one component need no comparison, so the blocks of ``main`` meet those of
    the other members and not each other.
    """
    at, most = F.xxhash64(node, key), F.col("g").eqNullSafe(F.col("main"))
    own = F.when(most, F.col("apart") + F.pmod(at, F.col("last") + 1 - F.col("apart"))).otherwise(F.pmod(at, F.col("apart"))).cast("int")
    last = F.when(most, F.col("apart") - 1).otherwise(F.col("last"))
    return members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last))).drop("main", "apart", "last")
