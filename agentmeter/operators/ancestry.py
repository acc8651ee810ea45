"""Questions about who descends from whom in a forest of parent links.

Links are climbed by pointer jumping: after k rounds a node points 2^k links up, so the rounds grow
with the logarithm of the depth and every round is a join on the node. From sizes of subtrees and
offsets among siblings, both summed up along the same jumps, every node gets an interval that holds
those of its descendants. Which ancestor is the nearest of some kind is then a matter of nested
intervals in order, and no (node, ancestor) pairs are formed.
"""

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentmeter.operators.ordered import latest_before, running_sum
from agentmeter.session import landed

#: Groups that the children of one parent are summed up in, and places that one chunk of intervals spans.
SIBLING_CHUNKS, PLACES_PER_CHUNK = 4096, 65536


@dataclass
class Forest:
    """``nodes`` (node, parent), a parent only where it is a node; ``jumps[k]`` (node, up), 2^k links up, where there
    are so many; ``cyclic`` (node), which are on a cycle or below one and in neither."""

    nodes: DataFrame
    jumps: list[DataFrame]
    cyclic: DataFrame


def climb(links: DataFrame) -> Forest:
    """The forest of (session, parent), one row a session; parents need no row of their own."""
    pairs = links.where("session IS NOT NULL AND parent IS NOT NULL").select(
        F.col("session").alias("node"), F.col("parent").alias("up")
    )
    jumps = [landed(pairs, "jump")]
    # A chain of n links has ended after this many rounds; what still points anywhere never ends.
    rounds = math.ceil(math.log2(jumps[0].count() + 1)) + 1
    for _ in range(rounds):
        further = jumps[-1].select(F.col("node").alias("up"), F.col("up").alias("_next"))
        jumps.append(landed(jumps[-1].join(further, "up").select("node", F.col("_next").alias("up")), "jump"))
        if jumps[-1].isEmpty():
            break
    cyclic = jumps.pop().select("node")
    if not cyclic.isEmpty():
        ending = [landed(j.join(cyclic, "node", "left_anti"), "jump") for j in jumps]
        jumps = [j for j in ending if not j.isEmpty()]
    roots = pairs.select(F.col("up").alias("node")).union(pairs.select("node")).distinct()
    whole = roots.join(cyclic, "node", "left_anti")
    parents = jumps[0] if jumps else pairs.limit(0)
    nodes = whole.join(parents, "node", "left").select("node", F.col("up").alias("parent"))
    return Forest(landed(nodes, "nodes"), jumps, cyclic)


def intervals(forest: Forest) -> DataFrame:
    """(node, first, size): descendants of a node have the ``size`` places from ``first`` on, its own the first."""
    sizes = forest.nodes.select("node", F.lit(1).cast("long").alias("size"))
    for jump in forest.jumps:
        below = jump.join(sizes, "node").groupBy(F.col("up").alias("node")).agg(F.sum("size").alias("_below"))
        more = F.col("size") + F.coalesce("_below", F.lit(0))
        sizes = landed(sizes.join(below, "node", "left").select("node", more.alias("size")), "sizes")
    # Any order of siblings will do, so it is one that spreads a parent's children over chunks.
    spread = forest.nodes.join(sizes, "node").select(
        "node",
        "size",
        F.coalesce("parent", F.lit("")).alias("under"),
        F.col("parent").isNotNull().cast("long").alias("below"),
        F.pmod(F.xxhash64("node"), F.lit(SIBLING_CHUNKS)).alias("chunk"),
    )
    ordered = running_sum(spread, ["under", "below"], ["node"], "size", "upto")
    first = landed(ordered.select("node", "size", (F.col("upto") - F.col("size") + F.col("below")).alias("first")), "first")
    for jump in forest.jumps:
        above = jump.join(first.select(F.col("node").alias("up"), F.col("first").alias("_above")), "up")
        moved = F.col("first") + F.coalesce("_above", F.lit(0))
        joined = first.join(above.select("node", "_above"), "node", "left")
        first = landed(joined.select("node", "size", moved.alias("first")), "first")
    return first.select("node", "first", "size")


def nearest_owner(owned: DataFrame, placed: DataFrame) -> DataFrame:
    """(item, node, ancestor) of each distinct (node, item) whose item a proper ancestor has too: the nearest one.

    ``placed`` are ``intervals``; nodes without one have no ancestors and are left out.
    """
    spans = owned.distinct().join(placed, "node")
    edges = spans.select(
        "item",
        "node",
        F.explode(
            F.array(
                F.struct(F.col("first").alias("pos"), F.lit(1).alias("step")),
                F.struct((F.col("first") + F.col("size")).alias("pos"), F.lit(-1).alias("step")),
            )
        ).alias("edge"),
    ).select("item", "node", "edge.*", F.floor(F.col("edge.pos") / PLACES_PER_CHUNK).alias("chunk"))
    # Where one span ends and the next begins, the end comes first.
    opened = landed(running_sum(edges, ["item"], ["pos", "step"], "step", "depth").where("step = 1"), "opened")
    # The span around one at depth d is the last that was opened at depth d - 1.
    named = lambda depth: F.concat_ws("\n", depth.cast("string"), "item").alias("level")
    place = ["chunk", "pos", F.lit(0).cast("bigint").alias("idx")]
    around = opened.select(named(F.col("depth")), *place, F.col("node").alias("ancestor"))
    asking = opened.where("depth > 1").select(named(F.col("depth") - 1), *place, "item", "node")
    found = latest_before(around, asking, "level", "hit")
    return found.select("item", "node", F.col("hit.ancestor").alias("ancestor"))
