"""Connected components of a link table, by hooking and shortcutting."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentmeter.llm.common import land


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b); root is the smallest node reachable.

    Every round lets a node and its present root take the smallest root among the
    node's neighbours, then replaces each root by its own root. Trees only ever
    point to smaller nodes, so the rounds end when nothing changes; their number
    grows with the logarithm of the longest chain. Every round is landed, and only
    the number of changed rows comes to the driver. Nulls and self-links are
    ignored; repeated links count once; no links give no rows.
    """
    pairs = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    pairs = land(
        pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "links",
    )
    roots = land(
        pairs.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")),
        "roots",
    )
    while True:
        near = (
            pairs.join(roots, pairs.b == roots.node)
            .groupBy("a")
            .agg(F.min("root").alias("best"))
        )
        own = roots.join(near, roots.node == near.a).select("node", "root", "best")
        offers = own.select("node", F.least("root", "best").alias("root")).union(
            own.select(F.col("root").alias("node"), F.least("root", "best").alias("root"))
        )
        hooked = land(offers.groupBy("node").agg(F.min("root").alias("root")), "hooked")
        up = hooked.select(F.col("node").alias("parent"), F.col("root").alias("top"))
        short = hooked.join(up, hooked.root == up.parent).select("node", F.col("top").alias("root"))
        before = roots.select("node", F.col("root").alias("was"))
        marked = land(
            short.join(before, "node").select("node", "root", (F.col("root") != F.col("was")).alias("moved")),
            "roots",
        )
        roots = marked.select("node", "root")
        if marked.where("moved").limit(1).count() == 0:
            return roots
