"""Longest-prefix matching against a table of configured names."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentmeter.functions.names import prefixes


def longest_prefix(
    names: DataFrame, name: str, authority: DataFrame, owner: str, out: str, body: Column, separator: str
) -> DataFrame:
    """``names`` with the longest ``owner`` that prefixes ``body`` at a separator.

    ``body`` is the part of the name that is matched. Candidate prefixes are
    generated and equi-joined, so Spark picks broadcast or shuffle by size.
    Names nobody owns keep a NULL.
    """
    candidates = (
        names.select(name)
        .distinct()
        .withColumn("_candidate", F.explode(prefixes(body, separator)))
    )
    owners = authority.select(F.col(owner).alias("_candidate")).distinct()
    best = (
        candidates.join(owners, "_candidate")
        .groupBy(name)
        .agg(F.max_by("_candidate", F.length("_candidate")).alias(out))
    )
    return names.join(best, name, "left")


def tool_servers(tools: DataFrame, servers: DataFrame) -> DataFrame:
    """``server``: the configured server whose ``<server>_`` prefixes the tool."""
    return longest_prefix(tools, "tool", servers, "server", "server", F.col("tool"), "_")


def segment_plugins(segments: DataFrame, plugins: DataFrame) -> DataFrame:
    """``plugin``: the configured plugin inside ``plugin_<plugin>_<server>``."""
    body = F.when(
        F.startswith("segment", F.lit("plugin_")), F.expr("substr(segment, 8)")
    )
    return longest_prefix(segments, "segment", plugins, "plugin", "plugin", body, "_")


def rent_segments(rent: DataFrame, plugins: DataFrame) -> DataFrame:
    """``plugin`` and ``segment`` of each ``plugin:<plugin>:<server>`` rent key.

    Keys in any other form, or of a plugin nobody configured, keep their own
    spelling as the segment and have no plugin.
    """
    body = F.when(F.startswith("key", F.lit("plugin:")), F.expr("substr(key, 8)"))
    matched = longest_prefix(rent, "key", plugins, "plugin", "plugin", body, ":")
    server = F.expr("substr(key, 8 + length(plugin) + 1)")
    return matched.withColumn(
        "segment",
        F.when(
            F.col("plugin").isNotNull(), F.concat(F.lit("plugin_"), "plugin", F.lit("_"), server)
        ).otherwise(F.col("key")),
    )
