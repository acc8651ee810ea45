"""Byte volume of tool results, and what installed tooling costs unused."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentmeter.functions.names import mcp_canon, mcp_server
from agentmeter.model import UNRESOLVED_PLUGIN
from agentmeter.operators import calls as call_ops
from agentmeter.operators.matching import rent_segments, segment_plugins

STATS = ("calls", "context_bytes", "image_bytes", "produced_bytes", "errors")
EXTRA = ("image_results", "externalised_results", "externalised_produced_bytes", "externalised_context_bytes")


def rollup(calls: DataFrame, in_window: Column) -> DataFrame:
    """One row per tool with every figure the command reports.

    A tool's server and plugin follow from its name, so this is the only
    aggregate over results; everything else folds this small table. The NULL
    tool row counts unmatched results, which no window restricts.
    """
    is_matched = F.col("call").isNotNull()
    counted = is_matched & in_window
    rows = call_ops.with_persisted(calls)
    summed = lambda value, when=F.lit(True): F.coalesce(
        F.sum(F.when(counted & when, value)), F.lit(0)
    ).cast("bigint")
    return rows.groupBy(F.col("call.tool").alias("tool")).agg(
        F.count_if(~is_matched).alias("unmatched_results"),
        F.count_if(counted).alias("calls"),
        summed(F.col("context_bytes")).alias("context_bytes"),
        summed(F.col("image_bytes")).alias("image_bytes"),
        summed(F.col("produced_bytes")).alias("produced_bytes"),
        F.count_if(counted & F.col("is_error")).alias("errors"),
        F.count_if(counted & (F.col("image_bytes") > 0)).alias("image_results"),
        F.count_if(counted & F.col("external")).alias("externalised_results"),
        summed(F.col("persisted_size"), F.col("external")).alias("externalised_produced_bytes"),
        summed(F.col("context_bytes"), F.col("external")).alias("externalised_context_bytes"),
    )


def by_tool(rolled: DataFrame) -> DataFrame:
    return rolled.filter("tool is not null and calls > 0").select("tool", *STATS)


def by_server(per_tool: DataFrame) -> DataFrame:
    return (
        per_tool.withColumn("server", mcp_server(F.col("tool")))
        .filter("server <> ''")
        .groupBy("server")
        .agg(*[F.sum(c).alias(c) for c in STATS])
    )


def by_plugin(per_server: DataFrame, plugins: DataFrame) -> DataFrame:
    """Servers a plugin provides, by plugin; one row for those nobody claims."""
    segments = per_server.filter("startswith(server, 'plugin_')").withColumnRenamed(
        "server", "segment"
    )
    return (
        segment_plugins(segments, plugins)
        .groupBy(F.coalesce("plugin", F.lit(UNRESOLVED_PLUGIN)).alias("plugin"))
        .agg(*[F.sum(c).alias(c) for c in STATS])
    )


def unresolved_segments(per_server: DataFrame, plugins: DataFrame) -> DataFrame:
    segments = per_server.select(F.col("server").alias("segment")).filter(
        "startswith(segment, 'plugin_')"
    )
    return segment_plugins(segments, plugins).filter("plugin is null").select("segment")


def rent_by_server(key_bytes: DataFrame, plugins: DataFrame | None) -> DataFrame:
    """Instruction bytes per server, in the spelling tool names use."""
    if plugins is None:
        spelled = key_bytes.withColumn("segment", F.col("key"))
    else:
        spelled = rent_segments(key_bytes, plugins)
    return spelled.groupBy(mcp_canon(F.col("segment")).alias("server")).agg(
        F.sum("attachment_bytes").alias("rent_bytes")
    )


def rent_by_plugin(key_bytes: DataFrame, plugins: DataFrame) -> DataFrame:
    return (
        rent_segments(key_bytes, plugins)
        .filter("plugin is not null")
        .groupBy("plugin")
        .agg(F.sum("attachment_bytes").alias("rent_bytes"))
    )


def rent_with_calls(stats: DataFrame, rent: DataFrame, key: str) -> DataFrame:
    """Both sides of one key space. A key with rent and no call is a counted
    zero; a key with calls and no rent has no rent figure at all."""
    return (
        stats.join(rent, key, "full_outer")
        .withColumn("rent_only", F.col("calls").isNull())
        .na.fill(0, list(STATS))
    )


def skill_calls(uses: DataFrame, in_window: Column) -> DataFrame:
    return (
        uses.filter(in_window)
        .filter("invoked_skill is not null")
        .groupBy(F.col("invoked_skill").alias("skill"))
        .agg(F.count(F.lit(1)).alias("skill_calls"))
    )


def skill_usage(rent: DataFrame, invoked: DataFrame) -> DataFrame:
    """Every skill that is listed or called, with its calls (0 when only listed)."""
    return rent.join(invoked, "skill", "full_outer").na.fill(0, ["skill_calls"])
