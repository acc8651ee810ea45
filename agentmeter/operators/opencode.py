"""Tool parts kept one row per call, call and result together."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentmeter.operators.matching import tool_servers


def tool_parts(parts: DataFrame) -> DataFrame:
    """(tool, session, ms, output_bytes, is_error) of the tool parts. The error
    flag is NULL where no status was recorded."""
    status = F.get_json_object("data", "$.state.status")
    return parts.filter(F.get_json_object("data", "$.type") == "tool").select(
        F.coalesce(F.get_json_object("data", "$.tool"), F.lit("")).alias("tool"),
        F.col("session_id").alias("session"),
        F.col("time_created").alias("ms"),
        F.octet_length(F.coalesce(F.get_json_object("data", "$.state.output"), F.lit("")))
        .cast("bigint")
        .alias("output_bytes"),
        F.when(status.isNotNull(), (status == "error").cast("bigint")).alias("is_error"),
    )


def by_tool(tool_rows: DataFrame, in_window: Column) -> DataFrame:
    return (
        tool_rows.filter(in_window)
        .groupBy("tool")
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.sum("output_bytes").alias("context_bytes"),
            F.sum("is_error").alias("errors"),
            F.min("ms").alias("min_ms"),
            F.max("ms").alias("max_ms"),
        )
    )


def by_server(per_tool: DataFrame, servers: DataFrame) -> DataFrame:
    """Configured servers by tool-name prefix. A server holding one tool with
    an unrecorded error count has no error count either."""
    return (
        tool_servers(per_tool, servers)
        .filter("server is not null")
        .groupBy("server")
        .agg(
            F.sum("calls").alias("calls"),
            F.sum("context_bytes").alias("context_bytes"),
            F.when(F.bool_and(F.col("errors").isNotNull()), F.sum("errors")).alias("errors"),
        )
    )


def totals(per_tool: DataFrame) -> DataFrame:
    return per_tool.agg(
        F.count(F.lit(1)).alias("distinct_tools"),
        F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"),
        F.coalesce(F.sum("context_bytes"), F.lit(0)).alias("context_bytes"),
        F.when(
            F.coalesce(F.bool_and(F.col("errors").isNotNull()), F.lit(True)),
            F.coalesce(F.sum("errors"), F.lit(0)),
        ).alias("errors"),
        F.min("min_ms").alias("min_ms"),
        F.max("max_ms").alias("max_ms"),
    )


def observations(tool_rows: DataFrame, in_window: Column) -> DataFrame:
    """Distinct (tool, session) pairs with the span each covers."""
    return (
        tool_rows.filter(in_window)
        .groupBy("tool", "session")
        .agg(F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"))
    )
