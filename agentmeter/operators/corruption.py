"""Evidence that a result was altered before the agent read it."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentmeter.functions.numbers import percent

COUNTS = ("calls", "errors", "denied", "failures", "empty_results", "truncated_results")


def rollup(calls: DataFrame, in_window: Column) -> DataFrame:
    """One row per (tool, marker, denial kind); the command's only pass.

    Rows with a NULL tool carry the corpus-wide defect counters.
    """
    is_matched = F.col("call").isNotNull()
    counted = is_matched & in_window
    denied = F.col("denial") != ""
    empty = (
        (F.col("context_bytes") == 0)
        & (F.col("image_bytes") == 0)
        & F.col("persisted_path").isNull()
    )
    first_of_event = F.col("idx") == 0
    return calls.groupBy(F.col("call.tool").alias("tool"), "marker", "denial").agg(
        F.count_if(~is_matched).alias("unmatched_results"),
        F.count_if(first_of_event & denied & (F.col("event_errors") > 1)).alias("ambiguous_denials"),
        F.count_if(counted).alias("calls"),
        F.count_if(counted & F.col("is_error")).alias("errors"),
        F.count_if(counted & F.col("is_error") & denied).alias("denied"),
        F.count_if(counted & F.col("is_error") & ~denied).alias("failures"),
        F.count_if(counted & empty).alias("empty_results"),
        F.count_if(counted & (F.col("marker") != "")).alias("truncated_results"),
    )


def with_rates(counts: DataFrame) -> DataFrame:
    return counts.withColumns(
        {
            "error_rate_percent": percent(F.col("errors"), F.col("calls")),
            "failure_rate_percent": percent(F.col("failures"), F.col("calls")),
        }
    )


def by_tool(rolled: DataFrame) -> DataFrame:
    summed = rolled.filter("tool is not null").groupBy("tool")
    return with_rates(summed.agg(*[F.sum(c).alias(c) for c in COUNTS]).filter("calls > 0"))


def by_marker(rolled: DataFrame) -> DataFrame:
    return (
        rolled.filter("marker <> ''")
        .groupBy("marker")
        .agg(F.sum("truncated_results").alias("truncated_results"))
        .filter("truncated_results > 0")
    )


def by_denial(rolled: DataFrame) -> DataFrame:
    return (
        rolled.filter("denial <> ''")
        .groupBy("denial")
        .agg(F.sum("denied").alias("denied"))
        .filter("denied > 0")
    )


def totals(rolled: DataFrame) -> DataFrame:
    summed = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS]
    one = rolled.agg(
        *summed,
        F.coalesce(F.sum("unmatched_results"), F.lit(0)).alias("unmatched_results"),
        F.coalesce(F.sum("ambiguous_denials"), F.lit(0)).alias("ambiguous_denials"),
        F.countDistinct(F.when(F.col("calls") > 0, F.col("tool"))).alias("distinct_tools"),
        F.countDistinct(F.when(F.col("truncated_results") > 0, F.col("marker"))).alias(
            "truncation_marker_kinds"
        ),
    )
    return with_rates(one).withColumns(
        {
            "empty_rate_percent": percent(F.col("empty_results"), F.col("calls")),
            "truncation_rate_percent": percent(F.col("truncated_results"), F.col("calls")),
        }
    )
