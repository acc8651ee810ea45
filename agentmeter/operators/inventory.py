"""What a corpus holds."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rollup(events: DataFrame, in_window: Column) -> DataFrame:
    """One row per (type, version): the only pass over events."""
    placed = F.when(F.col("ts") != "", F.col("ts"))
    return events.groupBy("type", "version").agg(
        F.count(F.lit(1)).alias("all_events"),
        F.count_if(in_window).alias("events"),
        F.count(placed).alias("timestamped"),
        F.count_if(in_window & placed.isNotNull()).alias("placed_in_window"),
        F.count_if("is_unknown").alias("unknown_events"),
        F.min(placed).alias("first_ts"),
        F.max(placed).alias("last_ts"),
    )


def by_type(rolled: DataFrame) -> DataFrame:
    return rolled.groupBy("type").agg(F.sum("events").alias("events")).filter("events > 0")


def by_version(rolled: DataFrame) -> DataFrame:
    return (
        rolled.filter("version <> ''")
        .groupBy("version")
        .agg(F.sum("events").alias("events"))
        .filter("events > 0")
    )


def unknown_types(rolled: DataFrame) -> DataFrame:
    return (
        rolled.groupBy("type")
        .agg(F.sum("unknown_events").alias("unknown_type_events"))
        .filter("unknown_type_events > 0")
    )


def never_timestamped(rolled: DataFrame) -> DataFrame:
    """Types a window cannot place; the nameless type is not one of them."""
    return (
        rolled.filter("type <> ''")
        .groupBy("type")
        .agg(F.sum("timestamped").alias("timestamped"), F.sum("all_events").alias("events"))
        .filter("timestamped = 0")
        .select("type", "events")
    )


def date_range(rolled: DataFrame) -> DataFrame:
    return rolled.agg(
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.coalesce(F.sum("placed_in_window"), F.lit(0)).alias("placed"),
    )


def file_counters(manifest: DataFrame) -> DataFrame:
    zero = F.lit(0)
    return manifest.agg(
        F.count_if("is_transcript").alias("files"),
        F.coalesce(F.sum("bytes"), zero).alias("bytes"),
        F.count_if(F.col("is_transcript") & ~F.col("is_subagent")).alias("files_top_level"),
        F.count_if("is_subagent").alias("files_subagent"),
        F.coalesce(F.sum("parse_errors"), zero).alias("parse_errors"),
        F.count_if(~F.col("is_transcript")).alias("files_non_transcript"),
        F.coalesce(F.sum("journal_records"), zero).alias("non_transcript_records"),
    )


def retention_gap(counters: DataFrame, cached: DataFrame) -> DataFrame:
    """Sessions the cache document knows minus transcripts still on disk."""
    return counters.withColumn("stats_cache_sessions", cached.select("total_sessions").scalar()).withColumn(
        "retention_gap", F.col("stats_cache_sessions") - F.col("files_top_level")
    )
