"""Failure patterns: retry loops, cross-session repeats, who made the call."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentmeter import model
from agentmeter.operators.ordered import collapse_runs, rank_within


def retry_loops(
    matched: DataFrame, in_window: Column, windowed: bool, results: DataFrame | None = None
) -> DataFrame:
    """Runs of at least three consecutive errors on one identical call.

    Consecutive means within the session's joined results, in scan order; the
    window only decides which finished runs are kept, so a cut can neither
    break a run nor make one. ``results`` (unjoined) is only counted, to find
    sessions too large for one task.
    """
    steps = matched.select(
        "session", "chunk", "pos", "idx", "tool", "hash", "is_error",
        F.lit(1).alias("streak"),
        (F.col("denial") != "").cast("int").alias("denied"),
        in_window.cast("int").alias("in_window"),
    )
    runs = collapse_runs(
        steps, ["session"], ["tool", "hash", "is_error"], ["streak", "denied", "in_window"]
    )
    loops = runs.filter(F.col("is_error") & (F.col("streak") >= model.RETRY_LOOP_MIN))
    return loops.filter("in_window > 0") if windowed else loops


def numbered_loops(loops: DataFrame) -> DataFrame:
    """``key``: session/tool/hash, with #n from the second loop of a triple."""
    ranked = rank_within(loops, ["session", "tool", "hash"], ["pos"], "occurrence")
    triple = F.concat_ws("/", "session", "tool", "hash")
    return ranked.withColumn(
        "key",
        F.when(F.col("occurrence") > 1, F.concat(triple, F.lit("#"), F.col("occurrence"))).otherwise(
            triple
        ),
    )


def call_outcomes(matched: DataFrame, in_window: Column) -> DataFrame:
    """In-window counts per (tool, hash, session), pre-aggregated once."""
    denied = F.col("denial") != ""
    return (
        matched.filter(in_window)
        .groupBy("tool", "hash", "session")
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.count_if("is_error").alias("errors"),
            F.count_if(F.col("is_error") & ~denied).alias("failures"),
            F.count_if(F.col("is_error") & denied).alias("denied"),
        )
    )


def repeated_failures(outcomes: DataFrame) -> DataFrame:
    """Calls that errored in at least two distinct sessions."""
    return (
        outcomes.groupBy("tool", "hash")
        .agg(
            *[F.sum(c).alias(c) for c in ("calls", "errors", "failures", "denied")],
            F.count_if(F.col("errors") > 0).alias("error_sessions"),
        )
        .filter(F.col("error_sessions") >= model.REPEATED_FAILURE_MIN_SESSIONS)
        .withColumn("key", F.concat_ws("/", "tool", "hash"))
    )


def by_attribution(matched: DataFrame, in_window: Column) -> DataFrame:
    """Errors by the attribution of the turn that made the call. A turn that
    recorded no value adds no row."""
    dims = F.array(
        *[
            F.struct(F.lit(name).alias("dimension"), F.col(column).alias("key"))
            for name, column, _ in model.FAILURE_DIMENSIONS
        ]
    )
    denied = F.col("denial") != ""
    return (
        matched.filter(in_window)
        .filter("is_error")
        .select("denial", F.explode(F.filter(dims, lambda d: F.coalesce(d["key"], F.lit("")) != "")).alias("d"))
        .groupBy("d.dimension", "d.key")
        .agg(
            F.count(F.lit(1)).alias("errors"),
            F.count_if(~denied).alias("failures"),
            F.count_if(denied).alias("denied"),
        )
    )
