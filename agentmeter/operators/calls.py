"""Joining tool results to the calls that asked for them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentmeter.operators.ordered import latest_before

CALL_FIELDS = ("tool", "hash", "skill", "plugin", "mcp_server")


def join_calls(uses: DataFrame, results: DataFrame) -> DataFrame:
    """Every result with ``call``: the latest earlier use of the same id.

    Ids are corpus-wide, a use in the same event counts as earlier, and a
    repeated result counts again. ``call`` is NULL for an unmatched result.
    No time bound applies here: a cut must never sever a join, so bounds are
    put on the joined rows by result timestamp.
    """
    asked = uses.select("use_id", "chunk", "pos", "idx", *CALL_FIELDS)
    return latest_before(asked, results, "use_id", "call")


def matched(calls: DataFrame) -> DataFrame:
    return calls.filter("call is not null").select(
        *[c for c in calls.columns if c != "call"],
        *[F.col(f"call.{c}").alias(c) for c in CALL_FIELDS],
    )


def unmatched(calls: DataFrame) -> DataFrame:
    return calls.filter("call is null").drop("call")


def unanswered(uses: DataFrame, calls: DataFrame, in_window: Column) -> DataFrame:
    """Distinct ids asked inside the window that nothing answers anywhere."""
    asked = uses.filter(in_window).select("use_id").distinct()
    answered = calls.filter("call is not null").select("use_id").distinct()
    return asked.join(answered, "use_id", "left_anti")


def with_persisted(calls: DataFrame) -> DataFrame:
    """Adds ``external`` (is the externalised size attributable) and
    ``produced_bytes``: what the tool produced before anything was moved out.

    The record sits on the event, so with several results it is ambiguous and
    attributed to none of them.
    """
    external = F.col("persisted_path").isNotNull() & (F.col("event_results") == 1)
    return calls.withColumns(
        {
            "external": external,
            "produced_bytes": F.when(external, F.col("persisted_size")).otherwise(
                F.col("context_bytes") + F.col("image_bytes")
            ),
        }
    )


def check_side_files(calls: DataFrame, side_files: DataFrame) -> DataFrame:
    """Externalised results whose side file is missing or of another size, and
    records on events where they cannot be attributed."""
    claimed = with_persisted(calls).filter("persisted_path is not null")
    ambiguous = claimed.filter("not external and idx = 0").select(
        "persisted_path", "persisted_size", F.lit(None).cast("bigint").alias("length"),
        F.lit("ambiguous").alias("problem"),
    )
    listed = side_files.select(F.col("path").alias("persisted_path"), "length")
    compared = (
        claimed.filter("external and call is not null")
        .select("persisted_path", "persisted_size")
        .join(listed, "persisted_path", "left")
        .withColumn(
            "problem",
            F.when(F.col("length").isNull(), F.lit("missing")).when(
                F.col("length") != F.col("persisted_size"), F.lit("size_mismatch")
            ),
        )
        .filter("problem is not null")
    )
    return ambiguous.unionByName(compared)
