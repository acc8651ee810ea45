"""Tokens, re-billing and the allocation of measured bills."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentmeter import model
from agentmeter.functions.numbers import allocate, percent, ratio, response_weight
from agentmeter.operators.ordered import first_per_key, last_per_key

TOKENS = ("responses", "fresh_tokens", "rebilled_tokens", "output_tokens", "thinking_tokens")


def distinct_responses(usage: DataFrame) -> DataFrame:
    """The first sighting of each message id; ``sightings`` counts them all."""
    return first_per_key(usage, "message_id", "sightings")


def duplicate_counters(responses: DataFrame) -> DataFrame:
    naive = F.coalesce(F.sum("sightings"), F.lit(0))
    distinct = F.count(F.lit(1))
    return responses.agg(
        naive.alias("responses_naive"),
        distinct.alias("responses_distinct"),
        (naive - distinct).alias("responses_duplicate"),
    ).withColumn(
        "duplicate_rate_percent",
        percent(F.col("responses_duplicate"), F.col("responses_naive")),
    )


def weighed(responses: DataFrame) -> DataFrame:
    return responses.withColumns(
        {
            "fresh_tokens": F.col("input") + F.col("cache_5m") + F.col("cache_1h"),
            "weight": response_weight(
                F.col("model"), F.col("input"), F.col("output"), F.col("cache_read"),
                F.col("cache_5m"), F.col("cache_1h"),
            ),
        }
    )


def rollup(responses: DataFrame) -> DataFrame:
    """Sums by (session, model, dimension, key): the finest grain anything
    needs, so one pass over responses feeds every other figure."""
    dims = [F.struct(F.lit("session").alias("dimension"), F.col("session").alias("key"))]
    for name, column, _ in model.ATTRIBUTION_DIMENSIONS:
        key = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(model.UNATTRIBUTED))
        dims.append(F.struct(F.lit(name).alias("dimension"), key.alias("key")))
    return (
        weighed(responses)
        .withColumn("d", F.explode(F.array(*dims)))
        .groupBy("session", "model", "d.dimension", "d.key")
        .agg(
            F.count(F.lit(1)).alias("responses"),
            F.sum("sightings").alias("sightings"),
            F.sum("fresh_tokens").alias("fresh_tokens"),
            F.sum("cache_read").alias("rebilled_tokens"),
            F.sum("output").alias("output_tokens"),
            F.sum("thinking").alias("thinking_tokens"),
            F.sum("weight").alias("weight"),
        )
    )


def _sums():
    return [F.sum(c).alias(c) for c in TOKENS]


def by_dimension(rolled: DataFrame) -> DataFrame:
    return (
        rolled.groupBy("dimension", "key")
        .agg(*_sums())
        .withColumn("rebill_multiplier", ratio(F.col("rebilled_tokens"), F.col("fresh_tokens")))
    )


def by_session_model(rolled: DataFrame) -> DataFrame:
    return (
        rolled.filter("dimension = 'session'")
        .groupBy("session", "model")
        .agg(*_sums(), F.sum("weight").alias("weight"))
    )


def totals(rolled: DataFrame) -> DataFrame:
    whole = rolled.filter("dimension = 'session'")
    zeroed = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*TOKENS, "sightings")]
    return whole.agg(*zeroed).withColumn(
        "rebill_multiplier", ratio(F.col("rebilled_tokens"), F.col("fresh_tokens"))
    )


def session_bills(bills: DataFrame) -> DataFrame:
    """The last bill each session recorded."""
    return last_per_key(bills, "session")


def model_bills(latest: DataFrame) -> DataFrame:
    return latest.select("session", F.explode("models").alias("model", "bill")).select(
        "session",
        "model",
        F.col("bill.cost_usd").alias("cost_usd"),
        (
            F.col("bill.input") + F.col("bill.output") + F.col("bill.cache_read")
            + F.col("bill.cache_create")
        ).alias("billed_tokens"),
    )


def allocation(rolled: DataFrame, per_model_bills: DataFrame) -> DataFrame:
    """Each billed (session, model) spread over its rows by weight. A slice
    nobody billed contributes no row, never a zero."""
    whole = by_session_model(rolled).select("session", "model", F.col("weight").alias("whole"))
    slices = per_model_bills.select("session", "model", "cost_usd").join(whole, ["session", "model"])
    return rolled.join(slices, ["session", "model"]).withColumn(
        "microdollars", allocate(F.col("cost_usd"), F.col("weight"), F.col("whole"))
    )


def cost_by_dimension(allocated: DataFrame) -> DataFrame:
    return allocated.groupBy("dimension", "key").agg(F.sum("microdollars").alias("cost_usd"))


def coverage(per_model_bills: DataFrame, session_models: DataFrame) -> DataFrame:
    """Each billed slice against what the transcript recorded for it."""
    recorded = session_models.select(
        "session",
        "model",
        (F.col("fresh_tokens") + F.col("rebilled_tokens") + F.col("output_tokens")).alias(
            "transcript_tokens"
        ),
    )
    return per_model_bills.join(recorded, ["session", "model"], "left").withColumns(
        {
            "coverage_ratio": F.when(F.col("transcript_tokens").isNull(), F.lit(0.0)).otherwise(
                ratio(F.col("transcript_tokens"), F.col("billed_tokens"))
            ),
            "is_absent": F.col("transcript_tokens").isNull(),
            "billed_tokens": F.when(F.col("transcript_tokens").isNotNull(), F.col("billed_tokens")),
        }
    )


def availability(sessions: DataFrame, latest: DataFrame) -> DataFrame:
    """1 where dollars exist for the session, else 0."""
    billed = latest.select("session", F.lit(1).alias("_billed"))
    return sessions.join(billed, "session", "left").withColumn(
        "dollars_available", F.coalesce("_billed", F.lit(0)).cast("bigint")
    ).drop("_billed")


def dimension_health(per_dimension: DataFrame) -> DataFrame:
    """Per attribution dimension: does any response claim it at all, and how
    much of its re-billed volume is unclaimed."""
    unclaimed = F.col("key") == model.UNATTRIBUTED
    return (
        per_dimension.filter("dimension <> 'session'")
        .groupBy("dimension")
        .agg(
            F.coalesce(F.sum(F.when(~unclaimed, F.col("responses"))), F.lit(0)).alias("claimed"),
            F.coalesce(F.sum(F.when(unclaimed, F.col("rebilled_tokens"))), F.lit(0)).alias(
                "unclaimed_tokens"
            ),
            F.sum("rebilled_tokens").alias("rebilled_tokens"),
        )
        .withColumns(
            {
                "unclaimed_percent": percent(F.col("unclaimed_tokens"), F.col("rebilled_tokens")),
                "is_absent": F.col("claimed") == 0,
            }
        )
        .withColumn(
            "is_thin",
            ~F.col("is_absent") & (F.col("unclaimed_percent") > model.THIN_ATTRIBUTION_PERCENT),
        )
    )


def thinnest_dimension(per_dimension: DataFrame) -> DataFrame:
    """The dimension whose unclaimed row holds most; ties go to declared order."""
    position = F.lit(0)
    for i, (name, _, _) in enumerate(model.ATTRIBUTION_DIMENSIONS):
        position = F.when(F.col("dimension") == name, F.lit(i)).otherwise(position)
    best = F.struct(F.col("rebilled_tokens"), -position)
    return (
        per_dimension.filter(
            (F.col("dimension") != "session")
            & (F.col("key") == model.UNATTRIBUTED)
            & (F.col("rebilled_tokens") > 0)
        )
        .agg(
            F.max_by("dimension", best).alias("dimension"),
            F.max("rebilled_tokens").alias("unclaimed_tokens"),
        )
        .filter("dimension is not null")
    )


def sessions_seen(events: DataFrame, in_window: Column) -> DataFrame:
    return events.filter(in_window).filter("session <> ''").select("session").distinct()
