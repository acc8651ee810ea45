"""Ratios, weights and money. Money is integer microdollars throughout."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from agentmeter import model


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is nothing to divide by."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(
        F.lit(100.0) * part.cast("double") / whole.cast("double")
    )


def cache_read_weight(model_name: Column) -> Column:
    name = F.lower(F.coalesce(model_name, F.lit("")))
    cheap = F.lit(False)
    for marker in model.CHEAP_CACHE_MODELS:
        cheap = cheap | F.contains(name, F.lit(marker))
    return F.when(cheap, F.lit(model.WEIGHT_CACHE_READ_CHEAP)).otherwise(
        F.lit(model.WEIGHT_CACHE_READ)
    )


def response_weight(
    model_name: Column, fresh_input: Column, output: Column, cache_read: Column, c5m: Column, c1h: Column
) -> Column:
    """Weight in thousandths of an input token: exact integers, so sums do not
    depend on the order partitions arrive in."""
    return (
        fresh_input * F.lit(model.WEIGHT_INPUT)
        + output * F.lit(model.WEIGHT_OUTPUT)
        + cache_read * cache_read_weight(model_name)
        + c5m * F.lit(model.WEIGHT_CACHE_CREATE_5M)
        + c1h * F.lit(model.WEIGHT_CACHE_CREATE_1H)
    ).cast("decimal(18,0)")


def microdollars(usd: Column) -> Column:
    return F.round(usd * F.lit(1e6)).cast("bigint")


def allocate(cost_usd: Column, share: Column, total: Column) -> Column:
    """One row's part of a bill; rounded once, here."""
    exact = cost_usd * share.cast("double") / total.cast("double") * F.lit(1e6)
    return F.when(total <= 0, F.lit(0).cast("bigint")).otherwise(F.round(exact).cast("bigint"))


def concern(share_percent: Column) -> Column:
    grade = F.lit("")
    for floor, mark in reversed(model.CONCERN_GRADES):
        grade = F.when(share_percent >= floor, F.lit(mark)).otherwise(grade)
    return grade
