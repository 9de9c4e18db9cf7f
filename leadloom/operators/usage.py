"""Metering: sums, quotas, costs and rate windows over the usage log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits where none are stored.
DEFAULT_DAILY = {"purchase": 60, "signup": 900, "click": 2500}


def daily(events: DataFrame) -> DataFrame:
    """Units of each operation on each UTC day."""
    return events.groupBy(F.date_trunc("day", "created_at").alias("day"), "operation").agg(F.coalesce(F.sum("quantity"), F.lit(0)).cast("long").alias("units"), F.count("*").alias("events"))


def quota(used: DataFrame, requested: int, limits: dict[str, int] | None = None) -> DataFrame:
    """Whether `requested` more units would be allowed; operations without a limit always are."""
    limits = DEFAULT_DAILY if limits is None else limits
    table = F.create_map(*(F.lit(x) for kv in limits.items() for x in kv))
    limit = F.try_element_at(table, F.col("operation"))
    return used.withColumn("limit", limit).withColumn("allowed", F.coalesce(F.col("units") + requested <= limit, F.lit(True))).withColumn("remaining", F.greatest(F.lit(0), limit - F.col("units")))


def cost(events: DataFrame, prices: DataFrame, multiplier: Column) -> DataFrame:
    """Estimated cost by operation: unit price times units; an operation without a price is UNKNOWN."""
    priced = events.join(prices, "operation", "left")
    amount = F.round(F.sum(F.col("price") * F.col("quantity") * multiplier), 4)
    return priced.groupBy("operation").agg(F.count("*").alias("events"), amount.alias("cost"), F.when(F.max("price").isNull(), "UNKNOWN").otherwise("ESTIMATED").alias("cost_status"))


def minute_windows(events: DataFrame, limit: int) -> DataFrame:
    """Hits per user, operation and clock minute that exceed the limit (windows begin with the clock, not with the first hit)."""
    counted = events.groupBy("user_id", "operation", F.window("created_at", "1 minute").alias("w")).agg(F.count("*").alias("hits"))
    return counted.filter(F.col("hits") > limit).select("user_id", "operation", F.col("w.start").alias("window_start"), "hits")
