"""Daily roll-ups: one row for each kind and local day.

Readings need kind, day, instant, value and source. Sums go through each source's own total, so that two devices that
count the same steps are not added up; a hot (kind, day) is pre-aggregated on the map side like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as V
from .classify import bounded, refusal

#: The bucket of readings without a source. It takes part in ties by this name.
UNATTRIBUTED = "(unattributed)"


def source_totals(readings: DataFrame, value: Column | str = "value") -> DataFrame:
    """Totals by kind, day and source."""
    v = F.col(value) if isinstance(value, str) else value
    return readings.groupBy("kind", "day", F.coalesce("source", F.lit(UNATTRIBUTED)).alias("source")).agg(F.sum(v).alias("total"))


def winning_source(readings: DataFrame, value: Column | str = "value") -> DataFrame:
    """kind, day, value, source: the largest source's total; of equal ones the least name. A bucket without a name credits nobody."""
    best = source_totals(readings, value).groupBy("kind", "day").agg(F.max("total").alias("value"), F.min_by("source", F.struct(-F.col("total"), "source")).alias("source"))
    return best.withColumn("source", F.nullif("source", F.lit(UNATTRIBUTED)))


def latest_source(readings: DataFrame, keys: tuple[str, ...] = ("kind", "day"), at: str = "instant") -> DataFrame:
    """keys, source: the source of the latest reading; at one instant a named one before none, then the least name."""
    one = readings.groupBy(*keys, at).agg(F.min("source").alias("source"))
    return one.groupBy(*keys).agg(F.max_by("source", at).alias("source"))


def spread(readings: DataFrame, value: Column | str = "value") -> DataFrame:
    v = F.col(value) if isinstance(value, str) else value
    return readings.groupBy("kind", "day").agg((F.sum(v).cast("double") / F.count(v)).alias("value"), F.min(v).cast("double").alias("min"), F.max(v).cast("double").alias("max"))


def by_policy(readings: DataFrame, policies: DataFrame, value: Column | str = "value") -> DataFrame:
    """kind, day, value, min, max, source, by each kind's policy; policies: kind, policy.

    All policies come from two aggregations: totals, extremes and the latest instant of each source's day, then the pick by day.
    Policies are few and go to every task: readings are not dealt by kind, of which there are only some.
    """
    v = F.col(value) if isinstance(value, str) else value
    r = readings.join(F.broadcast(policies.select("kind", "policy")), "kind")
    # the latest reading of a source; of those at one instant any, the name is the same
    per = r.groupBy("kind", "policy", "day", "source").agg(F.sum(v).alias("total"), F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.max("instant").alias("last"))
    name = F.coalesce("source", F.lit(UNATTRIBUTED))
    # at one instant: named before unnamed, then the least name
    latest = F.min_by("source", F.struct((-F.unix_micros("last")).alias("t"), F.col("source").isNull(), "source"))
    day = per.groupBy("kind", "policy", "day").agg(
        F.max("total").alias("best"), F.min_by(name, F.struct(-F.col("total"), name)).alias("winner"), (F.sum("total").cast("double") / F.sum("n")).alias("mean"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), latest.alias("latest")
    )
    p = F.col("policy")
    return day.select(
        "kind", "day",
        F.when(p == V.SUM, F.col("best").cast("double")).when(p == V.MAX, F.col("hi").cast("double")).otherwise(F.col("mean").cast("double")).alias("value"),
        F.when(p == V.SPREAD, F.col("lo").cast("double")).alias("min"), F.when(p == V.SPREAD, F.col("hi").cast("double")).alias("max"),
        F.when(p == V.SUM, F.nullif("winner", F.lit(UNATTRIBUTED))).otherwise(F.col("latest")).alias("source"),
    )


def admitted(rolled: DataFrame, dims: DataFrame | None = None) -> DataFrame:
    """Rolled-up rows with refused (why the value may not be stored) and bounds_cleared; refused bounds are null, refused rows stay for the report."""
    r = bounded(rolled, dims=dims).withColumns({"refused": refusal("value"), "_min": refusal("min"), "_max": refusal("max")})
    cleared = F.col("refused").isNull() & (F.col("_min").isNotNull() | F.col("_max").isNotNull())
    r = r.withColumns({"min": F.when(F.col("_min").isNull(), F.col("min")), "max": F.when(F.col("_max").isNull(), F.col("max")), "bounds_cleared": cleared})
    return r.drop("_min", "_max", "_low", "_open", "_high")


def multi_source_ratio(readings: DataFrame, value: Column | str = "value") -> DataFrame:
    """kind, days, mean_ratio, max_ratio: how much days of several sources would be overstated by adding them up."""
    day = source_totals(readings, value).groupBy("kind", "day").agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("all"), F.max("total").alias("best")).where("n > 1 and best > 0")
    ratio = F.col("all").cast("double") / F.col("best").cast("double")
    return day.groupBy("kind").agg(F.count(F.lit(1)).alias("days"), F.avg(ratio).alias("mean_ratio"), F.max(ratio).alias("max_ratio"))


def value_span(rolled: DataFrame) -> DataFrame:
    return rolled.groupBy("kind").agg(F.count(F.lit(1)).alias("days"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))


def first_rows(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], n: int) -> DataFrame:
    """The n first rows of each key by order. Each task keeps n of a key at most before the shuffle."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def first_dates(rows: DataFrame, n: int = 5) -> DataFrame:
    """kind, rows, first_days: the n earliest days of each kind and the number of all its rows; no kind's days are gathered whole."""
    days = first_rows(rows.select("kind", "day"), ("kind",), ("day",), n).groupBy("kind").agg(F.array_sort(F.collect_list("day")).alias("first_days"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("rows")).join(days, "kind")
