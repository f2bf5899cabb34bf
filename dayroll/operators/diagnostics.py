"""What an import says about itself: overlap, refusals, counts, the day-shift check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Nights needed for a verdict, the share of exact matches that means reading one's own rows, and what a shift must better.
NIGHTS, OWN, RATIO, HOURS = 14, 0.5, 0.5, 0.25


def overlap(pairs: DataFrame) -> DataFrame:
    """Of overwritten rows (kind, day, old_value, new_value): kind, days, mean_diff, max_diff, max_day (the earliest of equals)."""
    d = pairs.withColumn("_d", F.abs(F.col("new_value") - F.col("old_value")))
    return d.groupBy("kind").agg(F.count(F.lit(1)).alias("days"), F.avg("_d").alias("mean_diff"), F.max("_d").alias("max_diff"), F.min_by("day", F.struct(-F.col("_d"), "day")).alias("max_day"))


def tally(refused: DataFrame) -> DataFrame:
    """kind, n, sample_value, sample_day (the earliest, then the least value)."""
    return refused.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("day", "value")).alias("s")).select("kind", "n", F.col("s.value").alias("sample_value"), F.col("s.day").alias("sample_day"))


def refusals(records: DataFrame, rows: DataFrame, cleared: DataFrame) -> DataFrame:
    """kind, records, rows, bounds_cleared, sample_value, sample_day over refused readings and refused roll-ups; a reading's sample comes first."""
    r, o = tally(records).toDF("kind", "records", "rv", "rd"), tally(rows).toDF("kind", "rows", "ov", "od")
    c = cleared.groupBy("kind").agg(F.count(F.lit(1)).alias("bounds_cleared"))
    j = r.join(o, "kind", "full_outer").join(c, "kind", "full_outer")
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return j.select("kind", zero("records"), zero("rows"), zero("bounds_cleared"), F.coalesce("rv", "ov").alias("sample_value"), F.coalesce("rd", "od").alias("sample_day"))


def one_per_name(refused: DataFrame, *order: str) -> DataFrame:
    """name, n and the first record of each name refused."""
    rest = [c for c in refused.columns if c != "name"]
    return refused.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select("name", "n", *[F.col(f"r.{c}").alias(c) for c in rest])


def survey(rows: DataFrame, day: str = "day") -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def day_shift(new: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: nights compared, mean differences from the stored night before, on and after, exact matches of each. new, stored: day, value."""
    s = lambda k, n: stored.select(F.date_sub("day", k).alias("day"), F.col("value").alias(n))
    j = new.join(s(-1, "b"), "day").join(s(0, "o"), "day").join(s(1, "a"), "day")
    diff = lambda n: F.abs(F.col("value") - F.col(n))
    means = [F.avg(diff(n)).alias(f"{w}_day") for n, w in (("b", "prev"), ("o", "same"), ("a", "next"))]
    exact = [F.count_if(diff(n) == 0).alias(f"{w}_exact") for n, w in (("b", "prev"), ("o", "same"), ("a", "next"))]
    return j.agg(F.count(F.lit(1)).alias("compared_days"), *means, *exact)


def day_shift_verdict(shift: DataFrame) -> DataFrame:
    """day_shift() with best_offset and verdict: no-comparable-rows, self-comparison, unverified, agrees, mismatch."""
    p, s, n = F.col("prev_day"), F.col("same_day"), F.col("next_day")
    best = F.when((s <= p) & (s <= n), 0).when(p <= n, -1).otherwise(1)
    least = F.least(p, s, n)
    exact = F.when(F.col("_b") == 0, F.col("same_exact")).when(F.col("_b") == -1, F.col("prev_exact")).otherwise(F.col("next_exact"))
    days = F.col("compared_days")
    verdict = (
        F.when(days == 0, "no-comparable-rows")
        .when(exact > days * OWN, "self-comparison")
        .when(days < NIGHTS, "unverified")
        .when(F.col("_b") == 0, "agrees")
        .when((least < s * RATIO) & (s - least >= HOURS), "mismatch")
        .otherwise("agrees")
    )
    out = shift.withColumn("_b", best).withColumn("verdict", verdict)
    return out.withColumn("best_offset", F.when(~F.col("verdict").isin("no-comparable-rows", "self-comparison"), F.col("_b"))).drop("_b")
