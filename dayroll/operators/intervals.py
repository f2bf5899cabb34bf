"""Unions of half-open intervals of seconds: touching ones merge, empty and inverted ones don't count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as V
from .rollup import latest_source

#: Seconds of the first pieces that intervals are merged in.
PIECE = 3600
#: So many disjoint pieces in one night are reported.
DEGENERATE = 1000


def islands(rows: DataFrame, keys: tuple[str, ...], from_s: str = "from_s", to_s: str = "to_s") -> DataFrame:
    """keys, from_s, to_s of the merged intervals of each key. Those that begin in one PIECE of a key's time merge first, so
    that a key with many overlapping intervals comes to its last task as a few for each piece."""
    r = rows.where(F.col(to_s) > F.col(from_s)).select(*keys, F.col(from_s).alias("from_s"), F.col(to_s).alias("to_s"))
    return _merged(_merged(r.withColumn("_piece", F.floor(F.col("from_s") / PIECE)), (*keys, "_piece")).drop("_piece"), keys)


def _merged(r: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("from_s", "to_s")
    r = r.withColumn("_reach", F.max("to_s").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    r = r.withColumn("_island", F.count(F.when(F.col("_reach").isNull() | (F.col("from_s") > F.col("_reach")), 1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(*keys, "_island").agg(F.min("from_s").alias("from_s"), F.max("to_s").alias("to_s")).drop("_island")


def pieces(rows: DataFrame, keys: tuple[str, ...], from_s: str = "from_s", to_s: str = "to_s") -> DataFrame:
    """keys, begins, ends: the merged intervals of each key as two arrays in order, to be kept and extended()."""
    p = islands(rows, keys, from_s, to_s).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("from_s").cast("long").alias("from_s"), F.col("to_s").cast("long").alias("to_s")))).alias("_p"))
    return p.select(*keys, F.col("_p.from_s").alias("begins"), F.col("_p.to_s").alias("ends"))


def extended(kept: DataFrame, rows: DataFrame, keys: tuple[str, ...], from_s: str = "from_s", to_s: str = "to_s") -> DataFrame:
    """kept (what pieces() gave) with further intervals: whatever is split into whatever parts, in any order, gives the same pieces.
    Keys that rows do not name are as they were."""
    new = pieces(rows, keys, from_s, to_s).withColumnsRenamed({"begins": "_begins", "ends": "_ends"})
    both = kept.join(new, list(keys), "full_outer")
    none = "CAST(array() AS array<bigint>)"
    pair = lambda b, e: f"arrays_zip(coalesce({b}, {none}), coalesce({e}, {none}))"
    # both are in order and disjoint in themselves: one walk over all of them, in order, joins each to the last or leaves it apart
    walked = F.expr(f"""aggregate(transform(array_sort(concat(transform({pair("begins", "ends")}, x -> struct(x['0'] AS f, x['1'] AS t)), transform({pair("_begins", "_ends")}, x -> struct(x['0'] AS f, x['1'] AS t)))), x -> x),
        CAST(array() AS array<struct<f: bigint, t: bigint>>),
        (done, x) -> CASE WHEN size(done) > 0 AND x.f <= element_at(done, -1).t
            THEN concat(slice(done, 1, size(done) - 1), array(struct(element_at(done, -1).f AS f, greatest(element_at(done, -1).t, x.t) AS t)))
            ELSE concat(done, array(x)) END)""")
    same = F.col("_begins").isNull()
    out = both.withColumn("_w", F.when(~same, walked))
    return out.select(*keys, F.when(same, F.col("begins")).otherwise(F.col("_w.f")).alias("begins"), F.when(same, F.col("ends")).otherwise(F.col("_w.t")).alias("ends"))


def hours_of(kept: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, hours, pieces of what pieces() or extended() gave."""
    seconds = F.expr("aggregate(zip_with(begins, ends, (b, e) -> e - b), 0L, (s, x) -> s + x)")
    return kept.select(*keys, (seconds / 3600.0).alias("hours"), F.size("begins").cast("long").alias("pieces"))


def union_hours(rows: DataFrame, keys: tuple[str, ...], from_s: str = "from_s", to_s: str = "to_s") -> DataFrame:
    """keys, hours, pieces."""
    return islands(rows, keys, from_s, to_s).groupBy(*keys).agg((F.sum(F.col("to_s") - F.col("from_s")) / 3600.0).alias("hours"), F.count(F.lit(1)).alias("pieces"))


def stage_rows(segments: DataFrame, stage: str = "stage_kind", asleep: str = "asleep", total: str = "sleep-total") -> DataFrame:
    """One row for a segment's stage, and one more under the total if it counts as sleep."""
    kinds = F.filter(F.array(F.col(stage), F.when(F.col(asleep), F.lit(total))), lambda k: k.isNotNull())
    return segments.withColumn("kind", F.explode(kinds))


def nights(segments: DataFrame) -> DataFrame:
    """Segments (stage_kind, asleep, day, instant, from_s, to_s, source) as rolled-up rows: kind, day, value (hours), min, max, source, pieces."""
    rows = stage_rows(segments)
    hours = union_hours(rows, ("kind", "day"))
    none = F.lit(None).cast("double")
    return hours.join(latest_source(rows), ["kind", "day"]).select("kind", "day", F.col("hours").alias("value"), none.alias("min"), none.alias("max"), "source", "pieces")


def degenerate(hours: DataFrame) -> DataFrame:
    return hours.where(F.col("pieces") >= DEGENERATE)


UNION_KINDS = tuple(m[0] for m in V.METRICS if m[2] == V.UNION)
