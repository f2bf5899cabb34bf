"""The JSON push: one payload a line or file, {data: {metrics: [{name, units, data: [point]}]}}."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.scalars import json_number, json_text, local_day, local_time

ENVELOPE = "struct<data: struct<metrics: array<struct<name: string, units: string, data: array<string>>>>>"


def points(payloads: DataFrame, body: str = "value", batch: str | None = None) -> DataFrame:
    """One row for each point: pos (batch, metric, point), name, units, point (its JSON), day (null if undated), source and v (its variant). Metrics without points give none."""
    order = F.col(batch) if batch else F.lit(0)
    e = payloads.select(order.alias("_batch"), F.from_json(body, ENVELOPE).alias("e"))
    m = e.select("_batch", F.posexplode("e.data.metrics").alias("_m", "m"))
    p = m.select("_batch", "_m", "m.name", "m.units", F.posexplode("m.data").alias("_p", "point"))
    p = p.withColumn("v", F.try_parse_json("point"))
    stamp = json_text(F.col("v"), "date")
    return p.select(F.struct("_batch", "_m", "_p").alias("pos"), "name", "units", "point", local_day(local_time(stamp)).alias("day"), F.nullif(json_text(F.col("v"), "source"), F.lit("")).alias("source"), "v")


def shaped(rows: DataFrame) -> DataFrame:
    """rows with value, min, max: a quantity stands alone, else an average may have bounds."""
    v = F.col("v")
    qty, avg = json_number(v, "qty"), json_number(v, "Avg")
    bound = lambda f: F.when(qty.isNull() & avg.isNotNull(), json_number(v, f))
    return rows.withColumns({"value": F.coalesce(qty, avg), "min": bound("Min"), "max": bound("Max")})


def stages(v: Column) -> Column:
    """An array of the stages that a night has hours for: stage_pos, kind, value."""
    each = [F.struct(F.lit(i).alias("stage_pos"), F.lit(k).alias("kind"), json_number(v, f).alias("value")) for i, (f, k) in enumerate(V.NIGHT_FIELDS)]
    return F.filter(F.array(*each), lambda s: s["value"].isNotNull())


def night_rows(rows: DataFrame) -> DataFrame:
    """One row for each stage that a night has hours for: stage_pos, kind, value."""
    return rows.withColumn("_s", F.explode(stages(F.col("v")))).select("*", "_s.*").drop("_s")


def measured(rows: DataFrame, others: bool = False) -> DataFrame:
    """One row for each value of a point: stage_pos, kind, value, min, max. A night (class sleep) has one for each of its
    stages, without bounds, any other point one if it has a value. With others, undated points, those of no known kind and
    those without a value have a row too, without value, and first marks one row of each point."""
    q = shaped(rows)
    whole = F.struct(F.lit(0).alias("stage_pos"), "kind", "value", "min", "max")
    none = F.lit(None).cast("double")
    night = F.transform(stages(F.col("v")), lambda s: F.struct(s["stage_pos"].alias("stage_pos"), s["kind"].alias("kind"), s["value"].alias("value"), none.alias("min"), none.alias("max")))
    own = F.when(F.col("class") == "sleep", night).when(F.col("value").isNotNull(), F.array(whole))
    if others:
        own = F.when(F.col("day").isNotNull() & F.col("class").isin("curated", "sleep"), own)
        return q.withColumn("has_value", F.col("value").isNotNull()).select("*", F.posexplode_outer(own).alias("_i", "_s")).drop("kind", "value", "min", "max").select("*", "_s.*", (F.coalesce("_i", F.lit(0)) == 0).alias("first")).drop("_s", "_i")
    return q.withColumn("_s", F.explode(own)).drop("kind", "value", "min", "max").select("*", "_s.*").drop("_s")
