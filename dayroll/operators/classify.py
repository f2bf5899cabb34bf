"""Routing of readings: which are kept, which are refused and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.scalars import finite, folded_unit, instant, local_day, local_time, number


def classified(rows: DataFrame, producer: str, name: str = "name") -> DataFrame:
    """rows with class (curated, sleep, excluded, unknown) and kind, by a broadcast join with the vocabulary."""
    known = V.names(rows.sparkSession, producer).withColumnRenamed("name", "_name")
    return rows.join(F.broadcast(known), rows[name] == F.col("_name"), "left").withColumn("class", F.coalesce("class", F.lit("unknown"))).drop("_name")


def converted(rows: DataFrame, producer: str, value: str = "value", unit: str = "unit", kind: str = "kind", out: str = "canonical", more: dict[str, str] | None = None) -> DataFrame:
    """rows with the value in the kind's canonical unit; null if the unit is unknown or of another dimension. more: further
    values in the same unit, and the columns for them."""
    c = V.conversions(rows.sparkSession, producer).withColumnsRenamed({"kind": "_kind", "from_si": "_from", "to_si": "_to", "scale": "_scale"})
    joined = rows.join(F.broadcast(c), (folded_unit(rows[unit]) == F.col("spelling")) & (rows[kind] == F.col("_kind")), "left")
    same = (F.col("_from") == F.col("_to")) & (F.col("_from") == 1.0)
    new = {o: F.when(same, rows[v] * F.col("_scale")).otherwise(rows[v] * F.col("_from") / F.col("_to")) for v, o in ({value: out} | (more or {})).items()}
    return joined.withColumns(new).drop("spelling", "_kind", "_from", "_to", "_scale")


def bounded(rows: DataFrame, kind: str = "kind", dims: DataFrame | None = None) -> DataFrame:
    """rows with the kind's bounds as _low, _open, _high; dims (kind, low, low_open, high) stands in for the vocabulary, which alone is small for sure."""
    m = (V.metrics(rows.sparkSession) if dims is None else dims).select(F.col("kind").alias("_k"), F.col("low").alias("_low"), F.col("low_open").alias("_open"), F.col("high").alias("_high"))
    return rows.join(F.broadcast(m) if dims is None else m, rows[kind] == F.col("_k"), "left").drop("_k")


def refusal(value: Column | str) -> Column:
    """Why a value may not be stored, null if it may; needs the columns of bounded(). Not a number comes first: it sorts above all bounds."""
    v = F.col(value) if isinstance(value, str) else value
    admitted = ((v > F.col("_low")) | (~F.col("_open") & (v == F.col("_low")))) & (v <= F.col("_high"))
    return F.when(v.isNull() | F.col("_high").isNull(), None).when(~finite(v), V.NON_FINITE).when(~admitted, V.IMPLAUSIBLE)


def routed_records(raw: DataFrame) -> DataFrame:
    """Raw export records (type, unit, value, start, end, source, ordinal) with their outcome.

    outcome is skipped, excluded, a refusal's reason, or folded; folded quantities carry kind, canonical, day; folded sleep
    segments carry stage_kind, asleep, night, from_s and to_s. One pass over the records; the vocabularies are broadcast.
    """
    r = raw.withColumns({"name": F.col("type"), "instant": instant("start"), "local": local_time("start")})
    r = classified(r, "export").withColumn("number", number("value"))
    r = bounded(converted(r, "export", "number"))
    r = r.join(F.broadcast(V.stages(raw.sparkSession)), F.col("value") == F.col("stage"), "left")
    r = r.withColumns({"end_instant": instant("end"), "refused": refusal("canonical")})
    from_s, to_s = F.unix_seconds("instant"), F.unix_seconds("end_instant")
    quantity = (
        F.when(F.col("number").isNull() | ~finite("number"), "skipped")
        .when(F.col("unit").isNull(), V.MISSING_UNIT)
        .when(F.col("canonical").isNull(), V.UNCONVERTIBLE)
        .when(F.col("refused").isNotNull(), F.col("refused"))
        .otherwise("folded")
    )
    sleep = F.when(F.col("value").isNull(), "skipped").when(F.col("stage").isNull(), V.UNKNOWN_STAGE).when(F.col("end_instant").isNull() | (to_s <= from_s), "skipped").otherwise("folded")
    outcome = (
        F.when(F.col("type").isNull() | F.col("instant").isNull(), "skipped")
        .when(F.col("class") == "excluded", "excluded")
        .when(F.col("class") == "unknown", V.UNKNOWN_TYPE)
        .when(F.col("class") == "sleep", sleep)
        .otherwise(quantity)
    )
    return r.withColumns({"outcome": outcome, "day": local_day("local"), "from_s": from_s, "to_s": to_s})
